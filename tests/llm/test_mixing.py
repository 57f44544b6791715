from __future__ import annotations

import random
from collections import Counter

import pytest

import brute
from lattice.llm import mixing


def docs_of(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "É", None, "zz"])
        out.append((rng.choice([None, k, k, k]), rng.choice([None, "", "w " * rng.randint(1, 60)]), source))
    return out


@pytest.mark.parametrize("seed,n", [(1, 0), (2, 1), (3, 30), (4, 400)])
def test_matches_repeated_sharing(spark, seed, n):
    docs = docs_of(seed, n)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    got = mixing.mix(df.drop("size")).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    tidy = lambda rows: sorted(((str(r[0]), r[1], r[2], round(r[3], 4), r[4]) for r in rows))
    assert tidy(got) == tidy(brute.mix(docs))
    took, aim = Counter(), {}
    for r in got:
        took[r["source"]] += r["taken"]
        aim[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(took[s] - aim[s]) <= 60 for s in aim)
    drawn = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(df).collect())
    assert sum(len(brute.spaced(k[1])) * v for k, v in drawn.items()) == sum(took.values())


def test_splitting_tree_keeps_every_quota():
    quotas = [1000, 3, 0, 77, 512]
    dealt = mixing.split_quotas(quotas, 16)
    assert [sum(r) for r in dealt] == quotas and dealt == mixing.split_quotas(quotas, 16)
    totals = [sum(c) for c in zip(*dealt, strict=True)]
    assert max(totals) - min(totals) <= 1
    # Shares follow the multivariate hypergeometric mean over many seeds.
    mean = sum(mixing.split_quotas([100, 300], 4, seed)[0][0] for seed in range(400)) / 400
    assert abs(mean - 25) < 1.5


def test_draws_are_disjoint(spark):
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), "ab"[k % 5 == 0]) for k in range(300)], "doc_id long, text string, source string")
    rows = mixing.mixed(df, shards=5).collect()
    assert len({(r["doc_id"], r["epoch"]) for r in rows}) == len(rows) and {r["shard"] for r in rows} == set(range(5))


def test_shards_follow_the_tree_and_are_shuffled(spark):
    """What each shard holds of each source is what the tree gave it, and files hold stretches of one shard in the order of place."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "c", None])) for k in range(900)], "doc_id long, text string, source string")
    sized, cells = mixing.plan(docs, 8)
    instances = cells.select("source", mixing.F.explode(mixing.F.concat("takes", mixing.F.filter(mixing.F.array("part"), lambda x: x.isNotNull()))).alias("x")).select("source", "x.shard")
    by_source = {}
    for r in instances.collect():
        by_source.setdefault(r["source"], [0] * 8)[r["shard"]] += 1
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = mixing.split_quotas([sum(by_source[s]) for s in names], 8)
    assert [by_source[s] for s in names] == want
    totals = [sum(col) for col in zip(*want, strict=True)]
    assert max(totals) - min(totals) <= 1
    plain, out = mixing.mixed(docs, 8), mixing.shuffled(docs, 8)
    key = lambda df: sorted((r["doc_id"], r["epoch"], r["shard"], r["place"]) for r in df.collect())
    assert key(out) == key(plain)
    rows = out.select(mixing.F.spark_partition_id().alias("p"), mixing.F.monotonically_increasing_id().alias("n"), "shard", "place", "doc_id").orderBy("n").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a["p"] != b["p"] or (a["shard"], a["place"]) <= (b["shard"], b["place"])
    first = [r["doc_id"] for r in rows if r["shard"] == 0]
    assert first != sorted(first)
