from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lattice.llm import simhash
from lattice.llm.components import components


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint_matches_the_rule():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "É È a B", "a b c d", "Straße\x0bx y  Z\r\nq"] + [" ".join(rng.choices(["the", "Of", "ÀB", "x1", "zz"], k=k)) for k in range(1, 60)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) % 2**64 == brute_fp(t), t


@pytest.mark.parametrize("n", [1, 5_000, 3_000_000, 10**9])
def test_close_pairs_agree_under_a_mask(n):
    rng = random.Random(n)
    masks = simhash.block_masks(n)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a ^ b) & m % 2**64 == 0 for m in masks)


def family(rng, size):
    """Fingerprints a few bits from each other, in chains, among random ones."""
    out = [rng.getrandbits(64) for _ in range(size)]
    for _ in range(size):
        x = rng.choice(out)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        out.append(x)
    return sorted(set(out))


def signed(x):
    return x - 2**64 if x >> 63 else x


def roots(spark, links, fps):
    found = {r["id"] % 2**64: r["component"] % 2**64 for r in components(links).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(found.get(x, x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("hot", [50_000, 20])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, hot):
    rng = random.Random(7)
    fps = family(rng, 150)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    fps = sorted(set(fps))
    monkeypatch.setattr(simhash, "HOT", hot)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    label = brute_groups(fps)
    want = {}
    for x, k in zip(fps, label, strict=True):
        want.setdefault(k, set()).add(x)
    assert roots(spark, simhash.links(df), fps) == sorted(map(sorted, want.values()))
    assert roots(spark, simhash._through_neighbours(df), fps) == sorted(map(sorted, want.values()))


def test_hot_bucket_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "HOT", 10)
    rows = [(0, 1, f) for f in range(25)] + [(0, 2, 7), (0, 2, 6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 6]], pa.int64()) for k in range(3)], ["mask", "key", "fp"]) for i in range(0, len(rows), 6)]
    out = [r for b in simhash._search(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["u"] for r in out if r["v"] is None) == list(range(25))
    assert [{r["u"], r["v"]} for r in out if r["v"] is not None] == [{6, 7}]


def test_bucket_links_of_a_large_bucket():
    rng = random.Random(3)
    fps = np.array([signed(x) for x in family(rng, 60)], np.int64)
    u, v = simhash.bucket_links(np.zeros(len(fps), np.int64), fps)
    u, v = np.concatenate(u), np.concatenate(v)
    assert len(u) < len(fps) and (np.bitwise_count((u ^ v).view(np.uint64)) <= 4).all()


def test_documents(spark):
    base = " ".join(f"w{k}" for k in range(300))
    docs = [(5, base), (3, base + " tail"), (9, base), (None, base), (1, None), (8, "  "), (2, "something else"), (2, "something else"), (4, "quite other words here")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, fp string, component_id long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in docs]
    label = brute_groups(fps)
    least = {k: min(i for (i, _), x in zip(docs, label, strict=True) if x == k and i is not None) for k in set(label)}
    assert got == sorted(((i, least[k]) for (i, _), k in zip(docs, label, strict=True)), key=str)
    kept = sorted(str(r["doc_id"]) for r in simhash.deduplicated(df).collect())
    assert kept == sorted(map(str, least.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_chain_components(spark):
    n = 200
    chain = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(1000, k) for k in range(500, 600)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(chain).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and all(got[k] == 500 for k in range(500, 600)) and got[1000] == 500


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "s"), (7, a, "t"), (7, b, "t"), (None, a, "u"), (None, c, "u"), (None, c, "v"), (9, c + " ", "w"), (3, b, "x"), (3, b, "x"), (3, b, "y"), (4, None, "z"), (5, "", "z"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, of string").withColumn("key", simhash.F.lit(1)).repartition(4)
    out = simhash.deduplicated(df)
    assert out.columns == ["doc_id", "text", "of", "key"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    # Of rows that share doc_id and text one stays, of shared ids with other texts each is judged by its own.
    assert got == sorted([(1, a), (3, b), (9, c + " "), (4, None)], key=str)
    lone = spark.createDataFrame([(None, a), (None, b), (None, a)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.deduplicated(lone).collect()) == sorted([a, b])
    assert simhash.deduplicated(df.limit(0)).count() == 0
