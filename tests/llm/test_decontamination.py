from __future__ import annotations

import random

import pytest

import brute
from lattice.llm import decontamination as dec

VOCAB = ["the", "of", "Été", "x1", "ñ", "And", "zzz", "42", "q"]


def text(rng, n):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", ", ", "-", "\n", "..."]) for _ in range(n))


@pytest.mark.parametrize("marks,broadcast", [(1 << 18, True), (1, False)])
def test_matches_brute_force(spark, monkeypatch, marks, broadcast):
    """The same rows whatever the bounds: with one slot every text is shuffled, without broadcasts every join is."""
    monkeypatch.setattr(dec, "MARKS", marks)
    if not broadcast:
        monkeypatch.setattr(dec, "small", lambda df: df)
    rng = random.Random(4)
    items = [(k, text(rng, rng.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(10)] + [(3, "another the q zzz"), (None, "the"), (50, None), (51, " ;! "), (52, "the")]
    docs = []
    for _k in range(60):
        t = text(rng, rng.randint(0, 40))
        if rng.random() < 0.6:
            t += rng.choice(items[:10])[1].upper() + text(rng, rng.randint(0, 30))
        docs.append(t)
    docs += [None, "", items[6][1], items[6][1], text(rng, 20_000) + items[9][1]]
    ids = [rng.choice([None, 1, 2]) if k % 9 == 0 else 100 + k for k in range(len(docs))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, docs, strict=True)], "doc_id long, text string, item_id string, start int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["row"]["doc_id"], r["row"]["text"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in dec.judge(df, bench).collect()), key=str)
    assert got == sorted(((i, t, *w) for i, t, w in zip(ids, docs, brute.decontaminate(docs, items), strict=True)), key=str)
    assert dec.judge(df.limit(0), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in dec.judge(df, bench.limit(0)).collect())


def test_near_matches(spark):
    words = [f"w{k}" for k in range(13)]
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    docs = spark.createDataFrame([(1, "a b c " + " ".join(shuffled)), (2, " ".join(words[:12])), (3, " filler ".join(words) + " filler" * 40)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {r["doc_id"] for r in dec.near_matches(docs, bench, span=32).collect()} == {1, 3}


def test_near_matches_wherever_they_start(spark):
    """Every place where all terms of a window stand within the span, against a plain scan."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5)]
    docs = []
    for k in range(60):
        body = [f"x{k}" for _ in range(rng.randint(0, 40))]
        for w in words[: rng.choice([4, 5, 5, 5])]:
            body.insert(rng.randint(max(0, len(body) - 12), len(body)), w)
        docs.append((k, " ".join(body)))
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["start"] for r in dec.near_matches(spark.createDataFrame(docs, "doc_id long, text string"), bench, span=10).collect()}
    want = {}
    for k, t in docs:
        w = t.split()
        for p in range(len(w)):
            if w[p] in words and set(words) <= set(w[p : p + 10]):
                want[k] = p
                break
    assert got == want and 5 < len(want) < 55


def test_stored_index_has_all_postings(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["pos"], r["term"]) for r in dec.build_index(docs).collect()) == [(1, 0, "b"), (1, 1, "a"), (1, 2, "b")]


def test_rows_that_share_an_item_id(spark):
    one, other = (" ".join(f"{c}{k}" for k in range(13)) for c in "ab")
    items = [(1, one), (1, one), (2, one), (2, other), (3, one + " " + other), (3, other + " " + one)]
    texts = ["x " + one + " y", "x y " + other, one + " " + other, "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (items[:2], items[2:4], items[4:], items):
        got = sorted((r["row"]["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in dec.judge(docs, spark.createDataFrame(some, "item_id long, text string")).collect())
        assert got == [(k, *w) for k, w in enumerate(brute.decontaminate(texts, some))]
    near = dec.near_matches(docs, spark.createDataFrame(items[:4], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in near.collect()} == {(0, "1"), (0, "2"), (1, "2"), (2, "1"), (2, "2")}
