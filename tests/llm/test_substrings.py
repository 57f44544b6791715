from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lattice.llm import substrings, suffixes


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))


@pytest.mark.parametrize("bucket", [1 << 19, 50])
def test_equal_prefixes(monkeypatch, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    rng = random.Random(bucket)
    for _ in range(40):
        part = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120)))
        text = b"".join(rng.choice([part, part[::-1], b"a" * rng.randint(0, 150), bytes([rng.randrange(256)])]) for _ in range(6)) + b"z" * 50
        starts = np.array(sorted(rng.sample(range(len(text) - 49), min(200, len(text) - 49))), np.int64)
        at, group = suffixes.equal_prefixes(text, starts)
        assert sorted(at.tolist()) == starts.tolist()
        pieces = [text[i : i + 50] for i in at.tolist()]
        assert pieces == sorted(pieces)
        for k in range(1, len(pieces)):
            assert (group[k] == group[k - 1]) == (pieces[k] == pieces[k - 1])
        assert len(set(pieces)) == group[-1] + 1


def test_a_unit_sends_both_ends_of_a_name():
    """Of a name that repeats in a unit the least and the greatest ord go out, so a row elsewhere with either of them is told."""
    text = bytes(random.Random(5).randrange(256) for _ in range(300))
    rows = [(0, 9, 1, text), (1, 3, 2, text), (2, substrings.NO_ID, 3, text), (3, 5, 4, text)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "ord", "key", "body"])
    seen = {}
    for out in substrings._ask(4)(iter([batch])):
        for r in out.to_pylist():
            if r["kind"] == 0:
                names, ords, *_ = substrings._unpack(r["body"])
                for n, o in zip(names.tolist(), ords.tolist(), strict=True):
                    seen.setdefault(n, set()).add(o)
    assert seen and all(v == {3, substrings.NO_ID} for v in seen.values())


def brute(docs):
    """Rows (doc_id, text) to the results of the contract."""
    least = {}
    rows = [(substrings.NO_ID if d is None else d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for (d, b), (raw, _) in zip(rows, docs, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((raw, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(rng, n):
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choices(words, k=rng.randint(1, 40))), "x" * rng.randint(0, 130), "ab" * rng.randint(0, 60)]) for _ in range(rng.randint(0, 5))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed,unit", [(1, 24 << 20), (2, 500)])
def test_matches_brute_force(spark, monkeypatch, seed, unit):
    monkeypatch.setattr(substrings, "UNIT", unit)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1 << 24 if seed == 1 else 512)
    rng = random.Random(seed)
    body = texts(rng, 60)
    body.append(" ".join(body[:8]) * 40)  # a long text
    docs = [(rng.randint(0, 200), t) for t in body] + [(None, body[3]), (None, None), (7, None), (8, ""), (500, body[4]), (500, body[4]), (500, body[5] + body[4]), (-3, body[6])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, key string").repartition(6)
    got = sorted((tuple(r)[:5] for r in substrings.deduplicate(df).collect()), key=str)
    assert got == brute(docs)


def test_kept_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 30 + "b" * 30), (2, "b" * 10 + "a" * 30 + "b" * 30 + "tail")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substrings.deduplicate(df, with_text=True).collect()}
    assert kept == {1: b"a" * 30 + b"b" * 30, 2: b"b" * 10 + b"tail"}
    assert substrings.deduplicate(df.limit(0)).count() == 0
