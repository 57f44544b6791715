from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

import brute
from lattice.llm import minhash


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 40)) for _ in range(n))


brute_jaccard = brute.jaccard


def test_jaccard_and_estimate():
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 30, 400):
        a = words(rng, n)
        b = a.upper() if n % 2 else a + " " + words(rng, n // 4)
        assert minhash.jaccard(a, b) == pytest.approx(brute_jaccard(a, b))
        assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - brute_jaccard(a, b)) < 0.25
    assert minhash.jaccard(None, " ") == 1 and minhash.as_text(minhash.signature(None)) == "f" * 512


def brute_signature(text):
    """The rule in plain integers: polynomial word hashes, shingles of five, the least of each member of the family."""
    whole, table = 2**64 - 1, [int(x) for x in minhash._BYTES]

    def word(w):
        h = (sum(table[b] * pow(minhash._BASE, k, 2**64) for k, b in enumerate(w.encode())) + len(w.encode())) & whole
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & whole
        return h ^ h >> 29

    own = [word(w) for w in brute.spaced(brute.lowered(text))]
    if not own:
        return [2**32 - 1] * minhash.SLOTS
    own += [0] * (minhash.SHINGLE - len(own))
    grams = []
    for k in range(len(own) - minhash.SHINGLE + 1):
        x = sum(h * int(m) for h, m in zip(own[k:], minhash._MIX, strict=False)) & whole
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & whole
        grams.append(x ^ x >> 29)
    return [min((int(a) * x + int(b)) & whole for x in grams) >> 32 for a, b in zip(minhash._A, minhash._B, strict=True)]


def as_hex(sig):
    return "".join(f"{x:08x}" for x in sig)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 47, 150])
def test_edits_follow_the_rule(spark, n):
    rng = random.Random(n)
    rows = [(rng.randint(0, 30) if k % 7 else rng.choice([None, 2**62 + k]), rng.choice([None, "", "é" * k, words(rng, k)])) for k in range(n)]
    if n == 3:
        rows = [(1, "same text"), (1, "same text"), (1, "other")]
    if n == 150:  # two ids hold nearly all rows
        rows = [(None if k % 3 else 5 if k % 2 else k, words(rng, k % 20)) for k in range(n)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, fingerprint int").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in minhash.fingerprint_edits(df).collect())
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, ((xxhash.xxh64_intdigest(r[1].encode(), 42) + 2**63) % 2**64) >> 12))
    want = []
    for k, (d, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        own, changed, other = (brute_signature(x) for x in (t, edited, nxt))
        like = lambda x: sum(p == q for p, q in zip(own, x, strict=True)) / len(own)
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex(own), as_hex(changed), like(changed), like(other)))
    assert got == sorted(want)


def brute_groups(texts):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if brute_jaccard(texts[i], texts[j]) >= 0.8:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def family(rng, n, size, edits):
    """``n`` different texts, each a copy of one text with up to ``edits`` changed words."""
    base, out = words(rng, size).split(), []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"new{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_near_duplicates_match_brute_force(spark, monkeypatch, hot):
    """The same groups whether buckets are searched in memory or in rounds."""
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(5)
    texts = [words(rng, 40) for _ in range(12)]
    texts += [t for k in range(12) for t in family(rng, 4, 40, 1)] + family(rng, 25, 60, 2)
    texts += [texts[0], None, "  ", "a b", "A  b", "a b c"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute_groups(texts)))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bucket_search_connects_what_is_similar():
    rng = random.Random(8)
    for _ in range(30):
        texts = [t for _ in range(rng.randint(1, 3)) for t in family(rng, rng.randint(1, 12), rng.randint(5, 50), rng.randint(0, 4))]
        texts = list(dict.fromkeys(texts))
        want = brute_groups(texts)
        found = minhash.bucket_links(np.arange(len(texts)), [np.unique(minhash.shingles(t)) for t in texts], 0.8)
        assert len(found) == len(texts) - len(set(want))  # a spanning tree of each group
        label = list(range(len(texts)))
        for i, j in found:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
        assert label == want


def test_bands_reach_the_recall():
    for similar, recall in ((0.8, 0.99), (0.8, 0.9), (0.5, 0.95)):
        bands, width = minhash.banding(similar=similar, recall=recall)
        assert bands * width <= minhash.SLOTS and 1 - (1 - similar**width) ** bands >= recall
    rng = random.Random(3)
    bands, width = minhash.banding()
    met = near = 0
    for _ in range(40):
        family_ = family(rng, 8, 60, 2)
        sig = minhash.signatures(family_)
        for i in range(8):
            for j in range(i):
                if brute_jaccard(family_[i], family_[j]) >= 0.8 and family_[i] != family_[j]:
                    near += 1
                    met += any((sig[i, k * width : (k + 1) * width] == sig[j, k * width : (k + 1) * width]).all() for k in range(bands))
    assert near > 100 and met >= 0.97 * near


def test_long_texts_hash_alike_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["Äö", "word", "x" * rng.randint(1, 90), "\t\n", "A"]) for _ in range(5000))
    whole = minhash.shingles(text)
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert (minhash.shingles(text) == whole).all() and (minhash.shingles(text.swapcase().replace("äÖ", "Äö")) == whole).all()


def test_signatures_of_many_texts():
    texts = ["", None, " ", "a", "a b c", "x " * 3000, "q w e r t y", "é É A", *(" ".join(f"w{i * k % 97}" for i in range(40)) for k in range(300)), "z " * (minhash.BLOCK + 9)]
    assert (minhash.signatures(texts) == [minhash.signature(t) for t in texts]).all()
    assert minhash.signatures([]).shape == (0, minhash.SLOTS)
    x, sizes = minhash.shingled(texts)
    assert len(x) == sizes.sum() and sizes[:5].tolist() == [0, 0, 0, 1, 1]
