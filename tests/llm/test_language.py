"""Language ID against a plain version of its rules, on whole small tables and odd rows."""

from __future__ import annotations

import math
import random
import struct
import unicodedata
import zlib

import xxhash
import zstandard

from lattice.llm import language
from lattice.llm.queries import op4_language

SF = "/root/testdata/sf0.001"


def plain(text):
    """Lower-cased stretches of letters (and of marks that words keep), single spaces between."""
    out, word = [], ""
    for c in (text or "") + " ":
        if (c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "N") or (c.isalnum() and c.isalpha()):
            word += c
        elif word:
            out.append(word)
            word = ""
    return " ".join(out).lower()


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def draw(doc_id, text):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    x = xxhash.xxh64_intdigest(text.encode(), seed)
    return x % (1 << 40)


def dictionaries(rows):
    out = {}
    for lang in sorted({r[2] for r in rows if r[2] is not None}):
        first = {draw(d, t): t for d, t, k in rows if k == lang and t is not None and not held(d)}
        texts, size = [], 0
        for _, t in sorted(first.items())[: language.SAMPLE_DOCS]:
            p = plain(t)
            if p and size + len(p.encode()) + 1 <= language.SAMPLE_BYTES:
                texts.append(p)
                size += len(p.encode()) + 1
        if len(" ".join(texts).encode()) >= 8:
            out[lang] = " ".join(texts).encode()
    return out


def judged(text, dicts):
    data = plain(text).encode()
    if not data or not dicts:
        return "und", 0.0, True
    sizes = {}
    for lang, d in dicts.items():
        own = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(coder.compress(data[k : k + 4096])) for k in range(0, len(data), 4096))
    ranked = sorted(sizes.values())
    best = min(sizes, key=lambda k: (sizes[k], k))
    margin = ranked[1] - ranked[0] if len(ranked) > 1 else ranked[0]
    return best, 1 / sum(math.exp(-0.25 * min(2000, s - ranked[0])) for s in sizes.values()), margin < max(1, language.NARROW_SHARE * ranked[0])


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    dicts = dictionaries(rows)
    assert language.learn(spark.read.parquet(f"{SF}/documents.parquet")) == dicts
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in op4_language(spark, SF).collect()}
    want = {d: (held(d), p, round(s, 9), x) for d, t, _ in rows for p, s, x in [judged(t, dicts)]}
    assert got == want


def test_sample_of_odd_rows(spark):
    """Null ids, copies, long texts and many of one kind stay within the bounds of the sample."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(None, f"{word()} {k}" if k % 3 else "the very same text", "en") for k in range(900)] + [(k, word() * 3, "de") for k in range(300)] + [(5000 + k, "lang " * 60_000, "fr") for k in range(3)] + [(7000, "x" * 9, None), (7001, None, "de")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, draw int").repartition(5)
    learned = language.learn(df)
    assert learned == dictionaries([r for r in rows if r[1] is None or len(r[1]) <= language.SAMPLE_BYTES]) and set(learned) == {"en", "de"}
    assert learned["en"].count(b"the very same text") <= 1


def test_what_is_no_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judge = language.Judge(language.learn(docs))
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(100)]
    assert sum(judge(t)[3] for t in noise) >= 80
    rows = [r for r in docs.collect() if held(r["doc_id"])]
    kept = [r for r in rows if not judge(r["text"])[3]]
    assert len(kept) >= 0.98 * len(rows) and sum(judge(r["text"])[0] == r["lang"] for r in kept) >= 0.97 * len(kept)
