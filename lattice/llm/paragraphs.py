"""Substring dedup by paragraph MinHash banding, and by passages in what that leaves.

A paragraph is a line with a shingle of its own, so of ``minhash.SHINGLE`` words or more.  Equal lines are one node; lines that collide
in a band are compared by exact Jaccard similarity of their shingles (minhash.cluster), and of each component the first line in order
of (doc_id, line) stays.

Passages are found whatever the lines, so in shorter lines as well: in the words that are left of a document, the least shingle hash of
any ``REACH`` in a row is an anchor, and the ``UNIT`` words from an anchor on are a unit.  Texts with UNIT + REACH - 1 words in common
have a unit in common.  Of equal units (128 bits stand for the words) the first in order of (doc_id, word) stays; the words of the others
are cut, the white space around them stays.  Units of one document that overlap the first take nothing from each other.

Defined cases: null text is empty and has no lines; a null doc_id comes last in that order; rows that repeat doc_id and text are one
document and share their result; rows that share only the doc_id are told apart by their texts; an empty table gives an empty result;
very long lines and texts are hashed in pieces; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm import minhash
from lattice.llm._shared import SPACED_WORD, discard, written

#: Words of a unit, a multiple of minhash.SHINGLE; positions in a row of which one is an anchor.
UNIT, REACH = 40, 10
#: A line of minhash.SHINGLE words or more; it looks no further than the last of them.
PARAGRAPH = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{minhash.SHINGLE - 1}}}[^\x20\x09-\x0D]"
NO_ID = 2**63 - 1
_MIX = np.random.default_rng(7).integers(0, 2**63, (2, UNIT // minhash.SHINGLE), np.uint64) * np.uint64(2) + np.uint64(1)


def lines_of(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def _repeated_lines(rows: DataFrame) -> DataFrame:
    """(of, of_key, removed, long, kept_in): line numbers that go from each document, the words in stretches of such lines with UNIT words
    or more, and the doc_ids that keep them."""
    flat = rows.select("doc_id", "key", F.posexplode(lines_of(F.col("text"))).alias("line", "text"))
    lines = flat.select("doc_id", "key", "line", "text", *minhash.keyed(F.col("text")), F.regexp_count("text", F.lit(SPACED_WORD)).alias("words")).where(F.col("text").rlike(PARAGRAPH))
    grouped = minhash.cluster(lines.select("k1", "k2", "text"))
    placed = lines.drop("text").join(grouped, ["k1", "k2"], "left").select(
        F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2"), F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), "key", "line", "words",
    )
    placed = written(placed, "placed")
    first = written(placed.groupBy("c1", "c2").agg(F.min(F.struct("ord", "key", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    # Merge joins of two written tables: the same plan at every size, and Spark can split a line that very many documents have.
    gone = placed.join(first.hint("merge"), ["c1", "c2"]).where(F.struct("ord", "key", "line") != F.col("first"))
    by_doc = gone.groupBy(F.col("ord").alias("of"), F.col("key").alias("of_key")).agg(
        F.sort_array(F.collect_set(F.struct("line", "words"))).alias("gone"), F.sort_array(F.collect_set(F.nullif("first.ord", F.lit(NO_ID)))).alias("kept_in")
    )
    zero = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("long"))
    whole = lambda a: F.when(a["run"] >= UNIT, a["run"]).otherwise(F.lit(0))

    def joined(a: Column, x: Column) -> Column:
        """The next line goes on with the stretch if it is the next but one at most, as a blank line may stand between paragraphs."""
        on = x["line"] <= a["last"] + 2
        return F.struct(x["line"].alias("last"), F.when(on, a["run"] + x["words"]).otherwise(x["words"]).cast("long").alias("run"), F.when(on, a["long"]).otherwise(a["long"] + whole(a)).cast("long").alias("long"))

    long = F.aggregate("gone", zero, joined, lambda a: a["long"] + whole(a))
    out = written(by_doc.select("of", "of_key", F.transform("gone", lambda x: x["line"]).alias("removed"), long.alias("long"), "kept_in"), "gone")
    discard(placed, first, grouped)
    return out


def _without_lines(docs: DataFrame) -> DataFrame:
    """(ord, key, doc_id, n_lines, removed, long, kept_in, text) of each document: what is left without repeated paragraphs."""
    rows = _rows(docs)
    by_doc = _repeated_lines(rows)
    # A merge join by hint, so the plan is the same at every size.
    joined = rows.withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID))).join(by_doc.hint("merge"), (F.col("ord") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    joined = joined.select(
        "ord", "key", "doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("long", F.lit(0).cast("long")).alias("long"), F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"),
    )
    kept = F.array_join(without(F.col("lines"), F.transform("removed", lambda x: F.struct(x.alias("first"), F.lit(1).alias("n")))), "\n")
    left = written(joined.select("ord", "key", "doc_id", F.size("lines").cast("long").alias("n_lines"), "removed", "long", "kept_in", kept.alias("text")), "left")
    discard(by_doc)
    return left


def _slid(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each REACH values in a row."""
    n, reach = len(x) - REACH + 1, 1
    while 2 * reach <= REACH:
        x = pick(x[: len(x) - reach], x[reach:])
        reach *= 2
    return pick(x[:n], x[REACH - reach : REACH - reach + n])


def units(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, the 128 bits that stand for it) of each unit of texts with ``counts`` of the shingle hashes ``x``."""
    ends = np.cumsum(counts)
    last = np.repeat(ends, counts)  # where each position's text ends
    here = np.arange(len(x))
    if len(x) < REACH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    least = _slid(x, np.minimum)
    least[here[: len(least)] + REACH > last[: len(least)]] = 0  # stretches across two texts
    around = _slid(np.r_[np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)], np.maximum)
    at = np.flatnonzero((x == around) & (here + UNIT - minhash.SHINGLE < last))
    parts = x[at[None, :] + np.arange(0, UNIT, minhash.SHINGLE)[:, None]]
    bits = np.stack([((parts ^ (parts >> np.uint64(32))) * m[:, None]).sum(axis=0, dtype=np.uint64) for m in _MIX])
    bits ^= bits >> np.uint64(31)
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - counts)[text], bits.view(np.int64)


def _units(left: DataFrame) -> DataFrame:
    """(ord, key, at, k1, k2) of the units of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first, size, held = 0, 0, []
            for k, text in enumerate(batch.column(2)):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= minhash.BLOCK or k == len(ords) - 1:
                    which, at, bits = units(*minhash.shingled(held))
                    columns = ords[first + which], keys[first + which], at.astype(np.int32), *bits
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ord", "key", "at", "k1", "k2"])
                    first, size, held = k + 1, 0, []

    return left.select("ord", "key", "text").mapInArrow(run, "ord long, key long, at int, k1 long, k2 long")


def _passages(left: DataFrame) -> DataFrame:
    """(of, of_key, ats, keepers): first words of the units to be cut from each document, and the doc_ids that have them first."""
    found = written(_units(left), "units")
    again = written(found.groupBy("k1").count().where("count > 1").select("k1"), "again")
    several = written(found.join(again.hint("merge"), "k1", "left_semi"), "several")
    discard(found, again)
    first = written(several.groupBy("k1", "k2").agg(F.min(F.struct("ord", "key", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    placed = several.join(first.hint("merge"), ["k1", "k2"])
    gone = placed.where((F.col("ord") != F.col("first.ord")) | (F.col("key") != F.col("first.key")) | (F.col("at") >= F.col("first.at") + UNIT))
    by_doc = gone.groupBy(F.col("ord").alias("of"), F.col("key").alias("of_key"))
    out = written(by_doc.agg(F.sort_array(F.collect_set("at")).alias("ats"), F.collect_set(F.nullif("first.ord", F.lit(NO_ID))).alias("keepers")), "passages")
    discard(several, first)
    return out


def stretches(ats: list[int]) -> list[tuple[int, int]]:
    """(first word, words) of what the units at ``ats``, in order, cover."""
    out: list[tuple[int, int]] = []
    for a in ats:
        if out and a <= sum(out[-1]):
            out[-1] = out[-1][0], a + UNIT - out[-1][0]
        else:
            out.append((a, UNIT))
    return out


def cut_words(text: str, gaps: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``gaps`` (first, n) and the white space between them."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    edges = [0, *[x for a, n in gaps for x in (spans[a][0], spans[a + n - 1][1])], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_lines, removed (line numbers), n_long, kept_in (doc_ids that keep what goes), cut, kept (text).

    ``cut`` has the stretches (first, n) of words that go from what is left without the removed lines; ``n_long`` counts the words that
    go in stretches of UNIT words or more, of whole lines or of words.
    """
    left = _without_lines(docs)
    passages = _passages(left)
    joined = left.join(passages.hint("merge"), (F.col("ord") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    joined = joined.select("doc_id", "n_lines", "removed", F.array_sort(F.array_union("kept_in", F.coalesce("keepers", F.array().cast("array<long>")))).alias("kept_in"), "long", "ats", "text")
    pair = pa.struct([("first", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = [stretches(a or []) for a in batch.column(5).to_pylist()]
            kept = [cut_words(t.as_py(), g) if g else t.as_py() for t, g in zip(batch.column(6), gaps, strict=True)]
            cut = pa.array([[{"first": a, "n": n} for a, n in g] for g in gaps], pa.list_(pair))
            n_long = pa.array([n + sum(m for _, m in g) for n, g in zip(batch.column(4).to_pylist(), gaps, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n_long, cut, pa.array(kept, pa.string())], ["doc_id", "n_lines", "removed", "kept_in", "n_long", "cut", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, removed array<int>, kept_in array<long>, n_long long, cut array<struct<first:int,n:int>>, kept string")


def without(lines: Column, gaps: Column) -> Column:
    """``lines`` without the stretches ``gaps`` (first, n), which are in order and apart; linear in both."""
    n = F.size(gaps)
    starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["first"] + g["n"]))
    stops = F.concat(F.transform(gaps, lambda g: g["first"]), F.array(F.size(lines)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(n == 0, lines).otherwise(F.flatten(pieces))
