"""Line dedup by content-defined chunks.

Every line is hashed, and a rolling hash over the last ``REACH`` line hashes ends a chunk where it is divisible by ``SPREAD``, so
chunk boundaries move with the content.  Chunks of ``LEAST_LINES`` lines or more are grouped by their bytes; of each group the first in
order of (doc_id, line) stays and the others are removed.

Defined cases: null text is empty and has no lines; a null doc_id comes last in that order; rows that repeat doc_id and text are one
document and share their result; rows that share only the doc_id are told apart by their texts; an empty table gives an empty result;
a very long text is one row of arrays, of the size of the text; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import discard, md5_number, written
from lattice.llm.minhash import keyed
from lattice.llm.paragraphs import _rows, lines_of, without

REACH, SPREAD, LEAST_LINES = 2, 4, 2
#: The rolling hash is a polynomial in this base, modulo a prime.
BASE, PRIME = 1_000_003, 2_147_483_647
NO_ID = 2**63 - 1


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def chunks_of(lines: Column) -> Column:
    """Array of (first, n) of all chunks of ``lines``."""

    def rolled(h: Column) -> Column:
        return F.transform(h, lambda x, i: (x + F.coalesce(F.when(i > 0, F.try_element_at(h, i)), F.lit(0)) * BASE) % PRIME)

    def cut(r: Column) -> Column:
        last = F.filter(F.transform(r, lambda x, i: F.when((x % SPREAD == 0) | (i == F.size(r) - 1), i)), lambda i: i.isNotNull())
        starts = lambda e: F.concat(F.array(F.lit(0)), F.transform(F.slice(e, 1, F.size(e) - 1), lambda i: i + 1))
        return _let(last, lambda e: F.zip_with(starts(e), e, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n"))))

    hashed = F.transform(lines, lambda x: md5_number(x, 7))
    none = F.array().cast("array<struct<first:int,n:int>>")
    return F.when(F.size(lines) == 0, none).otherwise(_let(_let(hashed, rolled), cut))


def _chunks(rows: DataFrame) -> DataFrame:
    """(ord, key, first, n, k1, k2, body) of the chunks of LEAST_LINES lines or more."""
    cut = rows.select("ord", "key", lines_of(F.col("text")).alias("lines")).withColumn("chunks", chunks_of(F.col("lines")))
    several = F.filter("chunks", lambda c: c["n"] >= LEAST_LINES)
    bodies = F.transform(several, lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.array_join(F.slice("lines", c["first"] + 1, c["n"]), "\n").alias("body")))
    flat = cut.select("ord", "key", F.explode(bodies).alias("c")).select("ord", "key", "c.first", "c.n", "c.body")
    return flat.select("ord", "key", "first", "n", *keyed(F.col("body")), "body")


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_lines, removed (array of (first, n)), kept (text).

    The plan is the same at every size.  Chunks are grouped by their bytes, and what one task sees again is combined there, so a chunk
    that a third of all documents share is no hot key; their places are joined to the groups by 128 bits, in a join that Spark can split.
    """
    rows = _rows(docs).withColumn("ord", F.coalesce("doc_id", F.lit(NO_ID)))
    chunks = written(_chunks(rows), "chunks")
    place = F.struct("ord", "key", "first")
    seen = chunks.groupBy("k1", "k2", "body").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    keepers = written(seen.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "x"), "keepers")
    repeats = chunks.drop("body").join(keepers.hint("merge"), (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")))
    gone = repeats.where(place != F.col("x")).groupBy(F.col("ord").alias("of"), F.col("key").alias("of_key"))
    by_doc = written(gone.agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("removed")), "gone")
    discard(chunks, keepers)
    joined = rows.join(by_doc.hint("merge"), (F.col("ord") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    joined = joined.select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("removed", F.array().cast("array<struct<first:int,n:int>>")).alias("removed"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "removed", F.array_join(without(F.col("lines"), F.col("removed")), "\n").alias("kept"))
