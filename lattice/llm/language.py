"""Language identification by compression.

For every language a zstandard raw-content dictionary is cut from a bounded sample of labelled texts.  A text is
compressed with each dictionary; the language with the smallest result wins.  Texts are compressed in segments,
so that the dictionary keeps its say in a long text; all of the text counts.  A margin to the runner-up of fewer than ``NARROW`` bytes,
or of less than ``NARROW_SHARE`` of the smallest result, is a rejection: right answers on held-out labelled rows have margins of several
times that share, words that are in no dictionary don't.

Learned from: text and lang of rows that ``learns`` admits.  The sample: of each of the ``LANGUAGES`` most frequent labels, the
``SAMPLE_DOCS`` different texts that come first by a hash of doc_id and text, whole, as long as they add up to ``SAMPLE_BYTES`` (a text
that doesn't fit is passed over).  Predictions see the text only.

Defined cases: null text and text without a letter are ``und`` with score 0 and rejected; with nothing to learn
from all are; ties between languages go to the first by name and are rejected; rows that repeat each get a row, and count once in the
sample; null ids are told apart by their texts; further columns pass through, but for those that ``predict`` makes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SAMPLE_DOCS, SAMPLE_BYTES, LANGUAGES = 96, 1 << 18, 256
SEGMENT = 4096
NARROW, NARROW_SHARE = 1, 0.015
#: Evidence of one byte, for the score.
PER_BYTE = 0.25
LEVEL = 3
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def normal(text: str | None) -> str:
    """Lower-cased words with single spaces; empty if there is no letter."""
    joined = " ".join(LETTERS.findall(text or "")).lower()
    return joined if any(c.isalpha() for c in joined) else ""


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary's content for every language, from rows that aren't held out."""
    fit = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fit = fit.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= SAMPLE_BYTES))
    fit = fit.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    counts = fit.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES)
    # A few times the sample goes on to be ranked, so no task gets a whole language.
    share = F.lit(4.0 * SAMPLE_DOCS) / F.col("count") * (1 << 40)
    rows = fit.join(F.broadcast(counts), "lang").where(F.col("draw") < share).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in ranked.orderBy("lang", "rank").toLocalIterator():
        text = normal(r["text"])
        size = len(text.encode()) + 1
        if text and sizes.get(r["lang"], 0) + size <= SAMPLE_BYTES:
            texts.setdefault(r["lang"], []).append(text)
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + size
    learned = {k: " ".join(v).encode() for k, v in sorted(texts.items())}
    return {k: v for k, v in learned.items() if len(v) >= 8}


class Judge:
    def __init__(self, learned: dict[str, bytes]) -> None:
        self.names = sorted(learned)
        self.coders = []
        for k in self.names:
            d = zstandard.ZstdCompressionDict(learned[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, int, bool]:
        """(language, score, margin in bytes, rejected)."""
        data = normal(text).encode()
        if not data or not self.names:
            return "und", 0.0, 0, True
        parts = [data[k : k + SEGMENT] for k in range(0, len(data), SEGMENT)]
        sizes = [sum(len(c.compress(p)) for p in parts) for c in self.coders]
        best = min(sizes)
        margin = sorted(sizes)[1] - best if len(sizes) > 1 else best
        score = 1 / sum(exp(-PER_BYTE * min(2000, s - best)) for s in sizes)
        return self.names[sizes.index(best)], score, margin, margin < max(NARROW, NARROW_SHARE * best)


def predict(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "margin", "rejected")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    where = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(learned)
        for batch in batches:
            made = [judge(t.as_py()) for t in batch.column(where)]
            more = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "margin", "rejected"])

    schema = T.StructType(docs.schema.fields[:])
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("margin", "long"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
