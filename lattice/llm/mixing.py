"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

1. Every document gets a size (words) and a place in its source's permutation (a hash of its id), whose leading
   bits number its block.  Sizes are summed by (source, block) before anything is shuffled, so a source with a
   third of all rows is spread over its blocks.
2. Targets: every source's share of all words by its weight, never above ``MOST`` times its own words; what is
   cut off is shared again by weight.  The fixed point has one water level for all sources that aren't cut off.
3. A source gives whole passes over its blocks, and then the leading part of its permutation, up to the document
   whose middle passes the quota.  The quota in blocks is exact.
4. A binary tree over the output shards splits those block quotas: at each node the left half draws its share of
   every source without replacement.  A leaf's quotas are filled with disjoint stretches of the source's permuted
   blocks, and rows get an order key for the shuffle within their shard.

Which documents are taken, and how often, follows from steps 2 and 3 alone and reruns agree; step 4 deals them out.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0
weigh nothing; rows that repeat (doc_id, size) are taken alike; an empty table gives an empty mix; further columns
pass through ``mixed`` untouched unless they are called ``shard``, ``epoch`` or ``place``, which are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.llm._shared import SPACED_WORD, md5_number, small, written

WEIGHTS = (1, 2, 3)
MOST = 3
SHARDS = 16
#: Blocks of a source: two to this power at most.
BLOCK_BITS = 10
NO_ID = -(2**63)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"),
        _order(F.col("doc_id")).alias("at"),
    )


def _order(doc_id: Column) -> Column:
    return md5_number(F.coalesce(doc_id.cast("string"), F.lit("")))


def _block(at: Column) -> Column:
    return F.shiftright(at, 60 - BLOCK_BITS).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with each source's target.  One row a source: the windows see nothing larger."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(order) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), n + 1))
    cap = MOST * F.col("source_size").cast("double")
    by_level = Window.orderBy(F.col("level"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        weighted.withColumn("cap", cap)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("cut", F.col("left") / F.sum("weight").over(after) >= F.col("level"))
        .withColumn("open_left", F.col("total") - F.coalesce(F.sum(F.when(F.col("cut"), F.col("cap"))).over(everything), F.lit(0.0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("cut"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("cut"), F.col("cap")).otherwise(F.col("open_left") / F.col("open_weight") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def split_quotas(quotas: list[int], shards: int, seed: int = 5) -> list[list[int]]:
    """Quotas of blocks by source, dealt out to shards whose totals differ by one at most: a splitting tree."""
    rng = np.random.default_rng(seed)
    total = sum(quotas)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    out = [[0] * shards for _ in quotas]

    def split(lo: int, hi: int, counts: list[int]) -> None:
        if hi - lo == 1:
            for s, n in enumerate(counts):
                out[s][lo] = n
            return
        mid = (lo + hi) // 2
        want, rest, left = sum(room[lo:mid]), sum(counts), []
        for n in counts:
            took = int(rng.hypergeometric(n, rest - n, want)) if n and want else 0
            left.append(took)
            want, rest = want - took, rest - n
        split(lo, mid, left)
        split(mid, hi, [n - x for n, x in zip(counts, left, strict=True)])

    split(0, shards, list(quotas))
    return out


def plan(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(sized documents, cells).  A cell is a source's block with what the mix takes of it.

    Cells: source, block, source_size, target, takes (shards of the whole passes), part (the shard of the last,
    partial pass, or null) and upto (last document of a block that is only partly in that pass, or null).
    """
    spark = docs.sparkSession
    sized = written(_sized(docs), "sized")
    cells = sized.groupBy("source", _block(F.col("at")).alias("block")).agg(F.sum("size").alias("words"))
    cells = written(cells, "cells")
    by_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    by_source = by_source.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.join(by_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("before", F.coalesce(F.sum("words").over(by_block), F.lit(0)))
        .withColumn("full", F.col("before") + F.col("words") <= F.col("rest"))
        .withColumn("cut", ~F.col("full") & (F.col("before") <= F.col("rest")))
    )
    cells = written(cells, "blocks")
    # The block in which a source's last pass ends: its documents in order, up to the one whose middle passes the quota.
    ends = cells.where("cut").select(F.col("source").alias("of"), F.col("block").alias("in_block"), "before", "rest")
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    upto = (
        sized.join(ends, F.col("source").eqNullSafe(F.col("of")) & (_block(F.col("at")) == F.col("in_block")))
        .withColumn("key", _key())
        .withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        .where(F.col("start") + F.col("size") / 2 <= F.col("rest"))
        .groupBy("source").agg(F.max("key").alias("upto"))
    )
    instances = cells.select(
        "source", "block",
        F.explode(F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")), F.when(F.col("full") | F.col("cut"), F.array(F.col("passes"))).otherwise(F.array().cast("array<int>")))).alias("epoch"),
    )
    quotas = instances.groupBy("source").count().orderBy(F.col("source").asc_nulls_last()).collect()  # a row for each source
    dealt = split_quotas([r["count"] for r in quotas], shards)
    runs = json.dumps([{"source": r["source"], "shard": k, "first": sum(own[:k]), "last": sum(own[: k + 1]) - 1} for r, own in zip(quotas, dealt, strict=True) for k in range(shards) if own[k]])
    leaves = spark.range(1).select(F.explode(F.from_json(F.lit(runs), "array<struct<source:string,shard:int,first:long,last:long>>")).alias("x")).select(F.col("x.source").alias("of"), "x.shard", F.explode(F.sequence("x.first", "x.last")).alias("rank"))
    shuffled = Window.partitionBy("source").orderBy(md5_number(F.concat_ws("/", F.lit("block"), "epoch", "block")), "epoch", "block")
    drawn = (
        instances.withColumn("n", (F.row_number().over(shuffled) - 1).cast("long"))
        .join(leaves, F.col("source").eqNullSafe(F.col("of")) & (F.col("n") == F.col("rank")))
        .groupBy(F.col("source").alias("s"), F.col("block").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    )
    cells = (
        cells.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
        .join(upto.withColumnRenamed("source", "u"), F.col("source").eqNullSafe(F.col("u")), "left")
        .select(
            "source", "block", "source_size", "target",
            F.coalesce(F.filter("draws", lambda x: x["epoch"] < F.col("passes")), F.array()).alias("takes"),
            F.try_element_at(F.filter("draws", lambda x: x["epoch"] == F.col("passes")), F.lit(1)).alias("part"),
            "full", F.when(F.col("cut"), F.col("upto")).alias("upto"),
        )
    )
    return sized, written(cells, "plan")


def _key() -> Column:
    return F.struct(F.col("at"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id"), F.col("size"))


def drawn(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """Every row of ``sized`` (which may carry more columns) with source_size, target and its draws (epoch, shard)."""
    cells = small(cells.withColumnRenamed("source", "of").withColumnRenamed("block", "in_block"))
    in_part = F.col("part").isNotNull() & (F.col("full") | F.coalesce(_key() <= F.col("upto"), F.lit(False)))
    return (
        sized.join(cells, F.col("source").eqNullSafe(F.col("of")) & (_block(F.col("at")) == F.col("in_block")))
        .withColumn("draws", F.when(in_part, F.concat("takes", F.array("part"))).otherwise(F.col("takes")))
        .drop("of", "in_block", "takes", "part", "full", "upto")
    )


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, draws."""
    return drawn(*plan(docs, shards)).withColumn("taken", F.col("size") * F.size("draws"))


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, with epoch, shard and the order within the shard.

    Only the plan's cells are joined to the documents, by broadcast while they are few; the texts aren't shuffled then.
    """
    _, cells = plan(docs, shards)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), size_of(F.col("row.text")).alias("size"), _order(F.col("row.doc_id")).alias("at"))
    taken = drawn(sized, cells).select("row", "at", F.explode("draws").alias("draw"))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "epoch", "place")]
    place = md5_number(F.concat_ws("/", F.lit("row"), F.col("draw.shard"), F.col("draw.epoch"), F.col("at")))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("draw.epoch").alias("epoch"), F.col("draw.shard").alias("shard"), place.alias("place"))


def shuffled(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``mixed``, each shard's rows together and in their order within the shard: a task gets stretches of ``place`` of any shard.

    A shard's stretches are told apart by the leading ``BLOCK_BITS`` bits of the place, so a shard of any size is spread over tasks.
    """
    cell = F.shiftright("place", 60 - BLOCK_BITS)
    return mixed(docs, shards).repartition("shard", cell).sortWithinPartitions("shard", "place")
