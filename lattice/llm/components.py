"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm._shared import discard, written


def _towards_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): each pair with the least of u and everything u is paired with; and the table of those, written so that a hub's rows
    can be split in the join."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), F.least("least", "u").alias("m")), "least")
    return pairs.join(least, F.col("u") == F.col("of")).select("u", "v", "m"), least


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of ``links`` (u, v): component is the least id reachable.

    A hub's rows are pre-aggregated before each shuffle, and the joins on the hub are ones that Spark can split.
    Each round is written to the shared folder.
    """
    now = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        stamp = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if not stamp["n"] or tuple(stamp) == state:
            break
        state = tuple(stamp)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around, least = _towards_least(both)
        large = written(around.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        near, nearest = _towards_least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        before, now = now, written(small.where(F.col("u") != F.col("v")).distinct(), "links")
        discard(before, least, large, nearest)
    rooted = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    out = written(rooted.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(now)
    return out
