"""Reductions and small linear algebra over vectors (idx, v) and matrices (i, j, v).  Sums over nothing are zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("double"))


def column_totals(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("j").agg(F.sum("v").alias("total"))


def subtracted(x: Column, y: Column) -> Column:
    return x - y


def axpby_of(a: float, x: Column, b: float, y: Column) -> Column:
    """a*x + b*y of two columns; b = 1 spares the product."""
    return a * x + (y if b == 1 else b * y)


def dot_of(x: Column, y: Column) -> Column:
    """The aggregate sum of x*y; zero over nothing."""
    return _sum(x * y)


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "idx").select("idx", subtracted(F.col("x"), F.col("y")).alias("v"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    return x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "idx").select("idx", axpby_of(a, F.col("x"), b, F.col("y")).alias("v"))


def norm_squared(x: DataFrame) -> DataFrame:
    return x.agg(_sum(F.col("v") * F.col("v")).alias("s"))


def norm_squared_complex(x: DataFrame) -> DataFrame:
    """Of (idx, v) with v a struct (real, imag)."""
    return x.agg(_sum(F.col("v.real") * F.col("v.real") + F.col("v.imag") * F.col("v.imag")).alias("s"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "idx").agg(dot_of(F.col("x"), F.col("y")).alias("s"))


def dot_complex(x: DataFrame, y: DataFrame) -> DataFrame:
    """The sum of conj(x)*y."""
    both = x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), "idx")
    return both.agg(_sum(F.expr("x.real * y.real + x.imag * y.imag")).alias("real"), _sum(F.expr("x.real * y.imag - x.imag * y.real")).alias("imag"))


def gemv(matrix: DataFrame, x: DataFrame, leading: int | None = None) -> DataFrame:
    """matrix @ x; x is broadcast only while its counted rows are few, else both sides are shuffled on j.

    With a ``leading`` dimension the matrix is a flat row-major buffer (idx, v) with rows of that many elements, of which as many count
    as x has; shorter rows raise.
    """
    n = x.count()
    if leading is not None:
        if leading < n:
            raise ValueError("the leading dimension is smaller than the vector")
        matrix = matrix.select(F.expr(f"idx div {leading}").alias("i"), (F.col("idx") % leading).alias("j"), "v").where(F.col("j") < n)
    side = x.select(F.col("idx").alias("j"), F.col("v").alias("x"))
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    return matrix.join(side, "j").groupBy(F.col("i").alias("idx")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def gemv_rows(rows: DataFrame, x: list[float]) -> DataFrame:
    """(idx, v) of a matrix of array rows (idx, row) and a short vector: a projection, without a shuffle."""
    vector = F.lit(list(map(float, x)))
    return rows.select("idx", F.aggregate(F.zip_with("row", vector, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("v"))


def reduced(value: Column, modulus: int) -> Column:
    """``value`` modulo a positive number, with the sign of the value."""
    if modulus <= 0:
        raise ValueError("the modulus must be positive")
    return value % modulus


def to_lists(matrix: DataFrame) -> DataFrame:
    """(i, row): each row's values in order of j."""
    return matrix.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("row"))


def zeros(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0.0).alias("v"))


def conjugate_gradient(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-20, every: int = 10) -> tuple[DataFrame, int]:
    """(x, iteration at which r.r fell below ``tolerance``): 0 if b.b is below already, n if it never did.

    x, r and p are columns of one frame, so an iteration is one pass over the matrix (a broadcast of p, or a shuffle join beyond the
    bound) and one aggregate for both scalars: with rr = r.r, alpha = rr / p.Ap and the next r.r = rr - 2 alpha r.Ap + alpha^2 Ap.Ap.
    The driver holds the scalars only.  Frames are unpersisted as soon as the next one stands; every few rounds r.r is taken anew from r,
    which keeps rounding from building up, and the frame is checkpointed if a checkpoint folder is set.
    """
    spark = b.sparkSession
    state = b.select("idx", F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.col("v").cast("double").alias("p")).persist()
    held = [state]
    start = state.agg(F.count(F.lit(1)).alias("n"), _sum(F.col("r") * F.col("r")).alias("rr")).first()
    n, rr = start["n"], start["rr"]
    matrix = matrix.persist()
    durable = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    done = 0 if rr < tolerance else n
    for k in range(n if rr >= tolerance else 0):
        side = state.select(F.col("idx").alias("j"), F.col("p").alias("q"))
        side = F.broadcast(side) if n <= BROADCAST_ROWS else side
        ap = matrix.join(side, "j").groupBy(F.col("i").alias("idx")).agg(F.sum(F.col("v") * F.col("q")).alias("ap"))
        step = state.join(F.broadcast(ap) if n <= BROADCAST_ROWS else ap, "idx").persist()
        s = step.agg(*[_sum(e).alias(c) for c, e in (("pap", F.col("p") * F.col("ap")), ("rap", F.col("r") * F.col("ap")), ("apap", F.col("ap") * F.col("ap")))]).first()
        alpha = rr / s["pap"]
        fresh = k % every == every - 1 or (guess := rr - 2 * alpha * s["rap"] + alpha * alpha * s["apap"]) < 1e-6 * rr
        r = F.col("r") - alpha * F.col("ap")
        after = step.agg(_sum(r * r).alias("rr")).first()["rr"] if fresh else guess
        beta = after / rr
        state = step.select("idx", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r + beta * F.col("p")).alias("p"))
        if k % every == every - 1 or after < tolerance:
            state = (state.checkpoint() if durable else state.persist())
            state.count()
            for old in held:
                old.unpersist()
            step.unpersist()
            held = [state]
        else:
            held.append(step)
        rr = after
        if rr < tolerance:
            done = k
            break
    matrix.unpersist()
    return state.select("idx", F.col("x").alias("v")), done
