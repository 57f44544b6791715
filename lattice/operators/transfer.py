"""Copies, fills and strided views over vectors (idx, v) and BINARY columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.dtypes import dtype, wide, wrap


def allocate(spark: SparkSession, nbytes: int, code: str = "u1") -> DataFrame:
    """A zeroed vector of ``nbytes``."""
    if nbytes <= 0:
        raise ValueError("nbytes must be positive")
    return spark.range(nbytes // dtype(code).width).select(F.col("id").alias("idx"), F.lit(0).cast(dtype(code).spark).alias("v"))


def byte_length(value: Column) -> Column:
    return F.octet_length(value)


def memcpy(dest: Column, src: Column, count: int) -> Column:
    """The first ``count`` bytes of ``src`` over those of ``dest``; a count beyond either raises when it is run."""
    if count < 0:
        raise OverflowError("count must not be negative")
    fits = (F.octet_length(dest) >= count) & (F.octet_length(src) >= count)
    copied = F.concat(F.substring(src, 1, count), F.substring(dest, count + 1, 2**31 - 1))
    return F.when(fits, copied).otherwise(F.raise_error("memcpy: count is beyond a buffer").cast("binary"))


def copy(dest: DataFrame, src: DataFrame, count: int, code: str = "u1") -> DataFrame:
    """``dest`` with its first ``count`` elements from ``src``, cut to the dtype ``code``."""
    if count < 0:
        raise OverflowError("count must not be negative")
    value = wrap(wide(F.col("v"), code), code) if dtype(code).integral else F.col("v").cast(dtype(code).spark)
    head = src.where(F.col("idx") < count).select("idx", value.alias("from"))
    return dest.join(head, "idx", "left").select("idx", F.coalesce("from", "v").alias("v"))


def clamp_count(count: int, n: int) -> int:
    if count < 0:
        raise OverflowError("count must not be negative")
    return n if count == 0 or count > n else count


def memset(vector: DataFrame, val: int, count: int, nbytes: int) -> DataFrame:
    """The value's low byte over the first ``count`` bytes; 0 or too many means all."""
    if not -(2**31) <= val < 2**31:
        raise OverflowError("val must fit a C int")
    n = clamp_count(count, nbytes)
    return vector.select("idx", F.when(F.col("idx") < n, F.lit(val & 255).cast("smallint")).otherwise(F.col("v")).alias("v"))


def memset_bytes(data: Column, val: int, count: int) -> Column:
    """The value's low byte over the first ``count`` bytes of each value; 0 or too many means all."""
    if count < 0:
        raise OverflowError("count must not be negative")
    size = F.octet_length(data)
    n = size if count == 0 else F.least(size, F.lit(count))
    return F.concat(F.unhex(F.repeat(F.lit(f"{val & 255:02X}"), n)), F.substring(data, n + 1, size))


def fill(spark: SparkSession, pattern: bytes, count: int) -> DataFrame:
    """(idx, v BINARY): ``count`` repetitions of an 8- to 128-bit pattern."""
    if len(pattern) not in (1, 2, 4, 8, 16):
        raise ValueError("a pattern has 8, 16, 32, 64 or 128 bits")
    return spark.range(count).select(F.col("id").alias("idx"), F.lit(bytearray(pattern)).alias("v"))


def copy_from_host(dest: DataFrame, data: bytes) -> DataFrame:
    """A prefix overlay: bytes of ``data`` first, the rest of ``dest`` as it was."""
    spark = dest.sparkSession
    given = spark.range(1).select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(max(1, len(data)))), lambda k: F.conv(F.hex(F.substring(F.lit(bytearray(data)), k, F.lit(1))), 16, 10).cast("smallint"))).alias("k", "from"))
    head = given.where(F.col("k") < len(data)).select(F.col("k").cast("bigint").alias("idx"), "from")
    return dest.join(head, "idx", "left").select("idx", F.coalesce("from", "v").alias("v"))


def checked_copy_to_host(dest_nbytes: int, src_nbytes: int) -> None:
    if dest_nbytes < src_nbytes:
        raise ValueError("the destination is smaller than the source")


def strided_indices(spark: SparkSession, shape: Sequence[int], strides: Sequence[int] | None = None, offset: int = 0) -> DataFrame:
    """(pos, idx): the element of the buffer at each position of a view, row-major.  A zero extent gives no rows."""
    if strides is not None and len(strides) != len(shape):
        raise ValueError("strides and shape differ in dimensions")
    if strides is None:
        strides, below = [], 1
        for n in reversed(shape):
            strides.insert(0, below)
            below *= n
    total = 1
    for n in shape:
        total *= n
    at, below = F.lit(offset).cast("bigint"), 1
    for n, s in zip(reversed(shape), reversed(strides), strict=True):
        at = at + F.expr(f"(pos div {below}) % {max(n, 1)}") * s
        below *= n
    return spark.range(total).select(F.col("id").alias("pos")).select("pos", at.alias("idx"))


def span(shape: Sequence[int], strides: Sequence[int] | None = None) -> int:
    """Elements from the leftmost to the rightmost of a view, gaps included."""
    if any(n == 0 for n in shape):
        return 0
    if strides is None:
        out = 1
        for n in shape:
            out *= n
        return out
    ends = [(n - 1) * s for n, s in zip(shape, strides, strict=True)]
    return sum(e for e in ends if e > 0) - sum(e for e in ends if e < 0) + 1


def gather(vector: DataFrame, view: DataFrame) -> DataFrame:
    """(pos, v): a view's elements."""
    return view.join(vector, "idx").select("pos", "v")


INTERFACE_KINDS = "iufbc"


def check_interface(iface: dict) -> None:
    """Raise ValueError unless ``iface`` describes a numeric array: version 1, a data pair, a shape, matching strides."""
    if iface.get("version") != 1:
        raise ValueError("version must be 1")
    if not isinstance(iface.get("data"), tuple) or len(iface["data"]) != 2:
        raise ValueError("data must be a pair")
    if "shape" not in iface:
        raise ValueError("shape is missing")
    kind = str(iface.get("typestr", "")).lstrip("<>=|")
    if not kind or kind[0] not in INTERFACE_KINDS or not kind[1:].isdigit():
        raise ValueError("typestr must be numeric or boolean")
    if iface.get("strides") is not None and len(iface["strides"]) != len(iface["shape"]):
        raise ValueError("strides and shape differ in dimensions")
