"""What several operators need: the shared work folder, written intermediate tables, text rules."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that ``written`` has made and nobody has deleted yet.
_tables: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/lattice-work"
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Cuts the lineage in a place that survives the loss of executors.  Shuffle files of the plan that was written go as soon as it
    has ended (a setting of Spark's, on for the write only).  The table itself goes by ``discard``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        _tables[path] = spark
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattice_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once nothing that is still to run reads it."""
    for table in tables:
        _delete(getattr(table, "_lattice_path", None))


def _delete(path: str | None) -> None:
    if path in _tables:
        spark = _tables.pop(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_tables):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(path)


def buckets(spark: SparkSession) -> int:
    """Hash buckets for a shuffle of whole groups: a few for each shuffle partition, so it follows the cluster's size."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; text without wider characters takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bytes(name: str, kind: T.DataType) -> Column:
    """What a value takes in memory, roughly: strings and lists by their length, the rest by words of eight bytes."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 8 if not isinstance(kind.elementType, T.StructType) else 16 + 24 * len(kind.elementType.fields)
        own = F.coalesce(F.size(c), F.lit(0)) * inner
        return own + F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + 8 * F.coalesce(F.size(c), F.lit(0)) if isinstance(kind.elementType, T.StringType) else own + 16
    return F.lit(16 + 24 * len(kind.fields) if isinstance(kind, T.StructType) else 8)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df``, marked for broadcast if its measured rows stay under ``most`` bytes; else a shuffle join follows.

    ``df`` should be a written table, or cheap, as it is read for the measure.
    """
    width = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def md5_number(value: Column, digits: int = 15) -> Column:
    """The first ``digits`` hexadecimal digits of MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")
