"""Small catalogs for the queries and tests.

Platforms and their devices follow the usual listing (one device each of opencl accelerator, cpu and gpu, and a level_zero gpu); scores,
compute units, sub-devices and the cuda pair are chosen here, with a score of zero and a negative one to meet the edges of selection.
"""

from __future__ import annotations

import struct
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.operators import linalg

PLATFORMS = [(0, "platform a", "vendor a", "opencl"), (1, "platform b", "vendor a", "opencl"), (2, "platform c", "vendor a", "opencl"), (3, "platform d", "vendor a", "level_zero"), (4, "platform e", "vendor b", "cuda"), (5, "platform f", "vendor c", "hip")]
#: device_id, platform_id, parent_id, backend, device_type, enum_order, score, compute_units, aspects
DEVICES = [
    (10, 0, None, "opencl", "accelerator", 0, 0, 1, ["accelerator", "emulated"]), (11, 1, None, "opencl", "cpu", 1, 300, 16, ["cpu", "fp64"]), (12, 2, None, "opencl", "gpu", 2, 500, 24, ["gpu", "fp16"]),
    (13, 3, None, "level_zero", "gpu", 3, 550, 24, ["gpu", "fp16", "fp64"]), (14, 4, None, "cuda", "gpu", 4, 550, 80, ["gpu", "fp64"]), (15, 4, None, "cuda", "gpu", 5, -1, 80, ["gpu", "fp64"]),
    (16, 3, 13, "level_zero", "gpu", 6, 100, 12, ["gpu"]), (17, 3, 16, "level_zero", "gpu", 7, 90, 6, ["gpu"]),
]
#: device_id, max_work_group_size, max_work_item_sizes, sub_group_sizes, global_mem_size, local_mem_size, max_clock_frequency, native_vector_width_float, driver_version
PROPERTIES = [
    (10, 1, [1, 1, 1], [], 1073741824, 0, 100, 1, "1.0"), (11, 8192, [8192, 8192, 8192], [4, 8, 16], 34359738368, 32768, 3600, 8, "2.1"), (12, 256, [256, 256, 256], [8, 16, 32], 4294967296, 65536, 1200, 1, "3.2"),
    (13, 512, [512, 512, 512], [8, 16, 32], 8589934592, 65536, 1500, 1, "3.3"), (14, 1024, [1024, 1024, 64], [32], 17179869184, 49152, 1700, 1, "5.0"), (15, 1024, [1024, 1024, 64], [32], 17179869184, 49152, 1700, 1, "5.0"),
    (16, 512, [512, 512, 512], [8, 16, 32], 8589934592, 65536, 1500, 1, "3.3"), (17, 512, [512, 512, 512], [8, 16, 32], 8589934592, 65536, 1500, 1, "3.3"),
]
#: event_id, depends_on, start_ns, end_ns: a chain of copy, +1, sqrt and sin, and one apart.
TASKS = [(1, [], 1000, 5000), (2, [1], 5200, 9000), (3, [2], 9100, 9900), (4, [3, 1], 10000, 17500), (5, [], 1500, 2500)]
MATRIX = [[4.0, 1.0, 0.0, 0.5, 0.0], [1.0, 5.0, 1.0, 0.0, 0.25], [0.0, 1.0, 6.0, 1.0, 0.0], [0.5, 0.0, 1.0, 7.0, 1.0], [0.0, 0.25, 0.0, 1.0, 8.0]]
SOLUTION = [1.0, -2.0, 3.0, 0.5, 4.0]


def _literal(x: object, empty: str) -> str:
    if x is None:
        return "CAST(NULL AS INT)"
    if isinstance(x, list):
        return "array(" + ", ".join(_literal(v, empty) for v in x) + ")" if x else empty
    return f"'{x}'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str, empty: str = "") -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_literal(x, empty) for x in r) + ")" for r in rows) + f") AS t({names})"


D_NAMES = "device_id, platform_id, parent_id, backend, device_type, enum_order, score, compute_units, aspects"
P_NAMES = "platform_id, platform_name, vendor, backend"
T_NAMES = "event_id, depends_on, start_ns, end_ns"


def devices(spark: SparkSession) -> DataFrame:
    return spark.sql(_values(DEVICES, D_NAMES))


def devices_sql() -> str:
    return _values(DEVICES, D_NAMES).replace("array(", "list_value(")


R_NAMES = "device_id, max_work_group_size, max_work_item_sizes, sub_group_sizes, global_mem_size, local_mem_size, max_clock_frequency, native_vector_width_float, driver_version"


def properties(spark: SparkSession) -> DataFrame:
    return spark.sql(_values(PROPERTIES, R_NAMES, "CAST(array() AS array<int>)"))


def properties_sql() -> str:
    return _values(PROPERTIES, R_NAMES, "CAST([] AS INT[])").replace("array(", "list_value(")


def platforms(spark: SparkSession) -> DataFrame:
    return spark.sql(_values(PLATFORMS, P_NAMES))


def platforms_sql() -> str:
    return _values(PLATFORMS, P_NAMES)


def tasks(spark: SparkSession) -> DataFrame:
    return spark.sql(_values(TASKS, T_NAMES, "CAST(array() AS array<int>)"))


def tasks_sql() -> str:
    return _values(TASKS, T_NAMES, "CAST([] AS INT[])").replace("array(", "list_value(")


def spd_system(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A symmetric positive definite matrix (i, j, v) and the right-hand side that SOLUTION solves."""
    cells = [(f"{i}L", f"{j}L", f"{v}D") for i, row in enumerate(MATRIX) for j, v in enumerate(row)]
    matrix = spark.sql("SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {v})" for i, j, v in cells) + ") AS t(i, j, v)")
    right = [sum(a * x for a, x in zip(row, SOLUTION, strict=True)) for row in MATRIX]
    return matrix, spark.sql("SELECT * FROM (VALUES " + ", ".join(f"({k}L, {v}D)" for k, v in enumerate(right)) + ") AS t(idx, v)")


#: Unknowns, and the rank of what is added to the diagonal.
RANK = (1000, 16)


def rank_system(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """2 I + U U' with ``RANK`` (i, j, v), and the right-hand side that (1, -1/2, 1, -1/2, ...) solves."""
    n, rank = RANK
    wave = lambda at, k: F.cos(F.col(at) * (k + 1) + k)
    cells = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
    low = reduce(lambda a, b: a + b, [wave("i", k) * wave("j", k) for k in range(rank)])
    matrix = cells.select("i", "j", (low / n + F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.0)).alias("v"))
    x = spark.range(n).select(F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-0.5).alias("v"))
    return matrix, linalg.gemv(matrix, x)


def _module(*instructions: tuple[int, ...]) -> bytes:
    words = [0x07230203, 0x10000, 0, 99, 0]
    for op, *args in instructions:
        words += [(len(args) + 1) << 16 | op, *args]
    return struct.pack(f"={len(words)}I", *words)


def _name(target: int, text: str) -> tuple[int, ...]:
    data = text.encode() + b"\0"
    data += b"\0" * (-len(data) % 4)
    return (5, target, *struct.unpack(f"={len(data) // 4}I", data))


def _bits(layout: str, value: float) -> tuple[int, ...]:
    data = struct.pack(f"={layout}", value)
    return struct.unpack(f"={len(data) // 4}I", data)


#: Modules and what they hold: path, spec_id, dtype, name, itemsize, default.
MODULES = {
    "composite": _module((71, 10, 1, 0), (71, 11, 1, 1), (71, 12, 1, 2), (21, 1, 32, 0), (22, 2, 32), (21, 3, 8, 0), (50, 1, 10, 1), (50, 2, 11, *_bits("f", 0.0)), (50, 3, 12, 0)),
    "named": _module(_name(10, "rounds"), _name(11, "fast"), (71, 10, 1, 7), (71, 11, 1, 3), (21, 1, 32, 1), (20, 2), (50, 1, 10, *_bits("i", -5)), (48, 2, 11), (54, 1, 2, 3, 4), (71, 9, 1, 9)),
    "odd": _module((71, 10, 1, 4), (71, 11, 1, 5), (71, 12, 1, 4), (22, 1, 64), (50, 1, 10, *_bits("d", 2.5)), (49, 77, 12)),
    "none": _module((21, 1, 32, 0)),
}
CONSTANTS = [
    ("composite", 0, "u4", "unnamed_spec_const_0", 4, "1"), ("composite", 1, "f4", "unnamed_spec_const_1", 4, "0.0"), ("composite", 2, "u1", "unnamed_spec_const_2", 1, "0"),
    ("named", 3, "?", "fast", 1, "True"), ("named", 7, "i4", "rounds", 4, "-5"), ("odd", 4, "f8", "unnamed_spec_const_4", 8, "2.5"), ("odd", 5, "unknown_type", "unnamed_spec_const_5", 0, None),
]


def modules(spark: SparkSession) -> DataFrame:
    """(path, content), as files of modules are read."""
    return spark.sql("SELECT * FROM (VALUES " + ", ".join(f"('{k}', X'{v.hex()}')" for k, v in MODULES.items()) + ") AS t(path, content)")


def modules_sql() -> str:
    rows = ", ".join(f"('{p}', {i}::BIGINT, '{t}', '{n}', {w}, {'NULL' if v is None else repr(v)})" for p, i, t, n, w, v in CONSTANTS)
    return f"SELECT * FROM (VALUES {rows}) t(path, spec_id, dtype, name, itemsize, default_value)"
