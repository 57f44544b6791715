"""Allocations: a vector (idx, v) with its kind and owner, their catalog, and copies between allocations and the host.

A context is a session and a set of devices; what was allocated in another context has an unknown kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.dtypes import dtype
from lattice.operators import transfer

KINDS = ("device", "shared", "host")
#: Bytes that a copy to the host may bring to the driver.
HOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Context:
    """Devices of one session that share memory; equal if session and devices are."""

    session: int
    devices: tuple[int, ...]

    @classmethod
    def of(cls, spark: SparkSession, devices: int | Sequence[int]) -> Context:
        listed = (devices,) if isinstance(devices, int) else tuple(devices)
        if not listed or any(not isinstance(d, int) for d in listed):
            raise TypeError("a context takes one device id or several")
        return cls(spark._jsparkSession.hashCode(), listed)

    def get_devices(self) -> list[int]:
        return list(self.devices)

    @property
    def device_count(self) -> int:
        return len(self.devices)


@dataclass(frozen=True)
class Allocation:
    vector: DataFrame
    kind: str
    nbytes: int
    code: str
    device: int
    context: Context

    def usm_type(self, context: Context | None = None) -> str:
        """The kind, or "unknown" as seen from another context."""
        return self.kind if context is None or context == self.context else "unknown"


def allocate(spark: SparkSession, nbytes: int, kind: str, context: Context, code: str = "u1") -> Allocation:
    """A zeroed allocation on the context's first device."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind!r}")
    return Allocation(transfer.allocate(spark, nbytes, code), kind, nbytes, code, context.devices[0], context)


def catalog(spark: SparkSession, allocations: Sequence[Allocation], context: Context | None = None) -> DataFrame:
    """(alloc, nbytes, kind, device_id): metadata of allocations as seen from a context."""
    rows = [(k, a.nbytes, a.usm_type(context), a.device) for k, a in enumerate(allocations)]
    return spark.createDataFrame(rows, "alloc long, nbytes long, kind string, device_id int")


def owners(allocations: DataFrame, devices: DataFrame) -> DataFrame:
    """(alloc, device_id, backend, device_type) of a catalog's allocations."""
    return allocations.select("alloc", "device_id").join(devices.select("device_id", "backend", "device_type"), "device_id")


def copy_from_device(dest: Allocation, src: Allocation) -> Allocation:
    """``dest`` with ``src`` over its start; across contexts as within one, as no step goes by the host."""
    transfer.checked_copy_to_host(dest.nbytes, src.nbytes)
    n = src.nbytes // dtype(src.code).width
    return Allocation(transfer.copy(dest.vector, src.vector, n, src.code), dest.kind, dest.nbytes, dest.code, dest.device, dest.context)


def copy_from_host(dest: Allocation, data: bytes) -> Allocation:
    transfer.checked_copy_to_host(dest.nbytes, len(data))
    return Allocation(transfer.copy_from_host(dest.vector, data), dest.kind, dest.nbytes, dest.code, dest.device, dest.context)


def copy_to_host(src: Allocation) -> bytes:
    """The bytes of a u1 allocation, of ``HOST_BYTES`` at most; larger ones are written (``save``)."""
    if src.code != "u1":
        raise TypeError("bytes come from u1 allocations")
    if src.nbytes > HOST_BYTES:
        raise ValueError("too large for the host; save it instead")
    return bytes(r["v"] for r in src.vector.orderBy("idx").collect())


def buffer(src: Allocation) -> memoryview:
    """A view of the bytes; memory of a device has none."""
    if src.kind == "device":
        raise TypeError("device memory has no buffer")
    return memoryview(copy_to_host(src))


def save(src: Allocation, path: str) -> None:
    """The vector as Parquet, its kind and dtype as columns, so the table says all."""
    src.vector.select("idx", "v", F.lit(src.kind).alias("kind"), F.lit(src.code).alias("code")).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, context: Context) -> Allocation:
    """What ``save`` wrote, in another session or context if need be."""
    rows = spark.read.parquet(path)
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.max("kind").alias("other"), F.min("code").alias("code")).first()
    if head["kind"] not in KINDS or head["kind"] != head["other"]:
        raise ValueError(f"bad kind {head['kind']!r}")
    return Allocation(rows.select("idx", "v"), head["kind"], head["n"] * dtype(head["code"]).width, head["code"], context.devices[0], context)
