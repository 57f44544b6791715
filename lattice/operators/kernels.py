"""Kernels: named functions from columns to columns, launched over a one- to three-dimensional index space.

A launch is a projection, so Catalyst fuses chains of launches into one stage.  Operands are columns of one frame where
possible; ``bind`` joins vectors that come from different tables on idx.
"""

from __future__ import annotations

import inspect
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions.dtypes import dtype


class InvalidRange(ValueError):
    """A range that isn't one to three positive sizes, or doesn't fit its local range."""


@dataclass(frozen=True)
class SpecConstant:
    """A constant folded into the plan when the bundle is built; compares by value."""

    spec_id: int
    value: bool | int | float | complex | bytes
    code: str = "i4"

    def __post_init__(self) -> None:
        if not 0 <= self.spec_id < 2**32:
            raise ValueError("spec_id must be an unsigned 32-bit number")
        if self.code != "?" and not self.code.startswith("V"):
            dtype(self.code)
        if isinstance(self.value, (bytes, bytearray)) and not self.value:
            raise ValueError("a constant of no bytes")

    def column(self) -> Column:
        """A literal; a complex value as (real, imag), bytes as they are."""
        if isinstance(self.value, (bytes, bytearray)):
            return F.lit(bytearray(self.value))
        kind = "boolean" if self.code == "?" else dtype(self.code).spark
        if isinstance(self.value, complex):
            return F.struct(F.lit(self.value.real).cast(kind).alias("real"), F.lit(self.value.imag).cast(kind).alias("imag"))
        return F.lit(self.value).cast(kind)


@dataclass(frozen=True)
class RawArg:
    """Bytes of a struct parameter, copied when made."""

    data: bytes
    layout: str | None = None
    names: tuple[str, ...] = ()

    def __init__(self, data: bytes | bytearray | memoryview, layout: str | None = None, names: Sequence[str] = ()) -> None:
        object.__setattr__(self, "data", bytes(data))
        object.__setattr__(self, "layout", layout)
        object.__setattr__(self, "names", tuple(names))

    def column(self) -> Column:
        """The fields as a struct, or the bytes if there is no layout."""
        return F.lit(bytearray(self.data)) if self.layout is None else self.unpack(self.layout, self.names)

    def unpack(self, layout: str, names: Sequence[str]) -> Column:
        values = struct.unpack(layout, self.data)
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])


@dataclass(frozen=True)
class LocalAccessor:
    """Scratch memory of a work-group: its element type and shape."""

    code: str
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        dtype(self.code)
        if not 1 <= len(self.shape) <= 3 or any(not isinstance(n, int) or n < 0 for n in self.shape):
            raise ValueError("shape must have one to three non-negative sizes")

    @property
    def size(self) -> int:
        return reduce(lambda a, b: a * b, self.shape, 1)

    def filled(self, value: Column, at: Column) -> Column:
        """What a group's memory holds after each item wrote ``value`` at ``at`` and a barrier: an array; of writes to one place the least stays."""
        of_group = Window.partitionBy("wg")
        slots = [F.min(F.when(at == k, value.cast(dtype(self.code).spark))).over(of_group) for k in range(self.size)]
        return F.array(*slots)


@dataclass(frozen=True)
class WorkGroupMemory:
    nbytes: int

    @classmethod
    def of(cls, code: str, count: int) -> WorkGroupMemory:
        return cls(dtype(code).width * count)

    def shared(self, value: Column) -> Column:
        """The sum of what the items of a group put into the memory, as each of them reads it after a barrier."""
        return group_sum(value, F.col("wg"))


@dataclass
class Bundle:
    """Named kernels, with the constants they were built with."""

    kernels: dict[str, Callable[..., Column]] = field(default_factory=dict)
    constants: dict[int, SpecConstant] = field(default_factory=dict)

    def kernel(self, f: Callable[..., Column]) -> Callable[..., Column]:
        self.kernels[f.__name__] = f
        return f

    def has(self, name: str) -> bool:
        return name in self.kernels

    @staticmethod
    def can_compile(language: str) -> bool:
        """Whether kernels can be built from a source language: from column functions only."""
        return language.strip().lower() == "column"

    def get(self, name: str) -> Callable[..., Column]:
        if name not in self.kernels:
            raise KeyError(f"no kernel {name!r}")
        return self.kernels[name]

    def num_args(self, name: str) -> int:
        return len(inspect.signature(self.get(name)).parameters)

    def specialize(self, *constants: SpecConstant) -> Bundle:
        return Bundle(self.kernels, self.constants | {c.spec_id: c for c in constants})

    def constant(self, spec_id: int, default: Column) -> Column:
        return self.constants[spec_id].column() if spec_id in self.constants else default


def check_range(global_size: Sequence[int], local_size: Sequence[int] | None = None) -> int:
    """The number of work items; raises unless the ranges are valid."""
    if not 1 <= len(global_size) <= 3 or any(g < 1 for g in global_size):
        raise InvalidRange("a range has one to three positive sizes")
    if local_size is not None:
        if len(local_size) != len(global_size):
            raise ValueError("local and global range differ in dimensions")
        if any(lo < 1 or g % lo for g, lo in zip(global_size, local_size, strict=True)):
            raise InvalidRange("the global range must be divisible by the local one")
    return reduce(lambda a, b: a * b, global_size, 1)


def index_space(spark: SparkSession, global_size: Sequence[int], local_size: Sequence[int] | None = None) -> DataFrame:
    """(idx, i0[, i1[, i2]][, wg]): row-major, last dimension fastest; wg numbers the work-groups."""
    return with_index(spark.range(check_range(global_size, local_size)).withColumnRenamed("id", "idx"), global_size, local_size)


def with_index(df: DataFrame, global_size: Sequence[int], local_size: Sequence[int] | None = None) -> DataFrame:
    check_range(global_size, local_size)
    below = 1
    dims = []
    for g in reversed(global_size):
        dims.append(F.expr(f"(idx div {below}) % {g}") if below > 1 else F.col("idx") % g)
        below *= g
    out = df.withColumns({f"i{k}": c.cast("bigint") for k, c in enumerate(reversed(dims))})
    if local_size is not None:
        groups = F.lit(0)
        for k, (g, lo) in enumerate(zip(global_size, local_size, strict=True)):
            groups = groups * (g // lo) + F.expr(f"i{k} div {lo}")
        out = out.withColumn("wg", groups.cast("bigint"))
    return out


def bind(base: DataFrame, **vectors: DataFrame) -> DataFrame:
    """``base`` with each vector (idx, v) as a column; equi-joins on idx."""
    for name, v in vectors.items():
        base = base.join(v.select("idx", F.col("v").alias(name)), "idx")
    return base


def launch(df: DataFrame, kernel: Callable[..., Column], *args: object, out: str = "c") -> DataFrame:
    """``df`` with ``out`` = kernel(args).

    Strings name columns, numbers are scalars, a struct argument with a layout is its fields.  Local memory reaches the kernel as the
    object itself, whose methods work over the work-groups in the column ``wg``.
    """
    return df.withColumn(out, kernel(*[_bound(a) for a in args]))


def _bound(a: object) -> object:
    if isinstance(a, str):
        return F.col(a)
    if isinstance(a, SpecConstant):
        return a.column()
    if isinstance(a, RawArg):
        return a.column()
    if isinstance(a, (Column, LocalAccessor, WorkGroupMemory)):
        return a
    if isinstance(a, (bool, int, float)):
        return F.lit(a)
    raise TypeError(f"a kernel takes no {type(a).__name__}")


def group_sum(value: Column, group: Column) -> Column:
    """A work-group's sum, told to all its items (local memory and a barrier)."""
    return F.sum(value).over(Window.partitionBy(group))
