"""Element types.  Integers keep their exact width: results are computed wide and wrapped, whatever the ANSI setting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    code: str
    width: int
    spark: str
    wide: str

    @property
    def signed(self) -> bool:
        return self.code[0] == "i"

    @property
    def integral(self) -> bool:
        return self.code[0] in "iu"


DTYPES = {
    d.code: d
    for d in (
        DType("i1", 1, "tinyint", "bigint"), DType("i2", 2, "smallint", "bigint"), DType("i4", 4, "int", "bigint"), DType("i8", 8, "bigint", "decimal(38,0)"),
        DType("u1", 1, "smallint", "bigint"), DType("u2", 2, "int", "bigint"), DType("u4", 4, "bigint", "decimal(38,0)"), DType("u8", 8, "decimal(20,0)", "decimal(38,0)"),
        DType("f4", 4, "float", "double"), DType("f8", 8, "double", "double"),
    )
}


def dtype(code: str) -> DType:
    if code not in DTYPES:
        raise ValueError(f"unsupported dtype {code!r}; expected one of {', '.join(DTYPES)}")
    return DTYPES[code]


def wide(value: Column, code: str) -> Column:
    """``value`` in a type that holds sums and small multiples of the dtype's values."""
    return value.cast(dtype(code).wide)


def wrap(value: Column, code: str) -> Column:
    """A wide integer cut to the dtype's width (two's complement), or a float rounded to it."""
    d = dtype(code)
    if not d.integral:
        return value.cast(d.spark)
    span = F.lit(str(2 ** (8 * d.width))).cast(d.wide)
    half = F.lit(str(2 ** (8 * d.width - 1))).cast(d.wide)
    return (F.pmod(value + half, span) - half if d.signed else F.pmod(value, span)).cast(d.spark)


def multiply(a: Column, b: Column, code: str) -> Column:
    """``a * b`` wrapped; u8 goes by 32-bit limbs, as its products exceed 38 digits."""
    if code != "u8":
        return wrap(wide(a, code) * wide(b, code), code)
    limb = F.lit(str(2**32)).cast("decimal(20,0)")
    x, y = wide(a, code), wide(b, code)
    x_low, y_low = F.pmod(x, limb), F.pmod(y, limb)
    x_high, y_high = ((x - x_low) / limb).cast("decimal(19,0)"), ((y - y_low) / limb).cast("decimal(19,0)")
    low = (x_low.cast("decimal(19,0)") * y_low.cast("decimal(19,0)")).cast("decimal(38,0)")
    cross = F.pmod((x_high * y_low.cast("decimal(19,0)")).cast("decimal(38,0)") + (x_low.cast("decimal(19,0)") * y_high).cast("decimal(38,0)"), limb)
    return wrap(low + (cross.cast("decimal(19,0)") * limb.cast("decimal(19,0)")).cast("decimal(38,0)"), code)
