"""Element types, their Spark types and promotion.

The order of PROMOTION decides the type of an operation on two arrays: the first
that either has. A complex single with a double gives a complex double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element types from the one that wins a promotion to the one that never does.
PROMOTION = ("c64", "c32", "f64", "f32", "f16", "u64", "s64", "u32", "s32", "u16", "s16", "u8", "s8", "b8")
#: Spark types. Unsigned types take the next wider one.
SPARK = {
    "f16": "float", "f32": "float", "f64": "double", "b8": "boolean", "s8": "tinyint", "u8": "smallint", "s16": "smallint", "u16": "int",
    "s32": "int", "u32": "bigint", "s64": "bigint", "u64": "decimal(20,0)", "c32": "struct<re: float, im: float>", "c64": "struct<re: double, im: double>",
}
SIZES = {"f16": 2, "f32": 4, "f64": 8, "b8": 1, "s8": 1, "u8": 1, "s16": 2, "u16": 2, "s32": 4, "u32": 4, "s64": 8, "u64": 8, "c32": 8, "c64": 16}
BITS = {"s8": 8, "u8": 8, "s16": 16, "u16": 16, "s32": 32, "u32": 32, "s64": 64, "u64": 64}
#: Types of sums and products of narrow types.
SUMS = {"s8": "s32", "s16": "s32", "u8": "u32", "u16": "u32", "b8": "u32", "f16": "f32"}


def promote(a: str, b: str) -> str:
    if {a, b} == {"c32", "f64"}:
        return "c64"
    return min(a, b, key=PROMOTION.index)


def sum_type(dtype: str) -> str:
    return SUMS.get(dtype, dtype)


def mean_type(dtype: str) -> str:
    """Means of integers are single, of 64-bit ones double."""
    return {"s64": "f64", "u64": "f64", "f16": "f32"}.get(dtype, dtype if dtype[0] in "fc" else "f32")


def is_complex(dtype: str) -> bool:
    return dtype[0] == "c"


def is_integer(dtype: str) -> bool:
    return dtype[0] in "su"


def is_floating(dtype: str) -> bool:
    return dtype[0] in "fc"


def cast(x: Column, source: str, target: str) -> Column:
    """x of one element type as another: complex to real takes the magnitude, anything to b8 is x != 0, floats lose their
    fraction, and integers wrap around. Of a float beyond 64 bits the nearest 64-bit number is wrapped, so that infinity is -1
    as s32; NaN is 0."""
    if is_complex(source):
        if is_complex(target):
            part = SPARK[target].split("re: ")[1].split(",")[0]
            return F.struct(x["re"].cast(part).alias("re"), x["im"].cast(part).alias("im"))
        x, source = F.hypot(x["re"], x["im"]), "f64"
    if is_complex(target):
        part = SPARK[target].split("re: ")[1].split(",")[0]
        return F.struct(x.cast(part).alias("re"), F.lit(0).cast(part).alias("im"))
    if target == "b8":
        return x.cast("double") != 0
    if source == "b8":
        x = x.cast("int")
    if is_integer(target):
        bits = BITS[target]
        if is_floating(source):
            # a double's nearest bounds within 64 bits; beyond them Spark's cast raises an error
            near = F.when(F.isnan(x), F.lit(0.0)).when(x >= 2.0**63, F.lit(None)).when(x < -(2.0**63), F.lit(-(2.0**63))).otherwise(x)
            whole = F.when(~F.isnan(x) & (x >= 2.0**63), F.lit((1 << 63) - 1)).otherwise(near.cast("long"))
        else:
            whole = x
        if bits == 64:
            return whole.cast(SPARK[target])
        span = F.lit(1 << bits).cast("long")
        wrapped = F.pmod(whole.cast("long"), span)
        if target[0] == "s":
            wrapped = F.when(wrapped >= F.lit(1 << (bits - 1)), wrapped - span).otherwise(wrapped)
        return wrapped.cast(SPARK[target])
    return x.cast(SPARK[target])
