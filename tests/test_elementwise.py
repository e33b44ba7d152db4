import math

import numpy as np
import pytest

from skeinframe import dtypes
from skeinframe.functions import elementwise as E
from pyspark.sql import functions as F

VALUES = [-3.7, -2.5, -1.0, -0.3, -0.0, 0.0, 0.2, 0.5, 1.0, 1.9, 2.5, 3.0, 7.3, 26.0]


def column(spark, f, values=VALUES):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("f", "g"), [(E.erf, math.erf), (E.erfc, math.erfc), (E.sigmoid, lambda x: 1 / (1 + math.exp(-x))), (E.trunc, math.trunc), (E.floor, math.floor), (E.ceil, math.ceil), (E.pow2, lambda x: 2.0**x), (E.cbrt, np.cbrt), (E.expm1, math.expm1), (E.sign, lambda x: int(math.copysign(1, x) < 0))])
def test_functions(spark, f, g):
    assert column(spark, f) == pytest.approx([float(g(v)) for v in VALUES], rel=1e-12, abs=1e-300)


def test_gamma(spark):
    values = [-3.5, -1.2, 0.1, 0.5, 1.0, 2.0, 3.7, 10.0, 30.5, 100.0, 171.0]
    assert column(spark, E.tgamma, values) == pytest.approx([math.gamma(v) for v in values], rel=1e-12)
    assert column(spark, E.lgamma, values) == pytest.approx([math.lgamma(v) for v in values], rel=1e-11, abs=1e-12)
    assert column(spark, E.factorial, [0, 1, 5, 20]) == [1, 1, 120, math.factorial(20)]
    assert math.isinf(column(spark, E.lgamma, [0.0])[0]) and math.isnan(column(spark, E.tgamma, [-2.0])[0])


def test_ieee_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("y")).first()["y"]
    nan, inf = float("nan"), float("inf")
    assert one(E.div(1.0, 0.0)) == inf and one(E.div(-1.0, 0.0)) == -inf and math.isnan(one(E.div(0.0, 0.0))) and one(E.div(1.0, F.lit(-0.0))) == -inf
    assert one(E.log(0.0)) == -inf and math.isnan(one(E.log(-1.0))) and one(E.log1p(-1.0)) == -inf
    assert not one(E.eq(F.lit(nan), F.lit(nan))) and one(E.neq(F.lit(nan), 1.0)) and not one(E.gt(F.lit(nan), 1.0)) and not one(E.le(F.lit(nan), 1.0))
    assert one(E.round_(2.5)) == 3 and one(E.round_(-2.5)) == -3 and one(E.rem(F.lit(5.0), 3.0)) == -1.0 and one(E.mod(F.lit(-7.0), 3.0)) == -1.0
    assert one(E.idiv(7, 2)) == 3 and one(E.idiv(-7, 2)) == -3 and one(E.idiv(7, 0)) is None
    assert one(E.maxof(F.lit(nan), F.lit(1.0))) == 1.0 and one(E.minof(F.lit(nan), F.lit(1.0))) == 1.0
    assert one(E.logical_and(F.lit(nan), 1)) and one(E.root(2.0, 9.0)) == 3.0 and one(E.shiftr(F.lit(-8), 1)) == -4


def test_complex(spark):
    z, w = 1.5 - 2.0j, -0.5 + 1.0j
    one = lambda c: complex(*spark.range(1).select(c.alias("y")).first()["y"])
    a, b = E.cplx(z.real, z.imag), E.cplx(w.real, w.imag)
    for f, g in ((E.cmul, z * w), (E.cdiv, z / w), (E.cadd, z + w), (E.csub, z - w), (E.cpow, z**w)):
        assert one(f(a, b)) == pytest.approx(g)
    for f, g in ((E.cexp, np.exp(z)), (E.clog, np.log(z)), (E.csqrt, np.sqrt(z)), (E.csin, np.sin(z)), (E.ccos, np.cos(z)), (E.conjg, z.conjugate())):
        assert one(f(a)) == pytest.approx(g)


def test_promotion_and_casts(spark):
    assert dtypes.promote("u64", "s64") == "u64" and dtypes.promote("s64", "f32") == "f32" and dtypes.promote("c32", "f64") == "c64" and dtypes.promote("b8", "s8") == "s8"
    one = lambda c: spark.range(1).select(c.alias("y")).first()["y"]
    assert one(dtypes.cast(F.lit(-3.9), "f64", "s32")) == -3 and one(dtypes.cast(F.lit(300), "s32", "u8")) == 44 and one(dtypes.cast(F.lit(200), "s32", "s8")) == -56
    assert one(dtypes.cast(F.lit(0.5), "f64", "b8")) and one(dtypes.cast(E.cplx(3.0, 4.0), "c64", "f64")) == 5.0
