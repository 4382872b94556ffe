"""Vectors and multivectors: element-wise updates, reductions, plane rotations.

Operators that combine vectors by a weighted sum are one union and one sum by index, which combines
before the shuffle; the others are equi-joins. A multivector's columns are told apart by j.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import cabs, cmul, conj, cplx, ieee_div, scaled

Coefficient = float | Sequence[float]


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("i", "j") if c in df.columns]


def _times(alpha: Coefficient, v: str = "v") -> Column:
    """One coefficient, or one for each column j."""
    if isinstance(alpha, (int, float)):
        return scaled(alpha, F.col(v))
    per = F.array(*(F.lit(float(a)) for a in alpha))
    a = F.get(per, F.col("j").cast("int"))
    return F.when(a == 0, 0.0).otherwise(a * F.col(v))


def combine(*terms: tuple[Coefficient, DataFrame]) -> DataFrame:
    """The weighted sum of vectors; what a vector lacks counts as zero."""
    keys = _keys(terms[0][1])
    parts = [x.select(*keys, _times(a).alias("v")) for a, x in terms]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("v").alias("v"))


def abs_(x: DataFrame) -> DataFrame:
    return x.withColumn("v", F.abs("v"))


def axpby(a: Coefficient, x: DataFrame, b: Coefficient, y: DataFrame) -> DataFrame:
    return combine((a, x), (b, y))


def axpy(a: Coefficient, x: DataFrame, y: DataFrame) -> DataFrame:
    return combine((a, x), (1.0, y))


def update(alpha: Coefficient, x: DataFrame, beta: Coefficient, y: DataFrame, gamma: Coefficient, z: DataFrame) -> DataFrame:
    return combine((alpha, x), (beta, y), (gamma, z))


def scal(a: Coefficient, x: DataFrame) -> DataFrame:
    return x.withColumn("v", _times(a))


def fill(x: DataFrame, value: float) -> DataFrame:
    return x.withColumn("v", F.lit(float(value)))


def reciprocal(x: DataFrame) -> DataFrame:
    return x.withColumn("v", ieee_div(F.lit(1.0), F.col("v")))


def mult(gamma: float, y: DataFrame, alpha: float, a: DataFrame, x: DataFrame) -> DataFrame:
    """gamma * y + alpha * a .* x; a is a vector, x and y may have columns."""
    keys = _keys(x)
    ax = x.join(a.withColumnRenamed("v", "w"), "i").select(*keys, (F.col("w") * F.col("v")).alias("v"))
    return combine((gamma, y), (alpha, ax))


def _summed(df: DataFrame, total: Column, name: str = "v") -> DataFrame:
    """Over all rows, or by column where there are columns."""
    return df.groupBy(*(["j"] if "j" in df.columns else [])).agg(total.alias(name))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of x * y by column. A vector goes with each column of a multivector. Only entries that both have count."""
    both = [k for k in _keys(x) if k in _keys(y)]
    joined = x.withColumnRenamed("v", "xv").join(y.withColumnRenamed("v", "yv"), both)
    return _summed(joined, F.coalesce(F.sum(F.col("xv") * F.col("yv")), F.lit(0.0)))


def iamax(x: DataFrame) -> DataFrame:
    """Index from 1 of the largest magnitude, the first of equal ones; 0 for an empty vector."""
    return _summed(x, F.coalesce(F.max_by(F.col("i") + 1, F.struct(F.abs("v"), -F.col("i"))), F.lit(0).cast("long")), "at")


def nrm1(x: DataFrame) -> DataFrame:
    """Sum of magnitudes; of a complex value (columns re, im) the two parts' magnitudes."""
    return _summed(x, F.coalesce(F.sum(F.abs("re") + F.abs("im") if "re" in x.columns else F.abs("v")), F.lit(0.0)))


def nrm2_squared(x: DataFrame) -> DataFrame:
    return _summed(x, F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)))


def nrm2(x: DataFrame) -> DataFrame:
    return nrm2_squared(x).withColumn("v", F.sqrt("v"))


def nrm2w_squared(x: DataFrame, w: DataFrame) -> DataFrame:
    keys = _keys(x)
    q = ieee_div(F.abs("v"), F.abs("w"))
    return _summed(x.join(w.withColumnRenamed("v", "w"), [k for k in keys if k in w.columns]), F.coalesce(F.sum(q * q), F.lit(0.0)))


def nrm2w(x: DataFrame, w: DataFrame) -> DataFrame:
    return nrm2w_squared(x, w).withColumn("v", F.sqrt("v"))


def nrminf(x: DataFrame) -> DataFrame:
    """Largest magnitude, 0 for none; NaN is passed over."""
    return _summed(x, F.coalesce(F.max(F.when(~F.isnan("v"), F.abs("v"))), F.lit(0.0)))


def sum_(x: DataFrame) -> DataFrame:
    return _summed(x, F.coalesce(F.sum("v"), F.lit(0.0)))


def swap(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return y, x


def paired(x: DataFrame, y: DataFrame) -> DataFrame:
    """i, x, y."""
    return x.select("i", F.col("v").alias("x")).join(y.select("i", F.col("v").alias("y")), "i")


def rot(xy: DataFrame, c: float, s: float) -> DataFrame:
    """The plane rotation of pairs (i, x, y)."""
    x, y = F.col("x"), F.col("y")
    return xy.select("i", (c * x + s * y).alias("x"), (c * y - s * x).alias("y"))


def rotg(ab: DataFrame) -> DataFrame:
    """Givens rotations of pairs (a, b): adds r, z, c, s."""
    a, b = F.col("a"), F.col("b")
    a_rules = F.abs(a) > F.abs(b)
    r = F.hypot(a, b) * F.when(F.when(a_rules, a).otherwise(b) < 0, -1.0).otherwise(1.0)
    out = ab.withColumn("r", r)
    none = F.col("r") == 0
    out = out.withColumn("c", F.when(none, 1.0).otherwise(ieee_div(a, F.col("r")))).withColumn("s", F.when(none, 0.0).otherwise(ieee_div(b, F.col("r"))))
    z = F.when(none, 0.0).when(a_rules, F.col("s")).when(F.col("c") != 0, ieee_div(F.lit(1.0), F.col("c"))).otherwise(1.0)
    return out.withColumn("z", z)


def rotm(xy: DataFrame, param: Sequence[float]) -> DataFrame:
    """The modified rotation of pairs (i, x, y). param: flag, h11, h21, h12, h22; the flag says which of them hold."""
    flag, h11, h21, h12, h22 = map(float, param)
    if flag == -2:
        return xy
    if flag == 0:
        h11 = h22 = 1.0
    elif flag == 1:
        h12, h21 = 1.0, -1.0
    elif flag != -1:
        raise ValueError(f"flag {flag}")
    x, y = F.col("x"), F.col("y")
    return xy.select("i", (h11 * x + h12 * y).alias("x"), (h21 * x + h22 * y).alias("y"))


def rotmg_params(d1: float, d2: float, x1: float, y1: float) -> tuple[list[float], float, float, float]:
    """(param, d1, d2, x1) of the modified rotation that makes the second component zero."""
    gam = 4096.0
    if d1 < 0:
        return [-1.0, 0.0, 0.0, 0.0, 0.0], 0.0, 0.0, 0.0
    p2 = d2 * y1
    if p2 == 0:
        return [-2.0, 0.0, 0.0, 0.0, 0.0], d1, d2, x1
    p1 = d1 * x1
    q1, q2 = p1 * x1, p2 * y1
    if abs(q1) > abs(q2):
        flag, h = 0.0, [1.0, -y1 / x1, p2 / p1, 1.0]
        u = 1 - h[2] * h[1]
        if u <= 0:
            return [-1.0, 0.0, 0.0, 0.0, 0.0], 0.0, 0.0, 0.0
        d1, d2, x1 = d1 / u, d2 / u, x1 * u
    else:
        if q2 < 0:
            return [-1.0, 0.0, 0.0, 0.0, 0.0], 0.0, 0.0, 0.0
        flag, h = 1.0, [p1 / p2, -1.0, 1.0, x1 / y1]
        u = 1 + h[0] * h[3]
        d1, d2, x1 = d2 / u, d1 / u, y1 * u
    for which in (0, 1):
        d = (d1, d2)[which]
        while d != 0 and not gam**-2 < abs(d) < gam**2:
            flag = -1.0
            up = abs(d) <= gam**-2
            d = d * gam**2 if up else d / gam**2
            factor = 1 / gam if up else gam
            rows = (0, 2) if which == 0 else (1, 3)
            for k in rows:
                h[k] *= factor
            if which == 0:
                x1 *= factor
        d1, d2 = (d, d2) if which == 0 else (d1, d)
    return [flag, *h], d1, d2, x1


def rotmg(df: DataFrame) -> DataFrame:
    """Adds param (array) to rows (d1, d2, x1, y1); the scaling loop has no built-in counterpart."""
    @F.pandas_udf("array<double>")
    def run(d1: pd.Series, d2: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([rotmg_params(*row)[0] for row in zip(d1, d2, x1, y1)])

    return df.withColumn("param", run("d1", "d2", "x1", "y1"))


# Complex values: z is a struct (re, im)


def abs_complex(x: DataFrame) -> DataFrame:
    return x.select("i", cabs(F.col("z")).alias("v"))


def axpy_complex(alpha: tuple[float, float], x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha * x + y."""
    a = cplx(F.lit(float(alpha[0])), F.lit(float(alpha[1])))
    parts = x.select("i", cmul(a, F.col("z")).alias("z")).unionByName(y.select("i", "z"))
    sums = parts.groupBy("i").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    return sums.select("i", cplx(F.col("re"), F.col("im")).alias("z"))


def dot_complex(x: DataFrame, y: DataFrame) -> DataFrame:
    """The sum of conj(x) * y."""
    p = x.select("i", F.col("z").alias("a")).join(y.select("i", F.col("z").alias("b")), "i").select(cmul(conj(F.col("a")), F.col("b")).alias("z"))
    return p.agg(F.coalesce(F.sum("z.re"), F.lit(0.0)).alias("re"), F.coalesce(F.sum("z.im"), F.lit(0.0)).alias("im"))


def nrm2_complex(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), F.lit(0.0))).alias("v"))
