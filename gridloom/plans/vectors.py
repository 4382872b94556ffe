"""Queries V01 to V28: vectors and multivectors."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import vectors as V
from .registry import query

#: Row arrays: the embeddings, as whole numbers.
ROWS = "SELECT vec_id AS i, embedding AS e FROM embeddings"
#: The same, an entry a row, for DuckDB.
ENTRIES = "SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, floor(CAST(embedding[k] AS DOUBLE) * 1000) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)"


def rows(in_):
    return in_(ROWS).select("i", F.transform("e", lambda v: F.floor(v.cast("double") * 1000).cast("double")).alias("x"))


def entries(in_):
    return rows(in_).select("i", F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def spread(df, *arrays):
    """Arrays of equal length, an entry a row."""
    return df.select("i", F.posexplode(F.arrays_zip(*arrays)).alias("j", "z")).select("i", F.col("j").cast("long").alias("j"), *(F.col(f"z.{a}").alias(a) for a in arrays))


@query("V01_abs", "SELECT i, abs(v) AS v FROM {SX}")
def _(in_):
    return V.abs_(in_.SX)


@query("V02_axpby", "SELECT i, 2 * x.v + 3 * y.v AS v FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.axpby(2.0, in_.X, 3.0, in_.Y)


@query("V02_axpby_columns", "SELECT coalesce(p.i, q.i) AS i, coalesce(p.j, q.j) AS j, coalesce(p.v, 0) * coalesce(p.j, q.j) + 2 * coalesce(q.v, 0) AS v FROM {PM} p FULL JOIN {PN} q ON p.i = q.i AND p.j = q.j")
def _(in_):
    return V.axpby([float(k) for k in range(8)], in_.PM, 2.0, in_.PN)


@query("V03_axpy", "SELECT i, 2 * x.v + y.v AS v FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.axpy(2.0, in_.X, in_.Y)


@query("V04_serial_axpy", f"SELECT i, j, 3 * v + v * v AS v FROM ({ENTRIES})")
def _(in_):
    r = rows(in_).withColumn("y", E.arr_mult("x", "x"))
    return spread(r.select("i", E.arr_axpy(3.0, "x", "y").alias("v")), "v")


@query("V05_dot", "SELECT sum(x.v * y.v) AS v FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.dot(in_.X, in_.Y)


@query("V06_dot_columns", "SELECT p.j, sum(p.v * q.v) AS v FROM {PM} p JOIN {PN} q ON p.i = q.i AND p.j = q.j GROUP BY p.j")
def _(in_):
    return V.dot(in_.PM, in_.PN)


@query("V06_dot_vector_columns", "SELECT p.j, sum(p.v * s.v) AS v FROM {PM} p JOIN {S} s ON p.i = s.i GROUP BY p.j")
def _(in_):
    return V.dot(in_.PM, in_.S)


@query("V07_fill", "SELECT i, CAST(7.5 AS DOUBLE) AS v FROM {X}")
def _(in_):
    return V.fill(in_.X, 7.5)


@query("V08_iamax", "SELECT min(i) + 1 AS at FROM {SX} WHERE abs(v) = (SELECT max(abs(v)) FROM {SX})")
def _(in_):
    return V.iamax(in_.SX)


@query("V08_iamax_columns", "SELECT p.j, min(p.i) + 1 AS at FROM {PM} p JOIN (SELECT j, max(abs(v)) AS m FROM {PM} GROUP BY j) q ON p.j = q.j AND abs(p.v) = q.m GROUP BY p.j")
def _(in_):
    return V.iamax(in_.PM)


@query("V09_mult", "SELECT p.i, p.j, 2 * p.v + 3 * s.v * p.v AS v FROM {PM} p JOIN {S} s ON s.i = p.i")
def _(in_):
    return V.mult(2.0, in_.PM, 3.0, in_.S, in_.PM)


@query("V10_nrm1", "SELECT sum(abs(v)) AS v FROM {SX}")
def _(in_):
    return V.nrm1(in_.SX)


@query("V10_nrm1_complex", "SELECT sum(abs(x.v) + abs(y.v)) AS v FROM {SX} x JOIN {Y} y USING (i)")
def _(in_):
    return V.nrm1(V.paired(in_.SX, in_.Y).selectExpr("i", "x as re", "y as im"))


@query("V11_nrm2", f"SELECT j, round(sqrt(sum(v * v)), 6) AS v FROM ({ENTRIES}) GROUP BY j")
def _(in_):
    return V.nrm2(entries(in_)).withColumn("v", F.round("v", 6))


@query("V12_serial_nrm2", f"SELECT i, round(sqrt(sum(v * v)), 6) AS v FROM ({ENTRIES}) GROUP BY i")
def _(in_):
    return rows(in_).select("i", F.round(E.arr_nrm2("x"), 6).alias("v"))


@query("V13_nrm2_squared", "SELECT sum(v * v) AS v FROM {Y}")
def _(in_):
    return V.nrm2_squared(in_.Y)


@query("V14_nrm2w", "SELECT round(sqrt(sum((x.v / w.v) * (x.v / w.v))), 6) AS v FROM {X} x JOIN {W2} w USING (i)")
def _(in_):
    return V.nrm2w(in_.X, in_.W2).withColumn("v", F.round("v", 6))


@query("V15_nrm2w_squared", "SELECT sum((x.v / w.v) * (x.v / w.v)) AS v FROM {X} x JOIN {W2} w USING (i)")
def _(in_):
    return V.nrm2w_squared(in_.X, in_.W2)


@query("V16_nrminf", f"SELECT j, max(abs(v)) AS v FROM ({ENTRIES}) GROUP BY j")
def _(in_):
    return V.nrminf(entries(in_))


@query("V17_reciprocal", "SELECT i, 1 / v AS v FROM {N}")
def _(in_):
    return V.reciprocal(in_.N)


@query("V18_rot", "SELECT i, 3 * x.v + 4 * y.v AS x, 3 * y.v - 4 * x.v AS y FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.rot(V.paired(in_.X, in_.Y), 3.0, 4.0)


@query(
    "V19_rotg",
    """WITH t AS (SELECT i, x.v AS a, y.v AS b FROM {SX} x JOIN {Y} y USING (i)),
u AS (SELECT *, sqrt(a * a + b * b) * CASE WHEN (CASE WHEN abs(a) > abs(b) THEN a ELSE b END) < 0 THEN -1 ELSE 1 END AS r FROM t),
w AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE a / r END AS c, CASE WHEN r = 0 THEN 0 ELSE b / r END AS s FROM u)
SELECT i, round(r, 6) AS r, round(c, 6) AS c, round(s, 6) AS s,
       round(CASE WHEN r = 0 THEN 0 WHEN abs(a) > abs(b) THEN s WHEN c <> 0 THEN 1 / c ELSE 1 END, 6) AS z FROM w""",
)
def _(in_):
    out = V.rotg(V.paired(in_.SX, in_.Y).selectExpr("i", "x as a", "y as b"))
    return out.select("i", *(F.round(c, 6).alias(c) for c in "rcsz"))


@query("V20_rotm", "SELECT i, x.v + 2 * y.v AS x, 3 * x.v + y.v AS y FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.rotm(V.paired(in_.X, in_.Y), [0, 9, 3, 2, 9])


@query("V21_rotmg", "SELECT i, CAST(0 AS DOUBLE) AS made_zero, CAST(0 AS DOUBLE) AS norm_error FROM {X} x JOIN {W} y USING (i)")
def _(in_):
    """The rotation makes the second component zero, and keeps d1 x1^2 + d2 y1^2."""
    pairs = V.paired(in_.X, in_.W).selectExpr("i", "cast(1 + i % 5 as double) d1", "cast(1 + i % 3 as double) d2", "x + 1 as x1", "y as y1")
    p = V.rotmg(pairs)
    flag, h = F.get("param", F.lit(0)), [F.get("param", F.lit(k)) for k in range(5)]
    h11 = F.when(flag == 0, 1.0).otherwise(h[1])
    h21 = F.when(flag == 1, -1.0).otherwise(h[2])
    h12 = F.when(flag == 1, 1.0).otherwise(h[3])
    h22 = F.when(flag == 0, 1.0).otherwise(h[4])
    x, y = h11 * F.col("x1") + h12 * F.col("y1"), h21 * F.col("x1") + h22 * F.col("y1")
    # The new weights are the old ones over the transformation's determinant, exchanged for flag 1.
    det = h11 * h22 - h12 * h21
    new_d1 = F.when(flag == 1, F.col("d2")).otherwise(F.col("d1")) / det
    before = F.col("d1") * F.col("x1") ** 2 + F.col("d2") * F.col("y1") ** 2
    return p.select("i", F.round(F.abs(y), 6).alias("made_zero"), F.round(F.abs(new_d1 * x**2 - before) / before, 6).alias("norm_error"))


@query("V22_scal", "SELECT i, j, v * j AS v FROM {PM}")
def _(in_):
    return V.scal([float(k) for k in range(8)], in_.PM)


@query("V23_array_scale", f"SELECT i, j, v * 2.5 AS v FROM ({ENTRIES})")
def _(in_):
    return spread(rows(in_).select("i", E.arr_scal(2.5, "x").alias("v")), "v")


@query("V24_array_set", f"SELECT i, j, CAST(2.5 AS DOUBLE) AS v FROM ({ENTRIES})")
def _(in_):
    return spread(rows(in_).select("i", E.arr_set(2.5, "x").alias("v")), "v")


@query("V25_sum", "SELECT j, sum(v) AS v FROM {PM} GROUP BY j")
def _(in_):
    return V.sum_(in_.PM)


@query("V26_swap", "SELECT i, y.v AS x, x.v AS y FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    return V.paired(*V.swap(in_.X, in_.Y))


@query("V27_update", "SELECT i, 2 * x.v + 3 * y.v + 4 * w.v AS v FROM {X} x JOIN {Y} y USING (i) JOIN {W} w USING (i)")
def _(in_):
    return V.update(2.0, in_.X, 3.0, in_.Y, 4.0, in_.W)


@query("V28_team_kernels", f"SELECT i, sum(abs(v)) AS a, sum(2 * v + 3 * v * v) AS b, sum(v * v * v) AS d, round(sqrt(sum(v * v)), 6) AS n, sum(v * 4) AS s FROM ({ENTRIES}) GROUP BY i")
def _(in_):
    r = rows(in_).withColumn("y", E.arr_mult("x", "x"))
    return r.select(
        "i", E.arr_sum(F.transform("x", lambda v: F.abs(v))).alias("a"), E.arr_sum(E.arr_axpby(2.0, "x", 3.0, "y")).alias("b"),
        E.arr_dot("x", "y").alias("d"), F.round(E.arr_nrm2("x"), 6).alias("n"), E.arr_sum(E.arr_scal(4.0, "x")).alias("s"),
    )


def complex_of(a, b):
    return a.select("i", F.col("v").alias("re")).join(b.select("i", F.col("v").alias("im")), "i").select("i", F.struct("re", "im").alias("z"))


@query("V01_abs_complex", "SELECT i, round(sqrt(x.v * x.v + y.v * y.v), 6) AS v FROM {SX} x JOIN {Y} y USING (i)")
def _(in_):
    return V.abs_complex(complex_of(in_.SX, in_.Y)).withColumn("v", F.round("v", 6))


@query("V03_axpy_complex", "SELECT i, 2 * x.v - 3 * y.v + y.v AS re, 3 * x.v + 2 * y.v + x.v AS im FROM {SX} x JOIN {Y} y USING (i)")
def _(in_):
    return V.axpy_complex((2.0, 3.0), complex_of(in_.SX, in_.Y), complex_of(in_.Y, in_.SX)).select("i", "z.re", "z.im")


@query("V05_dot_complex", "SELECT sum(x.v * y.v + y.v * x.v) AS re, sum(x.v * x.v - y.v * y.v) AS im FROM {SX} x JOIN {Y} y USING (i)")
def _(in_):
    return V.dot_complex(complex_of(in_.SX, in_.Y), complex_of(in_.Y, in_.SX))


@query("V11_nrm2_complex", "SELECT round(sqrt(sum(x.v * x.v + y.v * y.v)), 6) AS v FROM {SX} x JOIN {Y} y USING (i)")
def _(in_):
    return V.nrm2_complex(complex_of(in_.SX, in_.Y)).withColumn("v", F.round("v", 6))
