"""Queries K01 to K34 and D08 to D11: small systems, one for each supplier.

A system is the normal equations of its line items (1, quantity, line number), symmetric and positive
definite, with whole numbers. Factorizations are checked by their product, solutions by the residual.
"""

import numpy as np
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import batched as B
from ..operators import kernels as K
from .registry import query
from .vectors import ENTRIES, rows, spread

ITEMS = "SELECT l_suppkey AS b, CAST(1 AS DOUBLE) AS f0, CAST(l_quantity AS DOUBLE) AS f1, CAST(l_linenumber AS DOUBLE) AS f2, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS y FROM lineitem"
#: Entries of the systems for DuckDB: (b, i, j, v), and the right sides (b, i, v).
SYS = f"(SELECT b, i, j, sum((CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END) * (CASE j WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END)) AS v FROM ({ITEMS}), (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j) GROUP BY b, i, j)"
RHS = f"(SELECT b, i, sum(y * (CASE i WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END)) AS v FROM ({ITEMS}), (SELECT unnest(range(3)) AS i) GROUP BY b, i)"
MAT = f"SELECT b, i, j, v FROM {SYS}"
VEC = f"SELECT b, i, v FROM {RHS}"


def systems(in_):
    """b, a (3 x 3), y (3)."""
    f = [F.col(f"f{k}") for k in range(3)]
    sums = in_(ITEMS).groupBy("b").agg(*(F.sum(f[i] * f[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)), *(F.sum(f[i] * F.col("y")).alias(f"y{i}") for i in range(3)))
    a = F.array(*(F.array(*(F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3))) for i in range(3)))
    return sums.select("b", a.alias("a"), F.array("y0", "y1", "y2").alias("y"))


def rounded(df, digits=3):
    return df.withColumn("v", F.round("v", digits) + 0.0)


def checked(in_, make, inputs=("a",)):
    """What the kernel makes of the systems: a matrix or vector for each, an entry a row, rounded."""
    s = systems(in_)
    sample = make(*(np.eye(3)[None] if i == "a" else np.ones((1, 3)) for i in inputs))
    out = B.apply(s, list(inputs), {"out": B.MATRIX if sample.ndim == 3 else B.VECTOR}, make)
    return rounded(B.unpack(out.select("b", "out"), "b", "out"))


def arrays(in_):
    return rows(in_).withColumn("y", F.reverse("x"))


PAIRS = f"(SELECT m.i, m.j, m.v AS x, w.v AS y FROM ({ENTRIES}) m JOIN ({ENTRIES}) w ON w.i = m.i AND w.j = 63 - m.j)"


@query("K01_axpy", f"SELECT i, j, 2 * x + y AS v FROM {PAIRS}")
def _(in_):
    return spread(arrays(in_).select("i", E.arr_axpy(2.0, "x", "y").alias("v")), "v")


@query("K02_xpay", f"SELECT i, j, x + 2 * y AS v FROM {PAIRS}")
def _(in_):
    return spread(arrays(in_).select("i", E.arr_axpby(1.0, "x", 2.0, "y").alias("v")), "v")


@query("K03_dot", f"SELECT i, sum(x * y) AS v FROM {PAIRS} GROUP BY i")
def _(in_):
    return arrays(in_).select("i", E.arr_dot("x", "y").alias("v"))


@query("K04_hadamard", f"SELECT i, j, x * y AS v FROM {PAIRS}")
def _(in_):
    return spread(arrays(in_).select("i", E.arr_mult("x", "y").alias("v")), "v")


@query("K05_copy_set_scale", f"SELECT i, sum(x) AS c, CAST(64 * 3 AS DOUBLE) AS s, sum(x * 4) AS t FROM {PAIRS} GROUP BY i")
def _(in_):
    return arrays(in_).select("i", E.arr_sum("x").alias("c"), E.arr_sum(E.arr_set(3.0, "x")).alias("s"), E.arr_sum(E.arr_scal(4.0, "x")).alias("t"))


@query("K06_identity_radial", f"SELECT b, i, j, CASE WHEN i = j THEN v + 0.5 ELSE v END AS v, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS one FROM {SYS}")
def _(in_):
    s = systems(in_).select("b", E.mat_add_radial(0.5, "a").alias("r"), E.mat_set_identity("a").alias("one"))
    return B.unpack(s, "b", "r").join(B.unpack(s, "b", "one").withColumnRenamed("v", "one"), ["b", "i", "j"])


@query("K07_iamax", f"SELECT i, min(j) AS at FROM (SELECT i, j, v, max(abs(v)) OVER (PARTITION BY i) AS m FROM ({ENTRIES})) WHERE abs(v) = m GROUP BY i")
def _(in_):
    return rows(in_).select("i", E.arr_iamax(F.col("x")).alias("at"))


@query("K08_lacgv", f"SELECT i, sum(x) AS re, -sum(y) AS im FROM {PAIRS} GROUP BY i")
def _(in_):
    z = arrays(in_).select("i", F.zip_with("x", "y", lambda a, b: E.cplx(a, b)).alias("z"))
    z = z.select("i", F.transform("z", lambda c: E.conj(c)).alias("z"))
    return z.select("i", E.arr_sum(F.transform("z", lambda c: c["re"])).alias("re"), E.arr_sum(F.transform("z", lambda c: c["im"])).alias("im"))


@query("K09_gemv", f"SELECT a.b, a.i, sum(a.v * y.v) AS v FROM {SYS} a JOIN {RHS} y ON y.b = a.b AND y.i = a.j GROUP BY a.b, a.i")
def _(in_):
    return B.unpack(systems(in_).select("b", E.mat_gemv("a", "y").alias("v")), "b", "v")


@query("K10_ger", f"SELECT a.b, a.i, a.j, a.v + 2 * p.v * q.v AS v FROM {SYS} a JOIN {RHS} p ON p.b = a.b AND p.i = a.i JOIN {RHS} q ON q.b = a.b AND q.i = a.j")
def _(in_):
    return B.unpack(systems(in_).select("b", E.mat_ger(2.0, "y", "y", "a").alias("v")), "b", "v")


_SQUARE = f"SELECT a.b, a.i, c.j, sum(a.v * c.v) AS v FROM {SYS} a JOIN {SYS} c ON c.b = a.b AND c.i = a.j GROUP BY a.b, a.i, c.j"


@query("K11_gemm", _SQUARE)
def _(in_):
    return B.unpack(B.apply(systems(in_), ["a"], {"v": B.MATRIX}, lambda a: a @ a), "b", "v")


@query("K11_gemm_arrays", _SQUARE)
def _(in_):
    return B.unpack(systems(in_).select("b", E.mat_gemm("a", "a").alias("v")), "b", "v")


@query("K12_batched_gemm", _SQUARE)
def _(in_):
    """As a join by system and inner index."""
    t = B.unpack(systems(in_).select("b", "a"), "b", "a")
    left, right = t.select("b", "i", F.col("j").alias("k"), F.col("v").alias("x")), t.select("b", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, ["b", "k"]).groupBy("b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


@query("K13_trmm", f"SELECT a.b, a.i, c.j, sum(2 * a.v * c.v) AS v FROM {SYS} a JOIN {SYS} c ON c.b = a.b AND c.i = a.j WHERE a.j <= a.i GROUP BY a.b, a.i, c.j")
def _(in_):
    return checked(in_, lambda a: K.trmm(a, a, alpha=2.0))


_UNIT = f"SELECT b, i, j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM {SYS}"


@query("K13_trtri", _UNIT)
def _(in_):
    return checked(in_, lambda a: K.trtri(a)[0] @ np.tril(a))


@query("K14_trsm", MAT)
def _(in_):
    return checked(in_, lambda a: np.tril(a) @ K.trsm(a, a))


@query("K14_trsm_right", MAT)
def _(in_):
    return checked(in_, lambda a: K.trsm(a, a, "U", side="R") @ np.triu(a))


@query("K15_trsv", VEC)
def _(in_):
    return checked(in_, lambda a, y: np.einsum("bij,bj->bi", np.triu(a), K.trsv(a, y, "U")), ("a", "y"))


@query("K16_tbsv", VEC)
def _(in_):
    return checked(in_, lambda a, y: np.einsum("bij,bj->bi", np.tril(np.triu(a, -1)), K.tbsv(K.full_to_band(np.tril(a), 1), y)), ("a", "y"))


@query("K17_lu", MAT)
def _(in_):
    return checked(in_, lambda a: np.matmul(*K.split_lu(K.lu(a))))


@query("K18_solve_lu", VEC)
def _(in_):
    def f(a, y):
        lu = K.lu(a)
        return np.einsum("bij,bj->bi", a, K.trsv(lu, K.trsv(lu, y, "L", "U"), "U"))

    return checked(in_, f, ("a", "y"))


@query("K18_inverse_lu", _UNIT)
def _(in_):
    return checked(in_, lambda a: K.inverse_lu(a) @ a)


@query("K19_getrf", MAT)
def _(in_):
    def f(a):
        lu, piv = K.getrf(a)
        return K.laswp(piv, np.matmul(*K.split_lu(lu)), False)

    return checked(in_, f)


@query("K19_getrs", VEC)
def _(in_):
    def f(a, y):
        lu, piv = K.getrf(a)
        return np.einsum("bij,bj->bi", a, K.getrs(lu, piv, y[:, :, None], "T")[:, :, 0])  # symmetric: the transposed solve too

    return checked(in_, f, ("a", "y"))


@query("K20_band_lu", VEC)
def _(in_):
    def f(a, y):
        n = a.shape[1]
        ab = np.zeros((len(a), 2 + 2 + 2 + 1, n))
        for d in range(-2, 3):
            j = np.arange(max(0, -d), min(n, n - d))
            ab[:, 4 + d, j] = a[:, j + d, j]
        lu, piv = K.gbtrf(ab, 2, 2)
        return np.einsum("bij,bj->bi", a, K.getrs(lu, piv, y[:, :, None])[:, :, 0])

    return checked(in_, f, ("a", "y"))


@query("K21_band_cholesky", VEC)
def _(in_):
    def f(a, y):
        fb = K.cholesky_band(K.full_to_band(np.triu(a), 2, "U"), "U")
        return np.einsum("bij,bj->bi", a, K.pbtrs(fb, y[:, :, None], "U")[:, :, 0])

    return checked(in_, f, ("a", "y"))


@query("K22_tridiagonal", VEC)
def _(in_):
    def f(a, y):
        d, e = np.diagonal(a, axis1=1, axis2=2) * 2, np.diagonal(a, -1, 1, 2) * 0.5
        x = K.pttrs(*K.pttrf(d, e), y)
        out = d * x
        out[:, 1:] += e * x[:, :-1]
        out[:, :-1] += e * x[:, 1:]
        return out

    return checked(in_, f, ("a", "y"))


@query("K23_pivots", f"SELECT b, i, j, v FROM (SELECT b, CAST(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS i, j, v FROM {SYS})")
def _(in_):
    """Row 0 with 2, then row 1 with 2."""
    return B.unpack(systems(in_).select("b", E.mat_permute_rows("a", F.array(F.lit(2), F.lit(2), F.lit(2))).alias("v")), "b", "v")


@query("K24_gesv", VEC)
def _(in_):
    return checked(in_, lambda a, y: np.einsum("bij,bj->bi", a, K.gesv(a, y[:, :, None], "static")[0][:, :, 0]), ("a", "y"))


@query("K24_gesv_fails", "SELECT CAST(1 AS BIGINT) AS static_info, CAST(0 AS BIGINT) AS partial_info")
def _(in_):
    """[[2, 1], [1, 0]] is beyond elimination with rows chosen beforehand, but has a solution."""
    s = in_.spark.createDataFrame([(0, [[2.0, 1.0], [1.0, 0.0]], [3.0, 1.0])], "b int, a array<array<double>>, y array<double>")

    def f(a, y):
        return np.stack([K.gesv(a, y[:, :, None], p)[1] for p in ("static", "partial")], 1).astype(float)

    return B.apply(s, ["a", "y"], {"info": B.VECTOR}, f).select(F.get("info", F.lit(0)).cast("long").alias("static_info"), F.get("info", F.lit(1)).cast("long").alias("partial_info"))


@query("K25_householder", f"SELECT b, i, CASE WHEN i = 0 THEN round(sqrt(q), 3) ELSE 0 END AS v FROM (SELECT b, i, sum(v * v) OVER (PARTITION BY b) AS q FROM {RHS})")
def _(in_):
    def f(y):
        v, tau, _ = K.householder(y)
        return np.abs(K.apply_householder(v, tau, y[:, :, None])[:, :, 0])

    return rounded(B.unpack(B.apply(systems(in_), ["y"], {"v": B.VECTOR}, f), "b", "v"), 3)


@query("K26_qr", MAT)
def _(in_):
    return checked(in_, lambda a: np.matmul(*K.qr(a)[:2]))


@query("K27_qr_pivoted", MAT)
def _(in_):
    def f(a):
        q, r, order, _ = K.qr(a, pivoted=True)
        out = np.zeros_like(a)
        out[np.arange(len(a))[:, None], :, order] = (q @ r).swapaxes(1, 2)
        return out

    return checked(in_, f)


@query("K27_solve_utv", VEC)
def _(in_):
    """A matrix of rank two: the right side is in its range, so the least-squares solution meets it."""

    def f(a, y):
        low = a.copy()
        low[:, 2] = low[:, 0] + low[:, 1]
        low[:, :, 2] = low[:, :, 0] + low[:, :, 1]
        right = y.copy()
        right[:, 2] = y[:, 0] + y[:, 1]
        u, t, v, rank = K.utv(low)
        assert (rank == 2).all()
        got = np.einsum("bij,bj->bi", low, K.solve_utv(u, t, v, rank, right[:, :, None])[:, :, 0])
        return np.concatenate([got[:, :2], y[:, 2:]], 1)

    return checked(in_, f, ("a", "y"))


@query("K28_eigen", MAT)
def _(in_):
    """Right vectors times values times the left vectors, transposed."""

    def f(a):
        re, im, right, left = K.eig(a)
        return ((right * (re + 1j * im)[:, None]) @ left.swapaxes(1, 2)).real

    return checked(in_, f)


@query("K29_svd", MAT)
def _(in_):
    def f(a):
        u, s, vt = K.svd(a)
        assert (np.diff(s, axis=1) <= 0).all()
        return (u * s[:, None]) @ vt

    return checked(in_, f)


@query("K30_packs", f"SELECT i, sum(CASE WHEN x < y THEN x ELSE y END) AS least, sum(CASE WHEN x > y THEN x ELSE y END) AS most, sum(CASE WHEN x > 0 THEN x ELSE y END) AS chosen FROM {PAIRS} GROUP BY i")
def _(in_):
    a = arrays(in_)
    return a.select("i", E.arr_sum(F.zip_with("x", "y", lambda x, y: F.least(x, y))).alias("least"), E.arr_sum(F.zip_with("x", "y", lambda x, y: F.greatest(x, y))).alias("most"), E.arr_sum(F.zip_with("x", "y", lambda x, y: F.when(x > 0, x).otherwise(y))).alias("chosen"))


@query("K31_batched_spmv", f"SELECT a.b, a.i, sum(a.v * y.v) AS v FROM {SYS} a JOIN {RHS} y ON y.b = a.b AND y.i = a.j WHERE abs(a.i - a.j) <= 1 GROUP BY a.b, a.i")
def _(in_):
    """A tridiagonal structure for all systems."""
    ptr, cols = [0, 2, 5, 7], np.array([0, 1, 0, 1, 2, 1, 2])
    return checked(in_, lambda a, y: K.csr_spmv(ptr, cols, a[:, np.repeat(np.arange(3), np.diff(ptr)), cols], y), ("a", "y"))


@query("K32_operators", f"SELECT y.b, y.i, round(y.v / a.v, 6) AS jacobi, y.v AS identity FROM {RHS} y JOIN {SYS} a ON a.b = y.b AND a.i = y.i AND a.j = y.i")
def _(in_):
    s = B.apply(systems(in_), ["a", "y"], {"v": B.VECTOR}, lambda a, y: y / np.diagonal(a, axis1=1, axis2=2))
    return B.unpack(s, "b", "v").select("b", "i", F.round("v", 6).alias("jacobi")).join(B.unpack(s.select("b", "y"), "b", "y").withColumnRenamed("v", "identity"), ["b", "i"])


@query("K33_cg", VEC)
def _(in_):
    return checked(in_, lambda a, y: np.einsum("bij,bj->bi", a, K.cg(a, y, y * 0, 1e-14)[0]), ("a", "y"))


@query("K34_gmres", VEC)
def _(in_):
    return checked(in_, lambda a, y: np.einsum("bij,bj->bi", a, K.gmres(a, y, y * 0, inverse_diagonal=1 / np.diagonal(a, axis1=1, axis2=2))[0]), ("a", "y"))


# One dense matrix: 25 x 25, diagonally dominant.

DENSE = "SELECT CAST(p.n_nationkey AS BIGINT) AS i, CAST(q.n_nationkey AS BIGINT) AS j, CAST((p.n_nationkey * 7 + q.n_nationkey * 3) % 11 + CASE WHEN p.n_nationkey = q.n_nationkey THEN 200 ELSE 0 END AS DOUBLE) AS v FROM nation p, nation q"


def one(in_, make):
    a = B.pack(in_(DENSE).withColumn("b", F.lit(0)), "b", "a")
    return rounded(B.unpack(B.apply(a, ["a"], {"v": B.MATRIX}, make), "b", "v").drop("b"), 6)


@query("D08_trsm", DENSE)
def _(in_):
    return one(in_, lambda a: np.tril(a) @ K.trsm(a, a))


@query("D09_gesv", DENSE)
def _(in_):
    return one(in_, lambda a: a @ K.gesv(a, a)[0] if not K.gesv(a, a)[1].any() else a * 0)


@query("D10_svd", DENSE)
def _(in_):
    return one(in_, lambda a: (lambda u, s, vt: (u * s[:, None]) @ vt)(*K.svd(a)))


@query("D10_svd_all", f"SELECT * FROM ({DENSE}) WHERE j < 10")
def _(in_):
    """All vectors of a matrix with more rows than columns; those beyond the shorter side take no part in the product."""
    return one(in_, lambda a: (lambda u, s, vt: (u[..., : s.shape[-1]] * s[:, None]) @ vt)(*K.svd(a[..., :10], "A", "A")))


@query("D10_svd_values", f"SELECT CAST(0 AS BIGINT) AS i, round(sum(v * v), 4) AS v FROM ({DENSE})")
def _(in_):
    """Singular values alone: the sum of their squares."""
    a = B.pack(in_(DENSE).withColumn("b", F.lit(0)), "b", "a")
    squares = B.apply(a, ["a"], {"v": B.VECTOR}, lambda a: (K.svd(a, "N", "N")[1] ** 2).sum(1, keepdims=True))
    return rounded(B.unpack(squares, "b", "v").drop("b"), 4)


@query("D11_trtri", "SELECT i, j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM (" + DENSE + ")")
def _(in_):
    return one(in_, lambda a: K.trtri(a, "U")[0] @ np.triu(a))
