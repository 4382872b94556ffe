"""Queries S04, S14 to S29, I07 and I08: triangular solves, factorizations, Krylov solvers, smoothers, generators.

Solutions are checked by their product with the matrix, factors by their product on the pattern.
"""

from pyspark.sql import functions as F

from ..operators import batched as B
from ..operators import graphs as G
from ..operators import krylov as K
from ..operators import matrices as M
from ..operators import triangular as T
from ..sources import generators as R
from ..store import Steps
from .registry import query

#: All parts on a square grid, as wide as their number needs, and the grid's matrix: diagonal 10, off it -1.
SIDE = "SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part"
POINTS = f"SELECT p_partkey AS i, p_partkey % side AS x, CAST(floor(p_partkey / side) AS BIGINT) AS y FROM part, ({SIDE}) n"
_NEAR = " UNION ALL ".join(f"SELECT i, x + {dx} AS u, y + {dy} AS w FROM ({POINTS}) p{k}" for k, (dx, dy) in enumerate([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]))
GRID = f"SELECT p.i, q.i AS j, CAST(CASE WHEN p.i = q.i THEN 10 ELSE -1 END AS DOUBLE) AS v FROM ({_NEAR}) p JOIN ({POINTS}) q ON q.x = p.u AND q.y = p.w"
RIGHT = f"SELECT i, CAST(1 + i % 7 AS DOUBLE) AS v FROM ({POINTS})"
ROWS = f"SELECT i FROM ({POINTS})"
#: Unit lower triangular: each part with those 500 and 700 before it.
LOW = "SELECT i, j, v FROM (SELECT p_partkey AS i, p_partkey AS j, CAST(1 AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, p_partkey - 500, CAST(2 AS DOUBLE) FROM part WHERE p_partkey >= 500 UNION ALL SELECT p_partkey, p_partkey - 700, CAST(3 AS DOUBLE) FROM part WHERE p_partkey >= 700)"


def kept(in_, text):
    """The input as a written table: solvers read theirs many times, and the grid's SQL has many scans."""
    return Steps(in_.spark, "input").keep("table", in_(text))


def rounded(df, digits=4):
    return df.select("i", (F.round("v", digits) + 0.0).alias("v"))


def back(in_, x, a=GRID, digits=4):
    """a x, which should be the right side."""
    return rounded(M.spmv(kept(in_, a), x, kept(in_, ROWS)), digits)


@query("S04_spmv_struct", f"SELECT a.i, sum(a.v * x.v) AS v FROM (SELECT i, j, CASE WHEN i = j THEN 4 ELSE -1 END AS v FROM ({GRID})) a JOIN ({RIGHT}) x ON x.i = a.j GROUP BY a.i")
def _(in_):
    """The grid's matrix by rule, on as many points as there are parts: the last line of a square may be short."""
    right = kept(in_, RIGHT)
    n, side = right.count(), in_(SIDE).first()["side"]
    a = R.grid_matrix(in_.spark, side, side, bounded=False).where((F.col("i") < n) & (F.col("j") < n))
    return M.spmv(a, right, n)


@query("S14_trsv", "SELECT i, v FROM {X}")
def _(in_):
    """The solution grows with the order, beyond what doubles hold: 1e23 with 20,000 parts."""
    low = in_(LOW)
    return rounded(T.exact_product(low, T.solve(low, in_.X, exact=True), in_.X))


@query("S14_trsv_transposed", "SELECT i, v FROM {X}")
def _(in_):
    low = in_(LOW)
    return rounded(T.exact_product(M.transpose(low), T.solve(low, in_.X, "L", "T", exact=True), in_.X))


@query("S15_levels", "SELECT i, 1 + i // 500 AS level FROM {X}")
def _(in_):
    return T.levels(in_(LOW), in_.X)


@query("S16_sptrsv", "SELECT i, v FROM {Y}")
def _(in_):
    """L then U = L^T: two solves."""
    low = in_(LOW)
    up = M.transpose(low).select("i", "j", "v")
    x = T.solve(up, T.solve(low, in_.Y, "L", unit=True, exact=True), "U", exact=True)
    return rounded(T.exact_product(low, T.exact_product(up, x, in_.Y, text=True), in_.Y))


@query("S17_supernodes", "SELECT i, least(i // 4, 23) + 1 AS node FROM (SELECT unnest(range(99)) AS i)")
def _(in_):
    r = in_.spark.range(100)
    a = r.select(F.col("id").alias("i"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("id") / 4) * 4 - 4), F.col("id"))).alias("j"))
    return T.supernodes(a)


_FILL = f"WITH a AS ({GRID}) SELECT i, j, min(level) AS level FROM (SELECT i, j, 0 AS level FROM a UNION ALL SELECT p.i, q.j, 1 FROM a p JOIN a q ON q.i = p.j WHERE p.j < p.i AND p.j < q.j) GROUP BY i, j"


@query("S18_iluk_symbolic", _FILL)
def _(in_):
    return T.fill_levels(kept(in_, GRID), 1)


@query("S19_iluk_numeric", f"SELECT f.i, f.j, coalesce(a.v, 0) AS v FROM ({_FILL}) f LEFT JOIN ({GRID}) a ON a.i = f.i AND a.j = f.j")
def _(in_):
    low, up = T.ilu(kept(in_, GRID), 1)
    ones = kept(in_, ROWS).select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    pattern = low.select("i", "j").unionByName(up.select("i", "j"))
    got = M.spgemm(low.unionByName(ones), up).join(pattern, ["i", "j"])
    return got.select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("S20_par_ilut", "SELECT TRUE AS better, TRUE AS unit_free")
def _(in_):
    """The residual falls below that of the plain triangles, and no diagonal is lost."""
    low, up, norms = T.par_ilut(kept(in_, GRID), kept(in_, ROWS), most=3)
    return up.where("i = j").agg((F.count("*") == kept(in_, ROWS).count()).alias("unit_free")).select(F.lit(bool(norms[-1] < norms[0])).alias("better"), "unit_free")


SYSTEMS = f"SELECT CAST(r_regionkey AS BIGINT) AS b, i, j, CASE WHEN i = j THEN v + r_regionkey ELSE v END AS v FROM region, ({GRID})"


@query("S21_mdf", SYSTEMS)
def _(in_):
    """Factors in the new order: their product is the matrix, on its pattern; the order is a permutation."""
    f = Steps(in_.spark, "factors").keep("f", T.mdf(in_(SYSTEMS)))  # read five times
    low = f.where("pi > pj").select("b", "i", F.col("pj").alias("k"), F.col("v").alias("x"))
    ones = f.where("pi = pj").select("b", "i", F.col("pi").alias("k"), F.lit(1.0).alias("x"))
    up = f.where("pi <= pj").select("b", F.col("pi").alias("k"), "j", F.col("v").alias("y"))
    product = low.unionByName(ones).join(up, ["b", "k"]).groupBy("b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    whole = f.groupBy("b").agg(F.countDistinct("pi").alias("n")).join(in_("SELECT count(*) AS parts FROM part")).where("n = parts").select("b")
    return product.join(f.select("b", "i", "j"), ["b", "i", "j"]).join(whole, "b").select("b", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


SKEW = f"SELECT i, j, CASE WHEN i = j THEN 4 * v WHEN i < j THEN 2 * v ELSE v END AS v FROM ({GRID})"


@query("S22_gmres", RIGHT)
def _(in_):
    r = K.gmres(kept(in_, SKEW), kept(in_, RIGHT), options=K.GmresOptions(restart=8, tolerance=1e-6))
    assert r.flag == "Conv"
    return back(in_, r.x, SKEW, 3)


@query("S23_preconditioners", RIGHT)
def _(in_):
    r = K.gmres(kept(in_, SKEW), kept(in_, RIGHT), K.Jacobi(kept(in_, SKEW)), K.GmresOptions(restart=8, tolerance=1e-6, ortho="MGS"))
    assert r.flag == "Conv"
    return back(in_, r.x, SKEW, 3)


@query("S23_lu_preconditioner", "SELECT i, v FROM {X}")
def _(in_):
    low = in_(LOW)
    up = M.transpose(low).select("i", "j", "v")
    x = K.LU(low, up, exact=True).apply(in_.X)
    return rounded(T.exact_product(low, T.exact_product(up, x, in_.X, text=True), in_.X))


@query("S24_smoother_setup", "SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored")
def _(in_):
    e = in_(f"SELECT i AS src, j AS dst FROM ({GRID}) WHERE i <> j")
    return G.conflicts(e, G.color(e, kept(in_, ROWS)))


RED_BLACK = f"SELECT i, (x + y) % 2 AS color FROM ({POINTS})"


@query("S25_gauss_seidel", RIGHT)
def _(in_):
    zero = kept(in_, RIGHT).withColumn("v", F.lit(0.0))
    return back(in_, K.gauss_seidel(kept(in_, GRID), kept(in_, RIGHT), zero, kept(in_, RED_BLACK), "symmetric", 1.0, 4), digits=2)


@query("S26_block_gauss_seidel", RIGHT)
def _(in_):
    zero = kept(in_, RIGHT).withColumn("v", F.lit(0.0))
    colors = in_(f"SELECT DISTINCT CAST(floor(i / 2) AS BIGINT) AS i, (CAST(floor(x / 2) AS BIGINT) + y) % 2 AS color FROM ({POINTS})")
    return back(in_, K.block_gauss_seidel(kept(in_, GRID), kept(in_, RIGHT), zero, 2, colors, sweeps=4), digits=2)


DYADIC = f"SELECT i, j, CASE WHEN i = j THEN CAST(8 AS DOUBLE) ELSE v END AS v FROM ({GRID})"
_X1 = f"SELECT i, v / 16 AS v FROM ({RIGHT})"


@query("S27_jacobi", f"WITH a AS ({DYADIC}), b AS ({RIGHT}), x AS ({_X1}) SELECT x.i, x.v + (b.v - s.v) / 16 AS v FROM x JOIN b ON b.i = x.i JOIN (SELECT a.i, sum(a.v * x.v) AS v FROM a JOIN x ON x.i = a.j GROUP BY a.i) s ON s.i = x.i")
def _(in_):
    """Two damped sweeps from zero; every value is a dyadic fraction."""
    zero = kept(in_, RIGHT).withColumn("v", F.lit(0.0))
    return K.jacobi(kept(in_, DYADIC), kept(in_, RIGHT), zero, 0.5, 2)


@query("S27_two_stage", RIGHT)
def _(in_):
    zero = kept(in_, RIGHT).withColumn("v", F.lit(0.0))
    x = zero
    for _ in range(3):  # a table a sweep keeps the plan short
        x = K.Steps(in_.spark, "two-stage").keep("x", K.two_stage(kept(in_, GRID), kept(in_, RIGHT), x, 1, 2, direction="symmetric"))
    return back(in_, x, digits=1)


@query("S28_sor", f"SELECT i, CAST(0 AS DOUBLE) AS v FROM ({ROWS})")
def _(in_):
    """The coloured sweep against the row-by-row one in the colours' order."""
    zero = kept(in_, RIGHT).withColumn("v", F.lit(0.0))
    x = K.gauss_seidel(kept(in_, GRID), kept(in_, RIGHT), zero, kept(in_, RED_BLACK), "forward", 1.2, 2)
    y = K.sor_in_order(kept(in_, GRID), kept(in_, RIGHT), kept(in_, RED_BLACK).select("i", F.struct("color", "i").alias("place")), 1.2, 2)
    return x.join(y.withColumnRenamed("v", "w"), "i").select("i", F.round(F.abs(F.col("v") - F.col("w")), 9).alias("v"))


@query("S29_pcg", RIGHT)
def _(in_):
    r = K.pcg(kept(in_, GRID), kept(in_, RIGHT), K.Jacobi(kept(in_, GRID)), 1e-6)
    assert r.flag == "Conv"
    return back(in_, r.x, digits=3)


@query("I07_random_matrix", "WITH e AS (SELECT i, i * 4 + k AS h0 FROM (SELECT unnest(range(1000)) AS i), (SELECT unnest(range(4)) AS k)), h AS (SELECT i, ((h0 + 13718) * 2654435761) % 4294967296 AS h FROM e), p AS (SELECT i, (i + (h // 128) % 41 - 20) AS q, h % 100 AS v FROM h) SELECT i, (q % 1000 + 1000) % 1000 AS j, CAST(max(v) AS DOUBLE) AS v FROM p GROUP BY 1, 2")
def _(in_):
    return R.random_matrix(in_.spark, 1000, 1000, 4, 20)


@query("I07_dominant_matrix", "SELECT TRUE AS dominant, CAST(1000 AS BIGINT) AS n")
def _(in_):
    a = R.dominant_matrix(in_.spark, 1000, 4, 20)
    each = a.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0)).alias("d"), F.sum(F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)).alias("s"))
    return each.agg(F.bool_and(F.col("d") > F.col("s")).alias("dominant"), F.count("*").alias("n"))


@query("I07_triangular_matrix", "SELECT TRUE AS lower, CAST(1000 AS BIGINT) AS diagonals")
def _(in_):
    return R.triangular_matrix(in_.spark, 1000, 4, 20).agg(F.bool_and(F.col("j") <= F.col("i")).alias("lower"), F.count_if(F.col("i") == F.col("j")).alias("diagonals"))


for _name, _dims, _stencil, _near, _diagonal in (("fd", (6, 5, 4), "FD", "abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) <= 1", 6), ("fe", (6, 5, 4), "FE", "abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1", 26)):
    _pts = "(SELECT i, i % 6 AS x, i // 6 % 5 AS y, i // 30 AS z FROM (SELECT unnest(range(120)) AS i))"
    _edge = "(p.x IN (0, 5) OR p.y IN (0, 4) OR p.z IN (0, 3))"
    query(f"I08_grid_{_name}", f"SELECT p.i, q.i AS j, CAST(CASE WHEN p.i <> q.i THEN -1 WHEN {_edge} THEN 1 ELSE {_diagonal} END AS DOUBLE) AS v FROM {_pts} p JOIN {_pts} q ON {_near} WHERE NOT {_edge} OR p.i = q.i")(
        lambda in_, d=_dims, s=_stencil: R.grid_matrix(in_.spark, *d, stencil=s)
    )
