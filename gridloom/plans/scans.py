"""Queries U01 to U15: scans, sorts, search, hashing, statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import scans as U
from ..operators import vectors as V
from .registry import query
from .vectors import ENTRIES, rows


@query("U01_exclusive_scan", "SELECT i, CAST(v AS BIGINT) AS v, CAST(sum(v) OVER (ORDER BY i) - v AS BIGINT) AS before FROM {X}")
def _(in_):
    return U.exclusive_sum(in_.X.withColumn("v", F.col("v").cast("long")))


@query("U01_inclusive_scan", "SELECT i, CAST(v AS BIGINT) AS v, CAST(sum(v) OVER (ORDER BY i) AS BIGINT) AS upto FROM {X}")
def _(in_):
    return U.inclusive_sum(in_.X.withColumn("v", F.col("v").cast("long")))


@query("U02_reductions", "SELECT sum(v) AS total, max(v) AS most, min(v) AS least, (SELECT max(n) FROM (SELECT count(*) AS n FROM {A} GROUP BY i)) AS longest_row FROM {X}")
def _(in_):
    longest = in_.A.groupBy("i").count().agg(F.max("count").alias("longest_row"))
    return in_.X.agg(F.sum("v").alias("total"), F.max("v").alias("most"), F.min("v").alias("least")).join(longest)


@query("U02_differences", "SELECT i, n - v AS v FROM (SELECT i, v, lead(v) OVER (ORDER BY i) AS n FROM {Y}) WHERE n IS NOT NULL")
def _(in_):
    return U.differences(in_.Y)


@query("U03_histogram", "SELECT v, count(*) AS n FROM {X} GROUP BY v")
def _(in_):
    return U.histogram(in_.X)


@query("U04_reverse_map", "SELECT label, count(*) AS n, CAST(sum(i) AS DOUBLE) AS total, min(i) AS first FROM (SELECT i, v AS label FROM {X}) GROUP BY label")
def _(in_):
    m = U.reverse_map(in_.X.withColumnRenamed("v", "label"))
    return m.select("label", F.size("members").cast("long").alias("n"), E.arr_sum(F.transform("members", lambda x: x.cast("double"))).alias("total"), F.get("members", F.lit(0)).alias("first"))


@query("U05_permute", "SELECT (i * 7) % 25 AS i, v FROM {N}")
def _(in_):
    return U.permute(in_.N, in_("SELECT i, (i * 7) % 25 AS p FROM {N}"))


@query("U05_permute_blocks", "SELECT ((i // 8) * 7) % 8 * 8 + i % 8 AS i, v FROM (SELECT j AS i, sum(v) AS v FROM (" + ENTRIES + ") GROUP BY j)")
def _(in_):
    v = rows(in_).select(F.posexplode("x").alias("i", "v")).groupBy(F.col("i").cast("long").alias("i")).agg(F.sum("v").alias("v"))
    order = in_.spark.range(8).select(F.col("id").alias("i"), (F.col("id") * 7 % 8).alias("p"))
    return U.permute_blocks(v, order, 8)


@query("U06_sort", "SELECT row_number() OVER (ORDER BY v DESC, i) - 1 AS place, i, v FROM {Y}")
def _(in_):
    return U.numbered(in_.Y, F.desc("v"), F.asc("i")).select("place", "i", "v")


@query("U06_array_sort", f"SELECT i, sum(v * p) AS placed FROM (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY v DESC) - 1 AS p FROM ({ENTRIES})) GROUP BY i")
def _(in_):
    s = rows(in_).select("i", F.array_sort("x", lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("x"))
    return s.select("i", E.arr_sum(F.transform("x", lambda v, p: v * p)).alias("placed"))


for _name, _op in (("lower", "<"), ("upper", "<=")):
    query(f"U07_{_name}_bound", f"SELECT key, (SELECT count(*) FROM {{Y}} y WHERE y.v {_op} key) AS at FROM (SELECT 900 + 2 * i AS key FROM {{N}})")(
        lambda in_, upper=_op == "<=": U.bound(in_("SELECT CAST(900 + 2 * i AS DOUBLE) AS key FROM {N}"), in_.Y, upper).withColumn("key", F.col("key").cast("long"))
    )


@query("U07_array_bounds", f"SELECT i, CAST(sum(CASE WHEN v < 10 THEN 1 ELSE 0 END) AS BIGINT) AS lo, CAST(sum(CASE WHEN v <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS hi FROM ({ENTRIES}) GROUP BY i")
def _(in_):
    s = rows(in_).withColumn("x", F.array_sort("x"))
    return s.select("i", E.lower_bound("x", F.lit(10.0)).cast("long").alias("lo"), E.upper_bound("x", F.lit(10.0)).cast("long").alias("hi"))


@query("U08_hash_accumulators", "SELECT l_suppkey AS i, sum(l_quantity) AS added, CAST(bit_or(l_linenumber) AS BIGINT) AS ored, CAST(bit_and(l_linenumber) AS BIGINT) AS anded FROM lineitem GROUP BY l_suppkey")
def _(in_):
    t = in_("SELECT l_suppkey AS i, l_quantity AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem")
    return t.groupBy("i").agg(F.sum("q").alias("added"), F.bit_or("n").alias("ored"), F.bit_and("n").alias("anded"))


@query("U09_bits", "SELECT i, CAST(bit_count(i) AS BIGINT) AS n, CASE WHEN i = 0 THEN 0 ELSE CAST(log2(i & -i) AS BIGINT) + 1 END AS lowest FROM {X}")
def _(in_):
    return in_.X.select("i", E.popcount(F.col("i")).cast("long").alias("n"), E.least_set_bit(F.col("i")).cast("long").alias("lowest"))


@query("U10_identical", "SELECT TRUE AS same, FALSE AS other, TRUE AS close")
def _(in_):
    a = U.identical(in_.X, in_.X, 0.0).withColumnRenamed("same", "same")
    b = U.identical(in_.X, in_.Y, 1.0).withColumnRenamed("same", "other")
    c = U.identical(in_.Y, V.axpby(1.0, in_.Y, 0.0, in_.Y), 1e-9, relative=True).withColumnRenamed("same", "close")
    return a.join(b).join(c)


@query("U11_fills", "SELECT i, CAST(i AS DOUBLE) * 3 + 2 AS affine, i % 7 AS modular, CAST(5 AS DOUBLE) AS filled FROM {X}")
def _(in_):
    iota = in_.spark.range(in_.X.count()).withColumnRenamed("id", "i")
    return iota.select("i", (F.col("i").cast("double") * 3 + 2).alias("affine"), F.pmod("i", F.lit(7)).alias("modular"), F.lit(5.0).alias("filled"))


@query("U12_xorshift", "WITH a AS (SELECT i, xor(i, i << 13) AS x FROM {X}), b AS (SELECT i, xor(x, x >> 7) AS x FROM a) SELECT i, x & 4095 AS low FROM (SELECT i, xor(x, (x & 70368744177663) << 17) AS x FROM b)")
def _(in_):
    return in_.X.select("i", E.xorshift(F.col("i")).bitwiseAND(F.lit(4095).cast("long")).alias("low"))


@query("U13_math", "SELECT i, abs(v) AS a, round(sqrt(abs(v)), 9) AS r, round(exp(v / 50), 9) AS e, round(ln(abs(v) + 1), 9) AS l, round(log10(abs(v) + 1), 9) AS l10, round(sin(v), 9) AS s, round(cos(v), 9) AS c, round(tan(v), 6) AS t, round(atan(v), 9) AS at, round(pow(v, 2), 6) AS p, isnan(v) AS nan FROM {SX}")
def _(in_):
    v = F.col("v")
    return in_.SX.select(
        "i", F.abs(v).alias("a"), F.round(F.sqrt(F.abs(v)), 9).alias("r"), F.round(F.exp(v / 50), 9).alias("e"), F.round(F.ln(F.abs(v) + 1), 9).alias("l"), F.round(F.log10(F.abs(v) + 1), 9).alias("l10"),
        F.round(F.sin(v), 9).alias("s"), F.round(F.cos(v), 9).alias("c"), F.round(F.tan(v), 6).alias("t"), F.round(F.atan(v), 9).alias("at"), F.round(F.pow(v, F.lit(2.0)), 6).alias("p"), F.isnan(v).alias("nan"),
    )


@query("U13_complex", "SELECT i, x.v * y.v + x.v * y.v AS re, x.v * x.v - y.v * y.v AS im, x.v + y.v AS sum_re, round(sqrt(x.v * x.v + y.v * y.v), 6) AS size FROM {X} x JOIN {Y} y USING (i)")
def _(in_):
    """(x + iy) times the conjugate of (y + ix), their sum, and the magnitude."""
    z = V.paired(in_.X, in_.Y).select("i", E.cplx(F.col("x"), F.col("y")).alias("a"), E.cplx(F.col("y"), F.col("x")).alias("b"))
    p, s = E.cmul(F.col("a"), E.conj(F.col("b"))), E.cadd(F.col("a"), F.col("b"))
    z = z.select("i", p.alias("p"), s.alias("s"), F.round(E.cabs(F.col("a")), 6).alias("size"))
    return z.select("i", F.col("p.re").alias("re"), (-F.col("p.im")).alias("im"), F.col("s.re").alias("sum_re"), "size")


@query("U14_fill_forward", "SELECT i, coalesce(last_value(CASE WHEN v <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY i // 100 ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS v FROM (SELECT i, CASE WHEN i % 3 = 0 THEN v ELSE 0 END AS v FROM {X})")
def _(in_):
    x = in_("SELECT i, CASE WHEN i % 3 = 0 THEN v ELSE CAST(0 AS DOUBLE) END AS v FROM {X}")
    return U.fill_zeros_forward(x, F.floor(F.col("i") / 100))


@query("U14_mark_duplicates", "SELECT i, row_number() OVER (PARTITION BY k, v ORDER BY i) > 1 AS again FROM (SELECT i, i % 10 AS k, v FROM {X})")
def _(in_):
    return U.mark_duplicates(in_("SELECT i, i % 10 AS k, v FROM {X}")).select("i", "again")


@query("U14_strided_copy", "SELECT i // 4 AS i, v FROM {X} WHERE i % 4 = 1")
def _(in_):
    return in_.X.where("i % 4 = 1").select(F.floor(F.col("i") / 4).alias("i"), "v")


@query("U15_configuration", "SELECT 'N' AS mode, 50 AS restart, CAST(1e-8 AS DOUBLE) AS tolerance, TRUE AS rejected")
def _(in_):
    """Options are frozen dataclasses; an unknown mode is an error."""
    from ..operators.krylov import GmresOptions
    from ..operators.matrices import _op

    o = GmresOptions()
    try:
        _op("Q", in_.A)
        rejected = False
    except ValueError:
        rejected = True
    return in_.spark.range(1).select(F.lit("N").alias("mode"), F.lit(o.restart).alias("restart"), F.lit(o.tolerance).alias("tolerance"), F.lit(rejected).alias("rejected"))
