"""Queries G01 to G14: graphs. Results that aren't unique are checked by what makes them valid."""

from pyspark.sql import functions as F

from ..operators import graphs as G
from .registry import INPUTS, query

SUP = "SELECT s_suppkey AS i FROM supplier"
NONE = "SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored"
WHOLE = "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS gaps"
#: Parts in one order, with how often.
WEIGHTED = "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey"
PARTS = "SELECT p_partkey AS i FROM part"


def partition(vertices, labels):
    """One row: vertices without a label, and numbers that no label has."""
    n = labels.agg((F.coalesce(F.max("label") + 1, F.lit(0)) - F.countDistinct("label")).alias("gaps"))
    return vertices.join(labels, "i", "left").agg(F.count_if(F.col("label").isNull()).alias("missing")).join(n)


@query("G01_color", NONE)
def _(in_):
    return G.conflicts(in_.G, G.color(in_.G, in_(SUP)))


@query("G01_color_preset", "SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS uncolored, TRUE AS kept")
def _(in_):
    preset = in_("SELECT s_suppkey AS i, CAST(7 AS BIGINT) AS color FROM supplier WHERE s_suppkey = 3")
    c = G.color(in_.G, in_(SUP), preset)
    return G.conflicts(in_.G, c).join(c.where("i = 3").agg(F.bool_and(F.col("color") == 7).alias("kept")))


@query("G02_color_distance2", NONE)
def _(in_):
    return G.conflicts_distance2(in_.G, G.color_distance2(in_.G, in_(SUP)))


@query("G03_color_bipartite", NONE)
def _(in_):
    """Orders of one customer get different colours."""
    e = in_("SELECT o_orderkey AS i, o_custkey AS j FROM orders")
    same = e.alias("a").join(e.alias("b"), F.expr("a.j = b.j and a.i <> b.i")).select(F.expr("a.i as src"), F.expr("b.i as dst"))
    return G.conflicts(same, G.color_rows(e))


@query("G04_conflicts", "SELECT count(*) AS conflicts, CAST(0 AS BIGINT) AS uncolored FROM {EDGES} e JOIN (SELECT p_partkey AS i, p_size AS c FROM part) a ON a.i = e.src JOIN (SELECT p_partkey AS i, p_size AS c FROM part) b ON b.i = e.dst WHERE a.c = b.c")
def _(in_):
    return G.conflicts(in_.EDGES, in_("SELECT p_partkey AS i, p_size AS color FROM part"))


@query("G04_histogram", "SELECT p_size AS color, count(*) AS n FROM part GROUP BY p_size")
def _(in_):
    return in_("SELECT p_partkey AS i, p_size AS color FROM part").groupBy("color").agg(F.count("*").alias("n"))


for _name, _quality in (("fast", False), ("quality", True)):

    @query(f"G05_mis2_{_name}", "SELECT CAST(0 AS BIGINT) AS too_near, CAST(0 AS BIGINT) AS uncovered")
    def _(in_, quality=_quality):
        from ..store import Steps

        e = Steps(in_.spark, "input").keep("edges", in_.dealt(INPUTS["G"]))
        return G.mis2_faults(e, in_(SUP), G.mis2(e, in_(SUP), quality))


for _name, _aggregate in (("coarsen", False), ("aggregate", True)):

    @query(f"G06_mis2_{_name}", WHOLE)
    def _(in_, aggregate=_aggregate):
        return partition(in_(SUP), G.mis2_coarsen(in_.G, in_(SUP), aggregate))


_SIZES = "(SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS label FROM part)"


@query("G07_explicit_coarsen", f"SELECT DISTINCT a.label AS src, b.label AS dst FROM {{EDGES}} e JOIN {_SIZES} a ON a.i = e.src JOIN {_SIZES} b ON b.i = e.dst WHERE a.label <> b.label")
def _(in_):
    return G.coarsen(in_.EDGES, in_(f"SELECT * FROM {_SIZES}"))


@query("G07_weighted_coarsen", f"SELECT a.label AS src, b.label AS dst, CAST(sum(w) AS BIGINT) AS w FROM ({WEIGHTED}) e JOIN {_SIZES} a ON a.i = e.src JOIN {_SIZES} b ON b.i = e.dst WHERE a.label <> b.label GROUP BY 1, 2")
def _(in_):
    return G.coarsen_weighted(in_(WEIGHTED), in_(f"SELECT * FROM {_SIZES}"))


@query("G08_multilevel", "SELECT TRUE AS smaller, CAST(0 AS BIGINT) AS lost FROM part WHERE p_partkey = 0")
def _(in_):
    """Every level is smaller, and vertices' weights add up to their number."""
    from ..store import Steps

    steps = Steps(in_.spark, "graph")
    e, v = steps.keep("edges", in_(WEIGHTED)), in_(PARTS)
    levels = G.multilevel(e, v, "hec", cutoff=v.count() // 8)
    n = [x.count() for _, x, _ in levels]
    last = levels[-1][1].agg((F.lit(n[0]) - F.sum("w")).alias("lost"))
    return last.select(F.lit(len(n) > 1 and all(a > b for a, b in zip(n, n[1:]))).alias("smaller"), "lost")


@query("G09_hec", WHOLE)
def _(in_):
    return partition(in_(PARTS), G.mapping(in_(WEIGHTED), in_(PARTS), "hec"))


@query("G09_match", "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_large")
def _(in_):
    e = in_("SELECT src, dst, (src + dst) % 7 AS w FROM {G}")
    m = G.mapping(e, in_(SUP), "match")
    return partition(in_(SUP), m).join(m.groupBy("label").count().agg(F.count_if(F.col("count") > 2).alias("too_large")))


@query("G09_gosh", WHOLE)
def _(in_):
    return partition(in_(SUP), G.mapping(in_("SELECT src, dst, 1 AS w FROM {G}"), in_(SUP), "gosh"))


@query("G09_mtmetis", WHOLE)
def _(in_):
    """A star: its leaves are matched two by two."""
    e = in_("SELECT i AS src, CAST(0 AS BIGINT) AS dst, 1 AS w FROM {N} WHERE i > 0 UNION ALL SELECT CAST(0 AS BIGINT), i, 1 FROM {N} WHERE i > 0")
    m = G.mapping(e, in_("SELECT i FROM {N}"), "mtmetis")
    assert m.select("label").distinct().count() <= 14
    return partition(in_("SELECT i FROM {N}"), m)


@query("G09_gosh2", WHOLE)
def _(in_):
    return partition(in_(PARTS), G.mapping(in_(WEIGHTED), in_(PARTS), "gosh2"))


@query("G09_mis2", WHOLE)
def _(in_):
    return partition(in_(SUP), G.mapping(in_("SELECT src, dst, 1 AS w FROM {G}"), in_(SUP), "mis2"))


_TRI = "SELECT p.src AS a, p.dst AS b, q.dst AS c FROM {EDGES} p JOIN {EDGES} q ON q.src = p.dst AND q.dst > q.src JOIN {EDGES} r ON r.src = p.src AND r.dst = q.dst WHERE p.dst > p.src"


@query("G10_triangle_count", f"SELECT count(*) AS n FROM ({_TRI})")
def _(in_):
    n = G.triangles(in_.EDGES, lambda t: t.agg(F.count("*").alias("n")))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("G10_triangles_per_vertex", f"SELECT v AS i, count(*) AS n FROM (SELECT unnest([a, b, c]) AS v FROM ({_TRI})) GROUP BY v")
def _(in_):
    n = G.triangles(in_.EDGES, lambda t: t.select(F.explode(F.array("a", "b", "c")).alias("i")).groupBy("i").agg(F.count("*").alias("n")))
    return n.groupBy("i").agg(F.sum("n").alias("n"))


@query("G10_visitor", f"SELECT CAST(sum(a + b + c) AS BIGINT) AS total FROM ({_TRI})")
def _(in_):
    def visit(batches):
        for pdf in batches:
            yield (pdf["a"] + pdf["b"] + pdf["c"]).to_frame("s")

    return G.visit_triangles(in_.EDGES, visit, "s long", lambda s: s.agg(F.sum("s").alias("total"))).agg(F.sum("total").alias("total"))


BAND = "SELECT (p.i * 7) % 25 AS src, (q.i * 7) % 25 AS dst FROM {N} p JOIN {N} q ON abs(p.i - q.i) BETWEEN 1 AND 2"


@query("G11_rcm", "SELECT CAST(25 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(24 AS BIGINT) AS last, TRUE AS narrow")
def _(in_):
    """A permuted band: labels are a permutation, and the bandwidth is near the band's own."""
    e = in_(BAND)
    labels = G.rcm(e, in_("SELECT i FROM {N}"))
    stats = labels.agg(F.countDistinct("label").alias("n"), F.min("label").alias("first"), F.max("label").alias("last"))
    return stats.join(G.bandwidth(e, labels).select((F.col("bandwidth") <= 4).alias("narrow")))


@query("G12_rcb", "SELECT CAST(4 AS BIGINT) AS parts, count(*) AS n, TRUE AS even FROM embeddings")
def _(in_):
    p = in_("SELECT vec_id AS id, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z FROM embeddings")
    sizes = G.rcb(p, 3).groupBy("part").agg(F.count("*").alias("k"))
    return sizes.agg(F.count("*").alias("parts"), F.sum("k").alias("n"), (F.max("k") <= 1.3 * F.min("k")).alias("even"))


@query("G13_balloon", WHOLE)
def _(in_):
    return partition(in_(SUP), G.balloon(in_.G, in_(SUP), 5))


@query("G14_symmetrize", "SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT l_partkey, l_suppkey FROM lineitem) WHERE src <> dst")
def _(in_):
    return G.symmetrize(in_("SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"))
