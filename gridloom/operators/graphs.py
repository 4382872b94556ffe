"""Graphs as edges (src, dst): colouring, independent sets, coarsening, triangles, orderings, partitions.

Rounds of joins and sums over stored tables; priorities and ties are by arithmetic hashes and ids, so
results are the same however rows are dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import Steps
from .ordered import in_blocks, in_order
from .scans import numbered
from .triangles import triangles, visit_triangles  # noqa: F401


#: Rows of a table with a row for each vertex that is still broadcast: some 10 MB.
SMALL = 200_000


def mixed(c: Column | str, salt: int = 0) -> Column:
    """A 32-bit arithmetic hash of an index."""
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod((c + salt) * 2654435761, F.lit(4294967296))


def symmetrize(edges: DataFrame, loops: bool = False) -> DataFrame:
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return (both if loops else both.where("src <> dst")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    n = edges.groupBy("src").agg(F.count("*").alias("n"))
    return vertices.select("i").join(n, F.col("i") == F.col("src"), "left").select("i", F.coalesce("n", F.lit(0)).alias("degree"))


def two_hops(edges: DataFrame) -> DataFrame:
    """Pairs at a distance of one or two."""
    e = edges.select("src", "dst")
    far = e.select("src", F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").where("src <> dst")
    return e.unionByName(far).distinct()


def color(edges: DataFrame, vertices: DataFrame, preset: DataFrame | None = None) -> DataFrame:
    """i, color (from 1): what greedy colouring gives in the order of falling degree, then falling id.

    A vertex takes the smallest colour that its neighbours before it lack. Preset colours (i, color > 0) stay. Edges to vertices
    that aren't in the table don't count.
    """
    steps = Steps(edges.sparkSession, "color")
    known = vertices.select("i")
    e = edges.where("src <> dst").join(known.withColumnRenamed("i", "dst"), "dst", "left_semi").join(known.withColumnRenamed("i", "src"), "src", "left_semi").select("src", "dst").distinct()
    e = steps.keep("edges", e)
    rank = degrees(e, vertices).withColumn("fixed", F.lit(0).cast("long"))
    if preset is not None:
        rank = rank.drop("fixed").join(preset.where("color > 0").select("i", F.col("color").cast("long").alias("fixed")), "i", "left").fillna(0, ["fixed"])
    rank = steps.keep("rank", rank)
    ends = rank.select("i", "fixed", F.struct("degree", "i").alias("r"))
    both = e.join(ends.select(F.col("i").alias("src"), F.col("r").alias("rs"), F.col("fixed").alias("fs")), "src").join(ends.select(F.col("i").alias("dst"), F.col("r").alias("rd"), F.col("fixed").alias("fd")), "dst")
    waits = both.where((F.col("fs") == 0) & ((F.col("fd") > 0) | (F.col("rd") > F.col("rs")))).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    known = rank.where("fixed > 0").select("i", F.col("fixed").alias("v")) if preset is not None else None
    out = in_order(rank.where("fixed = 0").select("i", "degree"), waits, [F.desc("degree"), F.desc("i")], F.collect_set("x"), _greedy, "i long, v long", steps, known)
    return out.select("i", F.col("v").alias("color"))


def _greedy(rows, first, near):
    """The smallest colours that links to earlier rows and what rows were told leave."""
    out, cols = [], near["c"].tolist()
    for k, told in enumerate(rows["told"]):
        taken = {out[c] for c in cols[first[k] : first[k + 1]]}
        if told is not None and told is not pd.NA and not isinstance(told, (int, float)):
            taken.update(told)
        free = 1
        while free in taken:
            free += 1
        out.append(free)
    return out


def closed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, m: each vertex with itself and its neighbours. Two vertices are within two steps if they share an m."""
    own = vertices.select("i")
    e = edges.where("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("m")).join(own, "i", "left_semi")
    return e.unionByName(own.select("i", F.col("i").alias("m"))).distinct()


def color_distance2(edges: DataFrame, vertices: DataFrame, limit: int | None = None) -> DataFrame:
    """i, color (from 1): greedy colouring at distance two, in the order of falling degree, then falling id; edges have both directions.

    No pair at distance two is made: each m keeps the colours of those around it, as a set of bits, and a
    vertex takes the smallest colour that none of its m has.
    """
    steps = Steps(edges.sparkSession, "color2")
    near = steps.keep("closed", closed(edges, vertices))
    nodes = near.groupBy("i").agg(F.count("*").alias("degree"))
    nodes, links, numbers = in_blocks(nodes, near.select("i", F.col("m").alias("j")), [F.desc("degree"), F.desc("i")], steps, limit)
    seen = done = None

    def run(_, links: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        for j, word, bits in zip(told["j"].tolist(), told["word"].tolist(), told["bits"].tolist()):
            taken[j] = taken.get(j, 0) | (bits & 0xFFFFFFFFFFFFFFFF) << 64 * word
        links = links.sort_values("place", kind="stable", ignore_index=True)
        own, place, ends = links["i"].tolist(), links["place"].to_numpy(), links["j"].tolist()
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist() if len(place) else []
        out = []
        for a, b in zip(first, [*first[1:], len(own)]):
            have = 0
            for m in ends[a:b]:
                have |= taken.get(m, 0)
            color = (~have & (have + 1)).bit_length() - 1  # the lowest bit that is not set
            for m in ends[a:b]:
                taken[m] = taken.get(m, 0) | 1 << color
            out.append((own[a], color + 1))
        return pd.DataFrame(out, columns=["i", "color"])

    for k in numbers:
        own = links.where(F.col("block") == k).select("block", "i", "place", "j")
        told = seen.join(own.select("j").distinct(), "j") if seen is not None else own.select("j", F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("bits")).limit(0)
        told = told.groupBy("j", "word").agg(F.bit_or("bits").alias("bits")).withColumn("block", F.lit(k).cast("long"))
        new = own.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, "i long, color long")
        done = steps.add("colors", new)
        if k != numbers[-1]:
            bit = (F.col("color") - 1).cast("long")
            marks = own.join(done, "i").groupBy("j", F.floor(bit / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits"))
            seen = steps.add("seen", marks)
    return done if done is not None else vertices.select("i", F.lit(0).cast("long").alias("color")).limit(0)


def conflicts_distance2(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: how many (ordered) pairs within two steps have equal colours, how many vertices lack one. Only pairs of equal colours are made."""
    around = closed(edges, colors).join(colors.select("i", "color"), "i")
    many = around.groupBy("m", "color").agg(F.collect_list("i").alias("who")).where(F.size("who") > 1)
    pairs = many.select(F.explode("who").alias("a"), "who").select("a", F.explode("who").alias("b")).where("a <> b").distinct()
    return pairs.agg(F.count("*").alias("conflicts")).join(colors.agg(F.count_if(F.coalesce(F.col("color"), F.lit(0)) == 0).alias("uncolored")))


def color_rows(entries: DataFrame) -> DataFrame:
    """Rows of a bipartite graph (i, j) that share a column get different colours."""
    e = entries.select("i", "j").distinct()
    shared = e.select(F.col("i").alias("src"), "j").join(e.select(F.col("i").alias("dst"), "j"), "j").where("src <> dst").select("src", "dst").distinct()
    return color(shared, e.select("i").distinct())


def conflicts(edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row: how many edges join equal colours, how many vertices lack one."""
    a, b = colors.select(F.col("i").alias("src"), F.col("color").alias("a")), colors.select(F.col("i").alias("dst"), F.col("color").alias("b"))
    n = edges.where("src <> dst").join(a, "src").join(b, "dst").agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))
    return n.join(colors.agg(F.count_if(F.coalesce(F.col("color"), F.lit(0)) == 0).alias("uncolored")))


def mis2(edges: DataFrame, vertices: DataFrame, quality: bool = False) -> DataFrame:
    """i: an independent set at distance two that no vertex can join. Each round, a vertex whose priority is the least within two steps joins, and all within two steps of it leave.

    quality: a fixed priority, low degrees first; else a new hash each round. Priorities are single numbers, for up to
    2^31 vertices, so that sums by hash find the least. Edges are read twice a round: a stored table.
    """
    steps = Steps(edges.sparkSession, "mis2")
    e = edges.where("src <> dst").select("src", "dst")
    ranked = numbered(degrees(e, vertices), *(("degree", mixed("i"), "i") if quality else ("i",)))
    now = steps.keep("status", ranked.select("i", "place", F.lit(0).alias("status")))  # 0 open, 1 just in, 2 in, -1 out
    small = now.count() <= SMALL
    told = lambda v: F.broadcast(v) if small else v

    def least(links: DataFrame, v: DataFrame) -> DataFrame:
        """The least p that vertices and those that they have links to say."""
        others = links.join(told(v.withColumnRenamed("i", "dst")), "dst").select(F.col("src").alias("i"), "p")
        return others.unionByName(v).groupBy("i").agg(F.min("p").alias("p"))

    at = 0
    while now.where("status = 0").limit(1).count():
        at += 1
        rank = F.col("place") if quality else mixed("i", 7919 * at) * 2147483648 + F.col("place")
        # The least open priority around, then around that; one that has just come in says -1, which puts all out.
        says = now.withColumn("p", F.when(F.col("status") == 1, F.lit(-1)).when(F.col("status") == 0, rank).cast("long"))
        said = says.where("p is not null").select("i", "p")
        first = steps.keep("first", least(e, said).join(told(now.select("i")), "i", "left_semi"))
        live = now.where("status = 0").select("i")
        second = least(e.join(told(live.withColumnRenamed("i", "src")), "src", "left_semi"), first).withColumnRenamed("p", "least")
        joined = says.join(told(second), "i", "left")
        new = F.when(F.col("status") == 1, F.lit(2)).when(F.col("status") != 0, F.col("status")).when(F.col("least") == -1, F.lit(-1)).when(F.col("p") == F.col("least"), F.lit(1)).otherwise(0)
        now = steps.keep("status", joined.select("i", "place", new.alias("status")))
    return now.where("status > 0").select("i")


def mis2_faults(edges: DataFrame, vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: how many (ordered) pairs of the chosen (i) are within two steps of each other, and how many vertices are within two of none. Edges have both directions; only pairs of the chosen are made."""
    steps = Steps(edges.sparkSession, "mis2-faults")
    chosen = steps.keep("chosen", chosen.select("i").distinct())
    small = vertices.count() <= SMALL
    told = lambda v: F.broadcast(v) if small else v
    e = edges.where("src <> dst").select("src", "dst")
    reached = e.join(told(chosen.select(F.col("i").alias("dst"))), "dst").select(F.col("src").alias("i"), F.col("dst").alias("by"))
    reached = steps.keep("reached", reached.unionByName(chosen.select("i", F.col("i").alias("by"))).distinct())
    pairs = reached.alias("a").join(reached.alias("b"), F.expr("a.i = b.i and a.by <> b.by")).select(F.expr("a.by as x"), F.expr("b.by as y")).distinct().agg(F.count("*").alias("too_near"))
    once = reached.select("i").distinct()
    twice = e.join(told(once.select(F.col("i").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("i")).unionByName(once).distinct()
    return pairs.join(vertices.select("i").join(twice, "i", "left_anti").agg(F.count("*").alias("uncovered")))


def mis2_coarsen(edges: DataFrame, vertices: DataFrame, aggregate: bool = False) -> DataFrame:
    """i, label (from 0): each vertex of a distance-2 independent set with its neighbours, the rest with the smallest neighbouring cluster.

    aggregate: before the rest is dealt out, a second independent set among what is left makes clusters of three or more.
    """
    steps = Steps(edges.sparkSession, "aggregate")
    e = steps.keep("edges", edges.where("src <> dst").select("src", "dst").distinct())
    roots = steps.keep("roots", mis2(e, vertices))
    grown = lambda r: r.select("i", F.col("i").alias("root")).unionByName(e.join(r.withColumnRenamed("i", "dst"), "dst").select(F.col("src").alias("i"), F.col("dst").alias("root")))
    own = steps.keep("own", grown(roots).groupBy("i").agg(F.min("root").alias("root")))
    if aggregate:
        left = steps.keep("left", vertices.select("i").join(own, "i", "left_anti"))
        among = steps.keep("among", e.join(left.withColumnRenamed("i", "src"), "src", "left_semi").join(left.withColumnRenamed("i", "dst"), "dst", "left_semi"))
        more = steps.keep("more", mis2(among, left))
        second = grown(more).join(left, "i", "left_semi").groupBy("i").agg(F.min("root").alias("root"))
        big = second.groupBy("root").agg(F.count("*").alias("n")).where("n >= 3").select("root")
        own = steps.keep("own", own.unionByName(second.join(big, "root", "left_semi")))
    while True:
        rest = vertices.select("i").join(own, "i", "left_anti")
        sizes = own.groupBy("root").agg(F.count("*").alias("size"))
        around = e.join(rest.withColumnRenamed("i", "src"), "src", "left_semi").join(own.withColumnRenamed("i", "dst"), "dst").join(sizes, "root")
        taken = steps.keep("taken", around.groupBy(F.col("src").alias("i")).agg(F.min_by("root", F.struct("size", "root")).alias("root")))
        if not taken.limit(1).count():
            break
        own = steps.keep("own", own.unionByName(taken))
    alone = vertices.select("i").join(own, "i", "left_anti").select("i", F.col("i").alias("root"))
    own = steps.keep("own", own.unionByName(alone))
    names = numbered(own.select("root").distinct(), "root").withColumnRenamed("place", "label")
    return own.join(names, "root").select("i", "label")


def coarsen(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst: the graph of the labels (i, label), without loops."""
    a, b = labels.select(F.col("i").alias("src"), F.col("label").alias("x")), labels.select(F.col("i").alias("dst"), F.col("label").alias("y"))
    return edges.join(a, "src").join(b, "dst").where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def coarsen_weighted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """src, dst, w: weights between labels summed, loops dropped."""
    a, b = labels.select(F.col("i").alias("src"), F.col("label").alias("x")), labels.select(F.col("i").alias("dst"), F.col("label").alias("y"))
    return edges.join(a, "src").join(b, "dst").where("x <> y").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("w").alias("w"))


def _named(own: DataFrame) -> DataFrame:
    names = numbered(own.select("root").distinct(), "root").withColumnRenamed("place", "label")
    return own.join(names, "root").select("i", "label")


def match(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, root: heavy-edge matching. Each round, open vertices point to their heaviest open neighbour (ties by hash); pairs that point to each other are merged, until no two open vertices are neighbours (the heaviest open edge always makes a pair). What is left stays alone."""
    steps = Steps(edges.sparkSession, "match")
    e = steps.keep("edges", edges.where("src <> dst").select("src", "dst", "w"))
    own = steps.add("own", vertices.select("i").limit(0).withColumn("root", F.col("i")))
    while True:
        live = e.join(own.select(F.col("i").alias("src")), "src", "left_anti").join(own.select(F.col("i").alias("dst")), "dst", "left_anti")
        key = F.struct("w", mixed(F.least("src", "dst") * 31 + F.greatest("src", "dst")), F.least("src", "dst"), F.greatest("src", "dst"))
        points = live.groupBy("src").agg(F.max_by("dst", key).alias("dst"))
        pairs = steps.keep("pairs", points.alias("a").join(points.alias("b"), F.expr("a.dst = b.src and a.src = b.dst")).select(F.expr("a.src as i"), F.expr("least(a.src, a.dst) as root")))
        if not pairs.limit(1).count():
            break
        own = steps.add("own", pairs)
    return own.unionByName(vertices.select("i").join(own, "i", "left_anti").select("i", F.col("i").alias("root")))


def hec(edges: DataFrame, vertices: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """i, root: heavy-edge coarsening. Every vertex points to its heaviest neighbour; those that point to each other merge, and the others join where they point, step by step.

    start (i, root): vertices that have their cluster already.
    """
    steps = Steps(edges.sparkSession, "hec")
    key = F.struct("w", mixed(F.least("src", "dst") * 31 + F.greatest("src", "dst")), F.least("src", "dst"), F.greatest("src", "dst"))
    points = steps.keep("points", edges.where("src <> dst").groupBy("src").agg(F.max_by("dst", key).alias("dst")))
    mutual = points.alias("a").join(points.alias("b"), F.expr("a.dst = b.src and a.src = b.dst")).select(F.expr("a.src as i"), F.expr("least(a.src, a.dst) as root"))
    if start is not None:
        taken = start.select("i")
        mutual = mutual.join(taken, "i", "left_anti").join(taken.withColumnRenamed("i", "root"), "root", "left_anti").select("i", "root")
        other = mutual.groupBy("root").agg(F.count("*").alias("n")).where("n = 2").select("root")  # both ends are free
        mutual = start.select("i", "root").unionByName(mutual.join(other, "root").select("i", "root"))
    own = steps.add("own", mutual)
    while True:
        more = points.join(own.select(F.col("i").alias("src")), "src", "left_anti").join(own.withColumnRenamed("i", "dst"), "dst").select(F.col("src").alias("i"), "root")
        more = steps.keep("more", more)
        if not more.limit(1).count():
            break
        own = steps.add("own", more)
    return own.unionByName(vertices.select("i").join(own, "i", "left_anti").select("i", F.col("i").alias("root")))


def gosh(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, root: centres are an independent set of high degrees (pairs above the mean degree don't count as neighbours); others join their centre of the highest degree."""
    steps = Steps(edges.sparkSession, "gosh")
    deg = steps.keep("degrees", degrees(edges, vertices))
    mean = deg.agg(F.avg("degree")).first()[0] or 0.0
    d = lambda n: deg.select(F.col("i").alias(n), F.col("degree").alias(f"d_{n}"))
    e = steps.keep("edges", edges.where("src <> dst").join(d("src"), "src").join(d("dst"), "dst").select("src", "dst", "d_src", "d_dst"))
    real = steps.keep("real", e.where((F.col("d_src") <= mean) | (F.col("d_dst") <= mean)))
    now = steps.keep("status", deg.select("i", "degree", F.lit(0).alias("status")))
    while now.where("status = 0").limit(1).count():
        rank = lambda p: F.struct(F.col(f"{p}degree"), mixed(F.col(f"{p}i")), F.col(f"{p}i"))
        around = real.select("src", "dst").join(now.select(F.col("i").alias("dst"), F.col("degree").alias("n_degree"), F.col("i").alias("n_i"), F.col("status").alias("s")), "dst")
        around = around.groupBy(F.col("src").alias("i")).agg(F.max(F.when(F.col("s") == 0, rank("n_"))).alias("top"), F.max("s").alias("inside"))
        new = F.when(F.col("status") != 0, F.col("status")).when(F.col("inside") == 1, -1).when(F.col("top").isNull() | (F.struct("degree", mixed("i"), "i") > F.col("top")), 1).otherwise(0)
        now = steps.keep("status", now.join(around, "i", "left").select("i", "degree", new.alias("status")))
    centres = now.where("status = 1").select("i")
    joins = real.join(now.where("status = -1").select(F.col("i").alias("src")), "src", "left_semi").join(centres.withColumnRenamed("i", "dst"), "dst", "left_semi")
    joins = joins.groupBy(F.col("src").alias("i")).agg(F.max_by("dst", F.struct("d_dst", "dst")).alias("root"))
    return centres.select("i", F.col("i").alias("root")).unionByName(joins)


def two_hop_match(edges: DataFrame, vertices: DataFrame, share: float = 0.25) -> DataFrame:
    """i, root: matching; where more than the share is left alone, leaves of one vertex are paired, and then vertices with the same neighbours."""
    steps = Steps(edges.sparkSession, "two-hop")
    own = steps.keep("own", match(edges, vertices))
    n = vertices.count()
    for kind in ("leaves", "twins"):
        alone = steps.keep("alone", own.groupBy("root").agg(F.count("*").alias("n"), F.max("i").alias("i")).where("n = 1").select("i"))
        if alone.count() <= share * n:
            break
        near = edges.where("src <> dst").join(alone.withColumnRenamed("i", "src"), "src", "left_semi").groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("one"), F.sum(mixed("dst")).alias("digest"), F.max("dst").alias("last"))
        key = ["one"] if kind == "leaves" else ["n", "one", "last", "digest"]
        near = near.where("n = 1") if kind == "leaves" else near
        placed = near.withColumn("k", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("src")) - 1) / 2))
        pairs = placed.withColumn("root", F.min("src").over(Window.partitionBy(*key, "k"))).select(F.col("src").alias("i"), F.col("root").alias("new"))
        own = steps.keep("own", own.join(pairs, "i", "left").select("i", F.coalesce("new", "root").alias("root")))
    return own


def gosh_hubs(edges: DataFrame, vertices: DataFrame, least: int = 50) -> DataFrame:
    """i, root: vertices of a degree above the mean (and above `least`) are centres. Others join the centre they weigh most with, then the cluster of their neighbour of the highest degree, then any neighbour's; what is left is merged along heavy edges."""
    steps = Steps(edges.sparkSession, "hubs")
    e = steps.keep("edges", edges.where("src <> dst").select("src", "dst", "w"))
    deg = steps.keep("degrees", degrees(e, vertices))
    mean = deg.agg(F.avg("degree")).first()[0] or 0.0
    own = steps.keep("own", deg.where(F.col("degree") > max(least, int(mean))).select("i", F.col("i").alias("root")))
    weights = [F.struct("w", "dst"), F.struct("degree", "dst"), F.struct(F.lit(0).alias("z"), -F.col("root"))]
    for by in weights:
        rest = vertices.select("i").join(own, "i", "left_anti").withColumnRenamed("i", "src")
        around = e.join(rest, "src", "left_semi").join(own.withColumnRenamed("i", "dst"), "dst").join(deg.withColumnRenamed("i", "dst"), "dst")
        own = steps.keep("own", own.unionByName(around.groupBy(F.col("src").alias("i")).agg(F.max_by("root", by).alias("root"))))
    return hec(e, vertices, own)


HEURISTICS = ("hec", "match", "mtmetis", "mis2", "gosh", "gosh2")


def mapping(edges: DataFrame, vertices: DataFrame, heuristic: str = "hec") -> DataFrame:
    """i, label (from 0) by a coarsening heuristic; edges are (src, dst, w), both directions."""
    if heuristic == "mis2":
        return mis2_coarsen(edges, vertices)
    if heuristic not in HEURISTICS:
        raise ValueError(f"heuristic {heuristic!r} is none of {HEURISTICS}")
    return _named({"hec": hec, "match": match, "mtmetis": two_hop_match, "gosh": gosh, "gosh2": gosh_hubs}[heuristic](edges, vertices))


def multilevel(edges: DataFrame, vertices: DataFrame, heuristic: str = "hec", cutoff: int = 50, least: int = 10, most: int = 200) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """[(edges, vertices with their weights, labels of the level before)], from the finest (no labels) down to the cutoff."""
    steps = Steps(edges.sparkSession, "levels")
    vertices = vertices if "w" in vertices.columns else vertices.withColumn("w", F.lit(1).cast("long"))
    out, n = [(edges, vertices, None)], vertices.count()
    while n > cutoff and len(out) < most:
        e, v, _ = out[-1]
        k = len(out)
        labels = steps.keep(f"labels{k}", mapping(e, v, heuristic))
        new_v = steps.keep(f"vertices{k}", v.join(labels, "i").groupBy(F.col("label").alias("i")).agg(F.sum("w").alias("w")))
        new_n = new_v.count()
        if new_n >= n or new_n < least:
            break
        out.append((steps.keep(f"edges{k}", coarsen_weighted(e, labels)), new_v, labels))
        n = new_n
    return out


def _starts(e: DataFrame, deg: DataFrame, steps: Steps) -> DataFrame:
    """i, degree, root (degree, i): each vertex's component, by its vertex of the least degree, then id."""
    now = steps.keep("root", deg.select("i", "degree", F.struct("degree", "i").alias("root"), F.lit(True).alias("new")))
    while True:
        # Only vertices whose root has changed tell others.
        told = e.join(now.where("new").select(F.col("i").alias("src"), "root"), "src").groupBy(F.col("dst").alias("i")).agg(F.min("root").alias("told"))
        lower = F.coalesce(F.col("told") < F.col("root"), F.lit(False))
        now = steps.keep("root", now.join(told, "i", "left").select("i", "degree", F.when(lower, F.col("told")).otherwise(F.col("root")).alias("root"), lower.alias("new")))
        if not now.where("new").limit(1).count():
            return now.drop("new")


def rcm(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """i, label: reverse Cuthill-McKee, a frontier a round. Components follow each other by their vertex of the least degree; within a frontier, vertices stand by their first parent's place, degree and id.

    All components move at once, so rounds are as many as the longest needs.
    """
    steps = Steps(edges.sparkSession, "rcm")
    e = steps.keep("edges", edges.where("src <> dst").select("src", "dst").distinct())
    known = _starts(e, degrees(edges, vertices), steps)
    # place: within the component; numbered_upto: how many of the component have one, the frontier with it.
    frontier = known.where("i = root.i").select("i", "root", F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("numbered_upto"))
    while True:
        frontier = steps.keep("frontier", frontier)
        if not frontier.limit(1).count():
            break
        placed = steps.add("placed", frontier.select("i", "root", "place"))
        reached = e.join(frontier.select(F.col("i").alias("src"), "place", "numbered_upto"), "src").join(placed.select(F.col("i").alias("dst")), "dst", "left_anti")
        reached = reached.groupBy(F.col("dst").alias("i")).agg(F.min("place").alias("parent"), F.first("numbered_upto").alias("numbered_upto")).join(known, "i")
        new = steps.keep("new", numbered(reached, "root", "parent", "degree", "i"))
        own = new.groupBy("root").agg(F.min("place").alias("least"), F.count("*").alias("n"))
        frontier = new.join(own, "root").select("i", "root", (F.col("place") - F.col("least") + F.col("numbered_upto")).alias("place"), (F.col("numbered_upto") + F.col("n")).alias("numbered_upto"))
    n = known.count()
    if not n:
        return known.select("i", F.lit(0).cast("long").alias("label"))
    return numbered(placed.withColumnRenamed("place", "at"), "root", "at").select("i", (n - 1 - F.col("place")).alias("label"))


def bandwidth(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("i").alias("src"), F.col("label").alias("x")), labels.select(F.col("i").alias("dst"), F.col("label").alias("y"))
    return edges.join(a, "src").join(b, "dst").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("bandwidth"))


def rcb(points: DataFrame, levels: int, ratio: float = 1.1) -> DataFrame:
    """id, part: recursive coordinate bisection of points (id, x[, y[, z]]) into 2^(levels - 1) parts.

    Each part is cut across its longest axis (the first of equal ones) at a midpoint that moves towards
    the heavier side until the halves' sizes are within the ratio, or only one value is left that a cut
    could put on the other side (equal coordinates stay together). All parts of a level are cut side by side; a move is one sum over the points.
    """
    if levels < 2:
        raise ValueError("levels must be two at least")
    steps = Steps(points.sparkSession, "rcb")
    axes = [c for c in ("x", "y", "z") if c in points.columns]
    now = steps.keep("points", points.withColumn("part", F.lit(0).cast("long")))
    for _ in range(levels - 1):
        box = now.groupBy("part").agg(*(f(c).alias(f"{c}_{n}") for c in axes for f, n in ((F.min, "lo"), (F.max, "hi"))))
        longest = F.greatest(*(F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in axes)) if len(axes) > 1 else F.col("x_hi") - F.col("x_lo")
        axis, lo, hi = F.lit(None), F.lit(None), F.lit(None)
        for c in reversed(axes):
            mine = F.col(f"{c}_hi") - F.col(f"{c}_lo") == longest
            axis, lo, hi = F.when(mine, F.lit(c)).otherwise(axis), F.when(mine, F.col(f"{c}_lo")).otherwise(lo), F.when(mine, F.col(f"{c}_hi")).otherwise(hi)
        cuts = {r["part"]: [r["axis"], r["lo"], r["hi"], None] for r in box.select("part", axis.alias("axis"), lo.alias("lo"), hi.alias("hi")).collect()}  # a row for each part
        value = F.coalesce(*(F.when(F.try_element_at(F.create_map(*(x for p, c in cuts.items() for x in (F.lit(p).cast("long"), F.lit(c[0])))), F.col("part")) == a, F.col(a)) for a in axes))
        along = steps.keep("along", now.withColumn("_v", value))
        # Values that the cut may still move past: from `least` (the smallest beyond lo) to `top` (the largest up to hi).
        open_, mids = set(cuts), {p: (c[1] + c[2]) / 2 for p, c in cuts.items()}
        least, top = {p: c[1] for p, c in cuts.items()}, {p: c[2] for p, c in cuts.items()}
        while open_:
            mid = F.try_element_at(F.create_map(*(x for p, m in mids.items() for x in (F.lit(p).cast("long"), F.lit(float(m))))), F.col("part"))
            above = F.col("_v") > mid
            got = along.groupBy("part").agg(F.count_if(above).alias("above"), F.count("*").alias("n"), F.max(F.when(~above, F.col("_v"))).alias("top"), F.min(F.when(above, F.col("_v"))).alias("least")).collect()
            for r in got:
                p, below = r["part"], r["n"] - r["above"]
                if p not in open_:
                    continue
                even = max(below, r["above"]) <= ratio * max(1, min(below, r["above"]))
                if below > r["above"]:
                    cuts[p][2], top[p] = mids[p], r["top"]
                else:
                    cuts[p][1], least[p] = mids[p], r["least"]
                new = (cuts[p][1] + cuts[p][2]) / 2
                if even or new == mids[p] or least[p] is None or least[p] >= top[p]:
                    open_.discard(p)
                else:
                    mids[p] = new
            open_ &= {r["part"] for r in got}
        mid = F.try_element_at(F.create_map(*(x for p, m in mids.items() for x in (F.lit(p).cast("long"), F.lit(float(m))))), F.col("part"))
        now = steps.keep("points", along.withColumn("part", F.col("part") * 2 + (F.col("_v") > mid).cast("long")).drop("_v"))
    return now.select("id", "part")


def balloon(edges: DataFrame, vertices: DataFrame, size: int) -> DataFrame:
    """i, label: clusters grown from every size-th vertex by hash, a step a round; a vertex takes the least label that reaches it."""
    steps = Steps(edges.sparkSession, "balloon")
    e = steps.keep("edges", edges.where("src <> dst").select("src", "dst").distinct())
    own = steps.keep("own", vertices.where(mixed("i") % size == 0).select("i", F.col("i").alias("root")))
    while True:
        rest = vertices.select("i").join(own, "i", "left_anti")
        new = e.join(own.withColumnRenamed("i", "dst"), "dst").join(rest.withColumnRenamed("i", "src"), "src", "left_semi").groupBy(F.col("src").alias("i")).agg(F.min("root").alias("root"))
        new = steps.keep("new", new)
        if not new.limit(1).count():
            break
        own = steps.keep("own", own.unionByName(new))
    own = own.unionByName(vertices.select("i").join(own, "i", "left_anti").select("i", F.col("i").alias("root")))
    return _named(own)
