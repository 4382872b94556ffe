"""What goes in an order, block by block: colours, levels, triangular solves. Chains are longer than steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import graphs as G
from gridloom.operators import krylov, ordered
from gridloom.operators import triangular as T
from gridloom.plans import load
from gridloom.store import Steps


def jobs(spark, name, run):
    """The result, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def edges_of(spark, pairs):
    return spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")


def greedy(n, pairs, preset=(), reach=1):
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    around = near if reach == 1 else {i: set().union(near[i], *(near[j] for j in near[i])) - {i} for i in near}
    color = dict(preset)
    for i in sorted(set(near) - set(color), key=lambda i: (-len(near[i]), -i)):
        color[i] = next(c for c in range(1, n + 2) if c not in {color.get(j) for j in around[i]})
    return color


CLIQUES = [(a, b) for k in (0, 40) for a in range(k, k + 40) for b in range(a + 1, k + 40)] + [(3, 70), (9, 44)]


@pytest.mark.parametrize("limit", [700, 10**6])
def test_color_takes_few_steps(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "LIMIT", limit)
    v = spark.range(81).withColumnRenamed("id", "i")
    got, n = jobs(spark, f"color{limit}", lambda: {r["i"]: r["color"] for r in G.color(edges_of(spark, CLIQUES), v).collect()})
    assert got == greedy(81, CLIQUES)
    assert limit == 700 or n < 60  # a round each colour took over a hundred


@pytest.mark.parametrize("limit", [700, 10**6])
def test_preset_colors_stay(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "LIMIT", limit)
    v, preset = spark.range(81).withColumnRenamed("id", "i"), {3: 7, 50: 1, 80: 2}
    given = spark.createDataFrame(list(preset.items()), "i long, color int")
    got, n = jobs(spark, f"preset{limit}", lambda: {r["i"]: r["color"] for r in G.color(edges_of(spark, CLIQUES), v, given).collect()})
    assert got == greedy(81, CLIQUES, preset.items())
    assert limit == 700 or n < 60


def test_color_of_a_grid_takes_few_steps(spark):
    side = 30  # the order follows the rows, so chains are as long as two sides
    pairs = [(i, j) for i in range(side * side) for j in (i + 1, i + side) if j < side * side and (j != i + 1 or j % side)]
    v = spark.range(side * side).withColumnRenamed("id", "i")
    got, n = jobs(spark, "grid", lambda: {r["i"]: r["color"] for r in G.color(edges_of(spark, pairs), v).collect()})
    assert all(got[a] != got[b] for a, b in pairs) and len(got) == side * side and min(got.values()) == 1
    assert n < 60


@pytest.mark.parametrize("limit", [120, 10**6])
def test_distance_two_without_pairs(spark, limit):
    pairs = [(0, k) for k in range(1, 70)] + [(69, 70), (70, 71), (80, 81)]  # a star: its leaves are two steps apart
    v, e = spark.range(90).withColumnRenamed("id", "i"), edges_of(spark, pairs)
    colors, n = jobs(spark, f"distance2-{limit}", lambda: G.color_distance2(e, v, limit))
    got = {r["i"]: r["color"] for r in colors.collect()}
    assert got == greedy(90, pairs, reach=2)
    assert limit == 120 or n < 60
    assert G.conflicts_distance2(e, colors).first().asDict() == {"conflicts": 0, "uncolored": 0}
    same = spark.createDataFrame([(1, 5), (2, 5), (70, 5), (69, 5), (3, 0)], "i long, color long")
    assert G.conflicts_distance2(e, same).first().asDict() == {"conflicts": 8, "uncolored": 1}


def plain_faults(n, pairs, chosen):
    near = {i: {i} | {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    two = {i: set().union(*(near[j] for j in near[i])) for i in near}
    return {"too_near": sum(b in two[a] for a in chosen for b in chosen if a != b), "uncovered": sum(not two[i] & set(chosen) for i in range(n))}


def test_independent_sets_are_checked_without_pairs(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (70, 2)).tolist() if p[0] != p[1]}
    v, e = spark.range(60).withColumnRenamed("id", "i"), edges_of(spark, pairs)
    for chosen in ([], [1, 2, 3, 30], list(range(0, 60, 7))):
        c = spark.createDataFrame([(i,) for i in chosen], "i long")
        assert G.mis2_faults(e, v, c).first().asDict() == plain_faults(60, pairs, chosen)
    fast = [r["i"] for r in G.mis2(e, v).collect()]
    assert plain_faults(60, pairs, fast) == {"too_near": 0, "uncovered": 0}


@pytest.mark.parametrize("small", [0, 200_000])
def test_independent_set_of_low_degrees(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)  # vertices' tables are joined by a shuffle, or broadcast
    pairs = [(0, k) for k in range(1, 20)] + [(19, 20), (20, 21)]
    got = [r["i"] for r in G.mis2(edges_of(spark, pairs), spark.range(25).withColumnRenamed("id", "i"), quality=True).collect()]
    assert plain_faults(25, pairs, got) == {"too_near": 0, "uncovered": 0}
    assert {21, 22, 23, 24} <= set(got) and 0 not in got


def plans_kept(monkeypatch):
    """Name and plan of each table that is kept from now on."""
    plans, keep = [], Steps.keep

    def noted(self, name, df, *a):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, name, df, *a)

    monkeypatch.setattr(Steps, "keep", noted)
    return plans


@pytest.mark.parametrize("quality", [False, True])
def test_independent_sets_sort_no_edges(spark, monkeypatch, quality):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (70, 2)).tolist() if p[0] != p[1]}
    plans = plans_kept(monkeypatch)
    got = [r["i"] for r in G.mis2(edges_of(spark, pairs), spark.range(60).withColumnRenamed("id", "i"), quality).collect()]
    assert plain_faults(60, pairs, got) == {"too_near": 0, "uncovered": 0} and len(set(got)) == len(got)
    if quality:  # what goes by degree, hash and id one by one
        near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(60)}
        two = {i: {i} | near[i] | {k for j in near[i] for k in near[j]} for i in near}
        chosen = set()
        for i in sorted(near, key=lambda i: (len(near[i]), i * 2654435761 % 2**32, i)):
            if not two[i] & chosen:
                chosen.add(i)
        assert set(got) == chosen
    assert any(name == "first" for name, _ in plans) and not any("SortAggregate" in plan for _, plan in plans)


def test_the_graph_of_suppliers_is_made_by_many_tasks(spark, monkeypatch):
    plans = plans_kept(monkeypatch)
    load()[0]["G05_mis2_quality"](spark, "/root/testdata/sf0.001")
    made = next(plan for name, plan in plans if name == "edges")  # its tables are small, its rows are the square
    assert "RoundRobinPartitioning(4)" in made


@pytest.mark.parametrize("limit", [500, 10**6])
def test_levels_of_a_long_chain(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "LIMIT", limit)
    low = spark.createDataFrame([(i, i - k, 1.0) for i in range(400) for k in (0, 2, 3) if i >= k], "i long, j long, v double")
    rows = spark.range(400).withColumnRenamed("id", "i")
    got, n = jobs(spark, f"levels{limit}", lambda: {r["i"]: r["level"] for r in T.levels(low, rows).collect()})
    assert got == {i: 1 + i // 2 for i in range(400)}
    assert {r["i"]: r["level"] for r in T.levels(low, rows, trans="T").collect()} == {399 - i: 1 + i // 2 for i in range(400)}
    assert limit == 500 or n < 40  # two hundred levels


def growing(spark, n):
    """A unit lower triangle whose solutions grow past what doubles hold, and a right side."""
    low = spark.createDataFrame([(i, i - k, v) for i in range(n) for k, v in ((0, 1.0), (2, 2.0), (3, 3.0)) if i >= k], "i long, j long, v double")
    return low, spark.createDataFrame([(i, 1.0 + i % 7) for i in range(n)], "i long, v double")


def test_exact_solution_gives_the_right_side_back(spark, monkeypatch):
    low, b = growing(spark, 300)
    x = T.solve(low, b, exact=True)
    assert max(abs(T._number(r["v"])) for r in x.collect()) > 2**60
    assert sorted(T.exact_product(low, x, b).collect()) == sorted(b.collect())
    monkeypatch.setattr(T, "EXACT_LIMIT", 100)
    assert sorted(T.solve(low, b, exact=True).collect()) == sorted(x.collect())
    halves = spark.createDataFrame([(0, 0, 3.0), (1, 0, 0.5), (1, 1, -1.0)], "i long, j long, v double")
    y = T.solve(halves, b.where("i < 2"), exact=True)
    assert sorted(tuple(r) for r in y.collect()) == [(0, "0x1/0x3"), (1, "-0xb/0x6")]


def test_exact_solution_of_the_transpose(spark):
    low, b = growing(spark, 300)
    x = T.solve(low, b, "L", "T", exact=True)
    back = T.exact_product(low.selectExpr("j as i", "i as j", "v"), x, b)
    assert sorted(back.collect()) == sorted(b.collect())


@pytest.mark.parametrize("limit", [500, 10**6])
def test_solve_of_a_long_chain(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "LIMIT", limit)
    low = spark.createDataFrame([(i, j, v) for i in range(200) for j, v in ((i, 4.0), (i - 1, 1.0), (i - 7, 2.0)) if j >= 0], "i long, j long, v double")
    dense = np.zeros((200, 200))
    for i, j, v in low.collect():
        dense[i, j] = v
    b = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "i long, v double")
    for uplo, trans, a in (("L", "N", dense), ("L", "T", dense.T)):
        got, n = jobs(spark, f"solve{trans}{limit}", lambda: [r["v"] for r in T.solve(low, b, uplo, trans).orderBy("i").collect()])
        assert np.allclose(got, np.linalg.solve(a, np.arange(200) % 5))
        assert limit == 500 or n < 40  # two hundred levels


def test_exact_preconditioner(spark):
    low, b = growing(spark, 120)
    up = low.selectExpr("j as i", "i as j", "v")
    x = krylov.LU(low, up, exact=True).apply(b)
    back = T.exact_product(low, T.exact_product(up, x, b, text=True), b)
    assert sorted(back.collect()) == sorted(b.collect())
