"""Approximate nearest neighbours by cosine: probed lists, scanned by adaptive dimension sampling.

Vectors are brought to unit length and rotated at random, so that any leading columns are a fair
sample of the distance. They are dealt to lists by their nearest of some centroids, which are fitted
to a bounded sample, half the root of the rows in number up to MAX_LISTS; every vector is in a list. A query
probes its nearest lists, as many as hold RECALL of the sample's true neighbours, and more where those
hold fewer than k others. Within a list the columns are read in blocks: after each, a hypothesis test
compares the distance so far, scaled to all columns, with the query's limit, and candidates that are too
far at the test's confidence are read no further. The limit is at first the distance of the query's k-th
nearest of the sample in the probed lists, and comes down as nearer ones are found. What is
left is scored again on the original vectors, in double precision.

A list is split into blocks of rows of a bounded size, and queries into groups of one, so a common
vector, however common, fills no task.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part,
nor do those of another length than most; rows that repeat a vec_id are one candidate each, but
none for a query of that vec_id, and a repeated query is asked once; null vec_ids are neither; equal
scores go by vec_id; fewer candidates than k are all returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTables

FIT_ROWS = 8000  # vectors that centroids are fitted to, at most
FIT_QUERIES = 300
MAX_LISTS = 1000  # an eighth of the vectors that they are fitted to
RECALL = 0.97
COLUMNS = 16  # to a block
DOUBT = 2.1  # the test's width: larger abandons fewer
MIN_ROWS, MAX_ROWS = 256, 8192  # of a block
QUERIES = 20_000  # to a group


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; the start is a spread of the rows as they come."""
    c = np.unique(x[np.linspace(0, len(x) - 1, lists).astype(int)], axis=0)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def lists_to_probe(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many of a query's nearest lists hold RECALL of its k nearest, on the sample."""
    q = x[np.linspace(0, len(x) - 1, min(len(x), FIT_QUERIES)).astype(int)]
    near = q @ x.T
    near[near > 1 - 1e-12] = -2  # itself, and its copies, which are in its own list
    top = np.argsort(-near, axis=1)[:, :k]
    home = np.argmax(x @ c.T, axis=1)
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def scan(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, limits: np.ndarray | None = None, doubt: float = DOUBT, chunk: int = 512, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that may be among the k nearest; q, x: rotated unit vectors, own, ids: their vec_ids.

    limits: squared distances that each query's k-th nearest is known not to exceed. tally: gets
    (candidates, those abandoned before their last columns).
    """
    dim = x.shape[1]
    best = np.full((len(q), k), np.inf)  # squared distances
    limits = np.full(len(q), np.inf) if limits is None else limits
    pairs, seen, dropped = [], 0, 0
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk]
        limit = np.minimum(best[:, -1], limits)[:, None]
        dist, alive = np.zeros((len(q), len(part))), own[:, None] != ids[None, at : at + chunk]
        began = int(alive.sum())
        seen += began
        for a in range(0, dim, COLUMNS):
            b = min(a + COLUMNS, dim)
            qs, ps = q[:, a:b], part[:, a:b]
            if alive.mean() > 0.2:
                dist += (qs**2).sum(1)[:, None] + (ps**2).sum(1)[None] - 2 * qs @ ps.T
            else:
                i, j = np.nonzero(alive)
                dist[i, j] += ((qs[i] - ps[j]) ** 2).sum(1)
            width = 1 + doubt / np.sqrt(b) if b < dim else 1 + 1e-9
            alive &= dist * (dim / b) <= limit * width**2 + 1e-9
            if b < dim <= b + COLUMNS:  # the last block but one
                dropped += began - int(alive.sum())
        i, j = np.nonzero(alive)
        pairs.append((i, j + at, dist[i, j]))
        best = np.sort(np.hstack([best, np.partition(np.where(alive, dist, np.inf), min(k, len(part)) - 1, axis=1)[:, :k]]), axis=1)[:, :k]
    if tally is not None:
        tally.append((seen, dropped))
    i, j, d = (np.concatenate(c) for c in zip(*pairs))
    keep = d <= np.minimum(best[:, -1], limits)[i] + 1e-9  # the limit has come down since; ties stay
    return i[keep], j[keep]


def sample_limits(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, probed: list | None = None, home: np.ndarray | None = None, chunk: int = 500) -> np.ndarray:
    """Squared distance of each query's k-th nearest in the sample x, of other vec_ids and in the lists it probes (home: the sample's lists); infinite if there are fewer."""
    out = np.full(len(q), np.inf)
    if len(x) >= k:
        for a in range(0, len(q), chunk):
            near = q[a : a + chunk] @ x.T
            near[own[a : a + chunk, None] == ids[None]] = -np.inf
            if probed is not None:
                met = np.zeros((len(near), home.max() + 1 + max(int(p.max()) for p in probed)), bool)
                for j, p in enumerate(probed[a : a + chunk]):
                    met[j, p] = True
                near[~met[:, home]] = -np.inf
            out[a : a + chunk] = 2 - 2 * np.partition(near, len(x) - k, axis=1)[:, len(x) - k] + 1e-9
    return out


def usable(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.empty(0)]).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # squares of very large components would overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    work = WorkTables(spark, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id is not null")
    dims = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 1
    rows = rows.where(usable(F.col("v"), dim))
    sampled = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(FIT_ROWS).collect()
    sample_ids, sampled = np.array([r["vec_id"] for r in sampled], np.int64), [r["v"] for r in sampled]
    n = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    x = _unit(np.array(sampled))
    c = centroids(x, int(min(MAX_LISTS, max(1, -(-len(x) // 8)), max(1, round(np.sqrt(n) / 2)))))
    sent, known = spark.sparkContext.broadcast((c, lists_to_probe(x, c, k))), spark.sparkContext.broadcast((x, sample_ids, np.argmax(x @ c.T, axis=1)))  # at most FIT_ROWS vectors

    def deal(batches):
        c, probes = sent.value
        for b in batches:
            near = _unit(_matrix(pa.chunked_array([b.column(1)]), dim)) @ c.T
            home = np.argmax(near, axis=1)
            order = np.argsort(-near, axis=1)[:, :probes].astype(np.int32)
            asked = b.column(2).to_numpy(zero_copy_only=False)
            probed = [o if a else None for o, a in zip(order, asked)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32)), pa.array(probed, pa.list_(pa.int32()))], names=["vec_id", "v", "list", "probed"])

    dealt = work.save(rows.mapInArrow(deal, "vec_id long, v array<double>, list int, probed array<int>"), "dealt")
    size = int(min(MAX_ROWS, max(MIN_ROWS, n / len(c))))
    blocks = dealt.groupBy("list").count().select("list", "count", F.ceil(F.col("count") / size).cast("int").alias("blocks"))  # a row for each list
    blocks = work.save(blocks, "blocks")
    sizes = np.zeros(len(c), np.int64)
    for r in blocks.collect():
        sizes[r["list"]] = r["count"]
    blocks = F.broadcast(blocks.drop("count"))

    def widen(batches):
        """Goes on to the next lists where those probed hold fewer than k rows of other vec_ids."""
        c, probes = sent.value
        for b in batches:
            order = np.argsort(-(_unit(_matrix(pa.chunked_array([b.column(1)]), dim)) @ c.T), axis=1).astype(np.int32)
            held = np.cumsum(sizes[order], axis=1)
            enough = (held < (k + b.column(2).to_numpy())[:, None]).sum(1) + 1
            probed = [o[: max(probes, e)] for o, e in zip(order, enough)]
            limits = sample_limits(_unit(_matrix(pa.chunked_array([b.column(1)]), dim)), b.column(0).to_numpy(), *known.value[:2], k, probed, known.value[2])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(probed, pa.list_(pa.int32())), pa.array(limits)], names=["vec_id", "v", "probed", "far"])

    asked = dealt.where("probed is not null").dropDuplicates(["vec_id"]).select("vec_id", "v")
    asked = asked.join(dealt.groupBy("vec_id").agg(F.count("*").alias("copies")), "vec_id").mapInArrow(widen, "vec_id long, v array<double>, probed array<int>, far double")
    asked = work.save(asked, "asked")
    groups = 1 + asked.count() // QUERIES
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), n).cast("int")
    # The row's place in its task joins in, as rows may repeat a vec_id.
    own = F.pmod(F.xxhash64("vec_id") + F.monotonically_increasing_id(), F.col("blocks")).cast("int")
    data = dealt.join(blocks, "list").select("vec_id", "v", "list", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    queries = asked.select("vec_id", "v", "far", spread(1, F.lit(groups)).alias("part"), F.explode("probed").alias("list")).join(blocks, "list")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"), F.col("list").alias("q_list"), F.col("part").alias("q_part"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "far")
    names = ["query_id", "vec_id", "score"]

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        q, x, own, ids = _matrix(left["q"], dim), _matrix(right["v"], dim), left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        turn, found, far = rotation(dim), [], left["far"].to_numpy()
        rq, rx, xn = _unit(q) @ turn, _unit(x) @ turn, None
        for a in range(0, len(q), 2000):
            i, j = scan(rq[a : a + 2000], rx, own[a : a + 2000], ids, k, far[a : a + 2000])
            for b in range(0, len(i), 200_000):
                qi, xj = q[a + i[b : b + 200_000]], x[j[b : b + 200_000]]
                qi, xj = qi / np.abs(qi).max(1, keepdims=True), xj / np.abs(xj).max(1, keepdims=True)
                s = (qi * xj).sum(1) / (np.sqrt((qi * qi).sum(1)) * np.sqrt((xj * xj).sum(1)))
                found.append((a + i[b : b + 200_000], ids[j[b : b + 200_000]], s))
        i, v, s = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        order = np.lexsort((v, -s, i))
        i, v, s = i[order], v[order], s[order]
        first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0)) if len(i) else i
        keep = rank < k
        return pa.table([pa.array(own[i[keep]]), pa.array(v[keep]), pa.array(s[keep])], names=names)

    found = queries.groupBy("q_list", "q_block", "q_part").cogroup(data.groupBy("list", "block", "part")).applyInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
