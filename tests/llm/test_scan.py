"""How much of a scan is abandoned, and recall on the table of embeddings."""

import numpy as np
import pyarrow.parquet as pq

DIR = "/root/testdata"


def embeddings(sf):
    t = pq.read_table(f"{DIR}/{sf}/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, v = t["vec_id"].to_numpy(), t["embedding"].to_pylist()
    ok = [k for k, e in enumerate(v) if e is not None and len(e) == 64 and None not in e and np.isfinite(e).all() and np.any(e)]
    return ids[ok], np.array([v[k] for k in ok], float)


def shares(q, own, x, ids, k=5):
    from gridloom.llm import neighbours as N

    q, x = N._unit(q), N._unit(x)
    pick = np.random.default_rng(0).permutation(len(x))[: N.FIT_ROWS]
    limits = N.sample_limits(q, own, x[pick], ids[pick], k)
    tally, turn = [], N.rotation(x.shape[1])
    i, j = N.scan(q @ turn, x @ turn, own, ids, k, limits, tally=tally)
    near = q @ x.T
    near[own[:, None] == ids[None]] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    found = set(zip(i.tolist(), j.tolist()))
    return tally[0][1] / tally[0][0], np.mean([(a, b) in found for a, row in enumerate(best.tolist()) for b in row])


def test_candidates_are_abandoned_on_the_table():
    ids, v = embeddings("sf0.1")
    own = np.flatnonzero(ids % 50 == 0)
    abandoned, recall = shares(v[own], ids[own], v, ids)
    assert abandoned >= 0.1 and recall >= 0.97


def test_clusters_abandon_most():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    x = centre[np.arange(4000) % 40] + 0.2 * rng.normal(size=(4000, 64))
    ids = np.arange(4000)
    abandoned, recall = shares(x[:200], ids[:200], x, ids)
    assert abandoned > 0.8 and recall >= 0.97


def test_recall_on_the_table(spark):
    from pyspark.sql import functions as F

    from gridloom.llm.neighbours import nearest

    ids, v = embeddings("sf0.01")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in nearest(spark.read.parquet(f"{DIR}/sf0.01/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        near = v @ v[k]
        near[ids == ids[k]] = -2
        want = set(ids[np.argsort(-near, kind="stable")[:5]].tolist())
        hit, total = hit + len(want & got[ids[k]]), total + 5
    assert hit / total >= 0.9
