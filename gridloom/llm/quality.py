"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Each word bucket has a fixed sparse random index vector. A word's vector is the sum of its
neighbours' index vectors over the whole corpus: tasks sum them by bucket, the sums are added up, a
table of fixed size whatever the corpus. Words go to buckets by a hash of their letters. A word's
looks (case, digits, marks) and whether it repeats the one before or any before it are words of
their own, with index vectors only. A document is the weighted mean of its words' vectors (frequent
words weigh less) beside the mean of its looks; the network gives a probability whose temperature
is set on learnt rows that the network's weights were not fitted to.

The sample of labelled rows is bounded (MOST); counts and vectors come from all documents, and whole
texts are scored.

Defined results: null and empty texts pool to zeros and get what the network gives those; repeated
rows each get a row; without labels of both classes every score is 0.5; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, worker_cache
from .labelled import held_out, learnable, sample

#: Labelled documents that are learnt from, at most, by class.
MOST = {0: 3000, 1: 5000}
BUCKETS, LOOKS, DIM = 4096, 512, 32
REACH = 2  # neighbours on each side
ONES = 4  # entries of an index vector that aren't zero
COMMON = 1e-3  # a word this frequent weighs half
HIDDEN = 32
THRESHOLD = 0.3
CACHED_WORDS = 300_000
REPEATS, SEEN = LOOKS - 1, LOOKS - 2

_RUNS = re.compile(r"(.)\1+", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n words the places of its entries and their signs."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((n, DIM)), axis=1)[:, :ONES], rng.choice([-1.0, 1.0], (n, ONES))


def dense(places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), DIM), np.float32)
    np.put_along_axis(out, places, signs.astype(np.float32), axis=1)
    return out


def looks(word: str) -> str:
    """Case, digits and marks, runs as one: 'Hello!!' -> 'Aa!!'. Runs of marks keep one repetition."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(lambda m: m[1] if m[1] in "Aa9" else 2 * m[1], out)


class Codes(dict):
    """word as it stands -> bucket * LOOKS + looks."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32("".join(_LETTERS.findall(word.lower())).encode("utf-8", "surrogatepass")) % BUCKETS
        code = bucket * LOOKS + zlib.crc32(looks(word).encode("utf-8", "surrogatepass")) % SEEN
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = code
        return code


def chunks(texts: list[str | None], codes: Codes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, codes of all words, text of each) for some texts at a time."""
    at = 0
    while at < len(texts):
        to, chars, found, of = at, 0, [], []
        while to < len(texts) and (to == at or chars < 2_000_000):
            words = (texts[to] or "").split()
            chars += len(texts[to] or "")
            found += map(codes.__getitem__, words)
            of.append(len(words))
            to += 1
        yield at, np.array(found, np.int64), np.repeat(np.arange(to - at), of)
        at = to


def add_contexts(sums: np.ndarray, bucket: np.ndarray, of: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to each bucket's sum the index vectors of its neighbours in the same text."""
    for o in range(1, REACH + 1):
        same = of[o:] == of[:-o]
        a, b = bucket[:-o][same], bucket[o:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(ONES):
                sums += np.bincount(x * DIM + places[y, k], signs[y, k], BUCKETS * DIM).reshape(BUCKETS, DIM)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x (DIM + 1): the word vectors, at unit length and with a weight as the last column. Over all documents."""
    names = [f"v{k}" for k in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, (places, signs) = worker_cache("codes", Codes), index_vectors(BUCKETS, 1)
        sums, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, code, of in chunks(batch.column(0).to_pylist(), codes):
                bucket = code // LOOKS
                counts += np.bincount(bucket, minlength=BUCKETS)
                add_contexts(sums, bucket, of, places, signs)
        kept = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts[kept]), *(pa.array(sums[kept, k].astype(np.int64)) for k in range(DIM))], names=["bucket", "n", *names])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long, " + ", ".join(f"{n} long" for n in names))
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIM + 1), np.float32)
    if len(got):
        v = got[names].to_numpy(float)
        share = got["n"].to_numpy(float) / got["n"].sum()
        out[got["bucket"].to_numpy(), :DIM] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        out[got["bucket"].to_numpy(), DIM] = COMMON / (COMMON + share)
    return out


def pool(texts: list[str | None], codes: Codes, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """texts x 2 DIM."""
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    for at, code, of in chunks(texts, codes):
        if not len(code):
            continue
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        doc = at + of[first]
        n = np.diff(np.r_[first, len(of)])[:, None]
        bucket, look = code // LOOKS, code % LOOKS
        v = vectors[bucket]
        weight = v[:, DIM:]
        out[doc, :DIM] = np.add.reduceat(v[:, :DIM] * weight, first, axis=0) / np.maximum(np.add.reduceat(weight, first, axis=0), 1e-9)
        shown = np.add.reduceat(index[look], first, axis=0)
        again = np.r_[False, (bucket[1:] == bucket[:-1]) & (of[1:] == of[:-1])]
        # Words that stand earlier in the same text.
        key = of * BUCKETS + bucket
        earlier = np.ones(len(key), bool)
        earlier[np.unique(key, return_index=True)[1]] = False
        for flag, which in ((again, REPEATS), (earlier, SEEN)):
            shown += np.add.reduceat(flag.astype(np.float32), first)[:, None] * index[which]
        out[doc, DIM:] = shown / n
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 0) -> Network:
    """Adam on the log loss; a fifth of the rows are left for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, fitted = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
    x = x.astype(float)
    mean, scale = x[fitted].mean(0), x[fitted].std(0) + 1e-6
    p = [rng.normal(0, (1 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z, t = (x[fitted] - mean) / scale, y[fitted].astype(float)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        turn = rng.permutation(len(z))
        for k in range(0, len(z), 128):
            xb, tb = z[turn[k : k + 128]], t[turn[k : k + 128]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - tb) / len(xb)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for q, g, a, b in zip(p, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, t = net.logits(x[kept]), y[kept]
    loss = lambda T: np.logaddexp(0, np.where(t == 1, -1, 1) * logit / T).mean()
    net.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return net


def quality(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted, for every document."""
    spark = docs.sparkSession
    work = WorkTables(spark, "quality")
    vectors = spark.sparkContext.broadcast(corpus_vectors(docs))

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index = worker_cache("codes", Codes), dense(*index_vectors(LOOKS, 2))
        for b in batches:
            x = pool(b.column(1).to_pylist(), codes, vectors.value, index)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, 2 * DIM, dtype=np.int32), pa.array(x.ravel()))], names=["doc_id", "x"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = work.save(docs.mapInArrow(pooled, "doc_id long, x array<float>"), "pooled")
    chosen = F.broadcast(sample(learnable(labels, "quality"), most))  # at most sum(most) rows
    got = sorted(table.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).collect())
    y = np.array([r["y"] for r in got])
    net = spark.sparkContext.broadcast(fit(np.array([r["x"] for r in got]), y) if len(set(y.tolist())) == 2 else None)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * DIM)
            p = net.value.probabilities(x) if net.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    out = table.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
