"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance r or less share a variant that is at most r/2 away from both. So every
distinct fingerprint emits all variants within r/2, rows are shuffled on the variant, and those that
meet are linked. For r = 2 that is 65 variants, and all that share one are within 2 of each other: a
variant has at most 65 fingerprints, and a chain through them links them all. Copies collapse to
one fingerprint before anything is emitted.

For texts that are similar but not nearly equal (`similar_documents`), ball hashing comes first, too.
But at a Jaccard similarity of 0.8 about 15 % of all bits differ, which would need balls of millions of
variants. So sets of shingles that share one of their rarest are candidates as well, a wider fingerprint
rules out most of those that only do that, and all links are verified on the sets themselves.

Defined results: null and empty texts have no words and fingerprint zero, which links like any
other; fewer words than a shingle make one shingle; repeated rows each get a row; null doc_ids take
part in links, and component_id is the least doc_id that is not null (null if there is none); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTables, worker_cache
from .components import components

CHUNK = 1 << 16
WIDE = 4  # 64-bit words of the wide fingerprint, and one more
BEFORE = 2  # shingles just before a common one in which an earlier common one is sought
SAMPLE, COMMON = 8000, 500_000  # sets whose shingles are counted, about; shingles that are kept as common


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of so many words, repeats included; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= shingle:
        return [h(joined, seed)]
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; zero without words."""
    return majority(np.array(shingle_hashes(text, shingle, seed), "<u8"))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Five SimHash words of a set of shingles: each takes the hashes' bits anew, by another odd multiplier."""
    out = []
    for k in range(WIDE + 1):
        x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * k & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out.append(majority(x))
    return out


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash", dict)
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(fp, radius: int):
    """All 64-bit variants of a long column within 0 or 1 bits, as an array."""
    if radius == 0:
        return F.array(fp)
    if radius != 1:
        raise ValueError("a ball of over 1 bit has thousands of variants; use a radius of 2 or 3 in all")
    return F.array(fp, *(fp.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough to connect all that are within radius (0 to 2) of each other."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    rows = fps.select("fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    met = rows.withColumn("a", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))).where("a is not null").select("a", F.col("fp").alias("b"))
    if radius < 2:  # what shares a variant may be 2 apart; at radius 1 only neighbours through one of the two themselves count
        met = rows.alias("x").join(fps.alias("y"), F.expr("x.variant = y.fp and x.fp <> y.fp")).select(F.expr("x.fp a"), F.expr("y.fp b"))
    return met.distinct().where(F.expr(f"bit_count(a ^ b) <= {radius}"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the least doc_id that links reach."""
    work = WorkTables(docs.sparkSession, "simhash")
    prints = work.save(with_fingerprints(docs, shingle), "prints")
    classes = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, radius), work)
    # Only fingerprints that have a link get here; all others are a component of their own.
    joined = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "least", "root")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(least, "root").select("fp", "component_id")
    named = work.save(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    out = prints.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, h (hash of the text), group: documents that links join have the same group. Links are the pairs of the given Jaccard similarity of shingles or more.

    Ball hashing of the sets' SimHash gives the first candidates: sets with one fingerprint, and one set of
    each of two fingerprints that are linked. It can't reach all pairs of such a similarity, so prefix
    filtering gives the rest: with all shingles in one order, two sets that are similar share one of the first
    |x| - ceil(similarity |x|) + 1 shingles of both, so no pair is missed, whatever the corpus's size. Any
    order is right; common shingles (counted on a bounded sample) come last, so that sets which share a
    passage but little else don't meet. First each set is linked with one of each list it stands in: the one
    with the fewest shingles before, which is nearest to what the list's sets have in common. Only sets that
    this leaves in different clusters are compared pair by pair, where they can be similar by their sizes,
    fingerprints and places: behind their first common shingle both must have enough left.
    """
    work = WorkTables(docs.sparkSession, "similar")
    words = [f"f{k}" for k in range(WIDE + 1)]
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), *((w, pa.int64()) for w in words), ("tokens", pa.list_(pa.int64()))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    common, counts = _common_shingles(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        worker_cache("simhash", dict)
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(x.as_py(), shingle), "<u8")) for x in b.column(2)]
            c = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fps = np.array([wide_fingerprint(x) for x in sets], np.uint64).reshape(-1, WIDE + 1).view(np.int64)
            tokens = pa.array([_prefix(x, common, counts, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(fps[:, k].copy()) for k in range(WIDE + 1)), tokens], schema=schema)

    prints = work.save(rows.mapInArrow(run, "doc_id long, h long, c long, n long, " + ", ".join(f"{w} long" for w in words) + ", tokens array<long>"), "prints")
    # Equal sets are one class, and one of its rows stands for it.
    classes = work.save(prints.groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("r"), *(F.first(x).alias(x) for x in ("n", *words))), "classes")
    prefixes = prints.dropDuplicates(["c"]).select("c", "n", F.posexplode("tokens").alias("pos", "token"), "tokens")
    prefixes = prefixes.select("token", "c", "n", "pos", F.expr(f"slice(tokens, greatest(pos - {BEFORE}, 0) + 1, least(pos, {BEFORE})) before"))
    lists = prefixes.groupBy("token").agg(F.min_by("c", F.struct("pos", "c")).alias("hub"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token", "hub")
    met = work.save(prefixes.join(work.save(lists, "lists"), "token"), "met")

    sides = {side: classes.select(*(F.col(x).alias(f"{side}_{x}") for x in ("c", "n", *words))) for side in "ab"}
    gap = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    fits = _may_be_similar(similarity, gap)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.unique(np.array(shingle_hashes(x.as_py(), shingle), "<u8")).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["c", "s"])

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) those whose sets are similar, all shingles compared."""
        need = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        need = classes.join(need, "c").select("c", F.col("r.doc_id").alias("need_id"), F.col("r.h").alias("need_h"))
        texts = rows.join(need, F.expr("doc_id <=> need_id and h = need_h")).select("c", "text")
        some = work.save(texts.mapInArrow(to_sets, "c long, s binary").dropDuplicates(["c"]), f"sets-{name}")
        pairs = pairs.join(some.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(some.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        out = work.save(pairs.select("a", "b", "x", "y").mapInArrow(_same_sets(similarity), "a long, b long"), f"links-{name}")
        work.drop(f"sets-{name}")
        return out

    def clusters(links: DataFrame, name: str) -> DataFrame:
        roots = components(links, work.part(f"round-{name}"))
        return work.save(classes.select("c").join(roots, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("label")), f"labels-{name}")

    hubs = met.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    hubs = hubs.join(sides["a"], F.col("a") == F.col("a_c")).join(sides["b"], F.col("b") == F.col("b_c")).where(fits).select("a", "b")
    links = similar(work.save(hubs.union(_met_in_balls(classes, work)).distinct(), "hubs"), "hubs")
    labels = clusters(links, "hubs")
    # Lists that still hold several clusters: every pair across clusters.
    met = work.save(met.select("token", "c", "pos", "before").join(labels, "c"), "open")
    mixed = met.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    met = work.save(met.join(mixed, "token").join(classes.drop("r"), "c"), "mixed")
    x, y = (met.select("token", *(F.col(v).alias(f"{side}_{v}") for v in ("label", "c", "pos", "before", "n", *words))) for side in "ab")
    # Where a shingle just before is common as well, the pair has met there; its first common shingle has none before.
    first = ~F.arrays_overlap("a_before", "b_before")
    pairs = x.join(y, "token").where(F.expr("a_c < b_c and a_label <> b_label") & fits & _enough_left(similarity) & first)
    pairs = work.save(pairs.select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct(), "pairs")
    labels = clusters(links.union(similar(pairs, "pairs")), "pairs")
    out = work.save(prints.select("doc_id", "h", "c").join(labels.select("c", F.col("label").alias("group")), "c").select("doc_id", "h", "group"), "groups")
    for part in ("prints", "met", "mixed", "open"):
        work.drop(part)
    return out


def _met_in_balls(classes: DataFrame, work: WorkTables) -> DataFrame:
    """Pairs (a, b) of classes `c` whose SimHash `f0` is the same or linked by ball hashing. One class stands for each fingerprint."""
    heads = work.save(classes.groupBy(F.col("f0").alias("fp")).agg(F.min("c").alias("head")), "heads")
    same = classes.join(heads, F.col("f0") == F.col("fp")).where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b"))
    near = work.save(links(heads, 2), "near")
    ends = [heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_c")) for side in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    return same.union(near)


def _may_be_similar(similarity: float, gap):
    """What sizes and fingerprints (a_n, b_n and the bits that differ) don't rule out.

    The share of differing bits that a similarity gives is at most the angle of equally large sets, over pi;
    five standard deviations more pass, and all small sets do, whose majorities are often ties.
    """
    from math import acos, pi, sqrt

    share, n = acos(2 * similarity / (1 + similarity)) / pi, 64 * (WIDE + 1)
    least, most = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (least >= most * similarity - 1e-9) & ((least < 50) | (gap <= int(n * share + 5 * sqrt(n * share * (1 - share)) + 1)))


def _enough_left(similarity: float):
    """What places (from 0) in the order don't rule out, if the token is the first that a and b share: the rest of both holds the overlap that the similarity takes."""
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * (similarity / (1 + similarity)) - 1e-9)
    return F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= overlap


def _common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample's texts have, ascending, and how many. They only order shingles, so the sample costs no pair."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(shingle_hashes(x.as_py(), shingle), "<u8")).view(np.int64))], names=["token"])

    share = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(share)) == 0).select("text")
    found = some.mapInArrow(explode, "token long").groupBy("token").count().where("count >= 4").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, counts = found["token"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefix(x: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of an ascending set by count, then by hash: any similar set has one of them among its own first."""
    first = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        x = x[np.argsort(np.where(common[at] == x, counts[at], 0), kind="stable")]
    return x[:first]


def _same_sets(similarity: float):
    """a, b and their sets x, y -> a, b of those whose Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= similarity * (len(both) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of each group the one with the least doc_id stays (a null id is the largest), all columns as they were; of rows that share doc_id and text, the one whose other columns come first as JSON."""
    groups = similar_documents(docs, shingle, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    stays = groups.groupBy("group").agg(F.min(order).alias("x")).select("x.doc_id", "x.h")
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__h", F.xxhash64("text"))
    kept = rows.alias("d").join(stays.alias("s"), F.expr("d.__id <=> s.doc_id and d.__h = s.h"), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.to_json(F.struct(*others)) if others else F.lit(""))
    return kept.groupBy("__id", "__h").agg(row.alias("__row")).select("__row.*")
