"""Removal of every byte that a repeated substring of a set length (the threshold) covers.

Prefix doubling gives each position a name for its first 1, 2, 4, ... bytes: equal names, equal
bytes. Within a text the doubling needs no shuffle, as the name at position p + h is at hand. Names
are compared over all texts, and positions drop out as soon as they are known to be unique or are
past the threshold:

1. A window is a substring of the threshold's length; its mark is the least name among the grams of
   half that length in it. Equal windows have equal marks. Neighbouring windows with one mark form a run.
2. Runs whose mark no other run has are unique and drop out. This leaves a small part.
3. Of the rest, runs that are equal as a whole are repeated throughout; they are past the threshold.
4. What is left are runs at the edges of repeated passages. Their windows' names, at the full length,
   are compared one by one; one run of each group of equal ones takes part too.

All comparisons are sums by key before the shuffle, or equi-joins whose hot keys AQE splits; the
rows that any step moves are in proportion to the bytes, and no group is gathered in one task.
Names have 64 bits; what is called equal has two equal ones (a run its mark and its name, a window two
names of its own), so a chance collision is out of reach.

Defined results: null and empty texts have no bytes; texts shorter than the threshold keep all;
repeated rows are repeated texts, and rows that share a doc_id are told apart by their texts; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables
from .substrings import least_of, names, pair

SEGMENT = 1 << 19  # window starts at a time: bounds the memory whatever a text's length
RUN = 150  # windows in a run, at most: its first and last then overlap


def segments(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start of each piece in them, its text, its place in the text); pieces of one text overlap by threshold - 1 bytes."""
    raw, at, of, place, size = [], [], [], [], 0

    def flush():
        return np.frombuffer(b"".join(raw), np.uint8), np.array(at, np.int64), np.array(of, np.int64), np.array(place, np.int64)

    for k, text in enumerate(texts):
        for start in range(0, max(0, len(text) - threshold + 1), SEGMENT):
            piece = text[start : start + SEGMENT + threshold - 1]
            raw.append(piece)
            at.append(size)
            of.append(k)
            place.append(start)
            size += len(piece)
            if size >= SEGMENT:
                yield flush()
                raw, at, of, place, size = [], [], [], [], 0
    if raw:
        yield flush()


def runs(texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, mark, name, several) of every run; several: the mark stands more than once in the run."""
    gram = threshold // 2
    width = threshold - gram + 1
    for raw, at, of, place in segments(texts, threshold):
        grams, windows = names(raw, gram, threshold)
        grams = grams * np.uint64(0xD6E8FEB86659FD93)
        marks = least_of(grams, width)
        piece = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(raw)]))[: len(marks)]
        inside = np.arange(len(marks)) + threshold <= np.r_[at[1:], len(raw)][piece]
        starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1])])
        sizes = np.diff(np.r_[starts, len(marks)])
        keep = inside[starts]
        starts, sizes = starts[keep], sizes[keep]
        # An anchor is a gram that is some window's mark: the largest mark of the windows around it is its own name.
        around = np.zeros(len(grams) + width - 1, np.uint64)
        around[width - 1 : width - 1 + len(marks)] = np.where(inside, marks, np.uint64(0))
        anchors = np.flatnonzero(~least_of(~around, width) == grams)
        order = np.lexsort((anchors, grams[anchors]))
        anchors = anchors[order]
        values, first = np.unique(grams[anchors], return_index=True)
        # Number of the mark's anchors in [start, start + windows + width - 1): ranks within the mark's own anchors.
        rank = np.searchsorted(values, marks[starts])
        base = first[rank] * (len(raw) + 1)
        key = np.repeat(first, np.diff(np.r_[first, len(anchors)])) * (len(raw) + 1) + anchors
        several = np.searchsorted(key, base + starts + sizes + width - 1) - np.searchsorted(key, base + starts) > 1
        parts = -(-sizes // RUN)
        which = np.repeat(np.arange(len(starts)), parts)
        shift = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        lo, n = starts[which] + shift, np.minimum(RUN, sizes[which] - shift)
        name = pair(pair(windows[lo], windows[lo + n - 1]), n.astype(np.uint64))
        own = piece[lo]
        yield of[own], place[own] + lo - at[own], n, marks[lo].view(np.int64), name.view(np.int64), several[which] | (parts[which] > 1)


def named_windows(texts: list[bytes], spans: list[list[dict]], threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, window, name, another name, asked) for the windows of the spans (lo, n, asked) of each text."""
    raw, size, rows = [], 0, []

    def flush():
        joined = np.frombuffer(b"".join(raw), np.uint8)
        name, other = (names(joined, threshold, seed=seed)[0].view(np.int64) for seed in (0x51, 0xB7))
        k, lo, at, n, asked = (np.array(c) for c in zip(*rows))
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(k, n), np.repeat(lo, n) + shift, name[np.repeat(at, n) + shift], other[np.repeat(at, n) + shift], np.repeat(asked, n)

    for k, (text, own) in enumerate(zip(texts, spans)):
        for s in own:
            raw.append(text[s["lo"] : s["lo"] + s["n"] + threshold - 1])
            rows.append((k, s["lo"], size, s["n"], s["asked"]))
            size += len(raw[-1])
            if size >= SEGMENT:
                yield flush()
                raw, size, rows = [], 0, []
    if raw:
        yield flush()


def covered(text: bytes, lo: np.ndarray, n: np.ndarray, threshold: int) -> tuple[int, int, bytes]:
    """(bytes covered, maximal runs of them, the bytes left) where windows lo .. lo + n - 1 are repeated."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + threshold, -1)
    out = np.cumsum(edge)[:-1] > 0
    return int(out.sum()), int((out & ~np.r_[False, out[:-1]]).sum()), np.frombuffer(text, np.uint8)[~out].tobytes()


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def repeated(docs: DataFrame, work: WorkTables, threshold: int) -> DataFrame:
    """k, d, lo, n: the windows lo to lo + n - 1 of the text with the keys k and d are repeated. docs: k, d, text."""

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            for of, lo, n, mark, name, several in runs(_bytes(b.column(2)), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(doc[of]), pa.array(lo), pa.array(n.astype(np.int16)), pa.array(mark), pa.array(name), pa.array(several)], names=["k", "d", "lo", "n", "mark", "name", "several"])

    every = work.save(docs.mapInArrow(all_runs, "k long, d long, lo long, n short, mark long, name long, several boolean"), "runs")
    shared = every.groupBy("mark").agg(F.count("*").alias("c"), F.max("several").alias("s")).where("c > 1 or s").select("mark")
    rest = work.save(every.join(work.save(shared, "marks"), "mark"), "rest")
    work.drop("runs")
    work.drop("marks")
    equal = work.save(rest.groupBy("mark", "name").agg(F.count("*").alias("c"), F.max("several").alias("several")), "equal")
    # A table of its own, so that both sides of the join are plain shuffles, which AQE can split where a mark is hot.
    marks = work.save(equal.groupBy("mark").agg(F.min("c").alias("least"), F.count("*").alias("names"), F.max("several").alias("s")), "shared")
    kinds = equal.join(marks, "mark").selectExpr("mark", "name", "c > 1 as whole", "c = 1 and (names > 1 or s) as look", "c > 1 and least = 1 as example")
    placed = work.save(rest.join(work.save(kinds.where("whole or look"), "kinds"), ["mark", "name"]), "placed")
    for part in ("rest", "equal", "shared", "kinds"):
        work.drop(part)
    examples = placed.where("example").groupBy("mark", "name").agg(F.min(F.struct("k", "d", "lo", "n")).alias("x")).selectExpr("x.k", "x.d", "x.lo", "x.n", "false as asked")
    looks = placed.where("look").selectExpr("k", "d", "lo", "n", "true as asked").unionByName(examples)
    looks = work.save(looks.groupBy("k", "d").agg(F.collect_list(F.struct("lo", "n", "asked")).alias("spans")), "looks")

    def edge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            for of, lo, name, other, asked in named_windows(_bytes(b.column(2)), b.column(3).to_pylist(), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(doc[of]), pa.array(lo), pa.array(name), pa.array(other), pa.array(asked)], names=["k", "d", "lo", "name", "other", "asked"])

    edges = work.save(docs.join(looks, ["k", "d"]).select("k", "d", "text", "spans").mapInArrow(edge_windows, "k long, d long, lo long, name long, other long, asked boolean"), "edges")
    twice = work.save(edges.groupBy("name", "other").agg(F.count("*").alias("c"), F.max("asked").alias("asked")).where("c > 1 and asked").select("name", "other"), "twice")
    found = work.save(edges.where("asked").join(twice, ["name", "other"]).selectExpr("k", "d", "lo", "cast(1 as short) as n"), "found")
    work.drop("edges")
    return placed.where("whole").select("k", "d", "lo", "n").unionByName(found)


def remove_repeated(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256, for every document."""
    work = WorkTables(docs.sparkSession, "suffixes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A row's keys: its id (another hash where there is none), and the hash of its text.
    texts = texts.withColumn("k", F.xxhash64("text")).withColumn("d", F.coalesce("doc_id", F.xxhash64(F.lit(1), "text")))
    spans = repeated(texts.select("k", "d", "text"), work, threshold).groupBy("k", "d").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, own in zip(_bytes(b.column(1)), b.column(2)):
                own = own.values
                lo, n = (own.field(c).to_numpy().astype(np.int64) if own is not None else np.empty(0, np.int64) for c in ("lo", "n"))
                removed, parts, kept = covered(text, lo, n, threshold) if len(lo) else (0, 0, text)
                rows.append((len(text), removed, parts, kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    out = texts.join(work.save(spans, "spans"), ["k", "d"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
