"""Best-fit packing of documents into sequences of a fixed capacity.

The plan is made from the counts of each length, at most `capacity` numbers whatever the corpus:

1. Pieces above a third of the capacity, of which at most two go into a sequence, are matched
   greedily: the longest with the longest that still fits beside it.
2. Shorter pieces, longest first, go each into the smallest gap that holds them; a new sequence
   opens where none does.

Both steps work on runs of equal sequences, so a run of a million equal pairs is one step. A piece
finds its place from its length and its number among the pieces of that length. Numbers come from
counts by (bucket of rows, length), so no length, however common, goes to one task.

Defined results: null and empty texts are a document of the end id only; repeated rows are packed
each on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WorkTables
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """The documents' token sequences, each with the end id after it; only what is longer than capacity is cut."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                raw += end
                rows += [(doc, k, at // 4, (part := min(4 * capacity, len(raw) - at)) // 4, zlib.crc32(raw[at : at + part])) for k, at in enumerate(range(0, len(raw), 4 * capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_counts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for so many pieces of each length: rows (length, from, to, per, sequence, offset), and the number of sequences.

    The pieces of a length numbered from `from` up to `to` (exclusive) stand `per` to a sequence:
    number n in sequence + (n - from) // per at offset + (n - from) % per * length.
    """
    left = {n: c for n, c in counts.items() if c}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    placed, seen, opened = [], dict.fromkeys(left, 0), 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: runs (first sequence, how many)

    def place(length: int, per: int, runs: int, sequence: int, offset: int) -> None:
        placed.append((length, seen[length], seen[length] + per * runs, per, sequence, offset))
        seen[length] += per * runs

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        mate = large[k] if k >= 0 else 0
        if mate == n:
            runs, odd = divmod(left[n], 2)
            if runs:
                place(n, 2, runs, opened, 0)
                gaps.setdefault(capacity - 2 * n, []).append((opened, runs))
                opened += runs
            left[n] = odd
            if odd:  # the last one takes the next shorter mate
                mate = large[k - 1] if k else 0
        if left[n]:
            runs = min(left[n], left[mate]) if mate else left[n]
            place(n, 1, runs, opened, 0)
            if mate:
                place(mate, 1, runs, opened, n)
                left[mate] -= runs
            gaps.setdefault(capacity - n - mate, []).append((opened, runs))
            opened += runs
            left[n] -= runs
        large = [x for x in large if left[x]]
    gaps.pop(0, None)
    order = sorted(gaps)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                runs = -(-left[n] // (capacity // n))
                gap, run = capacity, (opened, runs)
                opened += runs
            else:
                gap = order[k]
                run = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            first, many = run
            per = gap // n
            full = min(many, left[n] // per)
            done = []
            if full:
                place(n, per, full, first, capacity - gap)
                done.append((gap - per * n, (first, full)))
                left[n] -= per * full
            if full < many and left[n]:
                place(n, left[n], 1, first + full, capacity - gap)
                done.append((gap - left[n] * n, (first + full, 1)))
                left[n], full = 0, full + 1
            if full < many:
                done.append((gap, (first + full, many - full)))
            for g, r in done:
                if g:
                    if g not in gaps:
                        bisect.insort(order, g)
                    gaps.setdefault(g, []).append(r)
    return np.array(placed, np.int64).reshape(-1, 6), opened


def pack(items: DataFrame, capacity: int, bucket_rows: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to capacity. `items` is read twice: pass a stored table.

    The plan's size depends on the capacity alone (some thousand places for 2048), so it is sent to every task.
    """
    work, columns = WorkTables(items.sparkSession, "pack"), items.columns
    total = items.groupBy("length").count().collect()  # at most `capacity` rows
    counts = {r["length"]: r["count"] for r in total}
    plan, _ = pack_counts(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    buckets = max(64, -(-sum(counts.values()) // bucket_rows))
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    # Equal rows share a hash: they count within their bucket, and a large group of them would fill it; so the row's place in its task joins in.
    spread = spread.withColumn("_bucket", F.pmod(F.col("_bucket") + F.monotonically_increasing_id(), F.lit(buckets)).cast("int"))
    spread = work.save(spread, "buckets")  # read twice below, and places must be the same
    sizes = spread.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_bucket", "length").orderBy(*columns)
    ranked = spread.withColumn("_own", F.row_number().over(own) - 1)
    ranked = ranked.join(sizes, ["_bucket", "length"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    key, (length, start, _, per, sequence, offset) = plan[:, 0] * 2**40 + plan[:, 1], plan.T

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(key, n * 2**40 + rank, "right") - 1
            assert (length[at] == n).all()
            within = rank - start[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence[at] + within // per[at]), pa.array(offset[at] + within % per[at] * n)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.select(*columns, "_rank").mapInArrow(find, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """Every piece of every document with its sequence and its place there. Tokenized once."""
    work = WorkTables(docs.sparkSession, "packing")
    return pack(work.save(pieces(docs, capacity, tokenizer, end_id), "pieces"), capacity)


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The packed ids themselves: sequence_id, ids. doc_id must be unique here."""

    def ids(texts):
        import pandas as pd

        enc = encoder(tokenizer)
        return pd.Series([[*np.frombuffer(raw, "<u4").astype("int32").tolist(), end_id] for raw in enc.encode(texts.tolist())])

    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(ids, "array<int>")(F.coalesce("text", F.lit(""))).alias("ids"))
    part = packed.join(tokens, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return part.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
