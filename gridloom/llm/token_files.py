"""Token-ID files: flat unsigned integers, with 64-bit document offsets beside them.

A part has three files: `.ids` (little-endian unsigned integers, 16 bits wide where the vocabulary
allows it, else 32), `.off` (int64: where each document begins in `.ids`, and the end), `.doc` (int64
document ids; the least int64 stands for null). The manifest lists the parts in order with their
first document and first token, which are prefix sums of the parts' counts, so that a document's
place in the whole corpus is the part's base plus its offset. Readers memory-map the files.

Defined results: null and empty texts hold the end id only; null doc_ids come first; rows that
repeat a doc_id are all kept, in the order of their texts' hashes; an empty table gives no rows;
other columns are not read. Files are written under a name of the attempt's own and renamed, so a
retried or doubled task leaves one whole file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WorkTables, local_path, open_store
from .tokens import encoder

NO_ID = -(2**63)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Writes all documents in ascending doc_id order; returns the parts: part, docs, tokens (one row each).

    Lazy, as any DataFrame: the files are there once the result has been computed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        enc, kind, end = encoder(tokenizer), f"<u{width}", np.array([end_id], f"<u{width}").tobytes()
        if len(enc.ends) > 256**width:
            raise ValueError(f"the vocabulary does not fit into {width} bytes")
        own = f"{path}/part-{part:06d}.{uuid.uuid4().hex}"
        sizes, ids = [], []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or store.open_output_stream(f"{own}.ids")
            for raw in enc.encode(batch.column(1).to_pylist()):
                raw = np.frombuffer(raw, "<u4").astype(kind).tobytes()
                out.write(raw)
                out.write(end)
                sizes.append(len(raw) // width + 1)
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy())
        if not sizes:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
        for name, what in (("off", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{own}.{name}") as f:
                f.write(what.tobytes())
        for name in ("ids", "off", "doc"):
            store.move(f"{own}.{name}", f"{path}/part-{part:06d}.{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(sizes)], "tokens": [int(offsets[-1])]}, pa.schema([("part", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = spread.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(write, "part long, docs long, tokens long")


def with_bases(parts: DataFrame) -> DataFrame:
    """first_doc and first_token of each part: prefix sums over the parts, a row for each file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c[:-1]}") for c in ("docs", "tokens")))


def map_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc_ids) of a part; memory-mapped where the folder is on the machine's own file system."""
    path = local_path(folder)
    if path:
        got = {n: np.memmap(f, t, "r") if os.path.getsize(f := f"{path}/part-{part:06d}.{n}") else np.empty(0, t) for n, t in (("ids", f"<u{width}"), ("off", "<i8"), ("doc", "<i8"))}
    else:
        store, path = open_store(folder)
        got = {n: np.frombuffer(store.open_input_file(f"{path}/part-{part:06d}.{n}").readall(), t) for n, t in (("ids", f"<u{width}"), ("off", "<i8"), ("doc", "<i8"))}
    return got["ids"], got["off"], got["doc"]


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), read back from the files, a task a few files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, doc = map_part(folder, row["part"], width)
                for at in range(0, len(doc), 10_000):
                    cut = off[at : at + 10_001]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
                    own = doc[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(row["first_token"] + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], schema=schema)

    # As many tasks as parts: a part is much more work than its row shows.
    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the files to the cluster's shared folder and returns what they hold, a row for each document."""
    spark = docs.sparkSession
    work = WorkTables(spark, "token-files")
    parts = work.save(write_token_files(docs, work.at("ids"), tokenizer, end_id), "parts")
    return read_token_files(spark, work.save(with_bases(parts), "manifest"), work.at("ids"))
