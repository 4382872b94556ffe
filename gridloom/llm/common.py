"""What the operators share: work tables in the cluster's shared folder, file access, list helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a local one where it is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them see")
        found = "file://" + os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_kept: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task: of one operator at a time, so that caches don't add up in an executor."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Free memory of a Python worker returns to the system; else a reused worker holds the most it ever took while later stages run."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class WorkTables:
    """Intermediate results, written as Parquet to the shared folder and read again.

    This cuts the lineage without a copy that lives on one executor only, computes each step once
    (checkpoint() computes the last stage twice), and lets a retried task read the same rows again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def part(self, name: str) -> WorkTables:
        """A folder of its own within this one."""
        own = WorkTables(self.spark, "part")
        own.path = self.at(name)
        return own

    def at(self, part: str) -> str:
        return f"{self.path}/{part}"

    def save(self, df: DataFrame, part: str) -> DataFrame:
        """Writes and reads again; shuffle files of the plan go as soon as the table is there."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.at(part))
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.at(part))

    def drop(self, part: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(part))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() is much faster, and the same where all characters are ASCII."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, A_Z, a_z))


def documents_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows and bytes of text for each Arrow batch: the default of 10,000 whole documents takes much memory on both sides. A setting of the user's stays."""
    for key, new in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(new))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path; None for any other store."""
    found = re.match(r"(?:file:(?://)?)?(/.*)", uri)
    return found[1] if found and not uri.startswith("//") else None


def open_store(uri: str):
    """(file system, path) of a folder: the machine's own, or whichever pyarrow knows (hdfs, s3, gs)."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)
