"""Tables that loops keep between their steps, in the folder of spark.checkpoint.dir.

A step's plan ends in a written table: its lineage is cut, it is computed once, and every executor can
read it, also after others are lost.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where it is unset and all run on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them see")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "gridloom-checkpoints")).rstrip("/")


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


class Steps:
    """Keeps tables by name; keeping another under the same name drops the one before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.at, self.parts = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def write(self, writer, path: str, kind: str = "parquet") -> None:
        """Shuffle files of the plan go as soon as the table is there."""
        conf = self.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            getattr(writer, kind)(path)
        finally:
            conf.set(CLEANUP, before)

    def add(self, name: str, df: DataFrame, **options) -> DataFrame:
        """Appends to the table of that name, and gives all of it; what was given before stays as it was. options: the writer's."""
        path = self.parts.setdefault(name, f"{self.path}/{name}")
        self.write(df.write.mode("append").options(**options), path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, name: str, df: DataFrame, partitions: int | None = None, **options) -> DataFrame:
        self.at += 1
        path = f"{self.path}/{name}-{self.at}"
        self.write((df.coalesce(partitions) if partitions else df).write.options(**options), path)
        if before := self.parts.pop(name, None):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.parts[name] = path
        return self.spark.read.schema(df.schema).parquet(path)
