"""Labelled rows for the classifiers: which may be learnt from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is 0 modulo the folds; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == 0, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: a row for each labelled document that isn't held out. Of labels that contradict each other the larger counts."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y in (0, 1)")
    return rows.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(rows: DataFrame, most: dict[int, int]) -> DataFrame:
    """At most so many rows of each class, by a hash of the id: the same whichever order rows come in."""
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
