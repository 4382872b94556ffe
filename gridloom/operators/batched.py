"""Many small systems: a row each, with arrays for vectors and arrays of rows for matrices.

`apply` hands a kernel all systems of one shape in an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR, MATRIX, INTS = "array<double>", "array<array<double>>", "array<bigint>"


def _dense(cell) -> np.ndarray:
    if isinstance(cell, np.ndarray) and cell.dtype == object:
        return np.stack([np.asarray(r, float) for r in cell]) if len(cell) else np.empty((0, 0))
    return np.asarray(cell)


def apply(df: DataFrame, inputs: list[str], outputs: dict[str, str], kernel: Callable) -> DataFrame:
    """Adds columns (name: type) that the kernel makes of stacks of the input columns; it returns a tuple, or one stack."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = [[_dense(c) for c in pdf[i]] for i in inputs]
            shapes: dict = {}
            for k in range(len(pdf)):
                shapes.setdefault(tuple(c[k].shape for c in cells), []).append(k)
            made = {o: [None] * len(pdf) for o in outputs}
            for rows in shapes.values():
                got = kernel(*(np.stack([c[k] for k in rows]) for c in cells))
                for o, stack in zip(outputs, got if isinstance(got, tuple) else (got,)):
                    for at, k in enumerate(rows):
                        made[o][k] = stack[at].tolist()
            yield pdf.assign(**{o: pd.Series(v, index=pdf.index, dtype=object) for o, v in made.items()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in outputs] + [f"`{o}` {t}" for o, t in outputs.items()])
    kept = df.select(*[c for c in names if c not in outputs]) if set(names) & set(outputs) and not set(inputs) & set(outputs) else df
    return kept.mapInPandas(run, schema)


def pack(entries: DataFrame, key: str, name: str, *, vector: bool = False) -> DataFrame:
    """Triplets (key, i, j, v) of small dense matrices (every entry there), or (key, i, v) of vectors, to one row a system."""
    if vector:
        rows = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e"))
        return rows.select(key, F.col("e.v").alias(name))
    rows = entries.groupBy(key, "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", F.col("e.v").alias("r")))).alias("e"))
    return rows.select(key, F.col("e.r").alias(name))


def unpack(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, i, j, v) of a matrix column, or (key, i, v) of a vector column."""
    if df.schema[name].dataType.simpleString().startswith("array<array"):
        rows = df.select(key, F.posexplode(name).alias("i", "_r")).select(key, "i", F.posexplode("_r").alias("j", "v"))
        return rows.select(key, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")
    return df.select(key, F.posexplode(name).alias("i", "v")).withColumn("i", F.col("i").cast("long"))
