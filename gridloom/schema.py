"""Shapes of the tables that operators take and return.

vec (i, v); mv (i, j, v), j the column; mat (i, j, v), absent entries are zero; bsr (bi, bj, blk), blk a
block's rows one after the other; edges (src, dst); batch (b, ...), a row for each small system, with
arrays. Complex numbers are structs (re, im). Indices are long and count from 0, values are double.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VEC = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())])
MAT = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
MV = MAT
BSR = T.StructType([T.StructField("bi", T.LongType()), T.StructField("bj", T.LongType()), T.StructField("blk", T.ArrayType(T.DoubleType()))])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


@dataclass(frozen=True)
class MatrixMeta:
    """Numbers of rows and columns, where a matrix's shape is known."""

    nrows: int
    ncols: int


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The DataFrame, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing; found {df.columns}")
    return df


def same_inner(a: MatrixMeta | None, b: MatrixMeta | None) -> None:
    if a and b and a.ncols != b.nrows:
        raise ValueError(f"{a.nrows} x {a.ncols} does not go with {b.nrows} x {b.ncols}")
