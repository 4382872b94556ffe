"""Matrices made by rule: structured grids and seeded random ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import mixed


def grid_matrix(spark: SparkSession, nx: int, ny: int = 1, nz: int = 1, stencil: str = "FD", bounded: bool = True) -> DataFrame:
    """The Laplacian of a grid. FD: neighbours along the axes (3, 5, 7 points); FE: all around (3, 9, 27). Diagonal: as many as a full stencil has neighbours, off it -1.

    bounded: rows of the boundary have the identity only, where their grid's sides are fixed values.
    """
    dims = [n for n in (nx, ny, nz) if n > 1]
    steps = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (nx > 1 or not dx) and (ny > 1 or not dy) and (nz > 1 or not dz)]
    if stencil == "FD":
        steps = [s for s in steps if sum(map(abs, s)) <= 1]
    elif stencil != "FE":
        raise ValueError(f"stencil {stencil!r}")
    full = float(2 * len(dims) if stencil == "FD" else 3 ** len(dims) - 1)
    p = spark.range(nx * ny * nz).select(F.col("id").alias("i"), F.pmod("id", F.lit(nx)).alias("x"), F.pmod(F.floor(F.col("id") / nx), F.lit(ny)).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"))
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in steps)))
    q = p.withColumn("s", offsets).select("i", "x", "y", "z", (F.col("x") + F.col("s.a")).alias("u"), (F.col("y") + F.col("s.b")).alias("v"), (F.col("z") + F.col("s.c")).alias("w"))
    q = q.where((F.col("u").between(0, nx - 1)) & (F.col("v").between(0, ny - 1)) & (F.col("w").between(0, nz - 1)))
    q = q.withColumn("j", F.col("u") + nx * (F.col("v") + ny * F.col("w"))).withColumn("same", F.col("j") == F.col("i"))
    if bounded:
        edge = F.lit(False)
        for c, n in (("x", nx), ("y", ny), ("z", nz)):
            if n > 1:
                edge = edge | (F.col(c) == 0) | (F.col(c) == n - 1)
        q = q.withColumn("edge", edge).where("not edge or same")
        return q.select("i", F.col("j").cast("long").alias("j"), F.when(F.col("same"), F.when(F.col("edge"), 1.0).otherwise(full)).otherwise(-1.0).alias("v"))
    return q.select("i", F.col("j").cast("long").alias("j"), F.when(F.col("same"), full).otherwise(-1.0).alias("v"))


def random_matrix(spark: SparkSession, nrows: int, ncols: int, per_row: int, bandwidth: int, seed: int = 13718) -> DataFrame:
    """About per_row entries in each row, within the bandwidth of the diagonal, values from 0 to 99; the same for the same seed."""
    e = spark.range(nrows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
    h = mixed(F.col("i") * per_row + F.col("k"), seed)
    j = F.pmod(F.col("i") + F.pmod(F.floor(h / 128), F.lit(2 * bandwidth + 1)) - bandwidth, F.lit(ncols))
    return e.select("i", j.cast("long").alias("j"), F.pmod(h, F.lit(100)).cast("double").alias("v")).groupBy("i", "j").agg(F.max("v").alias("v"))


def diagonal_matrix(spark: SparkSession, n: int, seed: int = 13718) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), (1 + F.pmod(mixed("id", seed), F.lit(100))).cast("double").alias("v"))


def triangular_matrix(spark: SparkSession, n: int, per_row: int, bandwidth: int, lower: bool = True, seed: int = 13718) -> DataFrame:
    a = random_matrix(spark, n, n, per_row, bandwidth, seed)
    a = a.where("j < i" if lower else "j > i")
    return a.unionByName(diagonal_matrix(spark, n, seed))


def dominant_matrix(spark: SparkSession, n: int, per_row: int, bandwidth: int, dominance: float = 1.0, seed: int = 13718) -> DataFrame:
    """Off-diagonal entries of a random matrix, and diagonals that exceed their rows' sums by the dominance."""
    off = random_matrix(spark, n, n, per_row, bandwidth, seed).where("i <> j").withColumn("v", -F.col("v"))
    sums = off.groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
    diagonal = spark.range(n).withColumnRenamed("id", "i").join(sums, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + dominance).alias("v"))
    return off.unionByName(diagonal)
