"""Solvers: smoothers, preconditioned conjugate gradients, restarted GMRES.

Loops run on the driver; vectors and matrices stay tables. What comes to the driver are scalars and,
in GMRES, the small Hessenberg matrix of at most `restart` columns.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..store import Steps
from . import matrices as M
from . import triangular as T


class Preconditioner(ABC):
    @abstractmethod
    def apply(self, x: DataFrame) -> DataFrame:
        """M x, for a vector (i, v) with every row."""


class Identity(Preconditioner):
    def apply(self, x):
        return x


class MatrixPreconditioner(Preconditioner):
    def __init__(self, m: DataFrame, rows: DataFrame):
        self.m, self.rows = m, rows

    def apply(self, x):
        return M.spmv(self.m, x, self.rows)


class Jacobi(Preconditioner):
    def __init__(self, a: DataFrame):
        self.d = a.where("i = j").select("i", F.col("v").alias("d"))

    def apply(self, x):
        return x.join(self.d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))


class LU(Preconditioner):
    """Two triangular solves; exact ones give numbers as text."""

    def __init__(self, lower: DataFrame, upper: DataFrame, exact: bool = False):
        self.lower, self.upper, self.exact = lower, upper, exact

    def apply(self, x):
        return T.solve(self.upper, T.solve(self.lower, x, "L", unit=True, exact=self.exact), "U", exact=self.exact)


@dataclass(frozen=True)
class GmresOptions:
    restart: int = 50
    tolerance: float = 1e-8
    restarts: int = 50
    ortho: str = "CGS2"


@dataclass(frozen=True)
class SolveResult:
    x: DataFrame
    iterations: int
    residual: float
    flag: str


def _plus(x: DataFrame, a: float, y: DataFrame) -> DataFrame:
    """x + a y; both have every row."""
    return x.join(y.select("i", F.col("v").alias("w")), "i").select("i", (F.col("v") + F.lit(float(a)) * F.col("w")).alias("v"))


def _norm(x: DataFrame) -> float:
    return x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0


def _sums(steps: Steps, name: str, df: DataFrame, **sums) -> tuple[DataFrame, dict]:
    """Keeps the table, and gives sums over its rows that are taken while it is written."""
    seen = Observation()
    kept = steps.keep(name, df.observe(seen, *(F.sum(s).alias(k) for k, s in sums.items())))
    return kept, {k: v or 0.0 for k, v in seen.get.items()}


def pcg(a: DataFrame, b: DataFrame, precond: Preconditioner | None = None, tolerance: float = 1e-8, most: int = 200) -> SolveResult:
    """Conjugate gradients. x, r, p and q = a p are columns of one table, written once an iteration.

    What the next iteration needs of dot products follows from sums that are taken while the table is
    written, as r and x move along known columns. A preconditioner that isn't a diagonal is applied to a
    table of its own.
    """
    steps, precond = Steps(a.sparkSession, "pcg"), precond or Identity()
    a, rows = steps.keep("a", a), b.select("i")
    scale = precond.d if isinstance(precond, Jacobi) else None
    diagonal = scale is not None or isinstance(precond, Identity)
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"))
    state = state.join(scale, "i") if scale is not None else state.withColumn("d", F.lit(1.0))
    z = F.col("r") / F.col("d")
    if diagonal:
        state = state.select("*", z.alias("p"))
    else:
        state = steps.keep("start", state)
        state = state.join(precond.apply(state.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("p")), "i")
    state, s = _sums(steps, "state", state, rz=F.col("r") * F.col("p"), rr=F.col("r") * F.col("r"))
    rz, start, left, at = s["rz"], np.sqrt(s["rr"]), np.sqrt(s["rr"]), 0
    while start and left > tolerance * start and at < most:
        at += 1
        q = M.spmv(a, state.select("i", F.col("p").alias("v")), rows).withColumnRenamed("v", "q")
        c = {k: F.col(k) for k in "rqpd"}
        state, s = _sums(steps, "product", state.join(q, "i"), pq=c["p"] * c["q"], rr=c["r"] * c["r"], rq=c["r"] * c["q"], qq=c["q"] * c["q"], zr=c["r"] * c["r"] / c["d"], zq=c["r"] * c["q"] / c["d"], qz=c["q"] * c["q"] / c["d"])
        alpha = rz / s["pq"]
        moved = state.select("i", (F.col("x") + alpha * c["p"]).alias("x"), (c["r"] - alpha * c["q"]).alias("r"), "d", "p")
        if diagonal:
            left = np.sqrt(max(0.0, s["rr"] - 2 * alpha * s["rq"] + alpha**2 * s["qq"]))
            new = s["zr"] - 2 * alpha * s["zq"] + alpha**2 * s["qz"]
            state = moved.select("i", "x", "r", "d", (z + (new / rz) * F.col("p")).alias("p"))
        else:
            moved = steps.keep("moved", moved)
            moved = moved.join(precond.apply(moved.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("z")), "i")
            moved, s = _sums(steps, "next", moved, rz=F.col("r") * F.col("z"), rr=F.col("r") * F.col("r"))
            left, new = np.sqrt(s["rr"]), s["rz"]
            state = moved.select("i", "x", "r", "d", (F.col("z") + (new / rz) * F.col("p")).alias("p"))
        rz = new
    return SolveResult(steps.keep("solution", state.select("i", F.col("x").alias("v"))), at, left / start if start else 0.0, "Conv" if not start or left <= tolerance * start else "NoConv")


def gmres(a: DataFrame, b: DataFrame, precond: Preconditioner | None = None, options: GmresOptions = GmresOptions()) -> SolveResult:
    """Restarted GMRES, preconditioned on the right.

    x, the basis (an array of at most `restart` numbers) and the newest product w are columns of one table,
    written once a step; w's dot products with the basis are taken as it is written. A second pass over
    it (CGS2) or one for each basis vector (MGS) makes w orthogonal; its length follows from the sums.
    """
    if options.ortho not in ("CGS2", "MGS"):
        raise ValueError(f"ortho {options.ortho!r}")
    steps, precond = Steps(a.sparkSession, "gmres"), precond or Identity()
    a, rows = steps.keep("a", a), b.select("i")
    v, w = F.col("basis"), F.col("w")
    table, s = _sums(steps, "state", b.select("i", "v", F.lit(0.0).alias("x"), F.col("v").alias("r")), rr=F.col("r") * F.col("r"))
    size = beta = np.sqrt(s["rr"])
    if not size:
        return SolveResult(table.select("i", F.col("x").alias("v")), 0, 0.0, "Conv")
    total, flag, true = 0, "NoConv", 1.0
    for _ in range(options.restarts):
        true = beta / size
        if true < options.tolerance:
            flag = "Conv"
            break
        table = table.select("i", "v", "x", F.array(F.col("r") / beta).alias("basis"))
        h, done = np.zeros((options.restart + 1, options.restart)), 0
        for k in range(options.restart):
            newest = precond.apply(table.select("i", v[k].alias("v")))
            product = M.spmv(a, newest, rows).withColumnRenamed("v", "w")
            dots = {f"h{j}": v[j] * w for j in range(k + 1 if options.ortho == "CGS2" else 1)}
            table, s = _sums(steps, "state", table.join(product, "i"), **dots)
            if options.ortho == "CGS2":
                h[: k + 1, k] = [s[f"h{j}"] for j in range(k + 1)]
                rest = w - sum((F.lit(float(h[j, k])) * v[j] for j in range(k + 1)), F.lit(0.0))
                again = table.agg(*(F.sum(v[j] * rest) for j in range(k + 1)), F.sum(rest * rest)).first()
                h[: k + 1, k] += again[: k + 1]
                short = again[k + 1] - sum(x * x for x in again[: k + 1])
            else:
                h[0, k], rest = s["h0"], w
                for j in range(k + 1):
                    rest = rest - F.lit(float(h[j, k])) * v[j]
                    following, short = table.agg(F.sum(rest * (v[j + 1] if j < k else F.lit(0.0))), F.sum(rest * rest)).first()
                    if j < k:
                        h[j + 1, k] = following
            h[k + 1, k] = np.sqrt(max(0.0, short))
            total, done = total + 1, k + 1
            e = np.zeros(done + 1)
            e[0] = beta
            y = np.linalg.lstsq(h[: done + 1, :done], e, rcond=None)[0]
            near = np.linalg.norm(e - h[: done + 1, :done] @ y) / size
            if not np.isfinite(near):
                raise ArithmeticError("GMRES met a value that is not a number")
            if near < options.tolerance or h[k + 1, k] <= 1e-14:
                break
            orthogonal = w - sum((F.lit(float(h[j, k])) * v[j] for j in range(k + 1)), F.lit(0.0))
            table = table.select("i", "v", "x", F.concat(v, F.array(orthogonal / float(h[k + 1, k]))).alias("basis"))
        step = precond.apply(table.select("i", sum((F.lit(float(y[j])) * v[j] for j in range(done)), F.lit(0.0)).alias("v")))
        table = steps.keep("moved", table.select("i", "v", "x").join(step.select("i", F.col("v").alias("step")), "i").select("i", "v", (F.col("x") + F.col("step")).alias("x")))
        ax = M.spmv(a, table.select("i", F.col("x").alias("v")), rows).withColumnRenamed("v", "ax")
        table, s = _sums(steps, "state", table.join(ax, "i").select("i", "v", "x", (F.col("v") - F.col("ax")).alias("r")), rr=F.col("r") * F.col("r"))
        beta = np.sqrt(s["rr"])
        true = beta / size
        if true < options.tolerance:
            flag = "Conv"
            break
        if near < options.tolerance:
            flag = "LOA"  # the recurrence says it is there, the residual does not
    return SolveResult(table.select("i", F.col("x").alias("v")), total, true, flag)


# Smoothers


def jacobi(a: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0, sweeps: int = 1) -> DataFrame:
    """Damped Jacobi: the two-stage smoother without inner sweeps."""
    d = a.where("i = j").select("i", F.col("v").alias("d"))
    for _ in range(sweeps):
        r = _plus(b, -1.0, M.spmv(a, x, b.select("i")))
        x = _plus(x, omega, r.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v")))
    return x


def two_stage(a: DataFrame, b: DataFrame, x: DataFrame, outer: int = 1, inner: int = 1, omega: float = 1.0, gamma: float = 1.0, direction: str = "forward") -> DataFrame:
    """Two-stage Gauss-Seidel: inner Jacobi-Richardson steps stand for the triangular solve."""
    rows = b.select("i")
    d = a.where("i = j").select("i", F.col("v").alias("d"))
    by_d = lambda v: v.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
    turns = {"forward": ["L"], "backward": ["U"], "symmetric": ["L", "U"]}[direction] * outer
    for turn in turns:
        off = a.where("j < i" if turn == "L" else "j > i")
        t = by_d(_plus(b, -1.0, M.spmv(a, x, rows)))
        z = t.withColumn("v", F.col("v") * gamma)
        for _ in range(inner):
            pulled = _plus(t, -omega, by_d(M.spmv(off, z, rows)))
            z = _plus(pulled.withColumn("v", F.col("v") * gamma), 1 - gamma, z)
        x = _plus(x, omega, z)
    return x


def gauss_seidel(a: DataFrame, b: DataFrame, x: DataFrame, colors: DataFrame, direction: str = "symmetric", omega: float = 1.0, sweeps: int = 1) -> DataFrame:
    """Multicolour Gauss-Seidel / SOR: colours (i, color) one after the other, a colour's rows at once."""
    steps = Steps(a.sparkSession, "smoother")
    own = steps.keep("rows", a.join(colors, "i"))
    right = steps.keep("right", b.join(colors, "i").join(a.where("i = j").select("i", F.col("v").alias("d")), "i"))
    order = [r["color"] for r in colors.select("color").distinct().orderBy("color").collect()]  # as many as the graph needs colours
    turns = {"forward": order, "backward": order[::-1], "symmetric": order + order[::-1]}[direction]
    x = steps.keep("x", x)
    for _ in range(sweeps):
        for c in turns:
            here = right.where(F.col("color") == c)
            ax = own.where(F.col("color") == c).join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"))
            step = here.join(ax, "i", "left").select("i", (omega * (F.col("v") - F.coalesce("ax", F.lit(0.0))) / F.col("d")).alias("v"))
            x = steps.keep("x", x.unionByName(step).groupBy("i").agg(F.sum("v").alias("v")))
    return x


def block_gauss_seidel(a: DataFrame, b: DataFrame, x: DataFrame, size: int, colors: DataFrame, direction: str = "symmetric", sweeps: int = 1) -> DataFrame:
    """The same on blocks of `size` rows: colors (i, color) are of the blocks, whose diagonal blocks are inverted."""
    from . import batched as B
    from . import kernels as K

    steps = Steps(a.sparkSession, "smoother")
    blocks = M.to_bsr(a, size)
    inverse = B.apply(blocks.where("bi = bj").select("bi", "blk"), ["blk"], {"inv": B.VECTOR}, lambda m: K.inverse_lu(m.reshape(-1, size, size)).reshape(len(m), -1))
    inv = steps.keep("inverse", M.from_bsr(inverse.select("bi", F.col("bi").alias("bj"), F.col("inv").alias("blk")), size))
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    own = steps.keep("rows", a.withColumn("b", block("i")).join(colors.select(F.col("i").alias("b"), "color"), "b"))
    right = steps.keep("right", b.withColumn("b", block("i")).join(colors.select(F.col("i").alias("b"), "color"), "b"))
    order = [r["color"] for r in colors.select("color").distinct().orderBy("color").collect()]
    turns = {"forward": order, "backward": order[::-1], "symmetric": order + order[::-1]}[direction]
    x = steps.keep("x", x)
    for _ in range(sweeps):
        for c in turns:
            here = right.where(F.col("color") == c).select("i", "v")
            ax = own.where(F.col("color") == c).join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg((-F.sum(F.col("v") * F.col("x"))).alias("v"))
            r = here.unionByName(ax).groupBy("i").agg(F.sum("v").alias("r"))
            step = inv.join(r.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("r")).alias("v"))
            x = steps.keep("x", x.unionByName(step).groupBy("i").agg(F.sum("v").alias("v")))
    return x


def sor_in_order(a: DataFrame, b: DataFrame, places: DataFrame, omega: float = 1.0, sweeps: int = 1) -> DataFrame:
    """Row by row, in the order of places (i, place), from zero: what the others are compared with. Rows follow each other, so one task has the system."""
    rows = a.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row")).join(b.withColumnRenamed("v", "b"), "i").join(places, "i")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(place=[tuple(p.values()) if isinstance(p, dict) else p for p in pdf["place"]]).sort_values("place")
        x = dict.fromkeys(pdf["i"], 0.0)
        own = [(i, right, [(e["j"], e["v"]) for e in row]) for i, right, row in zip(pdf["i"], pdf["b"], pdf["row"])]
        for _ in range(sweeps):
            for i, right, row in own:
                x[i] += omega * (right - sum(v * x[j] for j, v in row)) / dict(row)[i]
        return pd.DataFrame({"i": list(x), "v": list(x.values())})

    return rows.groupBy().applyInPandas(run, "i long, v double")


def sor_sequential(a: np.ndarray, b: np.ndarray, x: np.ndarray, omega: float = 1.0, direction: str = "F") -> np.ndarray:
    """Row by row on one dense matrix and its right sides (columns): what the others are compared with."""
    x = x.astype(float).copy()
    for i in range(len(a)) if direction == "F" else range(len(a) - 1, -1, -1):
        x[i] += omega * (b[i] - a[i] @ x) / a[i, i]
    return x
