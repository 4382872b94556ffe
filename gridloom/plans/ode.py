"""Queries T01 to T05: initial value problems, one for each customer, with known solutions.

y' = -k y, and the oscillator y'' = -w^2 y, at rates that follow the customer's nation.
"""

import numpy as np
from pyspark.sql import functions as F

from ..operators import ode as T
from .registry import query

IVP = "SELECT c_custkey AS id, CAST(0 AS DOUBLE) AS t0, CAST(1 AS DOUBLE) AS t1, CAST(1 + c_nationkey AS DOUBLE) AS a FROM customer"
#: y' = -y from 1 + nation: what it is at 1.
DECAY = "SELECT c_custkey AS id, round((1 + c_nationkey) * exp(-1), {d}) AS y, 'SUCCESS' AS status FROM customer"
#: y1' = y2, y2' = -4 y1 from (1 + nation, 0).
TURN = "SELECT c_custkey AS id, round((1 + c_nationkey) * cos(2), {d}) AS y, 'SUCCESS' AS status FROM customer"


def decay(t, y):
    return -y


def turn(t, y):
    return np.stack([y[:, 1], -4 * y[:, 0]], 1)


def problems(in_, equations=1):
    return in_(IVP).select("id", "t0", "t1", F.array(F.col("a"), *[F.lit(0.0)] * (equations - 1)).alias("y0"))


def first(df, digits):
    return df.select("id", F.round(F.get("y", F.lit(0)), digits).alias("y"), "status")


for _method in ("RKEH", "RKF12", "RKBS", "RK4", "RKF45", "RKCK", "RKDP", "VER56"):
    _digits = 1 if _method == "RKF12" else 3
    query(f"T01_{_method.lower()}", DECAY.replace("{d}", str(_digits)))(lambda in_, m=_method, d=_digits: first(T.solve(problems(in_), decay, m), d))


@query("T01_rkfe", "SELECT c_custkey AS id, round((1 + c_nationkey) * pow(0.99, 100), 6) AS y, 'SUCCESS' AS status FROM customer")
def _(in_):
    return first(T.solve(problems(in_), decay, "RKFE", options=T.RkOptions(steps=100)), 6)


@query("T01_fixed_rk4", TURN.replace("{d}", "5"))
def _(in_):
    return first(T.solve(problems(in_, 2), turn, "RK4", options=T.RkOptions(adaptive=False, steps=100)), 5)


#: The start step of y' = -y: solution and derivatives are alike, so it is a root of a hundredth of their scale, and 1 at most.
START = "SELECT c_custkey AS id, round(least(1.0, pow(0.01 * ({atol} + {rtol} * (1 + c_nationkey)) / (1 + c_nationkey), 1.0 / {root})), 9) AS h FROM customer"


def start(in_, root, atol, rtol):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "h": T.first_step(decay, pdf["t0"].to_numpy(float), np.stack(pdf["y0"].to_list()), root, atol, rtol)})

    return problems(in_).mapInPandas(run, "id long, h double").select("id", F.round("h", 9).alias("h"))


@query("T02_first_step", START.format(atol="1e-12", rtol="1e-6", root=5))
def _(in_):
    """Of a Runge-Kutta method of order 5."""
    return start(in_, 5, 1e-12, 1e-6)


@query("T02_first_step_bdf", START.format(atol="1e-6", rtol="1e-3", root=2))
def _(in_):
    """Of BDF, which starts at order 1."""
    return start(in_, 2, 1e-6, 1e-3)


for _k in (1, 2, 3, 4, 5, 6):
    _d = 0 if _k == 1 else 2
    query(f"T03_bdf{_k}", TURN.replace("{d}", str(_d)) if _k > 1 else f"SELECT c_custkey AS id, round((1 + c_nationkey) / pow(1.01, 100), 4) AS y, 'SUCCESS' AS status FROM customer")(
        lambda in_, k=_k: first(T.solve(problems(in_), decay, "BDF1", steps=100), 4) if k == 1 else first(T.solve(problems(in_, 2), turn, f"BDF{k}", steps=1000), 2)
    )


@query("T04_bdf_adaptive", "SELECT c_custkey AS id, round(exp(-1) - exp(-1000), 4) AS y1, round(exp(-1), 4) AS y2, 'SUCCESS' AS status FROM customer")
def _(in_):
    """A stiff problem: y1' = -1000 y1 + y2, y2' = -y2 from (0, a); both against the exact solution, as shares of a / 999 and of a."""

    def stiff(t, y):
        return np.stack([-1000 * y[:, 0] + y[:, 1], -y[:, 1]], 1)

    p = in_(IVP).select("id", "t0", "t1", F.array(F.lit(0.0), F.col("a")).alias("y0"), "a")
    out = T.solve(p.select("id", "t0", "t1", "y0"), stiff, "BDF", bdf=T.BdfOptions(atol=1e-10, rtol=1e-6)).join(p.select("id", "a"), "id")
    share = lambda k, of: F.round(F.get("y", F.lit(k)) * of / F.col("a"), 4)
    return out.select("id", share(0, 999).alias("y1"), share(1, 1).alias("y2"), "status")


@query("T05_newton", "SELECT c_custkey AS id, round(sqrt(1 + c_nationkey), 6) AS y, 'SUCCESS' AS status FROM customer")
def _(in_):
    """y^2 = a, for all customers of a nation's a in the second unknown."""
    out = T.newton_rows(in_(IVP).select("id", F.array(F.col("a"), F.col("a")).alias("y0")), lambda y: np.stack([y[:, 0] ** 2 - y[:, 1], y[:, 1] * 0], 1), lambda y: np.stack([np.stack([2 * y[:, 0], -np.ones(len(y))], 1), np.tile([0.0, 1.0], (len(y), 1))], 1))
    return first(out, 6)
