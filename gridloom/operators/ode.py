"""Initial value problems, one a row, stepped side by side in numpy over Arrow batches.

A right-hand side is a function f(t, y) of stacks: t (systems,), y (systems, equations). Every row has
its own step size and status; rows that are done stand still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SUCCESS, MAX_STEPS, MIN_SIZE = "SUCCESS", "MAX_STEP", "MIN_SIZE"


@dataclass(frozen=True)
class Tableau:
    order: int
    a: tuple[tuple[float, ...], ...]
    b: tuple[float, ...]
    c: tuple[float, ...]
    e: tuple[float, ...]  # weights of the error estimate


# The published coefficients of the methods.
TABLEAUS = {
    "RKFE": Tableau(1, ((),), (1,), (0,), (0,)),
    "RKEH": Tableau(2, ((), (1,)), (1 / 2, 1 / 2), (0, 1), (-1 / 2, 1 / 2)),
    "RKF12": Tableau(2, ((), (1 / 2,), (1 / 256, 255 / 256)), (1 / 512, 255 / 256, 1 / 512), (0, 1 / 2, 1), (1 / 256 - 1 / 512, 0, -1 / 512)),
    "RKBS": Tableau(3, ((), (1 / 2,), (0, 3 / 4), (2 / 9, 1 / 3, 4 / 9)), (2 / 9, 1 / 3, 4 / 9, 0), (0, 1 / 2, 3 / 4, 1), (2 / 9 - 7 / 24, 1 / 3 - 1 / 4, 4 / 9 - 1 / 3, -1 / 8)),
    "RK4": Tableau(4, ((), (1 / 2,), (0, 1 / 2), (0, 0, 1)), (1 / 6, 1 / 3, 1 / 3, 1 / 6), (0, 1 / 2, 1 / 2, 1), (1 / 6, 0, -1 / 3, 1 / 6)),
    "RKF45": Tableau(
        5,
        ((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8, 3680 / 513, -845 / 4104), (-8 / 27, 2, -3544 / 2565, 1859 / 4104, -11 / 40)),
        (16 / 135, 0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55),
        (0, 1 / 4, 3 / 8, 12 / 13, 1, 1 / 2),
        (16 / 135 - 25 / 216, 0, 6656 / 12825 - 1408 / 2565, 28561 / 56430 - 2197 / 4104, -9 / 50 + 1 / 5, 2 / 55),
    ),
    "RKCK": Tableau(
        5,
        ((), (1 / 5,), (3 / 40, 9 / 40), (3 / 10, -9 / 10, 6 / 5), (-11 / 54, 5 / 2, -70 / 27, 35 / 27), (1631 / 55296, 175 / 512, 575 / 13824, 44275 / 110592, 253 / 4096)),
        (37 / 378, 0, 250 / 621, 125 / 594, 0, 512 / 1771),
        (0, 1 / 5, 3 / 10, 3 / 5, 1, 7 / 8),
        (37 / 378 - 2825 / 27648, 0, 250 / 621 - 18575 / 48384, 125 / 594 - 13525 / 55296, -277 / 14336, 512 / 1771 - 1 / 4),
    ),
    "RKDP": Tableau(
        5,
        (
            (), (1 / 5,), (3 / 40, 9 / 40), (44 / 45, -56 / 15, 32 / 9), (19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729),
            (9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656), (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84),
        ),
        (35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0),
        (0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1),
        (35 / 384 - 5179 / 57600, 0, 500 / 1113 - 7571 / 16695, 125 / 192 - 393 / 640, -2187 / 6784 + 92097 / 339200, 11 / 84 - 187 / 2100, -1 / 40),
    ),
    "VER56": Tableau(
        6,
        (
            (), (1 / 6,), (4 / 75, 16 / 75), (5 / 6, -8 / 3, 5 / 2), (-165 / 64, 55 / 6, -425 / 64, 85 / 96), (12 / 5, -8, 4015 / 612, -11 / 36, 88 / 255),
            (-8263 / 15000, 124 / 75, -643 / 680, -81 / 250, 2484 / 10625, 0), (3501 / 1720, -300 / 43, 297275 / 52632, -319 / 2322, 24068 / 84065, 0, 3850 / 26703),
        ),
        (3 / 40, 0, 875 / 2244, 23 / 72, 264 / 1955, 0, 125 / 11592, 43 / 616),
        (0, 1 / 6, 4 / 15, 2 / 3, 5 / 6, 1, 1 / 15, 1),
        (3 / 40 - 13 / 160, 0, 875 / 2244 - 2375 / 5984, 23 / 72 - 5 / 16, 264 / 1955 - 12 / 85, -3 / 44, 125 / 11592, 43 / 616),
    ),
}

#: BDF of order k: weights of the last values, newest first, and of the step.
BDF = {
    1: ((1,), 1),
    2: ((4 / 3, -1 / 3), 2 / 3),
    3: ((18 / 11, -9 / 11, 2 / 11), 6 / 11),
    4: ((48 / 25, -36 / 25, 16 / 25, -3 / 25), 12 / 25),
    5: ((300 / 137, -300 / 137, 200 / 137, -75 / 137, 12 / 137), 60 / 137),
    6: ((360 / 147, -450 / 147, 400 / 147, -225 / 147, 72 / 147, -10 / 147), 60 / 147),
}


@dataclass(frozen=True)
class RkOptions:
    adaptive: bool = True
    steps: int = 100
    most: int = 10_000
    atol: float = 1e-12
    rtol: float = 1e-6
    least: float = 1e-9


@dataclass(frozen=True)
class BdfOptions:
    first: float | None = None  # the start step; None: chosen
    atol: float = 1e-6
    rtol: float = 1e-3
    most: int = 100_000
    newton: int = 10


def _rms(x):
    return np.sqrt((x * x).mean(1))


def first_step(f: Callable, t, y, root: int, atol: float, rtol: float):
    """The start step of Hairer, Norsett and Wanner: small against the solution and its first two derivatives.

    root: of what the derivatives leave of the step; a Runge-Kutta method's order, a BDF's and one.
    """
    scale = atol + rtol * np.abs(y)
    k = f(t, y)
    d0, d1 = _rms(y / scale), _rms(k / scale)
    h0 = np.where((d0 < 1e-5) | (d1 < 1e-5), 1e-6, 0.01 * d0 / np.where(d1 == 0, 1, d1))
    d2 = _rms((f(t + h0, y + h0[:, None] * k) - k) / scale) / h0
    top = np.maximum(d1, d2)
    h1 = np.where(top <= 1e-15, np.maximum(1e-6, h0 * 1e-3), (0.01 / np.where(top == 0, 1, top)) ** (1 / root))
    return np.minimum(100 * h0, h1)


def rk_step(f, tab: Tableau, t, y, h):
    """(new y, error estimate) of one step each."""
    k = []
    for row, c in zip(tab.a, tab.c):
        k.append(f(t + c * h, y + h[:, None] * sum((a * q for a, q in zip(row, k)), np.zeros_like(y))))
    return y + h[:, None] * sum(b * q for b, q in zip(tab.b, k)), h[:, None] * sum(e * q for e, q in zip(tab.e, k))


def runge_kutta(f, t0, t1, y0, method: str = "RKF45", options: RkOptions = RkOptions()):
    """(y, status, steps)."""
    tab, y, t = TABLEAUS[method], y0.astype(float).copy(), t0.astype(float).copy()
    n = len(y)
    status, count = np.array([SUCCESS] * n, object), np.zeros(n, int)
    if not options.adaptive or method == "RKFE":
        h = (t1 - t0) / options.steps
        for _ in range(options.steps):
            y, _ = rk_step(f, tab, t, y, h)
            t = t + h
        return y, status, count + options.steps
    h = first_step(f, t, y, tab.order, options.atol, options.rtol)
    live, cut = t < t1, np.zeros(n, bool)
    while live.any():
        at = np.flatnonzero(live)
        hh = np.minimum(h[at], t1[at] - t[at])
        new, err = rk_step(lambda tt, yy: f(tt, yy), tab, t[at], y[at], hh)
        e = _rms(err / (options.atol + options.rtol * np.maximum(np.abs(new), np.abs(y[at]))))
        bad = ~(e <= 1)
        safe = np.where(np.isfinite(e) & (e > 0), e, np.where(e == 0, 1e-30, 1e30))
        shrink = np.maximum(0.2, 0.8 * safe ** (-1 / tab.order))
        grow = np.minimum(10, np.maximum(2, 0.9 * safe ** (-1 / tab.order)))
        ok = at[~bad]
        y[ok], t[ok] = new[~bad], t[ok] + hh[~bad]
        t[ok] = np.where(hh[~bad] >= t1[ok] - t[ok] + hh[~bad], t1[ok], t[ok])
        count[ok] += 1
        may_grow = ~bad & ~cut[at] & (e < 0.5)
        h[at] = np.where(bad, hh * shrink, np.where(may_grow, hh * grow, h[at]))
        cut[at] = bad
        small = at[bad & (h[at] < options.least)]
        status[small], live[small] = MIN_SIZE, False
        live[at[(t[at] >= t1[at])]] = False
        long = at[live[at] & (count[at] >= options.most)]
        status[long], live[long] = MAX_STEPS, False
    return y, status, count


def newton(g, jac, y0, most: int = 50, atol: float = 1e-14, rtol: float = 1e-12):
    """(y, converged, iterations) of g(y) = 0; jac(y) are stacks of matrices. Converged by the step's root mean square."""
    y = y0.astype(float).copy()
    done, count = np.zeros(len(y), bool), np.zeros(len(y), int)
    first = None
    for k in range(most):
        r = g(y)
        size = _rms(r)
        first = size if first is None else first
        done |= size <= np.maximum(rtol * first, atol)
        if done.all():
            break
        live = ~done
        step = np.zeros_like(y)
        step[live] = np.linalg.solve(jac(y)[live], -r[live][:, :, None])[:, :, 0]
        y += step
        count += live
        done |= live & (_rms(step) < np.maximum(atol, rtol * _rms(y))) & (k > 0)
    return y, done, count


def numeric_jacobian(f, t, y):
    n = y.shape[1]
    base, out = f(t, y), np.zeros((len(y), n, n))
    for j in range(n):
        d = 1e-7 * np.maximum(1, np.abs(y[:, j]))
        moved = y.copy()
        moved[:, j] += d
        out[:, :, j] = (f(t, moved) - base) / d[:, None]
    return out


def bdf_fixed(f, t0, t1, steps: int, y0, order: int = 5, jac=None):
    """(y, converged): BDF of a fixed order and step; the first values come from RKF45 at the same step."""
    jac = jac or (lambda t, y: numeric_jacobian(f, t, y))
    if steps < order - 1:
        raise ValueError("too few steps for the order")
    h, t = (t1 - t0) / steps, t0.astype(float)
    last = [y0.astype(float)]
    for _ in range(order - 1):
        y, _ = rk_step(f, TABLEAUS["RKF45"], t, last[0], h)
        last.insert(0, y)
        t = t + h
    weights, beta = BDF[order]
    ok, eye = np.ones(len(y0), bool), np.eye(y0.shape[1])
    for _ in range(steps - order + 1):
        t = t + h
        past = sum(w * v for w, v in zip(weights, last))
        y, done, _ = newton(lambda z: z - past - beta * h[:, None] * f(t, z), lambda z: eye - beta * h[:, None, None] * jac(t, z), last[0], atol=1e-13)
        ok &= done
        last = [y, *last[: order - 1]]
    return last[0], ok


# The NDF constants of Shampine and Reichelt for orders 0 to 5.
KAPPA = np.array([0, -0.1850, -1 / 9, -0.0823, -0.0415, 0])
GAMMA = np.concatenate([[0], np.cumsum(1 / np.arange(1, 6))])
ALPHA, ERROR = (1 - KAPPA) * GAMMA, KAPPA * GAMMA + 1 / np.arange(1, 7)
TOP = 5  # highest order


def _rescaled(d, order, factor):
    """Differences (systems, 8, equations) on a grid whose step is `factor` as wide, each system up to its own order."""
    k = np.arange(TOP + 1)

    def r(x):
        m = np.ones((len(x), TOP + 1, TOP + 1))
        m[:, 1:] = (k[1:, None] - 1 - x[:, None, None] * k) / k[1:, None]
        m[:, 1:, 0] = 0
        return np.cumprod(m, axis=1)

    inside = (k[:, None] <= order[:, None, None]) & (k <= order[:, None, None])
    change = np.where(inside, r(factor) @ r(np.ones(len(factor))), np.eye(TOP + 1))
    out = d.copy()
    out[:, : TOP + 1] = change.transpose(0, 2, 1) @ d[:, : TOP + 1]
    return out


def _corrections(f, jac, t, predicted, psi, c, scale, close: float, most: int):
    """(change, found, iterations) of Newton's method with one Jacobian a step: change = c f(t, predicted + change) - psi."""
    n = predicted.shape[1]
    matrix = np.eye(n) - c[:, None, None] * jac(t, predicted)
    fit = np.isfinite(matrix).all((1, 2))
    fit[fit] = np.linalg.det(matrix[fit]) != 0
    matrix[~fit] = np.eye(n)
    change, found, count = np.zeros_like(predicted), np.zeros(len(t), bool), np.zeros(len(t), int)
    for _ in range(most):
        at = np.flatnonzero(fit & ~found)
        if not len(at):
            break
        rest = c[at, None] * f(t[at], predicted[at] + change[at]) - psi[at] - change[at]
        step = np.linalg.solve(matrix[at], rest[:, :, None])[:, :, 0]
        change[at] += step
        count[at] += 1
        found[at] = _rms(step / scale[at]) < close
    return change, found, count


def bdf_adaptive(f, t0, t1, y0, options: BdfOptions = BdfOptions(), jac=None):
    """(y, status, steps) of variable-order (1 to 5), variable-step BDF (NDF) in backward differences.

    All systems of the stack step together, each with its own time, step and order.
    """
    jac = jac or (lambda t, y: numeric_jacobian(f, t, y))
    y, t, end, n = y0.astype(float), t0.astype(float).copy(), t1.astype(float), len(y0)
    atol, rtol = options.atol, options.rtol
    close = max(10 * np.finfo(float).eps / rtol, min(0.03, rtol**0.5))
    h = np.full(n, float(options.first)) if options.first else first_step(f, t, y, 2, atol, rtol)
    d = np.zeros((n, 8, y.shape[1]))
    d[:, 0], d[:, 1] = y, f(t, y) * h[:, None]
    order, same, count = np.ones(n, int), np.zeros(n, int), np.zeros(n, int)
    status, live = np.array([SUCCESS] * n, object), t < end

    def resize(at, factor):
        d[at] = _rescaled(d[at], order[at], factor)
        h[at] *= factor
        same[at] = 0

    while live.any():
        over = np.flatnonzero(live & (t + h > end))
        resize(over, (end[over] - t[over]) / h[over])
        small, long = live & ~(h >= 1e-14 * np.maximum(1, np.abs(t))), live & (count >= options.most)
        status[small], status[long] = MIN_SIZE, MAX_STEPS
        live &= ~small & ~long
        at = np.flatnonzero(live)
        if not len(at):
            break
        p, past = order[at], d[at, : TOP + 1]
        held = np.arange(TOP + 1) <= p[:, None]
        predicted = (past * held[:, :, None]).sum(1)
        psi = (past * (held * GAMMA)[:, :, None]).sum(1) / ALPHA[p, None]
        scale = atol + rtol * np.abs(predicted)
        change, found, tries = _corrections(f, jac, t[at] + h[at], predicted, psi, h[at] / ALPHA[p], scale, close, options.newton)
        scale = atol + rtol * np.abs(predicted + change)
        error = ERROR[p] * _rms(change / scale)
        safety = 0.9 * (2 * options.newton + 1) / (2 * options.newton + tries)
        good = found & (error <= 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            shrink = np.where(found, np.fmax(0.2, safety * error ** (-1 / (p + 1))), 0.5)
        resize(at[~good], shrink[~good])

        at, p, change, scale, error, safety = at[good], p[good], change[good], scale[good], error[good], safety[good]
        t[at] = np.where(t[at] + h[at] >= end[at] - 1e-15 * np.abs(end[at]), end[at], t[at] + h[at])
        count[at] += 1
        same[at] += 1
        d[at, p + 2], d[at, p + 1] = change - d[at, p + 1], change
        for k in range(TOP, -1, -1):
            of = at[p >= k]
            d[of, k] += d[of, k + 1]
        live[at[t[at] >= end[at]]] = False

        ready = same[at] >= p + 1
        at, p, scale, error, safety = at[ready], p[ready], scale[ready], error[ready], safety[ready]
        lower = np.where(p > 1, ERROR[p - 1] * _rms(d[at, p] / scale), np.inf)
        higher = np.where(p < TOP, ERROR[np.minimum(p + 1, TOP)] * _rms(d[at, p + 2] / scale), np.inf)
        with np.errstate(divide="ignore"):
            gains = np.stack([lower, error, higher]) ** (-1 / (p + np.arange(3)[:, None]))
        order[at] = p + gains.argmax(0) - 1
        resize(at, np.minimum(10, safety * gains.max(0)))
    return d[:, 0].copy(), status, count


def solve(df: DataFrame, f, method: str = "RKF45", steps: int | None = None, options: RkOptions = RkOptions(), jac=None, bdf: BdfOptions = BdfOptions()) -> DataFrame:
    """Rows (id, t0, t1, y0 array) -> id, y, status. method: a Runge-Kutta name, BDF1 to BDF6 (with steps), or BDF (adaptive).

    f(t, y) may read further columns: it gets them as keyword `params`, a data frame, if it takes one.
    """
    import inspect

    takes = "params" in inspect.signature(f).parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["y0"].map(len)
            for _, part in pdf.groupby(sizes.to_numpy()):
                y0, t0, t1 = np.stack(part["y0"].to_list()), part["t0"].to_numpy(float), part["t1"].to_numpy(float)
                if takes and method not in TABLEAUS:
                    raise ValueError("params go with Runge-Kutta methods at fixed steps")
                g = (lambda t, y: f(t, y, params=part)) if takes else f  # noqa: B023
                if method in TABLEAUS:
                    y, status, _ = runge_kutta(g, t0, t1, y0, method, options)
                elif method == "BDF":
                    y, status, _ = bdf_adaptive(g, t0, t1, y0, bdf, jac)
                else:
                    y, ok = bdf_fixed(g, t0, t1, steps or 100, y0, int(method[3:]), jac)
                    status = np.where(ok, SUCCESS, "NEWTON")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "y": list(y), "status": status})

    return df.mapInPandas(run, "id long, y array<double>, status string")


def newton_rows(df: DataFrame, g, jac) -> DataFrame:
    """Rows (id, y0) -> id, y, status, iterations, for g(y) = 0."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                y, ok, n = newton(g, jac, np.stack(pdf["y0"].to_list()))
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "y": list(y), "status": np.where(ok, SUCCESS, "MAX_ITER"), "iterations": n})

    return df.mapInPandas(run, "id long, y array<double>, status string, iterations long")
