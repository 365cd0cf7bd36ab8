"""Dose-response curves, fitted by a bounded Levenberg-Marquardt method over many groups at once in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points whose groups are fitted in one task, about.
MOST_POINTS = 200_000


@dataclass(frozen=True)
class Gates:
    """When a group is fitted, between which bounds, and when a fit counts.

    Bounds on the concentration are factors of the least and the greatest dose. `span` bounds top minus bottom instead of top.
    """

    least_points: int = 4
    distinct_doses: bool = False
    least_range: float = 0.0
    bottom: tuple[float, float] = (0.0, 100.0)
    top: tuple[float, float] = (0.0, 100.0)
    span: bool = False
    ic50: tuple[float, float] = (0.01, 100.0)
    hill: tuple[float, float] = (0.1, 10.0)
    start: str = "median"
    least_r2: float | None = 0.5
    accept: tuple[float, float] | None = (0.1, 10.0)


CANONICAL = Gates()
FOUR_PARAMETER = Gates(distinct_doses=True, least_range=40.0, span=True, ic50=(1.0, 1.0), start="geometric", least_r2=None, accept=None)
CLINICAL = Gates(bottom=(-50.0, 50.0), top=(20.0, 120.0))


def curve(dose: np.ndarray, p: np.ndarray, span: bool) -> np.ndarray:
    bottom, top, ic50, hill = p
    return bottom + (top if span else top - bottom) / (1.0 + (ic50 / np.maximum(dose, 1e-9)) ** hill)


def fit(dose: np.ndarray, response: np.ndarray, gates: Gates = CANONICAL) -> dict | None:
    """Parameters of one curve, or None where a gate shuts."""
    return fit_many([(dose, response)], gates)[0]


def fit_many(groups: list[tuple], gates: Gates = CANONICAL) -> list[dict | None]:
    """Parameters of each group's curve, or None where a gate shuts. Doses that aren't over 0 and missing values don't count.

    A group is its doses and responses; where a response is the mean of several, a third member has the rows (number, sum of
    squares about the mean, least, greatest) of each, and the result is that of all points.
    All groups descend together, each with its own damping; groups of few points are padded to the longest.
    """
    out: list[dict | None] = [None] * len(groups)
    kept = []
    for i, (dose, response, *means) in enumerate(groups):
        x, y = np.asarray(dose, float), np.asarray(response, float)
        w, about, lows, highs = np.asarray(means[0], float).T if means else (np.ones(len(y)), np.zeros(len(y)), y, y)
        ok = np.isfinite(x) & np.isfinite(y) & (x > 0)
        x, y, w, about = x[ok], y[ok], w[ok], about[ok].sum()
        if w.sum() < gates.least_points or gates.distinct_doses and len(np.unique(x)) < gates.least_points:
            continue
        ends = lows[ok].min(), highs[ok].max()
        if ends[1] - ends[0] < gates.least_range:
            continue
        if x.min() * gates.ic50[0] < x.max() * gates.ic50[1]:
            kept.append((i, x, y, w, about, ends))
    if not kept:
        return out
    n = np.array([len(x) for _, x, *_ in kept])
    xs, ys, ws = np.ones((len(kept), n.max())), np.zeros((len(kept), n.max())), np.zeros((len(kept), n.max()))
    start = np.empty((len(kept), 4))
    for k, (_, x, y, w, _, (lowest, highest)) in enumerate(kept):
        xs[k, : n[k]], ys[k, : n[k]], ws[k, : n[k]] = x, y, np.sqrt(w)
        middle = np.sqrt(x.min() * x.max()) if gates.start == "geometric" else _median(x, w)
        start[k] = lowest, highest - lowest if gates.span else highest, middle, 1.0
    least, most = np.array([x.min() for _, x, *_ in kept]), np.array([x.max() for _, x, *_ in kept])
    one = np.ones(len(kept))
    low = np.stack([gates.bottom[0] * one, gates.top[0] * one, np.log(least * gates.ic50[0]), np.log(gates.hill[0]) * one], axis=1)
    high = np.stack([gates.bottom[1] * one, gates.top[1] * one, np.log(most * gates.ic50[1]), np.log(gates.hill[1]) * one], axis=1)
    # Concentration and slope are searched on a log scale, where their bounds lie far apart; from three starts, the best end counts.
    start[:, 2:] = np.log(start[:, 2:])
    best, error = None, None
    for shift in (0.0, np.log(0.2), np.log(5.0)):
        p, e = _descend(xs, ys, ws, np.clip(start + [0, 0, shift, 0], low, high), low, high, gates.span)
        if best is None:
            best, error = p, e
        else:
            best, error = np.where((e < error)[:, None], p, best), np.minimum(e, error)
    best[:, 2:] = np.exp(best[:, 2:])
    for k, (i, x, y, w, about, _) in enumerate(kept):
        total = float((w * (y - (w * y).sum() / w.sum()) ** 2).sum() + about)
        r2 = 1 - float(error[k] + about) / total if total > 0 else 0.0
        p = best[k]
        if gates.least_r2 is not None and r2 <= gates.least_r2 or gates.accept and not x.min() * gates.accept[0] <= p[2] <= x.max() * gates.accept[1]:
            continue
        out[i] = {"bottom": float(p[0]), "top": float(p[1]), "ic50": float(p[2]), "hill": float(p[3]), "r2": r2, "n": int(w.sum())}
    return out


def _median(x: np.ndarray, w: np.ndarray) -> float:
    """The median of x, each as often as w says."""
    order, n = np.argsort(x), int(w.sum())
    return float(x[order][np.searchsorted(np.cumsum(w[order]), [(n - 1) // 2, n // 2], side="right")].mean())


def _descend(x, y, w, p, low, high, span: bool, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of many small problems at once; steps stay within bounds. Returns parameters and squared errors.

    Problems that stand still leave, as soon as they are half of those that are left.
    """
    logs, live, ends = np.log(x), np.arange(len(p)), (p.copy(), np.empty(len(p)))

    def model(q):
        bottom, top, c, h = (q[:, k : k + 1] for k in range(4))
        h = np.exp(h)
        far = c - logs
        u = np.exp(np.clip(h * far, -60, 60))
        g = 1 / (1 + u)
        height = top if span else top - bottom
        slope = -height * g * g * u * h
        jac = np.stack([np.ones_like(g) if span else 1 - g, g, slope, slope * far], axis=2) * w[:, :, None]
        return (bottom + height * g - y) * w, jac

    r, jac = model(p)
    error, damp, still = (r * r).sum(axis=1), np.full(len(p), 1e-2), np.zeros(len(p), dtype=int)
    for _ in range(rounds):
        grad = np.einsum("gnk,gn->gk", jac, r)
        stuck = (p <= low) & (grad > 0) | (p >= high) & (grad < 0)
        free = np.where(stuck, 0.0, 1.0)
        hess = np.einsum("gnk,gnl->gkl", jac, jac) * free[:, :, None] * free[:, None, :]
        diagonal = np.einsum("gkk->gk", hess)
        hess = hess + np.eye(4) * (damp[:, None] * diagonal + 1e-9 + (diagonal == 0))[:, None, :]
        q = np.clip(p + np.linalg.solve(hess, -(grad * free)[:, :, None])[:, :, 0], low, high)
        s, new = model(q)
        e = (s * s).sum(axis=1)
        better = e < error
        still = np.where(better & (error - e > 1e-12 * np.maximum(error, 1e-12)), 0, still + 1)
        p, r, jac = np.where(better[:, None], q, p), np.where(better[:, None], s, r), np.where(better[:, None, None], new, jac)
        error, damp = np.where(better, e, error), np.clip(np.where(better, damp / 5, damp * 4), 1e-12, 1e12)
        going = still <= 10
        if 2 * going.sum() <= len(going):
            ends[0][live], ends[1][live] = p, error
            logs, y, w, low, high, live = logs[going], y[going], w[going], low[going], high[going], live[going]
            p, r, jac, error, damp, still = p[going], r[going], jac[going], error[going], damp[going], still[going]
            if not len(live):
                break
    ends[0][live], ends[1][live] = p, error
    return ends


def fit_groups(df: DataFrame, keys: list[str], dose: str, response: str, gates: Gates = CANONICAL) -> DataFrame:
    """keys, ic50, bottom, top, hill, r2, n of each group whose curve counts.

    Points of one dose are averaged in the JVM, and each mean counts as often as it has points, so that the curve, r2 and n are those
    of all points, and what a group sends grows with its doses. Groups are dealt to tasks by their rows' number.
    """
    points = df.where(F.col(dose).isNotNull() & F.col(response).isNotNull()).select(*keys, F.col(dose).cast("double").alias("x"), F.col(response).cast("double").alias("y"))
    means = F.array(F.count("y").cast("double"), F.var_pop("y") * F.count("y"), F.min("y"), F.max("y"))
    each = points.where(F.abs("y") < float("inf")).groupBy(*keys, "x").agg(F.avg("y").alias("m"), means.alias("z")).select(*keys, "x", F.col("m").alias("y"), "z")
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // MOST_POINTS))
    lists = each.repartition(n, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "z"))).alias("xy"))

    @F.pandas_udf("struct<ic50:double,bottom:double,top:double,hill:double,r2:double,n:int>")
    def run(xy: pd.Series) -> pd.DataFrame:
        names, rows = ["ic50", "bottom", "top", "hill", "r2", "n"], []
        for k in range(0, len(xy), 500):
            part = [(np.array([p["x"] for p in g], float), np.array([p["y"] for p in g], float), [p["z"] for p in g]) for g in xy.iloc[k : k + 500]]
            rows += [[f[c] if f else None for c in names] for f in fit_many(part, gates)]
        return pd.DataFrame(rows, columns=names)

    return lists.select(*keys, run("xy").alias("f")).where("f.ic50 IS NOT NULL").select(*keys, "f.*")
