"""Non-linear fits of the decay law to sums that Spark adds up, any number of mainshocks at once.

The likelihood of a sequence depends on its events only through their number and
S(c), the sum of log(t + c).  S is smooth in log c, with no singularity nearer than pi,
so its values at NODES Chebyshev points between the bounds of c give it everywhere to
rounding.  One aggregate over the events yields these sums for all groups, another the
daily counts; the fitters then work on one row a group, however long its sequence is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.operators.aftershocks import FIT_GRID, T_START, accumulate, daily_bins

METHODS = ("grid", "levenberg_marquardt", "nelder_mead", "hybrid", "mle", "mle_annealing", "mle_em")
LSQ_LOW, LSQ_HIGH = np.array([1e-3, 1e-3, 0.5]), np.array([1e6, 10.0, 2.0])
MLE_LOW, MLE_HIGH = np.array([1e-9, 0.005, 0.6]), np.array([1e6, 5.0, 1.8])


def integral(t0: float, t1: float, c: float, p: float) -> float:
    """Integral of (t + c)**-p."""
    if abs(p - 1) < 1e-6:
        return math.log(t1 + c) - math.log(t0 + c)
    return ((t1 + c) ** (1 - p) - (t0 + c) ** (1 - p)) / (1 - p)


NODES = 48
_turn = math.pi * np.arange(NODES) / (NODES - 1)
_span = math.log(MLE_LOW[1]), math.log(MLE_HIGH[1])
#: Values of c at which S is summed.
C_NODES = [math.exp((_span[0] + _span[1]) / 2 + (_span[1] - _span[0]) / 2 * math.cos(x)) for x in _turn]
_weights = np.where(np.arange(NODES) % 2, -1.0, 1.0) * np.where((np.arange(NODES) == 0) | (np.arange(NODES) == NODES - 1), 0.5, 1.0)
_u_nodes = np.log(C_NODES)


def basis(c) -> np.ndarray:
    """What each node's value adds to the value at c, one c or a row for each of many (barycentric formula)."""
    gap = np.atleast_1d(np.log(c))[:, None] - _u_nodes
    exact = np.abs(gap) < 1e-14
    w = np.where(exact.any(axis=1, keepdims=True), exact, _weights / np.where(exact, 1.0, gap))
    out = w / w.sum(axis=1, keepdims=True)
    return out if np.ndim(c) else out[0]


@dataclass(frozen=True)
class Sums:
    """What a fit needs of one sequence.

    Number, last and edge-window counts of the events from T_START on; S at C_NODES;
    days with events and their counts, in days around whole ones (least squares) and in
    whole days (for the R2 of likelihood fits).
    """

    n: int
    last: float
    early: int
    late: int
    logs: np.ndarray
    days: np.ndarray
    counts: np.ndarray
    floor_days: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_sum(self, c) -> np.ndarray:
        """S at one or many c between the bounds."""
        return basis(c) @ self.logs


def windows(last: float) -> tuple[float, tuple[float, float]]:
    """End of the early window and the late window, for the start of p."""
    return min(1.0, last * 0.1), (min(10.0, last * 0.5), min(20.0, last * 0.7))


def sums_of(times: np.ndarray, horizon: float) -> Sums:
    """The sums of one small sequence of event times in days."""
    times = times[times > 0]
    used = times[times >= T_START]
    last = float(used.max()) if len(used) else 0.0
    early, late = windows(last)
    top = min(math.ceil(times.max()), int(horizon)) if len(times) else 0
    near = np.bincount(np.floor(times + 0.5).astype(int), minlength=top + 1)[1 : top + 1]
    whole = np.bincount(np.floor(used).astype(int), minlength=math.ceil(last))[: math.ceil(last)]
    logs = np.array([np.log(used + c).sum() for c in C_NODES])
    days, floor_days = np.flatnonzero(near), np.flatnonzero(whole)
    return Sums(len(used), last, int((used < early).sum()), int(((used >= late[0]) & (used < late[1])).sum()), logs, days + 1.0, near[days].astype(float), floor_days + 1.0, whole[floor_days].astype(float))


def log_likelihood(sums: Sums, horizon: float, x: np.ndarray) -> float:
    """Of the point process on [T_START, horizon]; minus infinity outside the bounds."""
    k, c, p = x
    if not (0 < k <= MLE_HIGH[0] and MLE_LOW[1] < c <= MLE_HIGH[1] and MLE_LOW[2] < p < MLE_HIGH[2]):
        return -math.inf
    return sums.n * math.log(k) - p * float(sums.log_sum(c)) - k * integral(T_START, horizon, c, p)


def simplex(f, x0: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, int]:
    """Nelder-Mead minimum of f from x0."""
    points = [np.array(x0, float)]
    for i in range(len(x0)):
        p = np.array(x0, float)
        p[i] = p[i] * 1.1 if p[i] else 0.01
        points.append(p)
    values = [f(p) for p in points]
    n = 0
    for n in range(1, rounds + 1):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol:
            break
        mid = np.mean(points[:-1], axis=0)
        far = mid + (mid - points[-1])
        v = f(far)
        if v < values[0]:
            further = mid + 2 * (mid - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = mid + 0.5 * (points[-1] - mid)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    best = int(np.argmin(values))
    return points[best], n


def model(days: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x[0] / (days + x[1]) ** x[2]


def sse(days: np.ndarray, counts: np.ndarray, x: np.ndarray) -> float:
    return float(((counts - model(days, x)) ** 2).sum())


def fit_grid(days, counts):
    best, at = math.inf, np.array([counts.max() * 2, 0.1, 1.1])
    for p, c in FIT_GRID:
        w = (days + c) ** p
        x = np.array([(counts / w).sum() / (1 / (days + c) ** (2 * p)).sum(), c, p])
        if (e := sse(days, counts, x)) < best:
            best, at = e, x
    return at, len(FIT_GRID)


def fit_levenberg_marquardt(days, counts, damping: float = 0.01, rounds: int = 100, tol: float = 1e-7):
    x, _ = fit_grid(days, counts)
    x = np.clip(x, LSQ_LOW, LSQ_HIGH)
    error, n = sse(days, counts, x), 0
    for n in range(1, rounds + 1):
        base = (days + x[1]) ** -x[2]
        jac = np.stack([base, -x[2] * x[0] * (days + x[1]) ** (-x[2] - 1), -x[0] * base * np.log(days + x[1])], axis=1)
        normal = jac.T @ jac
        try:
            step = np.linalg.solve(normal + damping * np.diag(np.maximum(np.diag(normal), 1e-12)), jac.T @ (counts - model(days, x)))
        except np.linalg.LinAlgError:
            break
        tried = np.clip(x + step, LSQ_LOW, LSQ_HIGH)
        e = sse(days, counts, tried)
        if e < error:
            gain, x, error, damping = error - e, tried, e, max(damping / 10, 1e-12)
            if gain < tol:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return x, n


def fit_nelder_mead(days, counts):
    def f(x):
        out = np.maximum(0, LSQ_LOW - x).sum() + np.maximum(0, x - LSQ_HIGH).sum()
        return sse(days, counts, np.clip(x, LSQ_LOW, LSQ_HIGH)) + 1e6 * out

    x, n = simplex(f, fit_grid(days, counts)[0], 200, 1e-6)
    return np.clip(x, LSQ_LOW, LSQ_HIGH), n


def fit_hybrid(days, counts):
    a, n = fit_grid(days, counts)
    b, m = fit_levenberg_marquardt(days, counts)
    return (b if sse(days, counts, b) < sse(days, counts, a) else a), n + m


def _start(sums: Sums, horizon: float, low: float = 0.9, high: float = 1.3) -> np.ndarray:
    """K, c and p to start from: p from the rates in two windows, K by the number of events."""
    early, late = windows(sums.last)
    a, b = sums.early / max(early, 1e-12), sums.late / max(late[1] - late[0], 1e-12)
    t0, t1 = early / 2, sum(late) / 2
    p = float(np.clip(math.log(a / b) / math.log(t1 / t0), low, high)) if a > 0 and b > 0 and t1 > t0 else 1.1
    return np.array([sums.n / integral(T_START, horizon, 0.1, p), 0.1, p])


def _loss(sums, horizon):
    def f(x):
        v = log_likelihood(sums, horizon, x)
        return 1e10 if v == -math.inf else -v

    return f


def fit_mle(sums, horizon):
    return simplex(_loss(sums, horizon), _start(sums, horizon), 300, 1e-8)


def fit_mle_annealing(sums, horizon, seed: int = 0, rounds: int = 5000, cooling: float = 0.995):
    rng = np.random.default_rng(seed)
    f = _loss(sums, horizon)
    x = best = _start(sums, horizon)
    v = low = f(x)
    heat = 1.0
    for _ in range(rounds):
        tried = x * np.exp(rng.normal(0, 0.1 * max(heat, 0.01), 3))
        w = f(tried)
        if w < v or rng.random() < math.exp(min(0.0, (v - w) / max(heat, 1e-9))):
            x, v = tried, w
            if v < low:
                best, low = x, v
        heat *= cooling
    return best, rounds


def _slope(horizon: float, c: float, p: float) -> float:
    """Derivative by p of the integral from 0 to the horizon."""
    top, low = math.log(horizon + c), math.log(c)
    if abs(p - 1) < 1e-6:
        return -(top - low)
    q = 1 - p
    a, b = (horizon + c) ** q, c**q
    return (a - b) / q**2 + (b * low - a * top) / q


def fit_mle_em(sums, horizon, rounds: int = 200):
    """Alternates a damped step of p between 0.7 and 1.6, a scan of c, and K in closed form.

    K's integral starts at 0, the likelihood's at T_START; stops when the likelihood does not move.
    """
    k, c, p = _start(sums, horizon, 0.8, 1.4)
    scan = np.array(accumulate(0.01, 2.0, 0.01))
    logs = sums.log_sum(scan)
    before, n = -math.inf, 0
    for n in range(rounds):
        p = float(np.clip(p - 0.01 * (_slope(horizon, c, p) - float(sums.log_sum(c))), 0.7, 1.6))
        tried = [sums.n / integral(0.0, horizon, x, p) for x in scan]
        value = [sums.n * math.log(y) - p * s - y * integral(T_START, horizon, x, p) for y, x, s in zip(tried, scan, logs, strict=True)]
        at = int(np.argmax(value))
        c, k = float(scan[at]), tried[at]
        if abs(value[at] - before) < 1e-6:
            break
        before = value[at]
    return np.array([k, c, p]), n


def hessian_errors(days, counts, x) -> dict[str, float]:
    """Standard errors from second differences of the squared error; none if singular or negative."""
    h = np.maximum(np.abs(x) * 0.01, 1e-8)
    second = np.zeros((3, 3))
    for i in range(3):
        for j in range(3):
            a, b = np.eye(3)[i] * h[i], np.eye(3)[j] * h[j]
            f = lambda d: sse(days, counts, x + d)
            second[i, j] = (f(a + b) - f(a - b) - f(b - a) + f(-a - b)) / (4 * h[i] * h[j])
    try:
        var = np.diag(sse(days, counts, x) / max(1, len(days) - 3) / 2 * np.linalg.inv(second / 1.0)) * 2
    except np.linalg.LinAlgError:
        return {}
    if (var <= 0).any() or not np.isfinite(var).all():
        return {}
    low, high = np.array([1.0, 0.01, 0.7]), np.array([math.inf, 2.0, 1.6])
    out = {}
    for name, v, s, a, b in zip("kcp", x, np.sqrt(var), low, high, strict=True):
        out |= {f"{name}_se": float(s), f"{name}_lo": float(max(a, v - 1.96 * s)), f"{name}_hi": float(min(b, v + 1.96 * s))}
    return out


def likelihood_interval(sums, horizon, x, level: float = 3.84) -> dict[str, float]:
    """Bounds of each parameter, others held, where twice the likelihood drop reaches ``level``; bisection."""
    top = log_likelihood(sums, horizon, x)
    out = {}
    for i, name in enumerate("kcp"):
        for side, edge in (("lo", 0.1), ("hi", 10.0)):
            a, b = x[i], x[i] * edge
            for _ in range(50):
                mid = (a + b) / 2
                tried = x.copy()
                tried[i] = mid
                a, b = (mid, b) if 2 * (top - log_likelihood(sums, horizon, tried)) < level else (a, mid)
                if abs(a - b) < 0.01 * abs(x[i]) * 0.01:
                    break
            out[f"{name}_{side}"] = float((a + b) / 2)
        out[f"{name}_se"] = (out[f"{name}_hi"] - out[f"{name}_lo"]) / 3.92
    return out


def bootstrap_errors(days, counts, fit, seed: int = 0, rounds: int = 100) -> dict[str, float]:
    """Percentile bounds from resampled days: implausible fits and outliers by quartiles are left out; 20 must remain."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(rounds):
        at = rng.integers(0, len(days), len(days))
        x, _ = fit(days[at], counts[at])
        if np.isfinite(x).all() and x[0] > 0 and 0 < x[1] < 10 and 0.3 < x[2] < 3:
            found.append(x)
    if len(found) < 20:
        return {}
    a = np.array(found)
    q1, q3 = np.percentile(a, [25, 75], axis=0)
    keep = ((a >= q1 - 1.5 * (q3 - q1)) & (a <= q3 + 1.5 * (q3 - q1))).all(axis=1)
    a = a[keep] if keep.sum() >= 20 else a
    out = {}
    for i, name in enumerate("kcp"):
        out |= {f"{name}_se": float(a[:, i].std()), f"{name}_lo": float(np.percentile(a[:, i], 2.5)), f"{name}_hi": float(np.percentile(a[:, i], 97.5))}
    return out


COLUMNS = [f"{n}_{w}" for n in "kcp" for w in ("se", "lo", "hi")]
SCHEMA = "k double, c double, p double, r2 double, log_likelihood double, aic double, bic double, iterations int, " + ", ".join(f"{c} double" for c in COLUMNS)


def fit_sums(sums: Sums, horizon: float, method: str, seed: int = 0, errors: bool = True) -> dict | None:
    """Fit of one sequence's sums; None below 5 days with events (the 10 events are counted before)."""
    days, counts = sums.days, sums.counts
    if len(days) < 5:
        return None
    out: dict = dict.fromkeys(["log_likelihood", "aic", "bic", *COLUMNS])
    if method.startswith("mle"):
        if not sums.n:
            return None
        x, n = {"mle": lambda: fit_mle(sums, horizon), "mle_annealing": lambda: fit_mle_annealing(sums, horizon, seed), "mle_em": lambda: fit_mle_em(sums, horizon)}[method]()
        value = log_likelihood(sums, horizon, x)
        out |= {"log_likelihood": value, "aic": -2 * value + 6, "bic": -2 * value + 3 * math.log(sums.n)}
        if errors and math.isfinite(value):
            out |= likelihood_interval(sums, horizon, x)
        days, counts = sums.floor_days, sums.floor_counts
    else:
        fit = {"grid": fit_grid, "levenberg_marquardt": fit_levenberg_marquardt, "nelder_mead": fit_nelder_mead, "hybrid": fit_hybrid}[method]
        x, n = fit(days, counts)
        if errors:
            out |= hessian_errors(days, counts, x) or bootstrap_errors(days, counts, fit, seed)
    spread = float(((counts - counts.mean()) ** 2).sum()) if len(counts) else 0.0
    return out | {"k": float(x[0]), "c": float(x[1]), "p": float(x[2]), "r2": 1 - sse(days, counts, x) / spread if spread else None, "iterations": int(n)}


def fit_one(times: np.ndarray, horizon: float, method: str, seed: int = 0, errors: bool = True) -> dict | None:
    """Fit of one small sequence of event times in days; None below 10 events or 5 days with events."""
    times = times[times > 0]
    return fit_sums(sums_of(times, horizon), horizon, method, seed, errors) if len(times) >= 10 else None


def decay_sums(seq: DataFrame, days_after: float = 365, by: list[str] | None = None) -> DataFrame:
    """One row a group of at least 10 events: (by..., n, last, early, late, logs, near, whole).

    ``logs`` are the sums of log(days + c) at C_NODES; ``near`` and ``whole`` are arrays of
    (day, events) of days with events, at most as many as the days looked at.  All are
    partial sums, so a group with most events is no burden to a task.
    """
    by = by or ["main"]
    rows = seq.filter("days > 0")
    used = rows.filter(F.col("days") >= T_START)
    total = rows.groupBy(*by).agg(F.count("*").alias("events"), F.max(F.when(F.col("days") >= T_START, F.col("days"))).alias("last")).filter("events >= 10")
    sums = used.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.log(F.col("days") + F.lit(c))) for c in C_NODES]).alias("logs"))
    early, start, stop = F.least(F.lit(1.0), F.col("last") * 0.1), F.least(F.lit(10.0), F.col("last") * 0.5), F.least(F.lit(20.0), F.col("last") * 0.7)
    edges = used.join(total, by).groupBy(*by).agg(F.count_if(F.col("days") < early).alias("early"), F.count_if((F.col("days") >= start) & (F.col("days") < stop)).alias("late"))
    listed = lambda binned, name: binned.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("day", "events"))).alias(name))  # noqa: E731  a row a day
    near = listed(daily_bins(rows, int(days_after), by).filter("events > 0"), "near")
    whole = listed(used.groupBy(*by, (F.floor("days") + 1).alias("day")).agg(F.count("*").alias("events")).join(total.select(*by, "last"), by).filter(F.col("day") <= F.ceil("last")).drop("last"), "whole")
    out = total
    for part in (sums, edges, near, whole):
        out = out.join(part, by, "left")
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last", F.lit(0.0)).alias("last"), F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("late", F.lit(0)).alias("late"), "logs", "near", "whole")


def fit(seq: DataFrame, method: str | list[str] = "hybrid", days_after: float = 365, by: list[str] | None = None, seed: int = 0, errors: bool = True) -> DataFrame:
    """Fit every group's sequence (column ``days``) by one or several of :data:`METHODS`; ``method`` tells which.

    A group is one mainshock's sequence.  Groups too small to fit give no row.
    """
    by = by or ["main"]
    methods = [method] if isinstance(method, str) else method
    if unknown := set(methods).difference(METHODS):
        raise ValueError(f"methods {sorted(unknown)} are none of {METHODS}")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seq.select(*by).schema)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def split(bins) -> tuple[np.ndarray, np.ndarray]:
        a = np.array([(b["day"], b["events"]) for b in bins], float).reshape(-1, 2) if bins is not None else np.zeros((0, 2))
        return a[:, 0], a[:, 1]

    def each(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                logs = np.array(r["logs"], float) if r["logs"] is not None else np.zeros(NODES)
                sums = Sums(int(r["n"]), r["last"], int(r["early"]), int(r["late"]), logs, *split(r["near"]), *split(r["whole"]))
                got = fit_sums(sums, days_after, r["method"], seed, errors)
                if got is not None:
                    out.append([*(r[c] for c in by), *(got[n] for n in names), r["method"]])
            yield pd.DataFrame(out, columns=[*by, *names, "method"])

    sums = decay_sums(seq, days_after, by).withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    return sums.repartition(*by, "method").mapInPandas(each, f"{keys}, {SCHEMA}, method string")  # a row a group and method


def bootstrap(seq: DataFrame, method: str = "hybrid", replicates: int = 100, days_after: float = 365, by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Fits of resampled sequences, one group a replicate, so replicates run in parallel.

    A replicate repeats each event a Poisson(1) number of times drawn from its hash.
    """
    by = by or ["main"]
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", "row_idx"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    times, total = F.lit(0), 0.0
    for n in range(8):
        total += math.exp(-1) / math.factorial(n)
        times = times + (u > total).cast("int")
    drawn = seq.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("times", times).filter("times > 0")
    drawn = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return fit(drawn, method, days_after, [*by, "replicate"], seed, errors=False)
