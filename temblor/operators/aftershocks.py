"""Aftershock decay: sequences, daily bins, grids, diagnostics and reference curves.

Sequences carry group columns, so many mainshocks are handled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor import schema
from temblor.functions.scalar import DAY_MS
from temblor.operators.components import ranked
from temblor.scratch import written

T_START = 0.001


def accumulate(start: float, stop: float, step: float) -> list[float]:
    """Values from repeated addition, as a loop over floating-point numbers makes them."""
    out, x = [], start
    while x <= stop:
        out.append(x)
        x += step
    return out


FIT_GRID = [(p, c) for p in accumulate(0.8, 1.5, 0.1) for c in accumulate(0.01, 1.0, 0.1)]
PROFILE_GRID = [(p, c) for p in accumulate(0.5, 1.8, 0.1) for c in accumulate(0.01, 1.0, 0.1)]


def sequence(cat: DataFrame, main_ms: int, days_after: float = 365, mc: float | None = None) -> DataFrame:
    """Events after a mainshock with ``days`` since it; every group of interest carries a ``main`` key."""
    days = (F.col("timeMs") - F.lit(main_ms)) / F.lit(float(DAY_MS))
    out = cat.withColumn("main", F.lit(main_ms).cast("bigint")).withColumn("days", days).filter((F.col("days") > 0) & (F.col("days") <= days_after))
    return out if mc is None else out.filter(F.col("magnitude") >= mc)


def daily_bins(seq: DataFrame, days_after: int = 365, by: list[str] | None = None) -> DataFrame:
    """Counts of days 1 to the last, each from half a day before to half a day after it, zeros included."""
    by = by or ["main"]
    last = seq.groupBy(*by).agg(F.least(F.ceil(F.max("days")), F.lit(days_after)).cast("bigint").alias("last")).filter("last >= 1")
    counted = seq.groupBy(*by, F.floor(F.col("days") + 0.5).alias("day")).agg(F.count("*").alias("events"))
    spine = last.select(*by, F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("day"))
    return spine.join(counted, [*by, "day"], "left").select(*by, "day", F.coalesce("events", F.lit(0)).alias("events"))


def fittable(seq: DataFrame, binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Groups of at least 10 events with at least 5 days that have any."""
    by = by or ["main"]
    a = seq.groupBy(*by).agg(F.count("*").alias("n")).filter("n >= 10").select(*by)
    b = binned.filter("events > 0").groupBy(*by).agg(F.count("*").alias("d")).filter("d >= 5").select(*by)
    return a.join(b, by)


def rate(t: Column, k: Column, c: Column, p: Column) -> Column:
    return k / F.pow(t + c, p)


def expected(t: Column, k: Column, c: Column, p: Column, start: float = 0.0) -> Column:
    """Expected number of events from ``start`` to t days."""
    log = k * (F.log(t + c) - F.log(c + start))
    power = k / (1 - p) * (F.pow(t + c, 1 - p) - F.pow(c + start, 1 - p))
    return F.when(F.abs(p - 1) < 0.001, log).otherwise(power)


def _grid(df: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(p).alias("p"), F.lit(c).alias("c")) for i, (p, c) in enumerate(points)])
    return df.withColumn("g", F.explode(cells)).select("*", "g.no", "g.p", "g.c").drop("g")


def grid_fit(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least-squares fit over a fixed grid of p and c, with K in closed form: K, c, p, sse, r2 per group.

    The first grid point wins ties; only days with events count.
    """
    by = by or ["main"]
    rows = binned.filter("events > 0")
    sums = rows.groupBy(*by).agg(F.avg("events").alias("mean"), F.sum(F.col("events") * F.col("events")).alias("sq"), F.count("*").alias("n"))
    w = F.pow(F.col("day") + F.col("c"), F.col("p"))
    per = _grid(rows, FIT_GRID).groupBy(*by, "no", "p", "c").agg((F.sum(F.col("events") / w) / F.sum(1 / F.pow(F.col("day") + F.col("c"), 2 * F.col("p")))).alias("k"))
    error = rows.join(per, by)
    miss = F.col("events") - rate(F.col("day"), F.col("k"), F.col("c"), F.col("p"))
    scored = error.groupBy(*by, "no", "p", "c", "k").agg(F.sum(miss * miss).alias("sse"))
    best = scored.groupBy(*by).agg(F.min(F.struct("sse", "no", "k", "c", "p")).alias("b")).join(sums, by)
    total = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    return best.select(*by, F.col("b.k").alias("k"), F.col("b.c").alias("c"), F.col("b.p").alias("p"), F.col("b.sse").alias("sse"), (1 - F.col("b.sse") / total).alias("r2"))


def profile_likelihood(seq: DataFrame, days_after: float = 365, by: list[str] | None = None) -> DataFrame:
    """Log-likelihood over a grid of p and c with the best K: p, c, k, log_likelihood."""
    by = by or ["main"]
    per = _grid(seq.select(*by, "days"), PROFILE_GRID).groupBy(*by, "no", "p", "c").agg(F.count("*").alias("n"), F.sum(F.log(F.col("days") + F.col("c"))).alias("logs"))
    area = expected(F.lit(float(days_after)), F.lit(1.0), F.col("c"), F.col("p"), T_START)
    per = per.withColumn("k", F.col("n") / area)
    value = F.col("n") * F.log("k") - F.col("p") * F.col("logs") - F.col("n")
    return per.select(*by, F.round("p", 2).alias("p"), F.round("c", 3).alias("c"), "k", value.alias("log_likelihood"))


def fitted_days(binned: DataFrame, params: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days with observed, fitted and cumulative counts, expected counts and Pearson residuals.

    The expected count of a day is that of (day - 1, day].
    """
    by = by or ["main"]
    k, c, p = F.col("k"), F.col("c"), F.col("p")
    run = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    day = F.col("day").cast("double")
    e = expected(day, k, c, p) - expected(day - 1, k, c, p)
    joined = binned.join(params.select(*by, "k", "c", "p"), by)
    return joined.select(*by, "day", "events", rate(day, k, c, p).alias("fitted"), F.sum("events").over(run).alias("observed_total"), expected(day, k, c, p).alias("expected_total"), e.alias("expected"), F.when(e > 0, (F.col("events") - e) / F.sqrt(e)).otherwise(0.0).alias("pearson"))


def transformed_times(seq: DataFrame, params: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each event's expected count and the residual of its rank against it."""
    by = by or ["main"]
    tau = expected(F.col("days"), F.col("k"), F.col("c"), F.col("p"))
    out = cumulative_curve(seq, by).withColumnRenamed("events", "rank").join(params.select(*by, "k", "c", "p"), by).select(*by, "row_idx", "days", tau.alias("tau"), "rank")
    return out.withColumn("residual", F.col("rank") - F.col("tau"))


def quantile_plot(times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sorted gaps of transformed times against quantiles of the unit exponential law."""
    by = by or ["main"]
    times = written(times.select(*by, "rank", "tau"), "times")  # its ranks are read three times
    before = times.select(*by, (F.col("rank") + 1).alias("rank"), F.col("tau").alias("before"))
    gaps = ranked(times.join(before, [*by, "rank"]).select(*by, "rank", (F.col("tau") - F.col("before")).alias("y")), by, [F.col("y"), F.col("rank")], "place")
    gaps = gaps.join(times.groupBy(*by).agg((F.count("*") - 1).alias("n")), by)
    i, n = F.col("place") - 1, F.col("n")
    return gaps.select(*by, i.alias("i"), (-F.log(1 - (i + 0.5) / n)).alias("x"), "y")


def reference_curves(days: DataFrame, main_magnitude: float, mc: float, models: DataFrame | None = None) -> DataFrame:
    """Daily rates of the published models for a mainshock: model, day, rate."""
    models = models if models is not None else schema.reference_models(days.sparkSession)
    k = F.pow(F.lit(10.0), F.col("a") + F.col("b") * (F.lit(main_magnitude) - F.lit(mc)))
    return days.select("day").crossJoin(F.broadcast(models)).select("model", "day", rate(F.col("day").cast("double"), k, F.col("c"), F.col("p")).alias("rate"))


def cumulative_curve(seq: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank of each event of a sequence in time order."""
    by = by or ["main"]
    return ranked(seq.select(*by, "row_idx", "days"), by, [F.col("days"), F.col("row_idx")], "events")


def model_curve(params: DataFrame, last_day: float, points: int = 101, by: list[str] | None = None) -> DataFrame:
    """Expected cumulative counts at evenly spaced days, 1 at least."""
    by = by or ["main"]
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (last_day / (points - 1))))
    curve = params.select(*by, "k", "c", "p", t.alias("day"))
    return curve.select(*by, "day", F.greatest(F.lit(1.0), expected(F.col("day"), F.col("k"), F.col("c"), F.col("p"))).alias("events"))


def interpretation(b: float | None = None, p: float | None = None, k: float | None = None) -> dict[str, str]:
    """Wording of fitted values: large or small b, slow or fast decay, productivity."""
    out = {}
    if b is not None:
        out["b"] = "more large events than usual" if b < 0.9 else "fewer large events than usual" if b > 1.1 else "typical"
    if p is not None:
        out["p"] = "slow decay" if p < 1 else "fast decay" if p > 1.2 else "typical decay"
    if k is not None:
        out["k"] = "high productivity" if k > 100 else "moderate productivity" if k > 50 else "low productivity"
    return out
