"""Gutenberg-Richter statistics for any number of groups in one job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.operators.components import numbered

LOG10_E = math.log10(math.e)


def bins(cat: DataFrame, width: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """Per group and magnitude bin: bin, edge (min + bin * width), events, at_least.

    Bins start at the group's smallest magnitude and include empty ones.
    """
    by = by or []
    keyed = cat.select(*by, "magnitude").filter("magnitude is not null")
    span = keyed.groupBy(*by).agg(F.min("magnitude").alias("low"), F.max("magnitude").alias("high")).filter("low is not null")
    joined = keyed.join(span, by) if by else keyed.crossJoin(F.broadcast(span))
    at = F.floor((F.col("magnitude") - F.col("low")) / width)
    counted = joined.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("events"))
    spine = span.select(*by, "low", F.explode(F.sequence(F.lit(0), F.ceil((F.col("high") - F.col("low")) / width))).alias("bin"))
    full = spine.join(counted, [*by, "bin"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    down = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    return full.select(*by, "bin", (F.col("low") + F.col("bin") * width).alias("edge"), "events", F.sum("events").over(down).alias("at_least"))


def incremental(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per bin from the cumulative ones, empty bins dropped."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("bin")
    return binned.withColumn("incremental", F.col("at_least") - F.coalesce(F.lead("at_least").over(w), F.lit(0))).filter("incremental > 0")


def completeness_curvature(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completeness by maximum curvature: the first bin with the largest count."""
    best = F.max(F.struct("events", (-F.col("bin")).alias("back"), "edge")).alias("b")
    return binned.groupBy(*(by or [])).agg(best).select(*(by or []), F.col("b.edge").alias("mc")).filter("mc is not null")


def completeness_nearest(binned: DataFrame, mc: float, by: list[str] | None = None) -> DataFrame:
    """The user's completeness, with the bin nearest to it (the first on ties)."""
    near = F.min(F.struct(F.abs(F.col("edge") - mc).alias("d"), "bin")).alias("b")
    return binned.groupBy(*(by or [])).agg(near).select(*(by or []), F.lit(float(mc)).alias("mc"), F.col("b.bin").alias("bin"))


def completeness_fit(cat: DataFrame, width: float = 0.1, by: list[str] | None = None, limit: float = 0.10, least: int = 10) -> DataFrame:
    """Completeness by goodness of fit: the lowest bin from which a fitted law misses at most ``limit``.

    For each candidate bin with at least ``least`` events above it, the law fitted to
    them gives expected cumulative counts; the misfit is the summed absolute
    difference over the summed counts.  Falls back to maximum curvature.
    """
    by = by or []
    table = bins(cat, width, by)
    n_bins = table.groupBy(*by).agg(F.max("bin").alias("top"))
    with_top = table.join(n_bins, by) if by else table.crossJoin(F.broadcast(n_bins))
    start = with_top.filter((F.col("bin") < F.col("top") - 1) & (F.col("at_least") >= least)).select(*by, F.col("bin").alias("from"), F.col("edge").alias("mc"), F.col("at_least").alias("n"))
    mags = cat.select(*by, "magnitude")
    # Sums above each candidate come from bin sums, not from a join of candidates with events.
    low = mags.groupBy(*by).agg(F.min("magnitude").alias("low"))
    keyed = mags.join(low, by) if by else mags.crossJoin(F.broadcast(low))
    sums = keyed.groupBy(*by, F.floor((F.col("magnitude") - F.col("low")) / width).alias("bin")).agg(F.sum("magnitude").alias("s"))
    down = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    above = table.join(sums, [*by, "bin"], "left").select(*by, F.col("bin").alias("from"), F.sum(F.coalesce("s", F.lit(0.0))).over(down).alias("mag_sum"))
    start = start.join(above, [*by, "from"]).withColumn("excess", F.col("mag_sum") / F.col("n") - (F.col("mc") - width / 2)).filter("excess > 0")
    start = start.withColumn("b", F.lit(LOG10_E) / F.col("excess")).withColumn("a", F.log10("n") + F.col("b") * F.col("mc"))
    pairs = start.join(table, by) if by else start.crossJoin(F.broadcast(table))
    pairs = pairs.filter("bin >= from")
    misfit = pairs.groupBy(*by, "from", "mc").agg((F.sum(F.abs(F.col("at_least") - F.pow(F.lit(10.0), F.col("a") - F.col("b") * F.col("edge")))) / F.sum("at_least")).alias("r"))
    passing = misfit.filter(F.col("r") <= limit).groupBy(*by).agg(F.min(F.struct("from", "mc")).alias("p")).select(*by, F.col("p.mc").alias("fitted"))
    curve = completeness_curvature(table, by)
    joined = curve.join(passing, by, "left") if by else curve.join(passing, F.lit(True), "left")
    return joined.select(*by, F.coalesce("fitted", "mc").alias("mc"))


def fit(cat: DataFrame, width: float = 0.1, method: str = "curvature", mc: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Law log10 N = a - b M of each group: mc, n, b, a, sigma_b, r2.

    ``method``: ``curvature``, ``goodness`` or ``given`` (with ``mc``).  Groups with
    fewer than two events or two filled bins above completeness, or without spread,
    give no row.
    """
    by = by or []
    table = bins(cat, width, by)
    if method == "given":
        found = completeness_nearest(table, mc, by).select(*by, "mc")
    elif method == "goodness":
        found = completeness_fit(cat, width, by)
    else:
        found = completeness_curvature(table, by)
    mags = cat.select(*by, "magnitude")
    above = (mags.join(found, by) if by else mags.crossJoin(F.broadcast(found))).filter("magnitude >= mc")
    n = above.groupBy(*by, "mc").agg(F.count("*").alias("n"), F.avg("magnitude").alias("mean"), F.var_samp("magnitude").alias("v"))
    n = n.withColumn("excess", F.col("mean") - (F.col("mc") - width / 2)).filter("n >= 2 and excess > 0")
    n = n.withColumn("b", F.lit(LOG10_E) / F.col("excess")).withColumn("a", F.log10("n") + F.col("b") * F.col("mc"))
    n = n.withColumn("sigma_b", 2.30 * F.col("b") * F.col("b") * F.sqrt(F.col("v") / F.col("n")))
    filled = (table.join(found, by) if by else table.crossJoin(F.broadcast(found))).filter("edge >= mc - 1e-9 and at_least > 0")
    line = filled.groupBy(*by).agg(F.count_if(F.col("events") > 0).alias("filled"), F.regr_r2(F.log10("at_least"), F.col("edge")).alias("r2")).filter("filled >= 2")
    out = n.join(line, by) if by else n.crossJoin(F.broadcast(line))
    return out.select(*by, "mc", "n", "b", "a", "sigma_b", "r2")


def fitted_line(cat: DataFrame, width: float = 0.1, **how) -> DataFrame:
    """Bins with the counts that the fitted law expects."""
    law = fit(cat, width, **how)
    return bins(cat, width).crossJoin(F.broadcast(law.select("a", "b"))).select("bin", "edge", "events", "at_least", F.pow(F.lit(10.0), F.col("a") - F.col("b") * F.col("edge")).alias("fitted"))


def rolling(cat: DataFrame, width: float = 0.1) -> DataFrame:
    """Completeness and b over a window of events sliding in time order.

    Windows hold min(500, max(100, n // 10)) events at steps of a quarter; ``centre_ms``
    is the time of the middle element.  No rows below 200 events or two fits.  Rows are
    numbered in ranges of time, then sent to the few windows they are in.
    """
    n = cat.count()
    if n < 200:
        return fit(cat.limit(0).withColumn("window", F.lit(0)), width, by=["window"]).withColumn("centre_ms", F.lit(0).cast("bigint"))
    size = min(500, max(100, n // 10))
    step = size // 4
    rows = numbered(cat.select("row_idx", "timeMs", "magnitude"), [F.col("timeMs"), F.col("row_idx")], "nth").select("timeMs", "magnitude", "nth")
    last = (n - size) // step
    first = F.greatest(F.lit(0), F.ceil((F.col("nth") - size + 1) / step))
    windows = rows.withColumn("window", F.explode(F.when(first <= F.least(F.floor(F.col("nth") / step), F.lit(last)), F.sequence(first, F.least(F.floor(F.col("nth") / step), F.lit(last))))))
    centre = windows.filter(F.col("nth") == F.col("window") * step + size // 2).select("window", F.col("timeMs").alias("centre_ms"))
    out = fit(windows, width, by=["window"]).join(centre, "window")
    return out
