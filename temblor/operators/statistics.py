"""Temporal statistics, histograms and groupers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, NumericType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from temblor.functions import scalar
from temblor.functions.scalar import DAY_MS
from temblor.operators.components import running
from temblor.scratch import written


def _all() -> WindowSpec:
    """The window over a table of few rows; made when called, as it needs a session."""
    return Window.partitionBy(F.lit(1))


def summary(cat: DataFrame) -> DataFrame:
    """One row: events, maximum magnitude (0 at least), mean depth, depth range."""
    return cat.agg(F.count("*").alias("events"), F.greatest(F.lit(0.0), F.coalesce(F.max("magnitude"), F.lit(0.0))).alias("max_magnitude"), F.avg("depth").alias("mean_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def counts_by(cat: DataFrame, key: Column, name: str) -> DataFrame:
    return cat.groupBy(key.alias(name)).agg(F.count("*").alias("events"))


def enhancement_stats(cat: DataFrame) -> DataFrame:
    """One row: sorted magnitude bins, year range, rows per depth category."""
    depth = scalar.depth_category(F.col("depth"))
    year = F.year(F.timestamp_millis("timeMs"))
    return cat.agg(
        F.sort_array(F.collect_set(scalar.magnitude_bin(F.col("magnitude")))).alias("magnitude_bins"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        *[F.count_if(depth == c).alias(c) for c in ("shallow", "intermediate", "deep")],
    )


def daily_counts(cat: DataFrame, max_gap_days: float = 1825, moving: int = 7) -> DataFrame:
    """Events per UTC day with a trailing mean over ``moving`` rows.

    Days without events are filled in only if the catalogue spans fewer than
    ``max_gap_days`` days (1825 for statistics, 7300 for the time view); otherwise the
    mean runs over the days that have events.  The first ``moving`` - 1 means are null.
    """
    day = F.to_date(F.timestamp_millis("timeMs"))
    counted = cat.groupBy(day.alias("day")).agg(F.count("*").alias("events"), F.min("timeMs").alias("lo"), F.max("timeMs").alias("hi"))
    span = counted.agg(F.min("day").alias("a"), F.max("day").alias("b"), ((F.max("hi") - F.min("lo")) / DAY_MS).alias("days"))
    spine = span.filter((F.col("days") < max_gap_days) & F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("day"))
    filled = counted.select("day", "events").union(spine.select("day", F.lit(0).cast("bigint"))).groupBy("day").agg(F.sum("events").alias("events"))
    order = _all().orderBy("day")  # one row a day
    mean = F.avg("events").over(order.rowsBetween(1 - moving, 0))
    return filled.select("day", "events", F.when(F.row_number().over(order) >= moving, mean).alias("moving_mean"))


def ordered_gaps(cat: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows with the time to the next row of the same group before it (``gap_ms``), null for the first.

    Rows are put in ranges of group and time and looked at once, in order, where they
    lie; only the first row of a range needs the last one of the range before, so a
    group of any size is shared by tasks and nothing is shuffled twice.
    """
    keys = by or []
    order = [F.col(c) for c in [*keys, "timeMs", "row_idx"]]
    spread = cat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    columns = spread.columns

    def lag(batches):
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = {c: batch.column(columns.index(c)) for c in [*keys, "timeMs"]}
            nothing = {c: pa.nulls(1, a.type) for c, a in at.items()}
            prior = {c: pa.concat_arrays([(last or nothing)[c], a.slice(0, n - 1)]) for c, a in at.items()}
            gap = pc.subtract(at["timeMs"], prior["timeMs"])
            for c in keys:
                same = pc.or_(pc.fill_null(pc.equal(at[c], prior[c]), False), pc.and_(pc.is_null(at[c]), pc.is_null(prior[c])))
                gap = pc.if_else(same, gap, pa.scalar(None, gap.type))
            opens = np.zeros(n, bool)
            opens[0] = last is None
            last = {c: a.slice(n - 1, 1) for c, a in at.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, gap.cast(pa.int64()), pa.array(opens)], names=[*columns, "gap_ms", "_opens"])

    kinds = StructType([*spread.schema.fields, StructField("gap_ms", LongType()), StructField("_opens", BooleanType())])
    rows = written(spread.mapInArrow(lag, kinds).withColumn("_p", F.shiftright("_m", 33)), "ordered")
    this = F.struct(*keys, "timeMs")
    last = rows.groupBy("_p").agg(F.max_by(this, "_m").alias("_last"))
    last = last.select("_p", F.lag("_last").over(_all().orderBy("_p")).alias("_last"))  # one row a range
    across = F.col("timeMs") - F.col("_last.timeMs")
    for c in keys:
        across = F.when(F.col(c).eqNullSafe(F.col(f"_last.{c}")), across)
    return rows.join(F.broadcast(last), "_p").select(*cat.columns, F.when(F.col("_opens"), across).otherwise(F.col("gap_ms")).alias("gap_ms"))


def gap_values(cat: DataFrame) -> DataFrame:
    """Distinct gaps in hours with their number of occurrences."""
    return ordered_gaps(cat).filter("gap_ms is not null").groupBy("gap_ms").agg(F.count("*").alias("n")).withColumn("hours", F.col("gap_ms") / 3600000.0)


def _at_rank(counted: DataFrame, rank: Column, n: Column) -> Column:
    """Smallest value whose running count exceeds a 0-based rank."""
    return F.min(F.when(F.col("upto") > rank, F.col("hours")))


def inter_event_stats(cat: DataFrame) -> DataFrame:
    """One row of gap statistics in hours: n, mean, upper median, min, max, population deviation, events a day, variation.

    No row for fewer than two events.  The median is the element at floor(n/2).
    """
    values = gap_values(cat)
    ranked = running(values, [F.col("hours")], {"upto": F.col("n")})
    total = values.agg(F.sum("n").alias("total"), F.sum(F.col("hours") * F.col("n")).alias("s"))
    mean = F.col("s") / F.col("total")
    joined = ranked.crossJoin(F.broadcast(total))  # one row
    out = joined.agg(
        F.max("total").alias("n"),
        F.max(mean).alias("mean_hours"),
        _at_rank(joined, F.floor(F.col("total") / 2), F.col("total")).alias("median_hours"),
        F.min("hours").alias("min_hours"),
        F.max("hours").alias("max_hours"),
        F.sqrt(F.sum(F.col("n") * (F.col("hours") - mean) * (F.col("hours") - mean)) / F.max("total")).alias("std_hours"),
    )
    return out.filter("n is not null").withColumn("events_per_day", 24.0 / F.col("mean_hours")).withColumn("variation", F.col("std_hours") / F.col("mean_hours"))


def inter_event_histogram(cat: DataFrame, bins: int = 25) -> DataFrame:
    """Gap histogram up to max(95th percentile, half the mean), with the counts of a Poisson process.

    No rows for fewer than five gaps or a mean of 0.
    """
    values = gap_values(cat)
    total = values.agg(F.sum("n").alias("total"), F.sum(F.col("hours") * F.col("n")).alias("s"))
    p95 = running(values, [F.col("hours")], {"upto": F.col("n")}).crossJoin(F.broadcast(total)).agg(_at_rank(values, F.floor(0.95 * (F.col("total") - 1)), F.col("total")).alias("p95"), F.max("total").alias("total"), F.max(F.col("s") / F.col("total")).alias("mean"))
    top = p95.filter("total >= 5 and mean > 0").select("total", "mean", F.greatest("p95", F.col("mean") / 2).alias("top"))
    top = top.withColumn("top", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).withColumn("width", F.col("top") / bins)
    inside = values.crossJoin(F.broadcast(top)).filter("hours <= top").groupBy(F.least(F.floor(F.col("hours") / F.col("width")), F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("events"))
    n = inside.agg(F.sum("events").alias("in_range"))
    spine = top.crossJoin(F.broadcast(n)).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo, hi = F.col("bin") * F.col("width"), (F.col("bin") + 1) * F.col("width")
    expected = F.col("in_range") * (F.exp(-lo / F.col("mean")) - F.exp(-hi / F.col("mean")))
    return spine.join(inside, "bin", "left").select(F.col("bin").cast("bigint").alias("bin"), lo.alias("lo"), hi.alias("hi"), F.coalesce("events", F.lit(0)).alias("events"), expected.alias("expected"))


def cumulative(cat: DataFrame) -> DataFrame:
    """Running number of events and running moment in time order."""
    out = running(cat, [F.col("timeMs"), F.col("row_idx")], {"events": F.lit(1), "moment": scalar.moment_nm(F.col("magnitude"))})
    return out.select("row_idx", "timeMs", "magnitude", "events", "moment")


def magnitude_histogram(cat: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, tested against the bins' own edges; the last one is closed."""
    return histogram(cat, "magnitude", bins).select("bin", "lo", "hi", "events")


def field(cat: DataFrame, name: str) -> DataFrame:
    """The catalogue with a numeric column ``v``: a column of it, or ``time``, ``hour`` or ``gap`` (minutes)."""
    if name == "hour":
        return cat.withColumn("v", F.hour(F.timestamp_millis("timeMs")).cast("double"))
    if name == "time":
        return cat.withColumn("v", F.col("timeMs").cast("double"))
    if name == "gap":
        return ordered_gaps(cat).withColumn("v", F.col("gap_ms") / 60000.0)
    return cat.withColumn("v", F.col(name).cast("double"))


def histogram(cat: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """Histogram of a field: bin, lo, hi, events, density, reverse cumulative count and share, log of the count.

    ``hour`` has 24 bins of one hour from the smallest hour on.  Empty input: no rows.
    """
    rows = field(cat, name).filter("v is not null and not isnan(v)")
    bins = 24 if name == "hour" else bins
    span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("total")).filter("total > 0")
    width = F.lit(1.0) if name == "hour" else F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / bins).otherwise(1.0)
    span = span.withColumn("width", width)
    at = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1))
    counted = rows.select("v").crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("events"))
    spine = span.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    full = spine.join(counted, "bin", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    down = _all().orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    full = full.withColumn("at_least", F.sum("events").over(down))
    return full.select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("lo"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
        "events",
        (F.col("events") / (F.col("total") * F.col("width"))).alias("density"),
        "at_least",
        (F.col("at_least") / F.col("total")).alias("survival"),
        F.when(F.col("events") > 0, F.log10("events")).alias("log10_events"),
    )


def top_values(cat: DataFrame, column: str, keep: int = 7, by_value: int = 8) -> DataFrame:
    """Rows with ``grp``: the ``keep`` most frequent values (ties to the smaller) and 'Other'.

    A numeric column of at most ``by_value`` distinct values is grouped by all of them.
    """
    if isinstance(cat.schema[column].dataType, NumericType) and cat.select(column).distinct().limit(by_value + 1).count() <= by_value:
        return cat.withColumn("grp", F.coalesce(F.col(column).cast("string"), F.lit("Unknown")))
    counted = cat.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("grp")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "grp").limit(keep).select("grp", F.lit(True).alias("kept"))
    named = cat.withColumn("_g", F.coalesce(F.col(column).cast("string"), F.lit("Unknown")))
    joined = named.join(F.broadcast(top), named["_g"] == top["grp"], "left")  # ``keep`` rows
    return joined.withColumn("grp", F.when(F.col("kept"), F.col("_g")).otherwise("Other")).drop("_g", "kept")


def quantiles(rows: DataFrame, points: list[float], value: str = "v") -> list[float]:
    """Quantiles that interpolate linearly between order statistics; empty without values.

    Distinct values are counted and their counts run up in ranges; only the order
    statistics next to each point come to the driver.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ran = running(counted, [F.col("v")], {"upto": F.col("n")})
    total = ran.agg(F.max("upto")).first()[0]
    if not total:
        return []
    at = [p * (total - 1) for p in points]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found = dict(zip(ranks, ran.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first(), strict=True))
    return [found[lo] if (lo := math.floor(x)) == x else (lo + 1 - x) * found[lo] + (x - lo) * found[lo + 1] for x in at]


def quantile_groups(cat: DataFrame, name: str, groups: int = 5) -> DataFrame:
    """Rows with ``grp``, the index of their quantile interval; equal edges collapse, the last interval is closed.

    Edges interpolate linearly between order statistics.
    """
    rows = field(cat, name).filter("v is not null")
    edges = quantiles(rows, [i / groups for i in range(groups + 1)])
    if not edges:
        return rows.withColumn("grp", F.lit(0))
    kept = [edges[0]] + [b for a, b in zip(edges, edges[1:], strict=False) if b > a]
    group = F.lit(max(0, len(kept) - 2))
    for i in range(len(kept) - 3, -1, -1):
        group = F.when(F.col("v") < kept[i + 1], F.lit(i)).otherwise(group)
    return rows.withColumn("grp", group)


def quantile_labels(edges: list[float]) -> list[str]:
    """Texts of intervals, with decimals by their span."""
    span = edges[-1] - edges[0]
    digits = 2 if span < 1 else 1 if span < 100 else 0
    return [f"{a:.{digits}f}–{b:.{digits}f}" for a, b in zip(edges, edges[1:], strict=False)]


def nearest_rank_stats(metrics: DataFrame, value: str, by: str, success: str | None = None) -> DataFrame:
    """Per name: count, mean, min, max, nearest-rank 50th, 95th and 99th percentiles, success rate.

    Counts of distinct values run up in ranges of name and value, so one name may hold
    nearly all rows.  Null values count as rows only; the null name is a name.
    """
    ok = F.avg(F.col(success).cast("double")) if success else F.lit(1.0)
    stats = metrics.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), ok.alias("success_rate"))
    counted = metrics.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ran = running(counted, [F.col("_by"), F.col("_v")], {"_upto": F.col("_c")})
    group = ran.groupBy("_by").agg(F.min(F.col("_upto") - F.col("_c")).alias("_b"), F.sum("_c").alias("_n")).withColumnRenamed("_by", "_g")
    placed = ran.join(group, F.col("_by").eqNullSafe(F.col("_g"))).withColumn("_rank", F.col("_upto") - F.col("_b"))
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = placed.groupBy("_by").agg(*[F.min(F.when(F.col("_rank") >= F.ceil(F.lit(p) * F.col("_n")), F.col("_v"))).alias(n) for n, p in ranks.items()])
    return stats.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "low", "high", *ranks, "success_rate")


def axis_ranges(cat: DataFrame, pad: float = 0.05, depth_step: float = 10.0) -> DataFrame:
    """One row: depth range rounded out to steps, magnitude range padded by a share."""
    span = F.max("magnitude") - F.min("magnitude")
    return cat.agg((F.floor(F.min("depth") / depth_step) * depth_step).alias("depth_lo"), (F.ceil(F.max("depth") / depth_step) * depth_step).alias("depth_hi"), (F.min("magnitude") - span * pad).alias("mag_lo"), (F.max("magnitude") + span * pad).alias("mag_hi"))
