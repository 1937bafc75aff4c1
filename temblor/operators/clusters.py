"""Summaries and outputs of labelled catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.functions import scalar
from temblor.functions.scalar import DAY_MS
from temblor.scratch import written


def with_sizes(labelled: DataFrame) -> DataFrame:
    """Add cluster_label (``noise`` or ``cluster_k``) and cluster_size (0 for noise)."""
    sizes = labelled.filter("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    out = labelled.join(sizes, "cluster_id", "left")
    name = F.when(F.col("cluster_id") < 0, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")))
    return out.withColumn("cluster_label", name).withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0)))


def result_summary(labelled: DataFrame) -> DataFrame:
    """One row: events, clusters, clustered and noise events and percent, smallest, largest and mean size."""
    sizes = labelled.groupBy("cluster_id").agg(F.count("*").alias("n"))
    real = F.col("cluster_id") >= 0
    n, c = F.sum("n"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0))
    return sizes.agg(
        n.alias("events"),
        F.count_if(real).alias("clusters"),
        c.alias("clustered"),
        (n - c).alias("noise"),
        (100.0 * c / n).alias("cluster_percent"),
        (100.0 - 100.0 * c / n).alias("noise_percent"),
        F.min(F.when(real, F.col("n"))).alias("smallest"),
        F.max(F.when(real, F.col("n"))).alias("largest"),
        F.avg(F.when(real, F.col("n"))).alias("mean_size"),
    )


def _largest_first(magnitude: str = "magnitude") -> Column:
    """Smaller for larger events, earlier ones on ties, then by row; ``m`` and ``t`` give magnitude and time."""
    return F.struct((-F.col(magnitude)).alias("k"), F.col("timeMs").alias("t"), F.col("row_idx").alias("i"), F.col(magnitude).alias("m"))


def equivalent_events(cat: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a cluster: size, centroid, summed moment and its magnitude, largest and second largest event,
    duration, percent of events before the largest, time and magnitude differences of the two."""
    rows = cat.join(labels.filter("cluster_id >= 0").select("row_idx", "cluster_id"), "row_idx")
    rows = rows.withColumn("place", _largest_first())
    one = rows.groupBy("cluster_id").agg(
        F.count("*").alias("events"),
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
        F.avg("depth").alias("depth"),
        F.sum(scalar.cluster_moment(F.col("magnitude"))).alias("moment"),
        F.min("timeMs").alias("first_ms"),
        F.max("timeMs").alias("last_ms"),
        F.min("place").alias("top"),
    )
    # A second aggregate instead of a window, so that tasks share a cluster of any size.
    one = written(one.select("*", F.col("top.m").alias("largest"), F.col("top.t").alias("largest_ms")), "clusters")
    rest = rows.join(one.select("cluster_id", "top"), "cluster_id").groupBy("cluster_id").agg(
        F.min(F.when(F.col("place") > F.col("top"), F.col("place"))).alias("next"),
        F.count_if(F.col("timeMs") < F.col("top.t")).alias("before"),
    )
    out = one.join(rest.select("cluster_id", "before", F.col("next.m").alias("second"), F.col("next.t").alias("second_ms")), "cluster_id")
    days = F.greatest(F.lit(0.001), (F.col("last_ms") - F.col("first_ms")) / DAY_MS)
    return out.select("cluster_id", "events", "latitude", "longitude", "depth", "moment", scalar.equivalent_magnitude(F.col("moment")).alias("magnitude"), "largest", "largest_ms", "second", days.alias("days"), (100.0 * F.col("before") / F.col("events")).alias("foreshock_percent"), ((F.col("second_ms") - F.col("largest_ms")) / DAY_MS).alias("dt_days"), (F.col("largest") - F.col("second")).alias("dm"))


def declustered_catalogue(cat: DataFrame, labels: DataFrame) -> DataFrame:
    """Single events and one equivalent event for each cluster, at the time of its largest."""
    singles = cat.join(labels.filter("cluster_id < 0").select("row_idx"), "row_idx").select(F.lit(-1).alias("cluster_id"), "timeMs", "latitude", "longitude", "depth", "magnitude")
    eq = equivalent_events(cat, labels).select("cluster_id", F.col("largest_ms").alias("timeMs"), "latitude", "longitude", "depth", "magnitude")
    return singles.unionByName(eq)


def annotated(cat: DataFrame, labels: DataFrame) -> DataFrame:
    """All events with a letter for their cluster, ``+`` for none."""
    letter = F.when(F.col("cluster_id") < 0, "+").otherwise(F.char(F.lit(65) + F.col("cluster_id") % 26))
    return cat.join(labels.select("row_idx", "cluster_id"), "row_idx").withColumn("letter", letter)


def marked(cat: DataFrame, labels: DataFrame) -> DataFrame:
    """Clustered events with magnitude to 0.1 and marks for the first largest and the first event."""
    rows = cat.join(labels.filter("cluster_id >= 0").select("row_idx", "cluster_id"), "row_idx").withColumn("magnitude", F.round("magnitude", 1))
    ends = rows.groupBy("cluster_id").agg(F.min_by("row_idx", _largest_first()).alias("big"), F.min_by("row_idx", F.struct("timeMs", "row_idx")).alias("first"))
    marked_ = rows.join(written(ends, "ends"), "cluster_id")
    return marked_.withColumn("is_largest", (F.col("row_idx") == F.col("big")).cast("int")).withColumn("is_first", (F.col("row_idx") == F.col("first")).cast("int")).drop("big", "first")
