"""De-duplication, merging and bookkeeping of newly arrived events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.functions import geo


def newest_revision(events: DataFrame, modified: str = "modificationTime", arrival: str = "row_idx", id_col: str = "eventID") -> DataFrame:
    """One row an event: the latest modification, the later arrival on ties; a missing modification is oldest."""
    w = Window.partitionBy(id_col).orderBy(F.col(modified).desc_nulls_last(), F.desc(arrival))
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_existing_wins(stored: DataFrame, arrived: DataFrame, id_col: str = "eventID") -> DataFrame:
    """Stored events and the arrived ones whose id is not stored; revisions are not applied."""
    return stored.unionByName(arrived.join(stored.select(id_col).distinct(), id_col, "left_anti"), allowMissingColumns=True)


def last_write_wins(stored: DataFrame, arrived: DataFrame, id_col: str = "eventID") -> DataFrame:
    """Arrived events and the stored ones that did not arrive again."""
    return arrived.unionByName(stored.join(arrived.select(id_col).distinct(), id_col, "left_anti"), allowMissingColumns=True)


def missing_interval(stored: DataFrame, requested_start_ms: int) -> DataFrame:
    """One row (start_ms, end_ms) of what lies before the stored events; none if nothing is missing."""
    return stored.agg(F.min("timeMs").alias("end_ms")).select(F.lit(requested_start_ms).alias("start_ms"), "end_ms").filter("end_ms is null or end_ms > start_ms")


def feature_status(strict_event_type: bool = False, box: tuple[float, float, float, float] = geo.NETWORK_BOX) -> Column:
    """``invalid`` (a required value is missing), ``skipped`` (outside the box, or of another type) or ``accepted``.

    A missing event type is accepted unless ``strict_event_type``.
    """
    missing = F.lit(False)
    for c in ("eventID", "timeMs", "latitude", "longitude", "magnitude"):
        missing = missing | F.col(c).isNull()
    kind = F.lower(F.trim("eventType"))
    other = (kind.isNotNull() & (kind != "earthquake")) if not strict_event_type else F.coalesce(kind != "earthquake", F.lit(True))
    return F.when(missing, "invalid").when(~geo.in_box(box) | other, "skipped").otherwise("accepted")


def ingest_report(features: DataFrame, **rule) -> DataFrame:
    """Rows per status and how many accepted rows repeat an id."""
    s = features.withColumn("status", feature_status(**rule))
    ids = s.filter("status = 'accepted'").groupBy("eventID").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("status"), "n")
    return s.groupBy("status").agg(F.count("*").alias("n")).unionByName(ids)


def ingest(features: DataFrame, path: str, **rule) -> DataFrame:
    """Store the accepted features under ``path`` and tell of all in the same pass: (status, n).

    ``accepted``, ``skipped`` and ``invalid`` are rows; ``failed`` and ``truncated`` are
    intervals that the source could not read whole (rows with an ``issue``); ``duplicate``
    are accepted rows that repeat an id.
    """
    issue = F.col("issue") if "issue" in features.columns else F.lit(None).cast("string")
    marked = features.withColumn("status", F.coalesce(issue, feature_status(**rule)))
    seen = Observation()
    told = ["accepted", "skipped", "invalid", "failed", "truncated"]
    watched = marked.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in told])
    watched.filter("status = 'accepted'").drop("status", "issue").write.mode("append").parquet(path)
    spark = features.sparkSession
    ids = spark.read.parquet(path).groupBy("eventID").agg((F.count("*") - 1).alias("n"))
    again = ids.agg(F.lit("duplicate").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = seen.get
    return spark.createDataFrame([(s, counts[s]) for s in told], "status string, n long").union(again)


def ingest_warnings(report: DataFrame) -> list[str]:
    """What a user should know of an ingest: failed, partial, truncated, invalid and repeated data."""
    n = {r.status: r.n for r in report.collect()}  # a row a status
    of = lambda s: n.get(s) or 0
    told = [
        (of("failed") and not of("accepted"), "all requests failed"),
        (of("failed") and of("accepted"), f"partial data: {of('failed')} requests failed"),
        (of("truncated"), f"truncated: {of('truncated')} pages were cut at the service's limit"),
        (of("invalid"), f"{of('invalid')} events miss required values"),
        (of("duplicate"), f"{of('duplicate')} events came more than once"),
    ]
    return [text for holds, text in told if holds]


def initial_load(stored: DataFrame, fetch: Callable[[int, int], DataFrame], now_ms: int, days: int = 365) -> DataFrame:
    """The last ``days`` of events: from the store if it reaches back that far, else fetched and merged with it."""
    start = now_ms - days * 86_400_000
    if missing_interval(stored, start).isEmpty():
        return stored.filter(F.col("timeMs").between(start, now_ms))
    return merge_existing_wins(stored, fetch(start, now_ms)).filter(F.col("timeMs").between(start, now_ms))
