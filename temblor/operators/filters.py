"""Row filters; all but the polygon reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.functions import geo, scalar
from temblor.functions.scalar import DAY_MS


def epoch_ms(day: str | date | datetime, end_of_day: bool = False) -> int:
    """Epoch milliseconds of a UTC date or time; ``end_of_day`` takes a date's last millisecond."""
    at = datetime.fromisoformat(day) if isinstance(day, str) else day
    if not isinstance(at, datetime):
        at = datetime(at.year, at.month, at.day)
    at = at.replace(tzinfo=at.tzinfo or timezone.utc)
    if end_of_day:
        at = at.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
    return int(at.timestamp() * 1000) - end_of_day


@dataclass(frozen=True)
class CatalogueFilter:
    """Inclusive bounds; None leaves a field open.  The end date counts to its last millisecond."""

    min_magnitude: float | None = None
    max_magnitude: float | None = None
    min_depth: float | None = None
    max_depth: float | None = None
    depth_category: str | None = None
    magnitude_bin: int | None = None
    start: str | None = None
    end: str | None = None
    whole_end_day: bool = True
    polygon: tuple[tuple[float, float], ...] | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for name, low, high in (("magnitude", self.min_magnitude, self.max_magnitude), ("depth", self.min_depth, self.max_depth)):
            if low is not None:
                out &= F.col(name) >= low
            if high is not None:
                out &= F.col(name) <= high
        if self.depth_category:
            edges = {"shallow": F.col("depth") <= 70, "intermediate": (F.col("depth") > 70) & (F.col("depth") <= 300), "deep": F.col("depth") > 300}
            out &= edges[self.depth_category]
        if self.magnitude_bin is not None:
            out &= (F.col("magnitude") >= self.magnitude_bin) & (F.col("magnitude") < self.magnitude_bin + 1)
        if self.start:
            out &= F.col("timeMs") >= epoch_ms(self.start)
        if self.end:
            out &= F.col("timeMs") <= epoch_ms(self.end, self.whole_end_day)
        if self.polygon:
            out &= geo.in_polygon(list(self.polygon))
        return out


def apply(cat: DataFrame, rule: CatalogueFilter, time_col: str | None = None) -> DataFrame:
    """Rows that meet the rule.

    Bounds on a computed ``timeMs`` stop short of the scan.  ``time_col`` names a timestamp
    of the same instant, null only where ``timeMs`` is; it gets them too, a millisecond wider.
    """
    kept = cat.filter(rule.condition())
    if time_col and rule.start:
        kept = kept.filter(F.col(time_col) >= datetime.fromtimestamp((epoch_ms(rule.start) - 1) / 1000, timezone.utc))
    if time_col and rule.end:
        kept = kept.filter(F.col(time_col) <= datetime.fromtimestamp((epoch_ms(rule.end, rule.whole_end_day) + 1) / 1000, timezone.utc))
    return kept


def last_days(cat: DataFrame, days: float, now_ms: int) -> DataFrame:
    return cat.filter(F.col("timeMs") >= now_ms - int(days * DAY_MS))


def without_noise(labelled: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Drop noise; a missing label counts as noise."""
    return labelled.filter(F.coalesce(label, F.lit(-1)) != -1)


def one_cluster(labelled: DataFrame, cluster: int, label: str = "cluster_id") -> DataFrame:
    return labelled.filter(F.col(label) == cluster)


def is_whole_cluster(selection: DataFrame, labelled: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Per cluster of a selection: selected rows, cluster size, and whether they are all of it."""
    a = selection.groupBy(label).agg(F.count("*").alias("selected"))
    b = labelled.groupBy(label).agg(F.count("*").alias("size"))
    return a.join(b, label).withColumn("whole", F.col("selected") == F.col("size"))


def find_event(cat: DataFrame, time_ms: int, magnitude: float) -> DataFrame:
    """The first row within a minute and half a magnitude of a known event."""
    near = cat.filter(F.col("timeMs").between(time_ms - 59_999, time_ms + 59_999) & (F.abs(F.col("magnitude") - magnitude) < 0.5))
    return near.orderBy("row_idx").limit(1)


def data_range(cat: DataFrame) -> DataFrame:
    """First and last UTC date of the catalogue."""
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    return cat.agg(day(F.min("timeMs")).alias("first_day"), day(F.max("timeMs")).alias("last_day"))


def enriched(cat: DataFrame, fix_inverted_bounds: bool = False) -> DataFrame:
    """Add magBin, depthCategory, year and a filled locality."""
    blank = F.col("locality").isNull() | (F.trim("locality") == "") | (F.col("locality") == "Unknown Location")
    return (
        cat.withColumn("magBin", scalar.magnitude_bin(F.col("magnitude")))
        .withColumn("depthCategory", scalar.depth_category(F.col("depth")))
        .withColumn("year", F.year(F.timestamp_millis("timeMs")))
        .withColumn("_near", F.when(blank, geo.nearest_place(F.col("latitude"), F.col("longitude"))))
        .withColumn("locality", F.when(blank, geo.locality_name(F.col("latitude"), F.col("longitude"), fix_inverted_bounds, F.col("_near"))).otherwise(F.col("locality")))
        .drop("_near")
    )


def around_event(cat: DataFrame, latitude: float, longitude: float, time_ms: int, radius_km: float, days_before: float = 30, days_after: float = 365, degree_box: bool = False) -> DataFrame:
    """Events near one mainshock with their distance and days since it.

    ``degree_box`` also asks for radius/111 degrees in either coordinate, a faster
    prefilter that loses true neighbours in longitude away from the equator.
    """
    out = cat.filter(F.col("timeMs").between(time_ms - int(days_before * DAY_MS), time_ms + int(days_after * DAY_MS)))
    reach = radius_km / 111
    if degree_box:
        out = out.filter(F.col("longitude").between(longitude - reach, longitude + reach))
    out = out.filter(F.col("latitude").between(latitude - reach * 1.01, latitude + reach * 1.01))
    out = out.withColumn("distance_km", geo.haversine_km("latitude", "longitude", latitude, longitude))
    return out.filter(F.col("distance_km") <= radius_km).withColumn("days", scalar.days_since(F.col("timeMs"), time_ms))


def sequence_radius_km(magnitude: float) -> int:
    """Rounded radius of a sequence view, 50 km at least."""
    return int(max(50.0, 10 ** (0.59 * magnitude - 2.44)) + 0.5)


def auto_mainshock(cat: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Largest event of each group, the earliest on ties."""
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("magnitude"), "timeMs", "row_idx")
    if not by:
        return cat.orderBy(F.desc("magnitude"), "timeMs", "row_idx").limit(1)
    return cat.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
