"""Exports: each is written by Spark, in parallel, as a folder of part files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "time,latitude,longitude,depth,magnitude,locality,mmi"


def _time(df: DataFrame) -> Column:
    return F.date_format(F.timestamp_millis("timeMs"), "dd/MM/yyyy HH:mm:ss")


def write_lines(lines: DataFrame, path: str, before: list[str] = (), after: list[str] = (), between: str = "") -> None:
    """Write the text lines (``value``) as a folder of files, each between other lines.

    ``between`` ends every line but a file's last.  A task writes the lines it has, in
    the order it has them; a task without lines writes nothing.
    """

    def file(batches):
        held = None
        for batch in batches:
            values = batch.column(0).to_pylist()
            if not values:
                continue
            lines = list(before) if held is None else [held + between]
            held = values.pop()
            yield pa.RecordBatch.from_pydict({"value": lines + [v + between for v in values]}, schema=pa.schema([("value", pa.string())]))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": [held, *after]}, schema=pa.schema([("value", pa.string())]))

    lines.select("value").mapInArrow(file, "value string").write.mode("overwrite").text(path)


def csv_lines(cat: DataFrame) -> DataFrame:
    """One text line an event; the locality is quoted, its own quotes are not escaped."""
    mmi = F.col("mmi").cast("string") if "mmi" in cat.columns else F.lit(None).cast("string")
    text = [_time(cat), *[F.col(c).cast("string") for c in ("latitude", "longitude", "depth", "magnitude")], F.concat(F.lit('"'), F.col("locality"), F.lit('"')), mmi]
    return cat.select(F.concat_ws(",", *[F.coalesce(t, F.lit("")) for t in text]).alias("value"))


def write_csv(cat: DataFrame, path: str) -> None:
    """CSV files, each with the header."""
    write_lines(csv_lines(cat), path, [HEADER])


def write_json(cat: DataFrame, path: str) -> None:
    """One JSON object a line."""
    cat.write.mode("overwrite").json(path)


def geojson_features(cat: DataFrame) -> DataFrame:
    """One GeoJSON feature a line; height is minus depth."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", -F.col("depth")).alias("coordinates"))
    props = F.struct(*[c for c in cat.columns if c not in ("longitude", "latitude", "row_idx")])
    return cat.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), props.alias("properties"))).alias("value"))


def write_geojson(cat: DataFrame, path: str) -> None:
    """Newline-delimited features, the form that scales; a reader joins them to a collection."""
    geojson_features(cat).write.mode("overwrite").text(path)


def metadata(cat: DataFrame) -> DataFrame:
    """One row: count and ranges of an export."""
    return cat.agg(F.count("*").alias("events"), *[f(c).alias(f"{n}_{c}") for c in ("timeMs", "latitude", "longitude", "depth", "magnitude") for n, f in (("min", F.min), ("max", F.max))])


def write_bundle(cat: DataFrame, path: str) -> None:
    """CSV, JSON, GeoJSON and metadata side by side in one folder."""
    write_csv(cat, f"{path}/csv")
    write_json(cat, f"{path}/json")
    write_geojson(cat, f"{path}/geojson")
    metadata(cat).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_analysis(labelled: DataFrame, path: str, settings: dict[str, str]) -> None:
    """Escaped CSV lines of events with their clusters; each file has comment lines of settings and a header."""
    cols = ["eventID", "timeMs", "latitude", "longitude", "depth", "magnitude", "locality", "cluster_id", "cluster_label", "cluster_size"]
    have = [c for c in cols if c in labelled.columns]
    cell = lambda c: F.when(F.col(c).cast("string").rlike('[",\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    lines = labelled.select(F.concat_ws(",", *[cell(c) for c in have]).alias("value"))
    write_lines(lines, path, [*[f"# {k}: {v}" for k, v in settings.items()], ",".join(have)])


def analysis_json(labelled: DataFrame, summary: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Events as JSON lines, each with its cluster, after one line of settings and summary (percents to 2 places)."""
    rounded = summary.select(*[F.round(c, 2).alias(c) if "percent" in c else F.col(c) for c in summary.columns])
    extra = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]) if settings else F.create_map()
    top = rounded.select(F.to_json(F.struct(extra.alias("parameters"), F.struct(*rounded.columns).alias("clustering_metadata"))).alias("value"))
    return top.unionByName(labelled.select(F.to_json(F.struct(*labelled.columns)).alias("value")))


def store(cat: DataFrame, path: str, min_magnitude: float) -> None:
    """Put a catalogue under its minimum magnitude; what was there is replaced."""
    cat.write.mode("overwrite").parquet(f"{path}/min_magnitude={min_magnitude}")


def stored(spark, path: str, min_magnitude: float) -> DataFrame:
    return spark.read.parquet(f"{path}/min_magnitude={min_magnitude}")
