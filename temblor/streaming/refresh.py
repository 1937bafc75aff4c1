"""Continuous refresh of a stored catalogue, and windowed counts of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from temblor.operators.incremental import newest_revision


def append_unseen(stream: DataFrame, path: str, checkpoint: str, id_col: str = "eventID", once: bool = True) -> StreamingQuery:
    """Append a stream's events to the Parquet store at ``path``, each id once, existing ones untouched.

    Every batch keeps the newest revision of an id and drops ids that the store has; a
    batch that is run again after a failure finds its rows stored and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = newest_revision(batch, arrival=id_col) if "modificationTime" in batch.columns else batch.dropDuplicates([id_col])
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(id_col), id_col, "left_anti")
        fresh.select(*batch.columns).write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str = "time", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and largest magnitude per tumbling window; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("events"), F.max("magnitude").alias("max_magnitude")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "max_magnitude")


def swarms(stream: DataFrame, keys: list[str], gap: str = "6 hours", late: str = "1 hour", time: str = "time") -> DataFrame:
    """Sessions of events of each key without a longer pause than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("events"), F.max("magnitude").alias("max_magnitude")).select("session_window.start", "session_window.end", *keys, "events", "max_magnitude")
