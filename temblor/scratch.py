"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, removed when the session ends.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(scratch_path, "own"):
            scratch_path.own = "file://" + tempfile.mkdtemp(prefix="temblor-")
        root = scratch_path.own
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/catalogue-{uuid.uuid4().hex}/{name}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place.getParent())
    return place.toString()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table.

    Cuts the lineage of iterative plans; survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place.getParent(), True)
