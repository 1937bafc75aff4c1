"""Shared helpers: scratch tables in the cluster's shared folder, text buffers, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(scratch_root, "own"):
        scratch_root.own = "file://" + tempfile.mkdtemp(prefix="temblor-")
    return scratch_root.own


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    This cuts the lineage: a lost executor costs a re-read of the file, never a
    recomputation, and the copy is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/temblor-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    fs, p = _path(df.sparkSession, df.scratch_path)
    fs.delete(p.getParent(), True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on in this session, Arrow batches of at most ``rows`` rows go to Python.

    Texts may be long.  Of a batch both sides hold copies, and the JVM keeps the buffers
    of its largest ones, so batches of 10,000 texts cost executors some hundred MB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_slices(column: pa.Array, budget: int = 2_000_000):
    """Yield ``(first_row, bytes, offsets)`` over runs of rows of about ``budget`` bytes.

    ``bytes`` is the UTF-8 of the run's texts, ``offsets`` has one entry more than
    the run has rows; null texts are empty.  A run always has at least one row, so
    a text longer than the budget is handled alone and never cut.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_runs(column: pa.Array, budget: int = 2_000_000):
    """Like :func:`text_slices`, but yield ``(first_row, list of str or None)``."""
    lengths = pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    n, first = len(column), 0
    while first < n:
        base = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, base + budget, "right")), first + 1), n)
        yield first, column.slice(first, last - first).to_pylist()
        first = last


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply) on unsigned integers."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n."""
    if len(_powers["up"]) < n:
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    up = powers(len(data) + 1)[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each byte span [start, end)."""
    down = powers(len(prefix))[1]
    h = (prefix[end] - prefix[start]) * down[start]
    return mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Component of every node of an undirected edge table: rows (node, component).

    ``component`` is the smallest node reachable.  Alternating large-star and
    small-star steps; every step is a grouped minimum and an equi-join, so hubs
    are pre-aggregated and no neighbourhood is gathered anywhere.  Each step is
    written to the shared folder.  Empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")

    def step(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(least, "u")
        if large:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return r.n, r.x

    now = materialize(pairs.distinct(), "edges")
    before = mark(now)
    while before[0]:
        nxt = materialize(step(step(now, True), False), "edges")
        after = mark(nxt)
        discard(now)
        now = nxt
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
