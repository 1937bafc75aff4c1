"""Operator 9, sharding by fixed virtual slots.

Records are hashed into a few thousand slots, bytes are summed per slot, and a
versioned slot-to-shard map says where each slot lives.  Rebalancing edits the map
and moves whole slots; no record is hashed again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from temblor.llm.common import materialize

MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType())])


def first_map(loads: dict[int, tuple[int, int]], n_slots: int, n_shards: int) -> list[tuple]:
    """Version 1: the heaviest slot first, each to the shard that holds least."""
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for slot in sorted(range(n_slots), key=lambda s: (-loads.get(s, (0, 0))[0], s)):
        held, shard = heapq.heappop(heap)
        size, rows = loads.get(slot, (0, 0))
        heapq.heappush(heap, (held + size, shard))
        out.append((1, slot, shard, size, rows))
    return sorted(out, key=lambda r: r[1])


def rebalanced_map(old: list[tuple], loads: dict[int, tuple[int, int]], n_shards: int, tolerance: float = 0.02) -> list[tuple]:
    """The next version of a map under new loads: move as few slots as it takes.

    Slots of shards that no longer exist move first; then slots leave shards above
    ``mean * (1 + tolerance)`` for the lightest shard, the largest that fits first.
    """
    version = max(r[0] for r in old) + 1
    place = {r[1]: r[2] for r in old}
    size = {s: loads.get(s, (0, 0))[0] for s in place}
    held = [0] * n_shards
    lost = []
    for s, shard in place.items():
        if shard < n_shards:
            held[shard] += size[s]
        else:
            lost.append(s)
    for s in sorted(lost, key=lambda s: (-size[s], s)):
        to = min(range(n_shards), key=lambda k: (held[k], k))
        place[s] = to
        held[to] += size[s]
    most = sum(held) / n_shards * (1 + tolerance)
    for shard in range(n_shards):
        for s in sorted((s for s in place if place[s] == shard), key=lambda s: (-size[s], s)):
            if held[shard] <= most:
                break
            to = min(range(n_shards), key=lambda k: (held[k], k))
            if size[s] and held[to] + size[s] <= most:
                place[s] = to
                held[to] += size[s]
                held[shard] -= size[s]
    return [(version, s, place[s], *loads.get(s, (0, 0))) for s in sorted(place)]


def write_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append one version of the map to the table at ``path``."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """A version of the stored map, the newest if none is named; as many rows as slots."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return [tuple(r) for r in table.filter(F.col("version") == version).orderBy("slot").collect()]


def slotted(docs: DataFrame, n_slots: int = 4096, n_shards: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Narrow rows (row, doc_id, size, text_crc32, virtual_slot) of every document.

    The slot is a hash of the text, so equal texts share a slot and a shard, except
    texts that together hold more than 1/n_shards of all bytes and so fit no shard: at
    most n_shards such texts exist, and their rows are spread over all slots by a hash
    of their id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = rows.groupBy("key").agg(F.sum("size").alias("held"), F.count("*").alias("n")).filter((F.col("held") > total / n_shards) & (F.col("n") > 1))
    hot = [r.key for r in heavy.select("key").collect()]  # fewer than n_shards rows
    spread = F.xxhash64("key", "doc_id", "row")
    key = F.when(F.col("key").isin(hot), spread).otherwise(F.xxhash64("key")) if hot else F.xxhash64("key")
    return rows.select("row", "doc_id", "size", "text_crc32", F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; the table has as many rows as slots."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r.virtual_slot: (r.b, r.n) for r in found}


def shard(docs: DataFrame, n_shards: int = 16, n_slots: int = 4096, map_path: str | None = None, text_col: str = "text", id_col: str = "doc_id", bucket_rows: int = 20_000) -> DataFrame:
    """Put every document into one of ``n_shards`` shards of nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot,
    map_version``: ``slot`` is the row's place in its shard, gapless from 0 (by
    virtual slot); ``grown_shard`` is null under the law ``bytes``.  Size is the text's
    UTF-8 bytes plus 1, 1 for a null text.  Equal texts go to one shard unless they
    hold more than a shard's share of all bytes.  Null and repeated ids are rows like
    others.  The map is written to ``map_path``, or to the session's scratch folder,
    and rows are placed by the table read back; a map already stored there is edited
    rather than made anew.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = slotted(docs, n_slots, n_shards, text_col, id_col)
    loads = slot_loads(rows)
    path = map_path or materialize(spark.createDataFrame([], MAP_SCHEMA), "map").scratch_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = map_path and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    write_map(spark, rebalanced_map(read_map(spark, path), loads, n_shards) if stored else first_map(loads, n_slots, n_shards), path)
    before: dict[int, int] = {}
    placed = []
    for version, slot, to, _, n in read_map(spark, path):
        placed.append((slot, to, before.get(to, 0), version, max(1, -(-n // bucket_rows))))
        before[to] = before.get(to, 0) + n
    where = spark.createDataFrame(placed, "virtual_slot int, shard int, base long, map_version int, parts int")
    # A slot of very many rows, such as a third of all texts being null, is numbered in parts by hash.
    dealt = rows.join(F.broadcast(where), "virtual_slot").withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")))  # n_slots rows
    counts = materialize(dealt.groupBy("virtual_slot", "part").agg(F.count("*").alias("n")), "parts")
    earlier = Window.partitionBy("virtual_slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.filter("n > 0").withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "row")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(starts, ["virtual_slot", "part"])
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
