"""Operator 3, mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equally many rows.  The j-th block of a source of
weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); running
the earliest deadline first keeps every source within one block of its weight at
every slot.  Weights are taken as exact fractions; when a source ends, the others go
on in proportion.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.llm.common import materialize


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Round weights to whole shares, each at least 1, that add up to ``period``."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots, not {period}")
    total = sum(weights.values())
    exact = {s: max(1.0, w / total * period) for s, w in weights.items()}
    scale = period / sum(exact.values())
    exact = {s: x * scale for s, x in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (rest := period - sum(out.values())) != 0:
        sign = 1 if rest > 0 else -1
        pool = [s for s in out if sign > 0 or out[s] > 1]
        out[max(pool, key=lambda s: (sign * (exact[s] - out[s]), s))] += sign
    return out


def earliest_deadlines(blocks: dict[str, int], weights: dict[str, Fraction | float | int]) -> Iterator[tuple[str, int, int]]:
    """``(source, block, phase)`` of every slot: released blocks, earliest deadline first.

    The weights count exactly as given.  With n[s] blocks, at virtual time v source s is due
    min(n[s], v * weight[s]) blocks, and what all sources are due is the slot.  A block is released
    in the slot in which its source is due more than the blocks before it, and its deadline is the
    slot by which it is due in full; as dues are whole in sum, all deadlines can be met.  So every
    source stays less than one block from its due.  A phase ends when a source is due its last
    block.  Sources of weight 0 come after all others.
    """
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    idle = {s: n for s, n in blocks.items() if n and not weights[s]}
    blocks = {s: n for s, n in blocks.items() if n and weights[s]}
    exact = {s: Fraction(weights[s]) for s in blocks}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    ends = sorted((Fraction(n, whole[s]), s) for s, n in blocks.items())  # by the virtual time of the last block
    times = [v for v, _ in ends]
    spent, active = [0], [sum(whole.values())]
    for _, s in ends:
        spent.append(spent[-1] + blocks[s])
        active.append(active[-1] - whole[s])
    exits = [math.floor(v) for v in sorted({spent[k] + v * active[k] for k, v in enumerate(times)})]
    at = dict.fromkeys(blocks, 0)

    def due(s: str, n: int) -> tuple[int, int]:
        """The slot at which n blocks of s are due, rounded down and up."""
        if times[at[s]].numerator * whole[s] < n * times[at[s]].denominator:
            at[s] = bisect_left(times, Fraction(n, whole[s]), at[s])
        k, w = at[s], whole[s]
        return spent[k] + n * active[k] // w, spent[k] - (-n * active[k] // w)

    done = dict.fromkeys(blocks, 0)
    waiting = [(0, s) for s in sorted(blocks)]
    ready: list[tuple[int, str]] = []
    free, phase = {}, 0
    for t in range(spent[-1]):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            free[s], deadline = due(s, done[s] + 1)
            heapq.heappush(ready, (deadline, s))
        while phase < len(exits) and exits[phase] <= t:
            phase += 1
        s = heapq.heappop(ready)[1]
        yield s, done[s], phase
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (free[s], s))
    if idle:
        for s, block, p in earliest_deadlines(idle, dict.fromkeys(idle, 1)):
            yield s, block, p + len(exits)


def one_period(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of whole shares."""
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t, (s, _, _) in enumerate(earliest_deadlines(shares, shares)):
        slots[s].append(t)
    return slots


PLACES = "source string, block long, slot long, phase int, start long"


def _places(spark: SparkSession, sizes: dict[str, int], weights: dict, block_rows: int, chunk: int = 500_000) -> DataFrame:
    """Slot, phase and first position of every block, written ``chunk`` blocks at a time."""
    slots = earliest_deadlines({s: -(-n // block_rows) for s, n in sizes.items()}, weights)
    path = f"{materialize(spark.createDataFrame([], PLACES), 'places').scratch_path}"
    slot = start = 0
    while held := list(islice(slots, chunk)):
        rows = [min(block_rows, sizes[s] - b * block_rows) for s, b, _ in held]  # only a source's last block can be short
        starts = list(accumulate(rows, initial=start))
        start = starts.pop()
        source, block, phase = zip(*held, strict=True)
        table = pa.table({"source": source, "block": pa.array(block, pa.int64()), "slot": pa.array(range(slot, slot + len(held)), pa.int64()), "phase": pa.array(phase, pa.int32()), "start": pa.array(starts, pa.int64())})
        spark.createDataFrame(table).write.mode("append").parquet(path)
        slot += len(held)
    return spark.read.schema(PLACES).parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 64, period: int | None = None, source_col: str = "source", id_col: str = "doc_id", seed: int = 0, bucket_rows: int = 20_000) -> DataFrame:
    """Interleave sources to target weights; one row per input row, none dropped.

    Returns ``doc_id, source, block, slot, phase, position``: ``block`` counts the
    source's blocks, ``slot`` is the block's place in the whole mix, ``position`` the
    row's, gapless from 0.  After every slot every source is less than one block from
    what its weight, as given, makes due (:func:`earliest_deadlines`).  Without
    ``weights`` a source's weight is the square root of its rows.  Sources missing
    from ``weights`` get the smallest weight given; a null source is a source named
    by the empty string.  Rows are ordered inside a source by a seeded hash of the id,
    then the id.  With ``period`` the weights are first rounded to whole shares of
    that many slots, and more sources than slots are refused.  The driver holds a
    number a source and runs through the blocks once.  An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))
    rows = materialize(rows, "sources")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row a source
    given = weights or {s: n**0.5 for s, n in sizes.items()}
    target = {s: given.get(s, min(given.values())) for s in sizes}
    if period and sizes:
        target = whole_shares(target, period)
    # No source is numbered in one task: rows are dealt into buckets by hash, numbered there, and offset by the buckets before.
    n_buckets = max(1, -(-sum(sizes.values()) // bucket_rows))
    dealt = rows.withColumn("bucket", F.pmod("h", F.lit(n_buckets)))
    counts = materialize(dealt.groupBy("source", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row")
    numbered = dealt.withColumn("rank", F.row_number().over(within) - 1).join(before, ["source", "bucket"])
    numbered = numbered.select("source", "doc_id", (F.col("rank") + F.col("base")).alias("nth")).withColumn("block", F.floor(F.col("nth") / block_rows))
    placed = numbered.join(_places(spark, sizes, target, block_rows), ["source", "block"])
    return placed.select("doc_id", "source", "block", "slot", "phase", (F.col("start") + F.col("nth") % block_rows).cast("long").alias("position"))
