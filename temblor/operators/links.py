"""Nearest-neighbour links in the space-time-magnitude metric, and their threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.functions import geo
from temblor.functions.scalar import DAY_MS
from temblor.operators.components import forest_roots, numbered, ranked
from temblor.operators.neighbours import shared_cells
from temblor.scratch import discard, written

R_FLOOR = 0.001


CLASSES, CLASS_WIDTH = 16, 0.5  # of magnitudes, down from the largest; the last one holds the rest
KID = "row_idx long, nth long, timeMs long, x_km double, y_km double, magnitude double, parent long, parent_nth long, eta double, since long"
CELLED = KID + ", bx long, by long, full boolean, margin double"


def _eta(days: np.ndarray, km: np.ndarray, gain: np.ndarray, d: float) -> np.ndarray:
    return np.where(days > 0, days * np.maximum(km, R_FLOOR) ** d * gain, np.inf)


def _improved(kids: dict, olds: dict, d: float, b: float) -> dict:
    """The kids with better parents, if there are some among the old rows; of equal ones the earliest."""
    known = np.isfinite(olds["magnitude"])
    order = np.flatnonzero(known)[np.argsort(olds["nth"][known], kind="stable")]
    olds = {c: v[order] for c, v in olds.items()}
    gain = 10.0 ** (-b * olds["magnitude"])
    lost = (-b * math.log(10.0) * olds["magnitude"]).astype(np.float32)
    eta, parent, nth = (kids[c].copy() for c in ("eta", "parent", "parent_nth"))
    kt, ot, (kx, ky), (ox, oy) = kids["timeMs"].astype(float), olds["timeMs"].astype(float), *((t["x_km"], t["y_km"]) for t in (kids, olds))
    step = max(1, 16_384 // max(1, len(order)))
    for a in range(0, len(eta) if len(order) else 0, step):
        s = slice(a, a + step)
        days, east, north = kt[s, None] - ot, kx[s, None] - ox, ky[s, None] - oy
        # Logarithms in single precision pick the pairs that can be the least; those are computed in full.
        rough = np.log(np.maximum(days, 0.5).astype(np.float32)) + np.float32(d / 2) * np.log(np.maximum(east * east + north * north, R_FLOOR * R_FLOOR).astype(np.float32)) + lost
        rough[days <= 0] = np.inf
        least = rough.min(axis=1, keepdims=True)
        i, j = np.nonzero((rough <= least + np.float32(0.01)) & (rough < np.inf))
        exact = _eta(days[i, j] / DAY_MS, np.hypot(east[i, j], north[i, j]), gain[j], d)
        first = np.lexsort((olds["nth"][j], exact, i))
        i, j, exact = i[first], j[first], exact[first]
        head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
        i, j, exact = i[head] + a, j[head], exact[head]
        better = (exact < eta[i]) | ((exact == eta[i]) & (olds["nth"][j] < nth[i]))
        i, j = i[better], j[better]
        eta[i], parent[i], nth[i] = exact[better], olds["row_idx"][j], olds["nth"][j]
    return kids | {"eta": eta, "parent": parent, "parent_nth": nth}


def _columns(table: pa.Table) -> dict:
    floats = ("x_km", "y_km", "magnitude", "eta", "margin")
    return {c: (table[c].cast(pa.float64()).fill_null(np.nan) if c in floats else table[c]).to_numpy() for c in table.column_names}


def _cut(rows: DataFrame, extent: float, most: int) -> tuple[DataFrame, float]:
    """The rows with square cells (bx, by) and ``part``, and the cells' width.

    Cells are as wide as leaves nine in ten rows in cells of at most ``most``; the rows of
    fuller ones are cut in time order into parts of so many.  ``full`` tells of those.
    """
    total = rows.count()
    width = max(extent * math.sqrt(most / max(total, 1)) / 2, R_FLOOR)
    while True:
        celled = rows.withColumn("bx", F.floor(F.col("x_km") / width)).withColumn("by", F.floor(F.col("y_km") / width))
        counts = celled.groupBy("bx", "by").agg(F.count("*").alias("n"))
        fit = counts.agg(F.sum(F.when(F.col("n") <= most, F.col("n"))).alias("s")).first().s or 0
        if fit >= 0.9 * total or width <= R_FLOOR:
            break
        width /= 2
    marked = celled.join(counts.select("bx", "by", (F.col("n") > most).alias("full")), ["bx", "by"])
    if fit == total:
        return marked.withColumn("part", F.lit(0).cast("bigint")), width
    marked = written(marked, "celled")
    thick = ranked(marked.filter("full"), ["bx", "by"], [F.col("nth")], "place").withColumn("part", F.floor((F.col("place") - 1) / most)).drop("place")
    return marked.filter("not full").withColumn("part", F.lit(0).cast("bigint")).unionByName(thick), width


def nearest_parents(cat: DataFrame, d: float = 1.6, b: float = 1.0, block_rows: int = 600, most: int = 1500, largest: int = 600) -> DataFrame:
    """(row_idx, parent, log10_eta): the strictly earlier event of least days * km**d * 10**(-b m).

    Ties go to the earliest parent.  Rows first search their own and the last block in
    time, the ``largest`` events, and their cell of the plane; this bounds how good a
    parent must be.  Any other one is earlier than the last block, so a class of
    magnitudes can have a better one only within a distance.  Rows whose distance reaches
    out of the cell are searched for in the cells around it, which most do not reach out
    of; where it does, the class is joined on cells as wide as the distance asks for.
    """
    points = geo.projected(cat.filter("latitude is not null and longitude is not null and timeMs is not null")).select("row_idx", "timeMs", "x_km", "y_km", F.col("magnitude").cast("double").alias("magnitude"))
    timed = written(numbered(points, [F.col("timeMs"), F.col("row_idx")], "nth"), "timed")
    held = timed.filter("magnitude is not null and not isnan(magnitude)")
    top = held.orderBy(F.desc("magnitude"), "nth").limit(largest).collect()  # so many rows at most
    tops = {c: np.array([r[c] for r in top], np.float64 if c in ("x_km", "y_km", "magnitude") else np.int64) for c in timed.columns}

    def in_time(table: pa.Table) -> pa.Table:
        rows = _columns(table)
        own = rows.pop("own").astype(bool)
        kids = {c: v[own] for c, v in rows.items() if c != "block"}
        none = np.full(own.sum(), -1, np.int64)
        kids |= {"parent": none, "parent_nth": none, "eta": np.full(len(none), np.inf), "since": np.full(len(none), rows["timeMs"].min())}
        kids = _improved(kids, {c: np.concatenate([rows[c], tops[c]]) for c in tops}, d, b)
        return pa.table({c: kids[c] for c in [f.split()[0] for f in KID.split(", ")]})

    blocks = timed.withColumn("block", F.floor(F.col("nth") / block_rows))
    both = blocks.withColumn("own", F.lit(True)).union(blocks.withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False)))
    bound = written(both.groupBy("block").applyInArrow(in_time, KID), "bound")

    ends = bound.agg(*[f(c).alias(f"{n}_{c}") for c in ("x_km", "y_km") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    extent = max([(ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0) for c in ("x_km", "y_km")] + [R_FLOOR])
    celled, width = _cut(bound, extent, most)

    def in_cell(table: pa.Table) -> pa.Table:
        rows = _columns(table)
        own = rows.pop("own").astype(bool)
        kids = _improved({c: v[own] for c, v in rows.items()}, {c: rows[c] for c in tops}, d, b)
        edge = np.minimum.reduce([kids[c] - kids[n] * width for c, n in (("x_km", "bx"), ("y_km", "by"))] + [(kids[n] + 1) * width - kids[c] for c, n in (("x_km", "bx"), ("y_km", "by"))])
        kids["margin"] = np.where(kids["full"].astype(bool), 0.0, np.maximum(0.0, edge))
        return pa.table({c: kids[c] for c in [f.split()[0] for f in CELLED.split(", ")]})

    both = celled.withColumn("own", F.lit(True)).unionByName(celled.filter("full").withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False)))
    found = written(both.groupBy("bx", "by", "part").applyInArrow(in_cell, CELLED), "found")
    discard(bound)
    best = found.select("row_idx", "parent", "parent_nth", "eta")
    if len(top) == largest:
        around, found = _around(found, tops["magnitude"].min(), width, block_rows, d, b)
        best = best.union(around).union(_elsewhere(found, tops["magnitude"].min(), extent, width / 32, block_rows, d, b))
        best = best.groupBy("row_idx").agg(F.min(F.struct("eta", "parent_nth", "parent")).alias("m")).select("row_idx", "m.*")
    best = best.filter("parent >= 0").select("row_idx", "parent", F.when(F.col("eta") > 0, F.log10("eta")).alias("log10_eta"))
    return cat.select("row_idx").join(best, "row_idx", "left")


def _around(found: DataFrame, top: float, width: float, block_rows: int, d: float, b: float) -> tuple[DataFrame, DataFrame]:
    """Better parents from the eight cells around, and the rows with margins that reach over these cells.

    Every row is sent to its own cell, and to the few around it that it can reach.  Full
    cells and those next to one keep their margins.
    """
    full = found.filter("full").select("bx", "by").distinct()
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    if full.isEmpty():
        found = found.withColumn("clear", F.lit(True))
    else:
        next_to = full.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
        next_to = next_to.select((F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), F.lit(False).alias("clear")).distinct()
        found = written(found.join(next_to, ["bx", "by"], "left").withColumn("clear", F.coalesce("clear", F.lit(True))), "found")
    reach = F.pow(F.col("eta") * 10.0 ** (b * top) / (F.greatest(F.lit(1), F.col("timeMs") - F.col("since")) / DAY_MS), F.lit(1 / d)) * (1 + 1e-6)
    to = lambda step, v, n: {0: F.lit(0.0), -1: F.col(v) - F.col(n) * width, 1: (F.col(n) + 1) * width - F.col(v)}[step]
    kids = found.filter(F.col("clear") & (F.col("nth") >= 2 * block_rows)).withColumn("reach", reach).filter((F.col("reach") >= R_FLOOR) & (F.col("reach") >= F.col("margin")))
    kids = kids.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.hypot(to(i, "x_km", "bx"), to(j, "y_km", "by")).alias("km")) for i, j in steps if i or j]))).filter(F.col("o.km") <= F.col("reach"))
    columns = [f.split()[0] for f in KID.split(", ")]
    kids = kids.select((F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"), F.lit(True).alias("own"), *columns)
    olds = found.filter("not full").select("bx", "by", F.lit(False).alias("own"), *columns)

    def near(table: pa.Table) -> pa.Table:
        rows = _columns(table)
        own = rows.pop("own").astype(bool)
        kids = {c: v[own] for c, v in rows.items()}
        better = _improved(kids, {c: rows[c][~own] for c in columns[:6]}, d, b)
        changed = better["parent_nth"] != kids["parent_nth"]
        return pa.table({c: better[c][changed] for c in ("row_idx", "parent", "parent_nth", "eta")})

    around = kids.union(olds).groupBy("bx", "by").applyInArrow(near, "row_idx long, parent long, parent_nth long, eta double")
    return written(around, "around"), found.withColumn("margin", F.when(F.col("clear"), F.col("margin") + width).otherwise(F.col("margin"))).drop("clear")


def _elsewhere(found: DataFrame, top: float, extent: float, finest: float, block_rows: int, d: float, b: float) -> DataFrame:
    """Parents as good as or better than those found, from before the blocks in time and outside the own cell.

    Parents have at most the magnitude ``top``.  The longer before a row, the nearer they
    must be, so those of three spans of time are looked for in cells of their own.
    """
    coarsest = max(1, math.ceil(math.log2(4 * extent / finest)))
    size = F.lit(finest) * F.pow(F.lit(2.0), F.col("level"))
    span = found.agg(F.count("*").alias("n"), (F.max("timeMs") - F.min("timeMs")).alias("ms")).first()
    near = max(1, int(16 * span.ms * block_rows / span.n))
    upto = F.element_at(F.array(*[F.lit(e).cast("bigint") for e in (near, 16 * near, span.ms + 1)]), F.col("bin") + 1)
    over = F.element_at(F.array(*[F.lit(e).cast("bigint") for e in (1, near, 16 * near)]), F.col("bin") + 1)
    days = F.greatest(over, F.col("timeMs") - F.col("since")) / DAY_MS
    reach = F.pow(F.col("eta") * F.pow(F.lit(10.0), b * (top - CLASS_WIDTH * F.col("class"))) / days, F.lit(1 / d)) * (1 + 1e-6)
    kids = found.filter(F.col("nth") >= 2 * block_rows).withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1)))).withColumn("bin", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(F.col("timeMs") - F.col("since") <= upto).withColumn("reach", reach)
    kids = kids.filter((F.col("reach") >= R_FLOOR) & (F.col("reach") >= F.col("margin"))).withColumn("reach", F.least("reach", F.lit(2 * extent)))
    kids = kids.withColumn("level", F.least(F.lit(coarsest), F.greatest(F.lit(0), F.ceil(F.log2(2 * F.col("reach") / finest)))).cast("int"))
    used = kids.select("class", "bin", "level").distinct().collect()  # some ten levels of each class and bin
    if not used:
        return found.limit(0).select("row_idx", "parent", "parent_nth", "eta")
    for c, axis in (("cx", "x_km"), ("cy", "y_km")):
        kids = kids.withColumn(c, F.explode(F.sequence(F.floor((F.col(axis) - F.col("reach")) / size), F.floor((F.col(axis) + F.col("reach")) / size))))
    kids = kids.withColumn("ct", F.explode(F.sequence(F.floor((F.col("timeMs") - upto) / upto), F.floor((F.col("timeMs") - F.greatest(over, F.col("timeMs") - F.col("since"))) / upto))))
    own = [F.when(~F.col("full"), F.col(c)).alias(c) for c in ("bx", "by")]
    kids = kids.select("class", "bin", "level", "cx", "cy", "ct", "row_idx", "timeMs", "x_km", "y_km", "eta", "since", *own)
    levels = F.array(*[F.array(*[F.struct(F.lit(r.bin).alias("bin"), F.lit(r.level).alias("level")) for r in used if r["class"] == k]).cast("array<struct<bin:int,level:int>>") for k in range(CLASSES)])
    olds = found.filter("magnitude is not null and not isnan(magnitude)").withColumn("class", F.least(F.lit(CLASSES - 1), F.greatest(F.lit(0), F.floor((top - F.col("magnitude")) / CLASS_WIDTH))).cast("int"))
    olds = olds.withColumn("l", F.explode(F.element_at(levels, F.col("class") + 1))).withColumn("bin", F.col("l.bin")).withColumn("level", F.col("l.level"))
    olds = olds.select("class", "bin", "level", F.floor(F.col("timeMs") / upto).alias("ct"), F.floor(F.col("x_km") / size).alias("cx"), F.floor(F.col("y_km") / size).alias("cy"), *[F.col(c).alias(f"o_{c}") for c in ("row_idx", "nth", "timeMs", "x_km", "y_km", "magnitude", "bx", "by")])
    kids, olds, cell = shared_cells(kids, olds, ["class", "bin", "level", "cx", "cy", "ct"], "row_idx", "o_row_idx")
    km = F.hypot(F.col("x_km") - F.col("o_x_km"), F.col("y_km") - F.col("o_y_km"))
    least = (F.col("timeMs") - F.col("o_timeMs")) / DAY_MS * F.pow(F.greatest(km, F.lit(R_FLOOR)), F.lit(d)) * F.pow(F.lit(10.0), -b * F.col("o_magnitude"))
    met = kids.join(olds, cell).filter((F.col("o_timeMs") < F.col("timeMs")) & (F.col("o_timeMs") <= F.col("since")))
    met = met.filter(~(F.col("bx").eqNullSafe(F.col("o_bx")) & F.col("by").eqNullSafe(F.col("o_by")))).filter(least <= F.col("eta") * (1 + 1e-9))

    def exactly(batches):
        """As the other searches compute it, so that ties are ties."""
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            eta = _eta((c["timeMs"] - c["o_timeMs"]) / DAY_MS, np.hypot(c["x_km"] - c["o_x_km"], c["y_km"] - c["o_y_km"]), 10.0 ** (-b * c["o_magnitude"]), d)
            yield pa.RecordBatch.from_arrays([batch.column("row_idx"), batch.column("o_row_idx"), batch.column("o_nth"), pa.array(eta)], names=["row_idx", "parent", "parent_nth", "eta"])

    met = met.select("row_idx", "timeMs", "x_km", "y_km", *[f"o_{c}" for c in ("row_idx", "nth", "timeMs", "x_km", "y_km", "magnitude")])
    return met.mapInArrow(exactly, "row_idx long, parent long, parent_nth long, eta double")


def otsu_threshold(links: DataFrame, value: str = "log10_eta", fallback: float = 0.15) -> DataFrame:
    """One row (n, threshold): the bin centre that parts low from high values best.

    Histogram of max(3, min(100, ceil(sqrt(n)))) bins, maximal between-class variance,
    the lowest bin on ties.  Below 20 values, or without spread, the element at
    floor(fallback * (n - 1)) of the sorted values.
    """
    v = links.select(F.col(value).alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    s = v.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    head = s.first()
    if not head.n:
        return s.select("n", F.lit(None).cast("double").alias("threshold"))
    if head.n < 20 or head.hi <= head.lo:
        few = v.groupBy("v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy("v")))  # fewer than 20 values, or one
        at = int(fallback * (head.n - 1))
        return few.filter(F.col("upto") > at).agg(F.lit(head.n).cast("bigint").alias("n"), F.min("v").alias("threshold"))
    bins = max(3, min(100, int(np.ceil(np.sqrt(head.n)))))
    width = (head.hi - head.lo) / bins
    at = F.greatest(F.lit(0), F.least(F.floor((F.col("v") - head.lo) / width), F.lit(bins - 1)))
    hist = v.groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    full = v.sparkSession.range(bins).select(F.col("id").alias("bin")).join(hist, "bin", "left").select("bin", (F.coalesce("c", F.lit(0)) / head.n).alias("p"), (head.lo + (F.col("bin") + 0.5) * width).alias("x"))
    up = Window.partitionBy(F.lit(1)).orderBy("bin")  # 100 rows at most
    run = full.withColumn("w", F.sum("p").over(up)).withColumn("m", F.sum(F.col("p") * F.col("x")).over(up)).withColumn("mt", F.sum(F.col("p") * F.col("x")).over(Window.partitionBy(F.lit(1))))
    between = F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2.0)) / (F.col("w") * (1 - F.col("w")))
    scored = run.filter("w > 0 and w < 1 - 1e-12").withColumn("s", between)
    return scored.agg(F.lit(head.n).cast("bigint").alias("n"), F.min_by("x", F.struct(-F.col("s"), "bin")).alias("threshold"))


def nearest_neighbour_clusters(cat: DataFrame, threshold: float = 1.0, d: float = 1.6, b: float = 1.0) -> DataFrame:
    """(row_idx, cluster_id, parent, log10_eta): trees of links at or below the threshold.

    A positive ``threshold`` asks for the automatic one.  Trees of two or more are
    clusters, numbered by their first member in time order; the rest is noise, -1.
    """
    links = written(nearest_parents(cat, d, b), "links")
    limit = otsu_threshold(links) if threshold > 0 else cat.sparkSession.createDataFrame([(float(threshold),)], "threshold double")
    strong = links.crossJoin(F.broadcast(limit.select("threshold"))).filter("log10_eta <= threshold and parent is not null")  # one row
    roots = forest_roots(strong.select(F.col("row_idx").alias("child"), "parent"))
    timed = written(roots.join(cat.select(F.col("row_idx").alias("node"), "timeMs"), "node"), "members")
    heads = timed.groupBy("root").agg(F.min(F.struct("timeMs", "node")).alias("head"))
    order = numbered(heads, [F.col("head")], "cluster_id").select("root", F.col("cluster_id").cast("int").alias("cluster_id"))
    named = timed.join(order, "root").select(F.col("node").alias("row_idx"), "cluster_id")
    return links.join(named, "row_idx", "left").select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "parent", "log10_eta")
