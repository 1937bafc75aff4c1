"""Density clustering in space and in space and time, k-means, and core distances."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.functions.scalar import DAY_MS
from temblor.operators import spanning
from temblor.operators.components import connected, numbered
from temblor.operators.neighbours import planar_pairs, window_pairs
from temblor.scratch import written


def labels_from_pairs(rows: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """(row_idx, cluster_id, core) of density clusters over neighbour pairs (a, b), both directions.

    A row with at least ``min_samples`` neighbours, itself included, is a core; cores
    that are neighbours share a cluster; clusters are numbered by their first core's
    row_idx; another neighbour of cores joins the lowest-numbered of their clusters;
    the rest is noise, -1.
    """
    pairs = written(pairs, "pairs")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    cores = rows.select("row_idx").join(counts, F.col("row_idx") == F.col("a"), "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("row_idx")
    cores = written(cores, "cores")
    ca, cb = cores.select(F.col("row_idx").alias("a")), cores.select(F.col("row_idx").alias("b"))
    comp = connected(pairs.join(ca, "a", "left_semi").join(cb, "b", "left_semi").filter("a < b"))
    named = cores.join(comp.withColumnRenamed("node", "row_idx"), "row_idx", "left").select("row_idx", F.coalesce("component", "row_idx").alias("component"))
    first = numbered(named.select("component").distinct(), [F.col("component")], "cluster_id")
    named = written(named.join(first, "component").select("row_idx", F.col("cluster_id").cast("int").alias("cluster_id")), "named")
    border = pairs.join(named.select(F.col("row_idx").alias("b"), "cluster_id"), "b").join(ca, "a", "left_anti").groupBy("a").agg(F.min("cluster_id").alias("cluster_id"))
    found = named.select("row_idx", "cluster_id", F.lit(True).alias("core")).union(border.select(F.col("a"), "cluster_id", F.lit(False)))
    return rows.select("row_idx").join(found, "row_idx", "left").select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("core", F.lit(False)).alias("core"))


def labels_by_cells(rows: DataFrame, points: DataFrame, cell: list[str], reach: list[int], extent: list[str], near: Callable[[str, str], Column], min_samples: int) -> DataFrame:
    """What :func:`labels_from_pairs` gives, without the pairs of dense places.

    ``points`` have row_idx, integer ``cell`` columns, and whatever ``near`` compares
    under a prefix for each side; ``extent`` names the coordinate of each cell column.
    Rows of one cell must be near each other, and rows that are near at most ``reach``
    cells apart.  So a cell of ``min_samples`` rows holds cores only; fewer rows look at
    the cells around, which meets each row a bounded number of times.  Clusters join
    cells: two cells first by their rows at the facing sides, and only cells that are
    apart after that are compared row by row.
    """
    around = [o for o in itertools.product(*[range(-r, r + 1) for r in reach]) if any(o)]
    steps = lambda some: F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in some])).alias("o")
    moved = [(F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(cell)]
    values = [c for c in points.columns if c not in cell]
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in values]

    held = points.groupBy(*cell).agg(F.count("*").alias("held"))
    points = written(points.join(held.hint("merge"), cell), "points")
    few = points.filter(F.col("held") < min_samples)
    look = lambda some: some.select(*cell, *side("a"), "held", steps(around)).select(*moved, *[f"a{c}" for c in values], "held")
    met = points.select(*cell, *side("b")).join(look(few).hint("merge"), cell).filter(near("a", "b"))
    beyond = met.groupBy(F.col("arow_idx").alias("row_idx")).agg(F.count("*").alias("n"))
    counted = few.join(beyond, "row_idx", "left").withColumn("core", F.col("held") + F.coalesce("n", F.lit(0)) >= min_samples).select(*cell, *values, "held", "core")
    counted = written(counted, "counted")
    cores = points.filter(F.col("held") >= min_samples).select(*cell, *values).union(counted.filter("core").select(*cell, *values))

    ends = [f(F.struct(*values), F.col(e)).alias(f"{n}{i}") for i, e in enumerate(extent) for n, f in (("lo", F.min_by), ("hi", F.max_by))]
    heads = written(cores.groupBy(*cell).agg(F.min("row_idx").alias("head"), *ends), "heads")
    facing = [c for i in range(len(cell)) for c in (f"lo{i}", f"hi{i}")]
    half = [o for o in around if o > tuple(0 for _ in cell)]
    one = heads.select(*cell, F.col("head").alias("a"), *[F.col(c).alias(f"a{c}") for c in facing], steps(half)).select(*moved, "o", "a", *[f"a{c}" for c in facing])
    two = heads.select(*cell, F.col("head").alias("b"), *[F.col(c).alias(f"b{c}") for c in facing])
    links = one.join(two.hint("merge"), cell)
    touching = F.lit(False)
    for i in range(len(cell)):
        far = lambda p, ends, i=i: F.when(F.col(f"o.o{i}") > 0, F.col(f"{p}{ends[0]}{i}")).otherwise(F.col(f"{p}{ends[1]}{i}"))
        links = links.withColumn(f"p{i}", far("a", ("hi", "lo"))).withColumn(f"q{i}", far("b", ("lo", "hi")))
        touching = touching | ((F.col(f"o.o{i}") != 0) & near(f"p{i}.", f"q{i}."))
    links = written(links.select("a", "b", F.coalesce(touching, F.lit(False)).alias("sure")), "links")
    sure = links.filter("sure").select("a", "b")
    comp = written(connected(sure), "components")
    open_ = links.filter("not sure")
    for k in "ab":
        open_ = open_.join(comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")), k, "left").withColumn(f"c{k}", F.coalesce(f"c{k}", k))
    open_ = written(open_.filter("ca <> cb").select("a", "b"), "open")
    named = cores.join(heads.select(*cell, "head").hint("merge"), cell).select("head", *values)
    found = open_.join(named.select(F.col("head").alias("a"), *side("a")), "a").join(named.select(F.col("head").alias("b"), *side("b")), "b").filter(near("a", "b")).select("a", "b").distinct()
    comp = connected(sure.union(found))

    heads = heads.join(comp.withColumnRenamed("node", "head"), "head", "left").select(*cell, F.coalesce("component", "head").alias("component"))
    first = numbered(heads.select("component").distinct(), [F.col("component")], "cluster_id")
    heads = written(heads.join(first, "component").select(*cell, F.col("cluster_id").cast("int").alias("cluster_id")), "named")
    owned = cores.join(heads.hint("merge"), cell)
    rest = counted.filter("not core")
    border = owned.select(*cell, "cluster_id", *side("b")).join(look(rest).hint("merge"), cell).filter(near("a", "b")).groupBy(F.col("arow_idx").alias("row_idx")).agg(F.min("cluster_id").alias("cluster_id"))
    beside = rest.join(heads, cell).groupBy("row_idx").agg(F.min("cluster_id").alias("cluster_id"))
    border = border.union(beside).groupBy("row_idx").agg(F.min("cluster_id").alias("cluster_id"))
    found = owned.select("row_idx", "cluster_id", F.lit(True).alias("core")).union(border.select("row_idx", "cluster_id", F.lit(False)))
    return rows.select("row_idx").join(found, "row_idx", "left").select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("core", F.lit(False)).alias("core"))


def dbscan(cat: DataFrame, eps_km: float = 25, min_samples: int = 5) -> DataFrame:
    """Planar density clusters; null positions are noise."""
    points = geo.projected(cat.filter("latitude is not null and longitude is not null")).filter("abs(x_km) < double('infinity') and abs(y_km) < double('infinity')")
    size = eps_km / math.sqrt(2) * (1 - 1e-9)  # of cells whose diagonal is within eps
    points = points.select("row_idx", "x_km", "y_km", *[F.floor(F.col(c) / size).cast("bigint").alias(n) for n, c in (("cx", "x_km"), ("cy", "y_km"))])

    def near(a: str, b: str) -> Column:
        dx, dy = (F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in ("x_km", "y_km"))
        return F.sqrt(dx * dx + dy * dy) <= eps_km

    return labels_by_cells(cat, points, ["cx", "cy"], [2, 2], ["x_km", "y_km"], near, min_samples)


def st_dbscan(cat: DataFrame, eps_km: float = 25, eps_days: float = 14, min_samples: int = 5, projected_box: bool = True) -> DataFrame:
    """Density clusters by great-circle distance and time.

    ``projected_box`` also asks that planar offsets be at most 1.15 eps, which far
    from the mean latitude excludes a few pairs.
    """
    window = int(eps_days * DAY_MS)
    if not projected_box or window <= 0:
        mains = cat.withColumn("radius_km", F.lit(float(eps_km))).withColumn("before_ms", F.lit(window)).withColumn("after_ms", F.lit(window))
        pairs = window_pairs(mains, cat).select(F.col("main").alias("a"), F.col("dep").alias("b"))
        return labels_from_pairs(cat, pairs, min_samples)
    points = geo.projected(cat).filter("timeMs is not null and abs(x_km) < double('infinity') and abs(y_km) < double('infinity')")
    cos = points.agg(F.max(F.cos(F.radians("latitude"))).alias("most"), F.cos(F.radians(F.avg("latitude"))).alias("mean")).first()
    # How much longer than its planar length a short way can be, anywhere in the catalogue.
    longest = max(1.0057, (cos.most or 1.0) / max(cos.mean or 1.0, 1e-3)) * (1 + (eps_km / geo.EARTH_KM) ** 2)
    size = eps_km / math.sqrt(2) / longest * (1 - 1e-9)
    space = [F.floor(F.col(c) / size).cast("bigint").alias(n) for n, c in (("cx", "x_km"), ("cy", "y_km"))]
    points = points.select("row_idx", "latitude", "longitude", "x_km", "y_km", "timeMs", *space, F.floor(F.col("timeMs") / window).cast("bigint").alias("ct"))

    def near(a: str, b: str) -> Column:
        off = lambda c: F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}"))
        apart = geo.haversine_km(f"{a}latitude", f"{a}longitude", f"{b}latitude", f"{b}longitude")
        return (off("timeMs") <= window) & (off("x_km") <= 1.15 * eps_km) & (off("y_km") <= 1.15 * eps_km) & (apart <= eps_km)

    wide = math.ceil(1.15 * eps_km / size)
    return labels_by_cells(cat, points, ["cx", "cy", "ct"], [wide, wide, 1], ["x_km", "y_km", "timeMs"], near, min_samples)


def optics_core_distances(cat: DataFrame, eps_km: float = 25, min_samples: int = 5) -> DataFrame:
    """(row_idx, core_km): distance to the ``min_samples``-th neighbour, itself included, within ``eps_km``; else null.

    Clusters at any smaller radius are :func:`dbscan` at that radius.
    """
    nodes = written(spanning.places(cat, True), "places")
    rows = nodes.agg(F.sum("n").alias("n")).first().n or 0
    if min_samples < 2 or rows < min_samples:
        return cat.select("row_idx", F.lit(None).cast("double").alias("core_km"))
    core = spanning.core_distances(nodes, min_samples - 1, True).filter(F.col("core") <= eps_km)
    core = core.join(nodes.select("node", "latitude", "longitude").hint("merge"), "node").select("latitude", "longitude", F.col("core").alias("core_km"))
    return cat.select("row_idx", "latitude", "longitude").join(core.hint("merge"), ["latitude", "longitude"], "left").select("row_idx", "core_km")


def optics(cat: DataFrame, eps_km: float = 25, min_samples: int = 5) -> DataFrame:
    """Clusters of the reachability plot cut at ``eps_km``: the density clusters of that radius, with core distances."""
    return dbscan(cat, eps_km, min_samples).join(optics_core_distances(cat, eps_km, min_samples), "row_idx")


def kmeans(cat: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(row_idx, cluster_id, centre_x_km, centre_y_km, distance_km) of k-means on planar positions.

    Every row with a position belongs to the cluster whose centre is nearest.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["x_km", "y_km"], outputCol="features").transform(geo.projected(cat.filter("latitude is not null and longitude is not null")))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(points)
    centres = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in model.clusterCenters()])  # k of them
    found = model.transform(points).withColumn("c", F.get(centres, F.col("cluster_id")))
    return found.select("row_idx", "cluster_id", F.col("c.x").alias("centre_x_km"), F.col("c.y").alias("centre_y_km"), F.hypot(F.col("x_km") - F.col("c.x"), F.col("y_km") - F.col("c.y")).alias("distance_km"))
