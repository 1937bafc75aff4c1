"""Hierarchical density clustering and reachability order, read off the tree of merges.

The tree is condensed by joins: a part that is too small falls out of its cluster where it
is split off, two parts that are large enough become clusters of their own.  Paths to
ancestors are followed by pointer jumping, so deep trees take few rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.operators.components import forest_roots, numbered, running
from temblor.operators.spanning import merges, spanning_tree
from temblor.scratch import written

MOST = 1e15  # the density (1 / distance) of rows that are no distance apart


def _links(joined: DataFrame) -> DataFrame:
    """(child, parent, size, other): every node of the tree of merges but the top, its size and that of its sibling."""
    left = joined.select(F.col("left").alias("child"), F.col("id").alias("parent"), F.col("left_size").alias("size"), F.col("right_size").alias("other"), "lam")
    return left.union(joined.select("right", "id", "right_size", "left_size", "lam"))


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of a forest of (child, parent) links, written."""
    return written(forest_roots(links), "roots")


def condensed(joined: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, birth, size) and drops (point, cluster, lam) of a tree of merges condensed at ``least``.

    ``birth`` and ``lam`` are densities, 1 / distance.
    """
    joined = written(joined.withColumn("lam", F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(MOST))), "merged")
    links = written(_links(joined), "links")
    small = links.filter(F.col("size") < least)
    lam = joined.select(F.col("id").alias("root"), "lam")
    # A row leaves at the first merge around it that has a size.
    left_at = _roots(small.select("child", "parent")).filter("node % 2 = 0").join(lam, "root").select(F.col("node").alias("point"), F.col("root").alias("at"), "lam")
    born = (F.col("size") >= least) & (F.col("other") >= least)
    inner = _roots(links.filter((F.col("size") >= least) & ~born).select("child", "parent"))
    big = joined.filter(F.col("left_size") + F.col("right_size") >= least).select("id", (F.col("left_size") + F.col("right_size")).alias("size"))
    owner = written(big.join(inner.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster")), "owner")
    drops = written(left_at.join(owner.withColumnRenamed("id", "at"), "at").select("point", "cluster", "lam"), "drops")
    splits = links.filter(born).select("child", "parent", F.col("lam").alias("birth"))
    up = splits.join(owner.select(F.col("id").alias("parent"), F.col("cluster").alias("above")), "parent").select(F.col("child").alias("cluster"), "above", "birth")
    clusters = owner.filter("id = cluster").join(big, "id").select("cluster", "size")
    clusters = clusters.join(up, "cluster", "left").select("cluster", F.col("above").alias("parent"), F.coalesce("birth", F.lit(0.0)).alias("birth"), "size")
    return written(clusters, "clusters"), drops


def stabilities(clusters: DataFrame, drops: DataFrame) -> DataFrame:
    """(cluster, parent, own): how much density rows and parts gain inside each cluster, at least 0."""
    gone = drops.groupBy("cluster").agg(F.sum("lam").alias("dropped"), F.count("*").alias("n"))
    parts = clusters.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") * F.col("birth")).alias("split"), F.sum("size").alias("m"))
    full = clusters.join(gone, "cluster", "left").join(parts, "cluster", "left")
    here = F.coalesce("dropped", F.lit(0.0)) - F.coalesce("n", F.lit(0)) * F.col("birth") + F.coalesce("split", F.lit(0.0)) - F.coalesce("m", F.lit(0)) * F.col("birth")
    return full.select("cluster", "parent", F.greatest(F.lit(0.0), here).alias("own"))


def _kept(pdf: pd.DataFrame) -> pd.DataFrame:
    """Values of one run of clusters, parts before wholes; parts of earlier runs come with their values."""
    below: dict[int, float] = {}
    out = []
    for r in pdf.sort_values("turn").itertuples(index=False):
        if r.known:
            value, keep = r.value, True
        else:
            parts = below.get(r.cluster)
            keep = parts is None or r.own >= parts
            value = r.own if keep else parts
            out.append((r.cluster, None if pd.isna(r.parent) else int(r.parent), value, keep))
        if not pd.isna(r.parent):
            below[int(r.parent)] = below.get(int(r.parent), 0.0) + value
    return pd.DataFrame(out, columns=["cluster", "parent", "value", "keep"]).astype({"parent": "Int64"})


def best_clusters(stable: DataFrame, run: int = 200_000) -> DataFrame:
    """(cluster, keep): whether a cluster is worth at least as much as the best choice among its parts.

    A part's number is below its whole's, because merges are numbered by distance, so
    runs of ``run`` clusters in ascending order need only values of parts in earlier
    runs.  A task holds one run and the parts of its clusters.
    """
    turned = written(numbered(stable, [F.col("cluster")], "turn"), "turned")
    total = turned.count()
    done = None
    for first in range(0, total, run):
        now = turned.filter(F.col("turn").between(first, first + run - 1)).select("cluster", "parent", "own", "turn", F.lit(False).alias("known"), F.lit(None).cast("double").alias("value"))
        if done is not None:
            wholes = now.select(F.col("cluster").alias("parent"))
            now = now.union(done.join(wholes, "parent", "left_semi").select("cluster", "parent", F.lit(None).cast("double"), F.lit(-1).cast("bigint"), F.lit(True), "value"))
        got = written(now.groupBy().applyInPandas(_kept, "cluster bigint, parent bigint, value double, keep boolean"), "values")
        done = got if done is None else done.union(got)
    return done.select("cluster", "keep") if done is not None else stable.select("cluster", F.lit(True).alias("keep"))


def hdbscan(cat: DataFrame, min_size: int = 5, min_samples: int = 5, planar: bool = False, local_edges: int = 100_000, run: int = 200_000) -> DataFrame:
    """(row_idx, cluster_id, probability, outlier_score) of the whole catalogue, any number of rows.

    Distances are great-circle ones, or ``planar``.  The tree of mutual reachability is
    condensed at ``min_size`` (2 at least, half the rows at most); a cluster is kept if
    its own stability is at least that of its parts, the whole included.  Rows of parts
    that were absorbed count from where their part was born.  Clusters are numbered by
    their first row.  Noise has cluster -1, probability 0 and an outlier score; rows
    without a position are noise with score 1, one row alone is a cluster.  Edges of
    equal weight are ordered by their rows, which decides between equally good trees.
    """
    out = cat.select("row_idx")
    tree, cores = spanning_tree(cat, min_samples, planar, local_edges)
    rows = cores.count()
    if rows < 2:
        alone = cores.select("row_idx", F.lit(0).alias("cluster_id"))
        found = out.join(alone, "row_idx", "left")
        single = F.col("cluster_id").isNotNull()
        return found.select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), single.cast("double").alias("probability"), (~single).cast("double").alias("outlier_score"))
    clusters, drops = condensed(merges(tree, local_edges), max(2, min(min_size, rows // 2)))
    keep = best_clusters(stabilities(clusters, drops), run)
    marked = written(clusters.join(keep, "cluster"), "marked")
    # The nearest kept cluster at or above each, and the highest of those.
    near = _roots(marked.filter("not keep and parent is not null").select(F.col("cluster").alias("child"), "parent"))
    nearest = written(marked.join(near.select(F.col("node").alias("cluster"), "root"), "cluster", "left").select("cluster", "keep", "parent", F.coalesce("root", "cluster").alias("near")), "nearest")
    held = nearest.join(marked.select(F.col("cluster").alias("near"), F.col("keep").alias("is_kept")), "near")
    above = nearest.filter("keep and parent is not null").select(F.col("cluster").alias("child"), "parent")
    above = above.join(held.filter("is_kept").select(F.col("cluster").alias("parent"), "near"), "parent").select("child", F.col("near").alias("parent"))
    tops = _roots(above)
    chosen = held.filter("is_kept").join(tops.select(F.col("node").alias("near"), "root"), "near", "left").select("cluster", "parent", F.coalesce("root", "near").alias("chosen"))
    chosen = written(chosen, "chosen")
    # Of what lies deeper, the part of the chosen cluster that it came with.
    deep = _roots(chosen.filter("cluster <> chosen and parent <> chosen").select(F.col("cluster").alias("child"), "parent"))
    part = chosen.filter("cluster <> chosen").join(deep.select(F.col("node").alias("cluster"), "root"), "cluster", "left").select("cluster", F.coalesce("root", "cluster").alias("part"))
    part = part.join(clusters.select(F.col("cluster").alias("part"), "birth"), "part").select("cluster", "birth")
    members = drops.join(chosen.select("cluster", "chosen"), "cluster", "left").join(part, "cluster", "left")
    members = written(members.select("point", "cluster", "chosen", F.col("lam"), F.when(F.col("chosen") == F.col("cluster"), F.col("lam")).otherwise(F.col("birth")).alias("stay")), "members")
    first = members.filter("chosen is not null").groupBy("chosen").agg(F.min("point").alias("first"), F.max("stay").alias("most"))
    labels = numbered(first, [F.col("first")], "cluster_id")
    gone = drops.groupBy("cluster").agg(F.max("lam").alias("a"))
    born = clusters.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.max("birth").alias("b"))
    densest = gone.join(born, "cluster", "left").select("cluster", F.greatest("a", F.coalesce("b", F.lit(0.0))).alias("densest"))
    judged = members.join(labels, "chosen", "left").join(densest, "cluster", "left")
    strength = F.when(F.col("most") > 0, F.least(F.lit(1.0), F.col("stay") / F.col("most"))).otherwise(F.lit(1.0))
    outlier = F.when(F.col("densest") > 0, F.greatest(F.lit(0.0), 1 - F.col("lam") / F.col("densest"))).otherwise(F.lit(1.0))
    labelled = F.col("cluster_id").isNotNull()
    judged = judged.select(F.shiftright("point", 1).alias("row_idx"), F.coalesce(F.col("cluster_id").cast("int"), F.lit(-1)).alias("cluster_id"), F.when(labelled, strength).otherwise(0.0).alias("probability"), F.when(labelled, 0.0).otherwise(outlier).alias("outlier_score"))
    found = out.join(judged, "row_idx", "left")
    return found.select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("outlier_score", F.lit(1.0)).alias("outlier_score"))


def cut(order: DataFrame, radius_km: float) -> DataFrame:
    """(row_idx, first_row): for the cores of ``radius_km`` the smallest row of their run, which is their density cluster; null for others.

    ``order`` is a :func:`reachability_order` whose ``eps_km`` is at least the radius.
    """
    opens = F.when(F.col("reachability_km") <= radius_km, F.lit(0)).otherwise(F.lit(1))
    runs = running(order.filter(F.col("core_km") <= radius_km), [F.col("position")], {"run": opens})
    first = runs.groupBy("run").agg(F.min("row_idx").alias("first_row"))
    return order.select("row_idx").join(runs.join(first, "run").select("row_idx", "first_row"), "row_idx", "left")


def reachability_order(cat: DataFrame, eps_km: float = 25, min_samples: int = 5, local_edges: int = 100_000) -> DataFrame:
    """(row_idx, position, reachability_km, core_km) of the density order of all rows by planar distance.

    Rows stand in the order of the leaves of the tree of merges, of two parts the one
    that holds the smaller row of their edge first; a row's reachability is the distance
    at which it joins those before it, null above ``eps_km`` and for the first row.
    ``core_km`` is the distance to the ``min_samples``-th row, itself included, null above
    ``eps_km``.  Cut at any radius, the runs of rows with a reachability up to it are the
    cores of the density clusters of that radius.  Rows without a position come last,
    by row_idx.
    """
    tree, cores = spanning_tree(cat, min_samples - 1, True, local_edges)
    joined = merges(tree, local_edges)
    links = joined.select(F.col("left").alias("child"), F.col("id").alias("parent"), F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("w"))
    links = written(links.union(joined.select("right", "id", "left_size", "w")), "links")
    # Rows before a node, added up along its path to the top by doubling.
    now = links.select(F.col("child").alias("node"), F.col("parent").alias("up"), "before")
    while True:
        higher = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("before").alias("more"))
        now = written(now.join(higher, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), F.col("next").isNotNull().alias("moved")), "before")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    starts = now.select("node", F.col("before").alias("position"))
    joins = links.filter("w is not null").select(F.col("child").alias("node"), "w").join(starts, "node").select("position", "w")
    placed = starts.filter("node % 2 = 0").select(F.shiftright("node", 1).alias("row_idx"), "position")
    within = lambda c: F.when(F.col(c) <= eps_km, F.col(c))
    found = cores.join(placed, "row_idx", "left").withColumn("position", F.coalesce("position", F.lit(0))).join(joins, "position", "left")
    found = found.select("row_idx", "position", within("w").alias("reachability_km"), within("core").alias("core_km"))
    lost = cat.join(found, "row_idx", "left_anti").select("row_idx")
    at = cores.agg(F.count("*").alias("n"))
    lost = numbered(lost, [F.col("row_idx")], "position").crossJoin(F.broadcast(at)).select("row_idx", F.col("position") + F.col("n"), F.lit(None).cast("double"), F.lit(None).cast("double"))  # one row
    return found.union(lost)
