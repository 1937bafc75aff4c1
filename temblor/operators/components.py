"""Connected components and positions in a global order, without gathering rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.scratch import discard, written


#: Up to so many links are followed by one task; more take rounds of joins until so few are left.  The result is the same.
LOCAL_LINKS = 300_000


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Roots of all nodes of one small table of links (u, v): v is u's parent."""
    up = dict(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))
    root: dict = {}
    for node in up:
        path = []
        while node in up and node not in root:
            path.append(node)
            node = up[node]
        end = root.get(node, node)
        root.update(dict.fromkeys(path, end))
    return pd.DataFrame({"node": [*root, *set(root.values())], "root": [*root.values(), *set(root.values())]})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest node reachable from every node of one small edge table (u, v)."""
    top: dict = {}

    def find(i):
        while top.setdefault(i, i) != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
        u, v = find(u), find(v)
        if u != v:
            top[max(u, v)] = min(u, v)
    return pd.DataFrame({"node": list(top), "root": [find(i) for i in list(top)]})


def _in_one_task(links: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    kind = links.schema["u"].dataType.simpleString()
    return links.select("u", "v").groupBy().applyInPandas(f, f"node {kind}, root {kind}")


def forest_roots(parents: DataFrame, child: str = "child", parent: str = "parent", local: int | None = None) -> DataFrame:
    """Root of every node of a forest given as child-parent links, by pointer jumping: (node, root).

    Up to ``local`` links (LOCAL_LINKS) one task follows them.
    """
    now = written(parents.select(F.col(child).alias("node"), F.col(parent).alias("root")), "roots")
    if now.count() <= (LOCAL_LINKS if local is None else local):
        return _in_one_task(now.select(F.col("node").alias("u"), F.col("root").alias("v")), _followed)
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved
        if moved.filter("moved").isEmpty():
            now = now.select("node", "root")
            tops = now.select(F.col("root").alias("node"), F.col("root")).distinct()
            return now.union(tops).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b", local: int | None = None) -> DataFrame:
    """Component of every node of an edge table: (node, component), the smallest node reachable.

    Every node hooks to its smallest neighbour, hooks are followed to their roots, and
    edges are rewritten to roots until at most ``local`` (LOCAL_LINKS) of them join
    different ones; those are finished by one task.
    """
    local = LOCAL_LINKS if local is None else local
    pairs = edges.select(F.least(F.col(a), F.col(b)).alias("u"), F.greatest(F.col(a), F.col(b)).alias("v"))
    work = written(pairs.filter("u <> v").distinct(), "edges")
    names = None
    while work.count() > local:
        both = work.union(work.select("v", "u"))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("child"), F.least("u", "v").alias("parent")).filter("child <> parent")
        roots = written(forest_roots(hook, local=local), "roots")
        up = roots.select(F.col("node").alias("component"), "root")
        # A node that is nobody's smaller neighbour and hooks nowhere is a root of its own.
        nodes = both.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component")) if names is None else names
        names = written(nodes.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "names")
        one, two = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = work.join(one, "u", "left").join(two, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        nxt = written(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        discard(work)
        work = nxt
    last = _in_one_task(work, _joined)
    if names is None:
        return last.select("node", F.col("root").alias("component"))
    last = written(last, "roots")
    names = written(names.join(last.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "names")
    least = names.groupBy("component").agg(F.min("node").alias("low"))
    return names.join(least, "component").select("node", F.least("low", "component").alias("component"))


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in ranges of a global order, written: ``_p`` numbers the ranges, ``_m`` ascends in each."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    return written(spread, "ordered")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add sums over all rows up to and with each row of a global order, by name.

    Ranges are summed up inside and offset by the sums of the ranges before, so no task
    sorts everything and a dense stretch of the order is cut into as many ranges as it needs.
    """
    spread = ranged(df, order)
    prior = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = spread.groupBy("_p").agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()])
    before = before.select("_p", *[F.sum(f"_b_{n}").over(prior).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    out = spread.select("*", *[F.sum(c).over(within).alias(f"_r_{n}") for n, c in sums.items()]).join(F.broadcast(before), "_p")  # one row a range
    return out.select(*df.columns, *[(F.coalesce(f"_r_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row in a global order.

    The written ranges know the place of each row in its range, so the sizes of the
    ranges before are all that is added; nothing is shuffled again.
    """
    spread = ranged(df, order)
    place = F.col("_m").bitwiseAND(F.lit(2**33 - 1))  # the rest of the id is the range's number
    prior = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = spread.groupBy("_p").agg((F.max(place) + 1).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_b"))
    return spread.join(F.broadcast(before), "_p").select(*df.columns, (place + F.col("_b")).alias(name))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row in its group; a group of any size is shared by tasks."""
    placed = written(numbered(df, [*map(F.col, by), *order], "_at"), "placed")
    first = placed.groupBy(*by).agg(F.min("_at").alias("_first"))
    return placed.join(first, by).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))
