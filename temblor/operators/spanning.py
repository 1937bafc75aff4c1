"""Minimum spanning tree of mutual reachability, and the tree of merges it gives.

The mutual reachability of two rows is the largest of their distance and their core
distances.  The tree grows by distance: at each doubling of a radius only edges up to it
are looked for, between components that are not joined yet.  Components are told apart
in small cells; two components are compared only in cells that can hold their shortest
edge.  Nothing has a bound on the number of rows, of a place or of a component.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.functions import geo
from temblor.operators.components import connected, forest_roots, numbered
from temblor.scratch import discard, written

OFFSET, PER_KM, TOP = 32768.0, 1024, 26  # km to positive positions, finest cells a km, and doublings of them to one cell of 65,536 km
ALL_AROUND = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
SLACK = 1e-9  # bounds of boxes are widened by this share


def places(cat: DataFrame, planar: bool = False) -> DataFrame:
    """Distinct positions: ``node`` (smallest row_idx there), n rows, position in km and in finest cells; null positions are left out."""
    rows = cat.filter("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
    if planar:
        at = geo.projected(rows).select("row_idx", "latitude", "longitude", F.col("x_km").alias("x"), F.col("y_km").alias("y"), F.lit(0.0).alias("z"))
    else:
        la, lo = F.radians("latitude"), F.radians("longitude")
        at = rows.select("row_idx", "latitude", "longitude", (geo.EARTH_KM * F.cos(la) * F.cos(lo)).alias("x"), (geo.EARTH_KM * F.cos(la) * F.sin(lo)).alias("y"), (geo.EARTH_KM * F.sin(la)).alias("z"))
    nodes = at.groupBy("latitude", "longitude").agg(F.min("row_idx").alias("node"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in "xyz"])
    return nodes.select("node", "n", "latitude", "longitude", "x", "y", "z", *[F.floor((F.col(c) + OFFSET) * PER_KM).cast("bigint").alias(f"i{c}") for c in "xyz"])


def _apart(planar: bool) -> Column:
    """Distance of the positions of two sides a and b."""
    if planar:
        return F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return geo.haversine_km("alatitude", "alongitude", "blatitude", "blongitude")


def _arc(chord: Column, planar: bool) -> Column:
    return chord if planar else 2 * geo.EARTH_KM * F.asin(F.least(F.lit(1.0), chord / (2 * geo.EARTH_KM)))


def _side(df: DataFrame, side: str, names: list[str]) -> list[Column]:
    return [F.col(c).alias(f"{side}{c}") for c in names]


def _cell(level) -> list[Column]:
    return [F.expr(f"shiftright(i{c}, {level})").alias(f"c{c}") for c in "xyz"]


def core_distances(nodes: DataFrame, k: int, planar: bool = False) -> DataFrame:
    """(node, core): distance to the ``k``-th nearest other row, rows of one position counted each.

    The smallest of its nested cells that holds more than ``k`` rows bounds a node's
    distance, so one look at the cells around settles it, in dense and thin places alike.
    ``k`` must be smaller than the number of rows.
    """
    nested = nodes.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(TOP)))).select("node", "n", "lv", *_cell("lv"))
    full = nested.groupBy("lv", "cx", "cy", "cz").agg(F.sum("n").alias("held")).filter(F.col("held") > k)
    level = nested.join(full.hint("merge"), ["lv", "cx", "cy", "cz"]).groupBy("node").agg(F.min("lv").alias("lv"))
    asked = written(nodes.join(level.hint("merge"), "node").withColumn("reach", F.lit(3.0**0.5 * (1 + SLACK)) * F.pow(F.lit(2.0), F.col("lv")) / PER_KM).withColumn("lv", F.col("lv") + 1), "asked")
    used = [r.lv for r in asked.select("lv").distinct().collect()]  # at most 27 levels
    if not used:
        return nodes.select("node", F.lit(None).cast("double").alias("core"))
    size = F.pow(F.lit(2.0), F.col("lv")) / PER_KM
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{c}") for v, c in zip(o, "xyz", strict=True)]) for o in ALL_AROUND])).alias("o")
    left = asked.select("lv", "reach", *_side(asked, "a", ["node", "latitude", "longitude", "x", "y", "z"]), *_cell("lv"), around)
    left = left.select("*", *[(F.col(f"c{c}") + F.col(f"o.o{c}")).alias(f"d{c}") for c in "xyz"])
    gap = [F.greatest(F.lit(0.0), F.col(f"d{c}") * size - OFFSET - F.col(f"a{c}"), F.col(f"a{c}") - ((F.col(f"d{c}") + 1) * size - OFFSET)) for c in "xyz"]
    left = left.filter(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2 <= F.col("reach") ** 2).drop("cx", "cy", "cz", "o")
    right = nodes.withColumn("lv", F.explode(F.array(*[F.lit(x) for x in used]))).select("lv", *[c.alias(f"d{n}") for c, n in zip(_cell("lv"), "xyz", strict=True)], *_side(nodes, "b", ["node", "n", "latitude", "longitude", "x", "y", "z"]))
    chord = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2
    near = left.join(right.hint("merge"), ["lv", "dx", "dy", "dz"]).filter(chord <= F.col("reach") ** 2).select("anode", "bnode", "bn", F.when(F.col("anode") == F.col("bnode"), F.lit(0.0)).otherwise(_apart(planar)).alias("d"))
    upto = F.sum("bn").over(Window.partitionBy("anode").orderBy("d", "bnode").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("upto", upto).filter(F.col("upto") > k).groupBy(F.col("anode").alias("node")).agg(F.min("d").alias("core"))


def _lightest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("c1", "c2").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("c1", "c2", "e.*")


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forest edges of one small edge table, and the new name of every component in it."""
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while top.setdefault(i, i) != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    rows = []
    for e in pdf.sort_values(["w", "a", "b"]).itertuples(index=False):
        one, two = find(e.c1), find(e.c2)
        if one != two:
            top[max(one, two)] = min(one, two)
            rows.append((e.w, e.a, e.b, None, None))
    rows += [(None, None, None, c, find(c)) for c in list(top)]
    kinds = {"w": "Float64", "a": "Int64", "b": "Int64", "c": "Int64", "root": "Int64"}
    return pd.DataFrame({n: pd.array(list(v), dtype=k) for (n, k), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})


def _forest(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """Lightest forest of a written table of edges between components: (w, a, b), and (c, root).

    Every component takes its lightest edge and joins its neighbour, round by round;
    what is left below ``local_edges`` is finished in one task.  Weights are ordered by
    (w, a, b), so the forest is the same either way.
    """
    found, names = None, None
    while edges.count() > local_edges:
        ways = edges.select("c1", "c2", "w", "a", "b").union(edges.select("c2", "c1", "w", "a", "b"))
        best = written(ways.groupBy(F.col("c1").alias("c")).agg(F.min(F.struct("w", "a", "b", F.col("c2").alias("to"))).alias("e")).select("c", "e.*"), "best")
        back = best.select(F.col("c").alias("to"), F.col("to").alias("again"))
        links = best.join(back, "to").filter("not (again = c and c < to)").select(F.col("c").alias("child"), F.col("to").alias("parent"))
        roots = written(forest_roots(links), "roots").select(F.col("node").alias("c"), "root")
        chosen = best.select("w", "a", "b").distinct()
        found = chosen if found is None else found.union(chosen)
        names = written(roots if names is None else _renamed(names, roots), "names")
        moved = edges.join(roots.select(F.col("c").alias("c1"), F.col("root").alias("r1")), "c1").join(roots.select(F.col("c").alias("c2"), F.col("root").alias("r2")), "c2").filter("r1 <> r2")
        edges = written(_lightest(moved.select(F.least("r1", "r2").alias("c1"), F.greatest("r1", "r2").alias("c2"), "w", "a", "b")), "edges")
    rest = written(edges.groupBy().applyInPandas(_kruskal, "w double, a bigint, b bigint, c bigint, root bigint"), "forest")
    last, kept = rest.filter("c is not null").select("c", "root"), rest.filter("c is null").select("w", "a", "b")
    return (kept, last) if found is None else (found.union(kept), _renamed(names, last))


def _renamed(names: DataFrame, later: DataFrame) -> DataFrame:
    """Names followed through a later renaming."""
    after = later.select(F.col("c").alias("root"), F.col("root").alias("after"))
    return names.join(after, "root", "left").select("c", F.coalesce("after", "root").alias("root"))


def spanning_tree(cat: DataFrame, min_samples: int = 5, planar: bool = False, local_edges: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Edges (w, a, b) of the minimum spanning tree over ``row_idx``, and (row_idx, core).

    ``core`` is the distance to the ``min_samples``-th nearest other row, or to the
    farthest if there are fewer.  Edges are ordered by (w, a, b) with a < b, so the tree
    is unique; rows of one position hang on the one with the smallest row_idx, by edges
    as long as their core distance.  Rows without a position are in neither result.
    """
    nodes = written(places(cat, planar), "places")
    total = nodes.agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).first()
    if not total.nodes:
        empty = cat.sparkSession.createDataFrame([], "w double, a bigint, b bigint")
        return empty, cat.sparkSession.createDataFrame([], "row_idx bigint, core double")
    k = min(min_samples, total.rows - 1)
    cores = core_distances(nodes, k, planar) if k else nodes.select("node", F.lit(0.0).alias("core"))
    nodes = written(nodes.join(cores, "node").withColumn("comp", F.col("node")), "nodes")
    first = nodes
    # The first radius is the one that some hundred nodes have as core distance; below it few pairs are to be found.
    by_level = nodes.groupBy(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("core"), F.lit(1.0 / PER_KM)) * PER_KM))).cast("int").alias("level")).agg(F.count("*").alias("n")).orderBy("level").collect()  # 27 rows at most
    held, level = 0, 0
    for r in by_level:
        held, level = held + r.n, r.level
        if held >= 500:
            break
    tree, joined = [], 0
    while joined < total.nodes - 1:
        reach, fine = 2.0**level / PER_KM, max(0, level - 2)
        live = nodes.filter(F.col("core") <= reach)
        box = [f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
        groups = live.groupBy("comp", *_cell(fine)).agg(*box, F.min("core").alias("soon"), F.max("core").alias("late"))
        names = ["comp", "cx", "cy", "cz", *[f"{n}{c}" for n in ("lo", "hi") for c in "xyz"], "soon", "late"]
        big = [F.expr(f"shiftright(c{c}, {level - fine})") for c in "xyz"]
        around = F.explode(F.array(*[F.struct(*[(big[i] + o[i]).alias(f"d{c}") for i, c in enumerate("xyz")]) for o in ALL_AROUND])).alias("o")
        one = groups.select(*_side(groups, "a", names), around).select("*", "o.*").drop("o")
        two = groups.select(*_side(groups, "b", names), *[b.alias(f"d{c}") for b, c in zip(big, "xyz", strict=True)])
        gap = [F.greatest(F.lit(0.0), F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}")) for c in "xyz"]
        span = [F.greatest(F.col(f"bhi{c}") - F.col(f"alo{c}"), F.col(f"ahi{c}") - F.col(f"blo{c}")) for c in "xyz"]
        near, far = (F.sqrt(v[0] ** 2 + v[1] ** 2 + v[2] ** 2) for v in (gap, span))
        meet = one.join(two, ["dx", "dy", "dz"]).filter("acomp < bcomp").withColumn("least", F.greatest("asoon", "bsoon", near * (1 - SLACK))).filter(F.col("least") <= reach)
        meet = meet.select("acomp", "acx", "acy", "acz", "bcomp", "bcx", "bcy", "bcz", "least", F.greatest("alate", "blate", _arc(far, planar) * (1 + SLACK)).alias("most"))
        meet = written(meet, "cells")
        bound = meet.groupBy("acomp", "bcomp").agg(F.min("most").alias("bound"))
        meet = meet.join(bound, ["acomp", "bcomp"]).filter("least <= bound").select("acomp", "acx", "acy", "acz", "bcomp", "bcx", "bcy", "bcz")
        keep = ["node", "comp", "core", "latitude", "longitude", "x", "y"]
        left, right = (live.select(*_side(live, s, keep), *[c.alias(f"{s}c{n}") for c, n in zip(_cell(fine), "xyz", strict=True)]) for s in "ab")
        pairs = meet.join(left, ["acomp", "acx", "acy", "acz"]).join(right, ["bcomp", "bcx", "bcy", "bcz"])
        pairs = pairs.withColumn("w", F.greatest("acore", "bcore", _apart(planar))).filter(F.col("w") <= reach)
        edges = written(_lightest(pairs.select(F.col("acomp").alias("c1"), F.col("bcomp").alias("c2"), "w", F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"))), "edges")
        level += 1
        if edges.isEmpty():
            continue
        kept, named = _forest(edges, local_edges)
        tree.append(kept)
        joined += kept.count()
        nodes = written(nodes.join(named.select(F.col("c").alias("comp"), "root"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"), "nodes")
    located = cat.filter("latitude is not null and longitude is not null").select("row_idx", "latitude", "longitude").join(first.select("latitude", "longitude", "node", "core"), ["latitude", "longitude"])
    same = located.filter("row_idx <> node").select(F.col("core").alias("w"), F.col("node").alias("a"), F.col("row_idx").alias("b"))
    for more in tree:
        same = same.union(more)
    return same, located.select("row_idx", "core")


def merges(tree: DataFrame, local_edges: int = 100_000) -> DataFrame:
    """Single-linkage merges of a spanning tree: (id, w, left, right, left_size, right_size).

    Rows are nodes 2 * row_idx, the merge of the edge with rank r (by w, a, b) is node
    2 * r + 1; ``left`` holds the edge's ``a``.  Ranges of ranks are halved until none has more than
    ``local_edges``: the components of the lighter half become single nodes of the
    heavier one, and then ranges do not depend on each other.
    """
    ranked = numbered(tree, [F.col("w"), F.col("a"), F.col("b")], "rank")
    now = written(ranked.select(F.lit(0).cast("bigint").alias("part"), "rank", "w", (F.col("a") * 2).alias("u"), (F.col("b") * 2).alias("v")), "ranges")
    sizes = None
    while True:
        wide = now.groupBy("part").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).filter(F.col("hi") - F.col("lo") >= local_edges)
        wide = written(wide.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2)), "wide")  # a row a range
        if wide.isEmpty():
            break
        split = written(now.join(F.broadcast(wide), "part", "left"), "split")
        light = split.filter("rank <= mid")
        comp = connected(light, "u", "v")  # (node, component)
        top = light.select("rank", F.col("u").alias("node")).join(comp, "node").groupBy("component").agg((F.max("rank") * 2 + 1).alias("merged"))
        own = comp if sizes is None else comp.join(sizes, "node", "left")
        held = own.groupBy("component").agg(F.sum(F.lit(1) if sizes is None else F.coalesce("size", F.lit(1))).alias("size"))
        renamed = written(comp.join(top, "component").join(held, "component").select("node", "merged", "size"), "renamed")
        more = renamed.select(F.col("merged").alias("node"), "size").distinct()
        # A component without an edge in the upper half of its range comes again, by the same name, when the lower half is cut.
        sizes = written(more if sizes is None else sizes.union(more).distinct(), "sizes")
        heavy = split.filter("rank > mid")
        for side in "uv":
            heavy = heavy.join(renamed.select(F.col("node").alias(side), F.col("merged").alias(f"{side}2")), side, "left").withColumn(side, F.coalesce(f"{side}2", side)).drop(f"{side}2")
        rest = split.filter("mid is null").select("part", "rank", "w", "u", "v")
        low, high = (half.select((F.col("part") * 2 + i).alias("part"), "rank", "w", "u", "v") for i, half in ((1, light), (2, heavy)))
        # Parts are numbered as in a heap, so halves never meet a part of another branch.
        nxt = written(rest.union(low).union(high), "ranges")
        discard(now)
        now = nxt
    if sizes is not None:
        for side in "uv":
            now = now.join(sizes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size")), side, "left")
    else:
        now = now.withColumn("u_size", F.lit(None).cast("bigint")).withColumn("v_size", F.lit(None).cast("bigint"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}
        at: dict[int, int] = {}
        size: dict[int, int] = {}

        def find(i: int, n: float) -> int:
            if i not in top:
                top[i], at[i], size[i] = i, i, 1 if pd.isna(n) else int(n)
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        out = []
        for e in pdf.sort_values("rank").itertuples(index=False):
            a, b = find(e.u, e.u_size), find(e.v, e.v_size)
            out.append((2 * e.rank + 1, e.w, at[a], at[b], size[a], size[b]))
            if size[a] < size[b]:
                a, b = b, a
            top[b], at[a], size[a] = a, 2 * e.rank + 1, size[a] + size[b]
        return pd.DataFrame(out, columns=["id", "w", "left", "right", "left_size", "right_size"])

    return written(now.groupBy("part").applyInPandas(link, "id bigint, w double, left bigint, right bigint, left_size bigint, right_size bigint"), "merges")
