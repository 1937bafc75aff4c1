"""Window declustering as range joins and a priority cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.functions.scalar import DAY_MS
from temblor.operators.components import numbered
from temblor.operators.neighbours import window_pairs
from temblor.scratch import discard, written

HARDEBECK_DAYS = 3 * 365.25


def gardner_knopoff_window(m: Column, single: tuple[float, float] | None = None) -> tuple[Column, Column]:
    """Radius in km and days of a mainshock; ``single`` replaces the two-part time law by 10**(c m + d)."""
    radius = F.pow(F.lit(10.0), 0.1238 * m + 0.983)
    if single:
        return radius, F.pow(F.lit(10.0), single[0] * m + single[1])
    return radius, F.when(m >= 6.5, F.pow(F.lit(10.0), 0.032 * m + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * m - 0.547))


def uhrhammer_window(m: Column) -> tuple[Column, Column]:
    return F.exp(-1.024 + 0.804 * m), F.exp(-2.870 + 1.235 * m)


def priority(prefix: str = "", by_time: bool = True) -> Column:
    """Rank of a row: larger first, then earlier, then by row_idx; smaller is higher."""
    parts = [(-F.col(f"{prefix}magnitude")).alias("m")]
    if by_time:
        parts.append(F.col(f"{prefix}timeMs").alias("t"))
    return F.struct(*parts, F.col({"": "row_idx", "m_": "main", "d_": "dep"}[prefix]).alias("i"))


def priority_cover(rows: DataFrame, covers: DataFrame) -> DataFrame:
    """Rows (row_idx) that are mains: not covered by a main of higher rank.

    ``covers`` has (main, dep) pairs whose main outranks its dep.  Rows without an
    undecided or main coverer become mains, rows covered by a main depend; each round
    settles the highest undecided rank, and in practice nearly everything.
    """
    waiting = written(covers.select("main", "dep"), "covers")
    mains = written(rows.select("row_idx").join(waiting.select(F.col("dep").alias("row_idx")), "row_idx", "left_anti"), "mains")
    found = mains
    while True:
        gone = written(waiting.join(mains.select(F.col("row_idx").alias("main")), "main", "left_semi").select("dep").distinct(), "gone")
        if gone.isEmpty():
            return found
        waiting_deps = waiting.join(gone, "dep", "left_anti")
        rest = written(waiting_deps.join(gone.select(F.col("dep").alias("main")), "main", "left_anti"), "covers")
        mains = written(waiting_deps.select("dep").distinct().join(rest.select("dep").distinct(), "dep", "left_anti").select(F.col("dep").alias("row_idx")), "mains")
        found = written(found.union(mains), "found")
        waiting = rest


def settled_mains(mains: DataFrame, by_time: bool, first: int = 1000, growth: int = 8) -> DataFrame:
    """Rows (row_idx) that are mains of their windows: not covered by a main of higher rank.

    Goes down the magnitudes in batches that grow by ``growth``.  A batch holds all
    undecided rows from a magnitude on, so it settles itself; what its mains cover is
    out before the next batch, and small rows are compared with mains only, never with
    every larger row around.
    """
    waiting, size, found = written(mains, "waiting"), first, None
    while n := waiting.count():
        least = None if n <= size else waiting.agg(F.percentile_approx("magnitude", 1 - size / n)).first()[0]
        here = F.lit(True) if least is None else F.coalesce(F.col("magnitude") >= least, F.lit(False))
        batch, rest = waiting.filter(here), waiting.filter(~here)
        covers = window_pairs(batch, batch).filter(priority("m_", by_time) < priority("d_", by_time)).select("main", "dep")
        settled = written(priority_cover(batch, covers), "settled")
        found = settled if found is None else found.union(settled)
        if least is None:
            break
        covered = window_pairs(batch.join(settled, "row_idx", "left_semi"), rest).select(F.col("dep").alias("row_idx")).distinct()
        nxt = written(rest.join(covered, "row_idx", "left_anti"), "waiting")
        discard(waiting)
        waiting, size = nxt, size * growth
    return found if found is not None else mains.select("row_idx")


def window_decluster(cat: DataFrame, window: tuple[Column, Column], foreshock_share: float = 1.0, by_time: bool = True) -> DataFrame:
    """(row_idx, cluster_id, is_main, dependent) of window declustering.

    Rows are taken larger first; a row not yet dependent is a mainshock and makes
    every row of its window dependent that is not, also a larger mainshock taken
    before.  A row in two clusters has the later one's number; clusters are numbered
    in the order of their mainshocks; a mainshock alone is noise, -1.
    """
    radius, days = window
    share = min(1.0, max(0.0, foreshock_share))
    rows = cat.select("row_idx", "latitude", "longitude", "timeMs", "magnitude")
    mains = rows.withColumn("radius_km", radius).withColumn("after_ms", days * DAY_MS).withColumn("before_ms", F.col("after_ms") * share)
    is_main = written(settled_mains(mains, by_time).withColumn("is_main", F.lit(True)), "mains")
    real = window_pairs(mains.join(is_main.select("row_idx"), "row_idx", "left_semi"), rows)
    member = written(real.groupBy("dep").agg(F.min(priority("m_", by_time)).alias("owner")), "members")
    owners = member.select(F.col("owner").alias("rank")).distinct()
    order = numbered(owners, [F.col("rank")], "cluster_id").select("rank", F.col("cluster_id").cast("int").alias("cluster_id"))
    order = written(order, "order")
    own = order.select(F.col("rank.i").alias("row_idx"), F.col("cluster_id").alias("own_id"))
    joined = rows.select("row_idx").join(is_main, "row_idx", "left").join(member.withColumnRenamed("dep", "row_idx"), "row_idx", "left").join(order, F.col("owner") == F.col("rank"), "left").join(own, "row_idx", "left")
    label = F.greatest(F.coalesce("cluster_id", F.lit(-1)), F.coalesce("own_id", F.lit(-1)))
    return joined.select("row_idx", label.alias("cluster_id"), F.coalesce("is_main", F.lit(False)).alias("is_main"), F.col("owner").isNotNull().alias("dependent"))


def gardner_knopoff(cat: DataFrame, single: tuple[float, float] | None = None, foreshock_share: float = 1.0) -> DataFrame:
    return window_decluster(cat, gardner_knopoff_window(F.col("magnitude"), single), foreshock_share)


def uhrhammer(cat: DataFrame, foreshock_share: float = 1.0) -> DataFrame:
    return window_decluster(cat, uhrhammer_window(F.col("magnitude")), foreshock_share)


def gardner_knopoff_mainshocks(cat: DataFrame) -> DataFrame:
    """Independent events of the two-part window, symmetric in time, ties by input order."""
    labels = window_decluster(cat, gardner_knopoff_window(F.col("magnitude")), 1.0, by_time=False)
    return cat.join(labels.filter("is_main and not dependent").select("row_idx"), "row_idx", "left_semi")


def _suppressed(cat: DataFrame, days: float, inclusive: bool, first: int = 2000, growth: int = 8) -> DataFrame:
    """row_idx of events after a strictly larger one, within a time and five rupture lengths of it.

    Goes down the magnitudes in batches of mains that grow by ``growth``; what a batch
    suppresses is looked for no more, so the many small mains meet the few events left.
    """
    rows = written(cat.select("row_idx", "latitude", "longitude", "timeMs", "magnitude"), "rows")
    mains = rows.withColumn("radius_km", 5 * geo.rupture_length_km(F.col("magnitude"))).withColumn("before_ms", F.lit(0)).withColumn("after_ms", F.lit(days * DAY_MS))
    n = rows.filter("magnitude is not null").count()
    sizes = [first * growth**i for i in range(40) if first * growth**i < n]
    edges = rows.agg(F.percentile_approx("magnitude", F.array(*[F.lit(1 - x / n) for x in sizes]), F.lit(100_000))).first()[0] if sizes else []
    waiting, above, found, total = rows, None, None, rows.count()
    for least in [*sorted(set(edges), reverse=True), None]:
        batch = mains if above is None else mains.filter(F.col("magnitude") < above)
        batch = batch if least is None else batch.filter(F.col("magnitude") >= least)
        left = waiting.count()
        pairs = window_pairs(batch, waiting, few_events=left * 4 < total).filter(F.col("m_magnitude") > F.col("d_magnitude"))
        if inclusive:
            pairs = pairs.filter((F.col("dt_ms") > 0) | ((F.col("dt_ms") == 0) & (F.col("main") < F.col("dep"))))
        else:
            pairs = pairs.filter((F.col("dt_ms") > 0) & (F.col("dt_ms") < days * DAY_MS))
        hit = written(pairs.select(F.col("dep").alias("row_idx")).distinct(), "suppressed")
        found = hit if found is None else found.union(hit)
        if least is None:
            return found
        rest = written(waiting.filter(F.col("magnitude") < least).join(hit, "row_idx", "left_anti"), "waiting")
        if waiting is not rows:
            discard(waiting)
        waiting, above = rest, least


def srl_mainshocks(cat: DataFrame, exclusion_days: float = HARDEBECK_DAYS, window_days: float = 10, rupture_multiple: float = 3) -> DataFrame:
    """Mainshock list in two stages of joins.

    Stage 1 drops events within ``exclusion_days`` after and five rupture lengths of a
    larger one.  Stage 2 drops what follows any remaining event within ``window_days``
    and ``rupture_multiple`` rupture lengths, 10 km at least, even if that event is dropped too.
    """
    valid = written(cat.join(_suppressed(cat, exclusion_days, True), "row_idx", "left_anti"), "valid")
    rows = valid.select("row_idx", "latitude", "longitude", "timeMs", "magnitude")
    mains = rows.withColumn("radius_km", F.greatest(F.lit(10.0), rupture_multiple * geo.rupture_length_km(F.col("magnitude")))).withColumn("before_ms", F.lit(0)).withColumn("after_ms", F.lit(window_days * DAY_MS))
    after = window_pairs(mains, rows).filter("dt_ms > 0").filter(F.col("m_magnitude") >= F.col("d_magnitude"))
    return valid.join(after.select(F.col("dep").alias("row_idx")).distinct(), "row_idx", "left_anti")


def hardebeck(cat: DataFrame, min_magnitude: float = 5, window_days: float = 10, rupture_multiple: float = 3, exclusion_days: float = HARDEBECK_DAYS) -> DataFrame:
    """(row_idx, cluster_id) of sequences of mainshocks that no larger event precedes nearby.

    Candidates of at least ``min_magnitude`` that stage 1 leaves are taken larger first;
    one without a cluster takes all events without one that follow within the window and
    max(10 km, multiple of its rupture length).  A mainshock alone is a cluster of one.
    """
    rows = cat.select("row_idx", "latitude", "longitude", "timeMs", "magnitude")
    large = rows.filter(F.col("magnitude") >= min_magnitude)  # only these can suppress one another
    valid = written(large.join(_suppressed(large, exclusion_days, False), "row_idx", "left_anti"), "valid")
    mains = valid.withColumn("radius_km", F.greatest(F.lit(10.0), rupture_multiple * geo.rupture_length_km(F.col("magnitude")))).withColumn("before_ms", F.lit(0)).withColumn("after_ms", F.lit(window_days * DAY_MS))
    pairs = window_pairs(mains, rows).filter("dt_ms > 0").withColumn("m_rank", priority("m_", False)).withColumn("d_rank", priority("d_", False))
    pairs = written(pairs.select("main", "dep", "m_rank", "d_rank"), "windows")
    inside = pairs.join(valid.select(F.col("row_idx").alias("dep")), "dep", "left_semi").filter("m_rank < d_rank")
    is_main = written(priority_cover(valid, inside), "mains")
    real = pairs.join(is_main.select(F.col("row_idx").alias("main")), "main", "left_semi").join(is_main.select(F.col("row_idx").alias("dep")), "dep", "left_anti")
    member = real.groupBy("dep").agg(F.min("m_rank").alias("rank")).withColumnRenamed("dep", "row_idx")
    heads = valid.join(is_main, "row_idx", "left_semi").select("row_idx", priority(by_time=False).alias("rank"))
    every = written(member.select("row_idx", "rank").union(heads), "every")
    order = numbered(heads.select("rank").distinct(), [F.col("rank")], "cluster_id")
    found = every.join(order, "rank").select("row_idx", F.col("cluster_id").cast("int").alias("cluster_id"))
    return rows.select("row_idx").join(found, "row_idx", "left").select("row_idx", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def aftershock_counts(mains: DataFrame, cat: DataFrame, window_days: float = 10, rupture_multiple: float = 3) -> DataFrame:
    """(row_idx, aftershocks): events after each mainshock in its window, without a radius floor."""
    sized = mains.withColumn("radius_km", rupture_multiple * geo.rupture_length_km(F.col("magnitude"))).withColumn("before_ms", F.lit(0)).withColumn("after_ms", F.lit(window_days * DAY_MS))
    counted = window_pairs(sized, cat).filter("dt_ms > 0").groupBy("main").agg(F.count("*").alias("aftershocks"))
    return mains.select("row_idx").join(counted, F.col("row_idx") == F.col("main"), "left").select("row_idx", F.coalesce("aftershocks", F.lit(0)).alias("aftershocks"))


def significant_mainshocks(cat: DataFrame, min_magnitude: float = 5.5, method: str = "srl", window_days: float = 10, more_than: int = 2, k: int = 10) -> DataFrame:
    """The k largest declustered mainshocks that have more than a few aftershocks."""
    large = cat.filter(F.col("magnitude") >= min_magnitude)
    mains = srl_mainshocks(large) if method == "srl" else gardner_knopoff_mainshocks(large)
    mains = written(mains, "mainshocks")
    counted = mains.join(aftershock_counts(mains, cat, window_days), "row_idx").filter(F.col("aftershocks") > more_than)
    return counted.orderBy(F.desc("magnitude"), "row_idx").limit(k)
