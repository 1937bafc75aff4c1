"""Registered catalogue queries and the SQL that must give the same rows.

Every query runs over the whole ``events`` table, seen as an earthquake catalogue.
Floating-point results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor import schema
from temblor.functions import geo, scalar
from temblor.operators import aftershock_fits, aftershocks, clusters, declustering, density, filters, frequency, hierarchy, incremental, links, neighbours, sampling, sequences, spanning, statistics
from temblor.sources import sinks
from temblor.sources.events import SHARED, catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CAT = f"cat AS (SELECT {SHARED}, epoch_us(ts) // 1000 AS timeMs FROM events)"
POLYGON = ((170.0, -45.0), (176.5, -44.0), (177.5, -38.0), (172.0, -36.0), (168.5, -41.0))
MAIN = (1_705_000_000_000, 4.0)  # of the decay queries: a fixed instant inside the data, and a magnitude


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(6371e0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def query(sql: str | None = None):
    """Register a function (catalogue, spark) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalogue(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql if "WITH" in sql[:20] else f"WITH {CAT} {sql}"
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("SELECT row_idx, eventID, timeMs, latitude, longitude, depth, magnitude, eventType FROM cat")
def catalogue_view(cat):
    return cat.select("row_idx", "eventID", "timeMs", "latitude", "longitude", "depth", "magnitude", "eventType")


def _places() -> str:
    rows = ", ".join("({}, '{}', {!r}::DOUBLE, {!r}::DOUBLE)".format(i, n.replace("'", "''"), a, o) for i, (n, a, o) in enumerate(schema.PLACES))
    return f"places(no, name, plat, plon) AS (VALUES {rows})"


def _regions() -> str:
    rows = ", ".join("({}, '{}', {!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE, {})".format(i, r[0].replace("'", "''"), *r[1:]) for i, r in enumerate(schema.REGIONS))
    return f"regions(no, region, a, b, w, e, pr) AS (VALUES {rows})"


@query(f"""WITH {CAT}, {_places()}, {_regions()},
    near AS (SELECT row_idx, min(struct_pack(d := {km("latitude", "longitude", "plat", "plon")}, no := no)) AS m FROM cat, places GROUP BY row_idx),
    reg AS (SELECT row_idx, arg_min(region, struct_pack(p := -pr, n := no)) AS region FROM cat JOIN regions ON latitude BETWEEN a AND b AND longitude BETWEEN w AND e GROUP BY row_idx)
    SELECT cat.row_idx, floor(magnitude)::BIGINT AS magBin, CASE WHEN depth <= 70 THEN 'shallow' WHEN depth <= 300 THEN 'intermediate' ELSE 'deep' END AS depthCategory,
        year(make_timestamp(timeMs * 1000))::INTEGER AS year,
        CASE WHEN m.d < 30 THEN 'Near ' || name
             WHEN m.d < 100 THEN floor(m.d + 0.5)::BIGINT || ' km ' || (['N','NE','E','SE','S','SW','W','NW'])[(floor((((degrees(atan2(longitude - plon, latitude - plat)) + 360) % 360) / 45) + 0.5)::INTEGER % 8) + 1] || ' of ' || name
             WHEN region IS NOT NULL THEN region WHEN latitude < -47 THEN 'South of New Zealand' WHEN latitude > -34 THEN 'North of New Zealand'
             WHEN longitude > 179 OR longitude < -175 THEN 'East of New Zealand' WHEN longitude < 166 THEN 'West of New Zealand' ELSE 'New Zealand region' END AS locality
    FROM cat JOIN near USING (row_idx) JOIN places ON places.no = m.no LEFT JOIN reg USING (row_idx)""")
def enrich(cat):
    return filters.enriched(cat).select("row_idx", "magBin", "depthCategory", "year", "locality")


@query("SELECT row_idx, magnitude, depth FROM cat WHERE magnitude BETWEEN 2.5 AND 4.5 AND depth <= 70 AND timeMs BETWEEN epoch_ms(TIMESTAMP '2024-01-05') AND epoch_ms(TIMESTAMP '2024-01-21') - 1")
def filter_dashboard(cat):
    rule = filters.CatalogueFilter(min_magnitude=2.5, max_magnitude=4.5, depth_category="shallow", start="2024-01-05", end="2024-01-20")
    return filters.apply(cat, rule, "time").select("row_idx", "magnitude", "depth")


def _edges() -> str:
    pts = list(zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True))
    return "edges(xi, yi, xj, yj) AS (VALUES " + ", ".join(f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for a, b in pts) + ")"


@query(f"""WITH {CAT}, {_edges()}, shifts(s) AS (VALUES (0), (360), (-360))
    SELECT DISTINCT row_idx FROM (SELECT row_idx, s FROM cat, shifts, edges WHERE (yi > latitude) <> (yj > latitude)
        AND longitude + s < (xj - xi) * (latitude - yi) / (yj - yi) + xi GROUP BY row_idx, s HAVING count(*) % 2 = 1)""")
def filter_polygon(cat):
    return filters.apply(cat, filters.CatalogueFilter(polygon=POLYGON)).select("row_idx")


@query("SELECT row_idx FROM cat WHERE longitude BETWEEN 163 AND 179.9 AND latitude BETWEEN -49 AND -27 AND isfinite(latitude)")
def filter_network_box(cat):
    return cat.filter(geo.in_box() & geo.plottable()).select("row_idx")


@query(f"""SELECT row_idx, round(distance_km, 6) AS distance_km, round(days, 6) AS days FROM (SELECT row_idx, {km("latitude", "longitude", "-42e0", "173e0")} AS distance_km,
    (timeMs - {MAIN[0]}) / 86400000e0 AS days FROM cat) WHERE distance_km <= 150 AND days BETWEEN -30 AND 365""")
def events_around(cat):
    return filters.around_event(cat, -42.0, 173.0, MAIN[0], 150.0).select("row_idx", *r6("distance_km", "days"))


@query("SELECT row_idx FROM cat WHERE abs(timeMs - (SELECT timeMs FROM cat WHERE row_idx = 77)) < 60000 AND abs(magnitude - (SELECT magnitude FROM cat WHERE row_idx = 77)) < 0.5 ORDER BY row_idx LIMIT 1")
def find_event(cat):
    known = cat.filter("row_idx = 77").select("timeMs", "magnitude").first()
    return filters.find_event(cat, known.timeMs, known.magnitude).select("row_idx")


@query("SELECT strftime(make_timestamp(min(timeMs) * 1000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(max(timeMs) * 1000), '%Y-%m-%d') AS last_day FROM cat")
def data_range(cat):
    return filters.data_range(cat)


@query("SELECT arg_max(row_idx, struct_pack(m := magnitude, t := -timeMs, i := -row_idx)) AS row_idx, eventType FROM cat GROUP BY eventType")
def auto_mainshock(cat):
    return filters.auto_mainshock(cat, ["eventType"]).select("row_idx", "eventType")


@query(f"""SELECT count(*) AS events, greatest(0, max(magnitude)) AS max_magnitude, round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth FROM cat""")
def summary_stats(cat):
    return statistics.summary(cat).withColumn("mean_depth", F.round("mean_depth", 6))


@query("""SELECT CASE WHEN depth < 70 THEN 'shallow' WHEN depth < 300 THEN 'intermediate' ELSE 'deep' END AS depth_class,
    CASE WHEN magnitude < 3 THEN '<3' WHEN magnitude < 4 THEN '3-4' WHEN magnitude < 5 THEN '4-5' WHEN magnitude < 6 THEN '5-6' ELSE '6+' END AS magnitude_class, count(*) AS events FROM cat GROUP BY ALL""")
def counts_by_class(cat):
    return cat.groupBy(scalar.depth_class(F.col("depth")).alias("depth_class"), scalar.magnitude_class(F.col("magnitude")).alias("magnitude_class")).agg(F.count("*").alias("events"))


@query("""SELECT array_to_string(list_sort(list_distinct(list(floor(magnitude)::BIGINT))), ',') AS magnitude_bins, min(year(make_timestamp(timeMs * 1000)))::INTEGER AS first_year, max(year(make_timestamp(timeMs * 1000)))::INTEGER AS last_year,
    count(*) FILTER (depth <= 70) AS shallow, count(*) FILTER (depth > 70 AND depth <= 300) AS intermediate, count(*) FILTER (depth > 300) AS deep FROM cat""")
def enhancement_stats(cat):
    return statistics.enhancement_stats(cat).withColumn("magnitude_bins", F.array_join(F.transform("magnitude_bins", lambda x: x.cast("string")), ","))


@query("""WITH """ + CAT + """, d AS (SELECT make_timestamp(timeMs * 1000)::DATE AS day, count(*) AS events FROM cat GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(events, 0)::BIGINT AS events, CASE WHEN row_number() OVER w >= 7 THEN round(avg(coalesce(events, 0)) OVER (ORDER BY day ROWS 6 PRECEDING), 6) END AS moving_mean
    FROM s LEFT JOIN d USING (day) WINDOW w AS (ORDER BY day)""")
def daily_counts(cat):
    return statistics.daily_counts(cat).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events", *r6("moving_mean"))


GAPS = f"{CAT}, gaps AS (SELECT (timeMs - lag(timeMs) OVER (ORDER BY timeMs, row_idx)) / 3600000e0 AS h FROM cat QUALIFY h IS NOT NULL)"


@query(f"""WITH {GAPS}, r AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n FROM gaps)
    SELECT max(n)::BIGINT AS n, round(avg(h), 6) AS mean_hours, round(max(h) FILTER (i = n // 2), 6) AS median_hours, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours, round(stddev_pop(h), 6) AS std_hours,
    round(24 / avg(h), 6) AS events_per_day, round(stddev_pop(h) / avg(h), 6) AS variation FROM r""")
def inter_event_stats(cat):
    return statistics.inter_event_stats(cat).select("n", *r6("mean_hours", "median_hours", "min_hours", "max_hours", "std_hours", "events_per_day", "variation"))


@query(f"""WITH {GAPS}, r AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS n, avg(h) OVER () AS m FROM gaps),
    t AS (SELECT greatest(max(h) FILTER (i = floor(0.95 * (n - 1))), max(m) / 2) AS top, max(m) AS m, greatest(max(h) FILTER (i = floor(0.95 * (n - 1))), max(m) / 2) / 25 AS w FROM r),
    c AS (SELECT least(floor(h / w)::BIGINT, 24) AS bin, count(*) AS events FROM gaps, t WHERE h <= top GROUP BY 1), k AS (SELECT sum(events) AS n FROM c)
    SELECT s.bin::BIGINT AS bin, round(s.bin * w, 6) AS lo, round((s.bin + 1) * w, 6) AS hi, coalesce(events, 0)::BIGINT AS events, round(n * (exp(-(s.bin * w) / m) - exp(-((s.bin + 1) * w) / m)), 6) AS expected
    FROM (SELECT unnest(range(25)) AS bin) s CROSS JOIN t CROSS JOIN k LEFT JOIN c USING (bin)""")
def inter_event_histogram(cat):
    return statistics.inter_event_histogram(cat).select("bin", *r6("lo", "hi"), F.col("events").cast("bigint").alias("events"), *r6("expected"))


@query("""SELECT row_idx, row_number() OVER w AS events, round(log10(sum(pow(10, 1.5 * magnitude + 9.1)) OVER w), 6) AS log_moment FROM cat WINDOW w AS (ORDER BY timeMs, row_idx)""")
def cumulative_moment(cat):
    return statistics.cumulative(cat).select("row_idx", "events", F.round(F.log10("moment"), 6).alias("log_moment"))


def _hist(value: str, bins: int, width: str = "") -> str:
    w = width or f"CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1 END"
    return f"""WITH {CAT}, v AS (SELECT {value} AS v FROM cat), s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v), p AS (SELECT *, {w} AS w FROM s),
    c AS (SELECT least(floor((v - lo) / w)::BIGINT, {bins - 1}) AS bin, count(*) AS events FROM v, p GROUP BY 1)
    SELECT b.bin::BIGINT AS bin, round(lo + b.bin * w, 6) AS lo, round(lo + (b.bin + 1) * w, 6) AS hi, coalesce(events, 0)::BIGINT AS events, round(coalesce(events, 0) / (n * w), 6) AS density,
    (sum(coalesce(events, 0)) OVER d)::BIGINT AS at_least, round(sum(coalesce(events, 0)) OVER d / n, 6) AS survival, round(CASE WHEN events > 0 THEN log10(events) END, 6) AS log10_events
    FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN p LEFT JOIN c USING (bin) WINDOW d AS (ORDER BY b.bin DESC)"""


def _rounded_hist(h: DataFrame) -> DataFrame:
    return h.select("bin", *r6("lo", "hi"), F.col("events").cast("bigint").alias("events"), *r6("density"), "at_least", *r6("survival", "log10_events"))


@query(_hist("magnitude", 30))
def magnitude_histogram(cat):
    return _rounded_hist(statistics.histogram(cat, "magnitude", 30))


@query(_hist("depth", 20))
def depth_histogram(cat):
    return _rounded_hist(statistics.histogram(cat, "depth", 20))


@query(_hist("hour(make_timestamp(timeMs * 1000))::DOUBLE", 24, "1e0"))
def hour_histogram(cat):
    return _rounded_hist(statistics.histogram(cat, "hour"))


@query("""WITH """ + CAT + """, t AS (SELECT eventType, count(*) AS n FROM cat GROUP BY 1 ORDER BY n DESC, eventType LIMIT 2)
    SELECT CASE WHEN eventType IN (SELECT eventType FROM t) THEN eventType ELSE 'Other' END AS grp, count(*) AS events FROM cat GROUP BY 1""")
def top_values(cat):
    return statistics.top_values(cat, "eventType", 2).groupBy("grp").agg(F.count("*").alias("events"))


@query("""WITH """ + CAT + """, e AS (SELECT quantile_cont(depth, [0.2, 0.4, 0.6, 0.8]) AS q FROM cat)
    SELECT (CASE WHEN depth < q[1] THEN 0 WHEN depth < q[2] THEN 1 WHEN depth < q[3] THEN 2 WHEN depth < q[4] THEN 3 ELSE 4 END)::INTEGER AS grp, count(*) AS events FROM cat, e GROUP BY 1""")
def quantile_groups(cat):
    return statistics.quantile_groups(cat, "depth").groupBy("grp").agg(F.count("*").alias("events"))


@query("""SELECT eventType, count(*) AS n, round(avg(depth), 6) AS mean, min(depth) AS low, max(depth) AS high, quantile_disc(depth, 0.5) AS p50, quantile_disc(depth, 0.95) AS p95, quantile_disc(depth, 0.99) AS p99 FROM cat GROUP BY 1""")
def nearest_rank_stats(cat):
    return statistics.nearest_rank_stats(cat, "depth", "eventType").withColumn("mean", F.round("mean", 6)).drop("success_rate")


@query("SELECT floor(min(depth) / 10) * 10 AS depth_lo, ceil(max(depth) / 10) * 10 AS depth_hi, round(min(magnitude) - (max(magnitude) - min(magnitude)) * 0.05, 6) AS mag_lo, round(max(magnitude) + (max(magnitude) - min(magnitude)) * 0.05, 6) AS mag_hi FROM cat")
def axis_ranges(cat):
    return statistics.axis_ranges(cat).select(F.col("depth_lo").cast("double").alias("depth_lo"), F.col("depth_hi").cast("double").alias("depth_hi"), *r6("mag_lo", "mag_hi"))


@query("""WITH """ + CAT + """, n AS (SELECT count(*) AS total FROM cat), p AS (SELECT floor(magnitude) AS bin, count(*) AS n, min(row_idx) AS f FROM cat GROUP BY 1),
    w AS (SELECT bin, n, f, greatest(1, floor(500e0 * n / total)::BIGINT) AS want FROM p, n), k AS (SELECT *, greatest(1, n // want) AS step FROM w),
    r AS (SELECT row_idx, f, step, row_number() OVER (PARTITION BY bin ORDER BY row_idx) AS rn FROM (SELECT row_idx, floor(magnitude) AS bin FROM cat) JOIN k USING (bin))
    SELECT row_idx FROM (SELECT row_idx, f, rn FROM r WHERE (rn - 1) % step = 0 ORDER BY f, rn LIMIT 500)""")
def stratified_sample(cat):
    return sampling.stratified(cat, 500).select("row_idx")


@query("SELECT row_idx, magnitude FROM cat ORDER BY magnitude DESC, row_idx LIMIT 10")
def largest_events(cat):
    return sampling.largest(cat, 10).select("row_idx", "magnitude")


GR = """gs AS (SELECT min(magnitude) AS lo, max(magnitude) AS hi FROM cat), gc AS (SELECT floor((magnitude - lo) / 0.1e0)::BIGINT AS bin, count(*) AS events FROM cat, gs GROUP BY 1),
    gb AS (SELECT b.bin, lo + b.bin * 0.1e0 AS edge, coalesce(events, 0)::BIGINT AS events, (sum(coalesce(events, 0)) OVER (ORDER BY b.bin DESC))::BIGINT AS at_least
        FROM (SELECT lo, unnest(range(0, ceil((hi - lo) / 0.1e0)::BIGINT + 1)) AS bin FROM gs) b LEFT JOIN gc USING (bin))"""


def _law(mc: str) -> str:
    return f"""WITH {CAT}, {GR}, mc AS ({mc}), n AS (SELECT mc, count(*) AS n, avg(magnitude) AS m, var_samp(magnitude) AS v FROM cat, mc WHERE magnitude >= mc GROUP BY mc),
    f AS (SELECT *, log10(exp(1)) / (m - (mc - 0.1e0 / 2)) AS b FROM n), l AS (SELECT regr_r2(log10(at_least), edge) AS r2 FROM gb, mc WHERE edge >= mc - 1e-9 AND at_least > 0)
    SELECT {q6("mc")}, n, {q6("b")}, round(log10(n) + b * mc, 6) AS a, round(2.30e0 * b * b * sqrt(v / n), 6) AS sigma_b, {q6("r2")} FROM f, l"""


@query(f"WITH {CAT}, {GR} SELECT bin::BIGINT AS bin, {q6('edge')}, events, at_least FROM gb")
def gr_bins(cat):
    return frequency.bins(cat).select("bin", *r6("edge"), "events", "at_least")


@query(f"WITH {CAT}, {GR}, i AS (SELECT bin, at_least - coalesce(lead(at_least) OVER (ORDER BY bin), 0) AS incremental FROM gb) SELECT bin::BIGINT AS bin, incremental::BIGINT AS incremental FROM i WHERE incremental > 0")
def gr_incremental(cat):
    return frequency.incremental(frequency.bins(cat)).select("bin", "incremental")


CURVATURE = "SELECT arg_min(edge, struct_pack(e := -events, b := bin)) AS mc FROM gb"


@query(_law(CURVATURE))
def gr_fit(cat):
    return frequency.fit(cat).select(*r6("mc"), "n", *r6("b", "a", "sigma_b", "r2"))


@query(_law("SELECT 3e0 AS mc"))
def gr_fit_given(cat):
    return frequency.fit(cat, method="given", mc=3.0).select(*r6("mc"), "n", *r6("b", "a", "sigma_b", "r2"))


@query(_law("""SELECT coalesce((SELECT arg_min(mc, start) FROM (SELECT start, mc, sum(abs(at_least - pow(10, a - b * edge))) / sum(at_least) AS r FROM (
        SELECT g.bin AS start, g.edge AS mc, log10(exp(1)) / (avg(magnitude) - (g.edge - 0.1e0 / 2)) AS b, log10(count(*)) + log10(exp(1)) / (avg(magnitude) - (g.edge - 0.1e0 / 2)) * g.edge AS a
        FROM gb g, gs, cat WHERE floor((magnitude - lo) / 0.1e0) >= g.bin AND g.bin < (SELECT max(bin) FROM gb) - 1 AND g.at_least >= 10 GROUP BY 1, 2) z JOIN gb ON gb.bin >= z.start GROUP BY 1, 2) WHERE r <= 0.10), (""" + CURVATURE + ")) AS mc"))
def gr_fit_goodness(cat):
    return frequency.fit(cat, method="goodness").select(*r6("mc"), "n", *r6("b", "a", "sigma_b", "r2"))


@query(f"""{_law(CURVATURE).replace("SELECT round(mc, 6)", ", law AS (SELECT mc, n, b, log10(n) + b * mc AS a FROM f) SELECT bin::BIGINT AS bin, round(edge, 6) AS edge, events, at_least, round(pow(10, a - b * edge), 4) AS fitted FROM gb, law --").split("--")[0]}""")
def gr_line(cat):
    return frequency.fitted_line(cat).select("bin", *r6("edge"), "events", "at_least", F.round("fitted", 4).alias("fitted"))


@query(f"""WITH {CAT}, o AS (SELECT timeMs, magnitude, row_number() OVER (ORDER BY timeMs, row_idx) - 1 AS i, count(*) OVER () AS n FROM cat),
    p AS (SELECT least(500, greatest(100, max(n) // 10)) AS size, max(n) AS n FROM o), w AS (SELECT unnest(range(0, (n - size) // (size // 4) + 1)) AS win, size, size // 4 AS step FROM p),
    m AS (SELECT win, timeMs, magnitude, i = win * step + size // 2 AS mid FROM o JOIN w ON i >= win * step AND i < win * step + size),
    s AS (SELECT win, min(magnitude) AS lo, max(timeMs) FILTER (mid) AS centre_ms FROM m GROUP BY 1),
    c AS (SELECT win, floor((magnitude - lo) / 0.1e0)::BIGINT AS bin, count(*) AS k FROM m JOIN s USING (win) GROUP BY 1, 2),
    mc AS (SELECT win, arg_min(lo + bin * 0.1e0, struct_pack(e := -k, b := bin)) AS mc FROM c JOIN s USING (win) GROUP BY 1),
    f AS (SELECT win, mc, count(*) AS n, log10(exp(1)) / (avg(magnitude) - (mc - 0.1e0 / 2)) AS b, var_samp(magnitude) AS v FROM m JOIN mc USING (win) WHERE magnitude >= mc GROUP BY 1, 2)
    SELECT win::BIGINT AS win, centre_ms, {q6("mc")}, n, {q6("b")}, round(2.30e0 * b * b * sqrt(v / n), 6) AS sigma_b FROM f JOIN s USING (win)""")
def gr_rolling(cat):
    return frequency.rolling(cat).select(F.col("window").alias("win"), "centre_ms", *r6("mc"), "n", *r6("b", "sigma_b"))


REVISED = "SELECT 'ev' || (row_idx % 700)::VARCHAR AS eventID, CASE WHEN row_idx % 5 <> 0 THEN timeMs % 1000 END AS modificationTime, row_idx, magnitude FROM cat"


def _revised(cat):
    return cat.select(F.concat(F.lit("ev"), (F.col("row_idx") % 700).cast("string")).alias("eventID"), F.when(F.col("row_idx") % 5 != 0, F.col("timeMs") % 1000).alias("modificationTime"), "row_idx", "magnitude")


@query(f"SELECT eventID, row_idx, magnitude FROM ({REVISED}) QUALIFY row_number() OVER (PARTITION BY eventID ORDER BY modificationTime DESC NULLS LAST, row_idx DESC) = 1")
def dedup_newest(cat):
    return incremental.newest_revision(_revised(cat)).select("eventID", "row_idx", "magnitude")


@query("SELECT eventID, magnitude FROM cat WHERE row_idx % 3 = 0 UNION ALL SELECT eventID, magnitude + 1 FROM cat WHERE row_idx % 2 = 0 AND row_idx % 3 <> 0")
def merge_existing_wins(cat):
    a, b = cat.filter("row_idx % 3 = 0").select("eventID", "magnitude"), cat.filter("row_idx % 2 = 0").select("eventID", (F.col("magnitude") + 1).alias("magnitude"))
    return incremental.merge_existing_wins(a, b)


@query("SELECT eventID, magnitude FROM cat WHERE row_idx % 3 = 0 AND row_idx % 2 <> 0 UNION ALL SELECT eventID, magnitude + 1 FROM cat WHERE row_idx % 2 = 0")
def merge_last_wins(cat):
    a, b = cat.filter("row_idx % 3 = 0").select("eventID", "magnitude"), cat.filter("row_idx % 2 = 0").select("eventID", (F.col("magnitude") + 1).alias("magnitude"))
    return incremental.last_write_wins(a, b)


@query("SELECT 1700000000000 AS start_ms, min(timeMs) AS end_ms FROM cat HAVING min(timeMs) > 1700000000000")
def missing_interval(cat):
    return incremental.missing_interval(cat, 1_700_000_000_000)


@query("""WITH """ + CAT + """, s AS (SELECT 'ev' || (row_idx % 900)::VARCHAR AS eventID, CASE WHEN row_idx % 11 = 0 THEN 'invalid' WHEN NOT (longitude BETWEEN 163 AND 179.9 AND latitude BETWEEN -44 AND -27) OR eventType = 'click' THEN 'skipped' ELSE 'accepted' END AS status FROM cat)
    SELECT status, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT eventID) FROM s WHERE status = 'accepted'""")
def ingest_report(cat):
    rows = cat.withColumn("eventID", F.concat(F.lit("ev"), (F.col("row_idx") % 900).cast("string"))).withColumn("magnitude", F.when(F.col("row_idx") % 11 != 0, F.col("magnitude")))
    rows = rows.withColumn("eventType", F.when(F.col("eventType") != "click", F.lit(None).cast("string")).otherwise(F.col("eventType")))
    return incremental.ingest_report(rows, box=(163.0, -44.0, 179.9, -27.0))


STAGE1 = f"""sup AS (SELECT DISTINCT d.row_idx FROM cat d JOIN cat m ON m.magnitude > d.magnitude AND (m.timeMs < d.timeMs OR (m.timeMs = d.timeMs AND m.row_idx < d.row_idx))
    AND d.timeMs - m.timeMs <= 3 * 365.25e0 * 86400000e0 AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= 5 * pow(10, 0.59e0 * m.magnitude - 2.44e0)), valid AS (SELECT * FROM cat WHERE row_idx NOT IN (FROM sup))"""
STAGE2 = f"""after AS (SELECT DISTINCT d.row_idx FROM valid d JOIN valid m ON d.timeMs > m.timeMs AND d.timeMs - m.timeMs <= 864000000 AND m.magnitude >= d.magnitude
    AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= greatest(10e0, 3 * pow(10, 0.59e0 * m.magnitude - 2.44e0))), mains AS (SELECT * FROM valid WHERE row_idx NOT IN (FROM after))"""


@query(f"WITH {CAT}, {STAGE1}, {STAGE2} SELECT row_idx FROM mains")
def srl_mainshocks(cat):
    return declustering.srl_mainshocks(cat).select("row_idx")


@query(f"""WITH {CAT} SELECT m.row_idx, count(d.row_idx) AS aftershocks FROM (SELECT * FROM cat WHERE magnitude >= 4) m LEFT JOIN cat d ON d.timeMs > m.timeMs AND d.timeMs - m.timeMs <= 864000000
    AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= 3 * pow(10, 0.59e0 * m.magnitude - 2.44e0) GROUP BY 1""")
def aftershock_counts(cat):
    return declustering.aftershock_counts(cat.filter("magnitude >= 4"), cat)


@query(f"""WITH cat_ AS (SELECT {SHARED}, epoch_us(ts) // 1000 AS timeMs FROM events), cat AS (SELECT * FROM cat_ WHERE magnitude >= 4), {STAGE1}, {STAGE2}
    SELECT m.row_idx, m.magnitude, count(*) AS aftershocks FROM mains m JOIN cat_ d ON d.timeMs > m.timeMs AND d.timeMs - m.timeMs <= 864000000
    AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= 3 * pow(10, 0.59e0 * m.magnitude - 2.44e0) GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 10""")
def significant_mainshocks(cat):
    return declustering.significant_mainshocks(cat, 4.0, more_than=0).select("row_idx", "magnitude", "aftershocks")


SEQ = f"seq AS (SELECT row_idx, magnitude, (timeMs - {MAIN[0]}) / 86400000e0 AS days FROM cat WHERE timeMs > {MAIN[0]} AND (timeMs - {MAIN[0]}) / 86400000e0 <= 365)"
DAYS = f"{SEQ}, ld AS (SELECT least(ceil(max(days)), 365)::BIGINT AS k FROM seq), dc AS (SELECT floor(days + 0.5)::BIGINT AS day, count(*) AS events FROM seq GROUP BY 1), db AS (SELECT s.day, coalesce(events, 0)::BIGINT AS events FROM (SELECT unnest(range(1, k + 1)) AS day FROM ld) s LEFT JOIN dc USING (day))"


def _seq(cat):
    return aftershocks.sequence(cat, MAIN[0])


@query(f"WITH {CAT}, {DAYS} SELECT day, events FROM db")
def decay_daily_bins(cat):
    return aftershocks.daily_bins(_seq(cat)).select("day", "events")


def _points(grid) -> str:
    return "(VALUES " + ", ".join(f"({i}, {p!r}::DOUBLE, {c!r}::DOUBLE)" for i, (p, c) in enumerate(grid)) + ") AS g(no, p, c)"


GRID = f"""{DAYS}, x AS (SELECT * FROM db WHERE events > 0), kk AS (SELECT no, p, c, sum(events / pow(day + c, p)) / sum(1 / pow(day + c, 2 * p)) AS k FROM x, {_points(aftershocks.FIT_GRID)} GROUP BY 1, 2, 3),
    sc AS (SELECT no, p, c, k, sum((events - k / pow(day + c, p)) * (events - k / pow(day + c, p))) AS sse FROM x, kk GROUP BY 1, 2, 3, 4), best AS (SELECT * FROM sc ORDER BY sse, no LIMIT 1)"""


@query(f"WITH {CAT}, {GRID} SELECT round(k, 4) AS k, round(c, 6) AS c, round(p, 6) AS p, round(sse, 3) AS sse, round(1 - sse / (SELECT sum(events * events) - count(*) * avg(events) * avg(events) FROM x), 6) AS r2 FROM best")
def decay_grid_fit(cat):
    return aftershocks.grid_fit(aftershocks.daily_bins(_seq(cat))).select(F.round("k", 4).alias("k"), *r6("c", "p"), F.round("sse", 3).alias("sse"), *r6("r2"))


AREA = "(CASE WHEN abs(p - 1) < 0.001 THEN ln(365e0 + c) - ln(c + 0.001e0) ELSE (pow(365e0 + c, 1 - p) - pow(c + 0.001e0, 1 - p)) / (1 - p) END)"


@query(f"""WITH {CAT}, {SEQ}, t AS (SELECT no, p, c, count(*) AS n, sum(ln(days + c)) AS logs FROM seq, {_points(aftershocks.PROFILE_GRID)} GROUP BY 1, 2, 3)
    SELECT round(p, 2) AS p, round(c, 3) AS c, round(n / {AREA}, 4) AS k, round(n * ln(n / {AREA}) - p * logs - n, 4) AS log_likelihood FROM t""")
def decay_profile(cat):
    return aftershocks.profile_likelihood(_seq(cat)).select("p", "c", F.round("k", 4).alias("k"), F.round("log_likelihood", 4).alias("log_likelihood"))


def lam(t: str) -> str:
    return f"(CASE WHEN abs(p - 1) < 0.001 THEN k * (ln({t} + c) - ln(c)) ELSE k / (1 - p) * (pow({t} + c, 1 - p) - pow(c, 1 - p)) END)"


@query(f"""WITH {CAT}, {GRID}, e AS (SELECT day, events, k / pow(day + c, p) AS fitted, {lam("day")} AS expected_total, {lam("day")} - {lam("(day - 1)")} AS expected FROM db, best)
    SELECT day, events, round(fitted, 4) AS fitted, (sum(events) OVER (ORDER BY day))::BIGINT AS observed_total, round(expected_total, 4) AS expected_total, round(expected, 4) AS expected, round((events - expected) / sqrt(expected), 4) AS pearson FROM e""")
def decay_fitted_days(cat):
    bins = aftershocks.daily_bins(_seq(cat))
    out = aftershocks.fitted_days(bins, aftershocks.grid_fit(bins))
    return out.select("day", "events", F.round("fitted", 4).alias("fitted"), "observed_total", *[F.round(c, 4).alias(c) for c in ("expected_total", "expected", "pearson")])


TAU = f"tt AS (SELECT row_idx, {lam('days')} AS tau, row_number() OVER (ORDER BY days, row_idx) AS rank FROM seq, best)"


@query(f"WITH {CAT}, {GRID}, {TAU} SELECT row_idx, rank, round(tau, 4) AS tau, round(rank - tau, 4) AS residual FROM tt")
def decay_residuals(cat):
    seq = _seq(cat)
    out = aftershocks.transformed_times(seq, aftershocks.grid_fit(aftershocks.daily_bins(seq)))
    return out.select("row_idx", F.col("rank").cast("bigint").alias("rank"), F.round("tau", 4).alias("tau"), F.round("residual", 4).alias("residual"))


@query(f"""WITH {CAT}, {GRID}, {TAU}, g AS (SELECT tau - lag(tau) OVER (ORDER BY rank) AS y, rank FROM tt QUALIFY y IS NOT NULL)
    SELECT (row_number() OVER (ORDER BY y, rank) - 1)::BIGINT AS i, round(-ln(1 - (row_number() OVER (ORDER BY y, rank) - 1 + 0.5e0) / count(*) OVER ()), 6) AS x, round(y, 4) AS y FROM g""")
def decay_quantiles(cat):
    seq = _seq(cat)
    times = aftershocks.transformed_times(seq, aftershocks.grid_fit(aftershocks.daily_bins(seq)))
    return aftershocks.quantile_plot(times).select(F.col("i").cast("bigint").alias("i"), *r6("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {CAT}, {DAYS}, md(model, a, b, p, c) AS (VALUES {", ".join(f"('{m[0]}', {m[2]!r}::DOUBLE, {m[3]!r}::DOUBLE, {m[4]!r}::DOUBLE, {m[5]!r}::DOUBLE)" for m in schema.REFERENCE_MODELS)})
    SELECT model, day, round(pow(10, a + b * (6.5e0 - 4e0)) / pow(day + c, p), 6) AS rate FROM db, md""")
def decay_reference(cat):
    return aftershocks.reference_curves(aftershocks.daily_bins(_seq(cat)), 6.5, 4.0).select("model", "day", *r6("rate"))


MAINS = (1_705_000_000_000, 1_705_600_000_000, 1_706_400_000_000)
TRIED = ((800.0, 0.02, 0.7), (1500.0, 0.3, 1.0), (2500.0, 1.7, 1.2))  # K, c and p between the points at which sums are taken


def _sequences(cat):
    """The sequences after three instants, as groups."""
    mains = F.explode(F.array(*[F.lit(m) for m in MAINS])).alias("main")
    days = (F.col("timeMs") - F.col("main")) / F.lit(86_400_000.0)
    return cat.select("*", mains).withColumn("days", days).filter("days > 0 and days <= 365")


@query()
def decay_fits(cat):
    """All fitters on three sequences at once."""
    return aftershock_fits.fit(_sequences(cat), list(aftershock_fits.METHODS))


@query(f"""WITH {CAT}, s AS (SELECT main, (timeMs - main) / 86400000e0 AS days FROM cat, (VALUES {", ".join(f"({m})" for m in MAINS)}) t(main) WHERE timeMs > main AND timeMs <= main + 31536000000),
    x(no, k, c, p) AS (VALUES {", ".join(f"({i}, {k!r}e0, {c!r}e0, {p!r}e0)" for i, (k, c, p) in enumerate(TRIED))})
    SELECT main, no, count(*) AS n, round(sum(ln(k / pow(days + c, p))) - any_value(k * CASE WHEN p = 1 THEN ln(365 + c) - ln(0.001e0 + c) ELSE (pow(365 + c, 1 - p) - pow(0.001e0 + c, 1 - p)) / (1 - p) END), 4) AS log_likelihood FROM s, x WHERE days >= 0.001 GROUP BY main, no""")
def decay_likelihoods(cat):
    """Likelihoods of given parameters, from the sums that the fitters use."""
    sums = aftershock_fits.decay_sums(_sequences(cat)).select("main", "n", "logs")
    values = []
    for no, (k, c, p) in enumerate(TRIED):
        area = F.lit(k * aftershock_fits.integral(0.001, 365.0, c, p))
        basis = aftershock_fits.basis(c)
        at = sum((F.col("logs")[i] * float(w) for i, w in enumerate(basis)), F.lit(0.0))
        values.append(F.struct(F.lit(no).alias("no"), F.round(F.col("n") * F.log(F.lit(k)) - p * at - area, 4).alias("log_likelihood")))
    return sums.select("main", "n", F.explode(F.array(*values)).alias("v")).select("main", "v.no", "n", "v.log_likelihood")


PLANE = f"m0 AS (SELECT avg(latitude) AS la, avg(longitude) AS lo FROM cat), xy AS (SELECT row_idx, timeMs, magnitude, (longitude - lo) * 111.32e0 * cos(la * pi() / 180) AS x, (latitude - la) * 110.57e0 AS y FROM cat, m0)"


_G = "(1.570796e0 - atan(0.993231e0 * tan({} * 1.745329e-02)))"


@query(f"""SELECT row_idx, round(CASE WHEN latitude = -41.3 AND longitude = 174.8 THEN 0 ELSE acos(greatest(-1, least(1, sin(a) * sin(b) * cos((174.8e0 - longitude) * 1.745329e-02) + cos(a) * cos(b)))) * 6371.227e0 * (1 + 3.37853e-3 * (1e0 / 3 - pow(cos(1.570796e0 - (latitude - 41.3e0) * 1.745329e-02 / 2), 2))) END, 6) AS distance_km
    FROM (SELECT *, {_G.format("latitude")} AS a, {_G.format("-41.3e0")} AS b FROM cat)""")
def ellipsoid_distance(cat):
    """Distance of every event from one place on the ellipsoid."""
    return cat.select("row_idx", F.round(geo.ellipsoid_km(F.col("latitude"), F.col("longitude"), F.lit(-41.3), F.lit(174.8)), 6).alias("distance_km"))


@query(f"WITH {CAT}, {PLANE} SELECT row_idx, round(x, 6) AS x_km, round(y, 6) AS y_km FROM xy")
def projected(cat):
    return geo.projected(cat).select("row_idx", *r6("x_km", "y_km"))


@query(f"""WITH {CAT}, {PLANE}, g AS (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM xy), o(i) AS (VALUES (-1), (0), (1))
    SELECT a.row_idx, count(*) AS neighbours FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5 GROUP BY 1""")
def neighbour_counts(cat):
    points = geo.projected(cat).select("row_idx", "x_km", "y_km")
    return neighbours.planar_pairs(points, 5.0).groupBy(F.col("a").alias("row_idx")).agg(F.count("*").alias("neighbours"))


@query(f"""WITH RECURSIVE {CAT}, {PLANE}, g AS (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM xy), o(i) AS (VALUES (-1), (0), (1)),
    nb AS (SELECT a.row_idx AS a, b.row_idx AS b FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5),
    core AS (SELECT a AS c FROM nb GROUP BY 1 HAVING count(*) + 1 >= 5), ce AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(src, dst) AS (SELECT c, c FROM core UNION SELECT r.src, ce.b FROM reach r JOIN ce ON ce.a = r.dst), comp AS (SELECT src AS c, min(dst) AS k FROM reach GROUP BY 1),
    num AS (SELECT c, (dense_rank() OVER (ORDER BY k) - 1)::INTEGER AS id FROM comp), bord AS (SELECT a, min(id) AS id FROM nb JOIN num ON num.c = nb.b WHERE a NOT IN (FROM core) GROUP BY 1)
    SELECT cat.row_idx, coalesce(num.id, bord.id, -1)::INTEGER AS cluster_id, num.id IS NOT NULL AS core FROM cat LEFT JOIN num ON num.c = cat.row_idx LEFT JOIN bord ON bord.a = cat.row_idx""")
def dbscan(cat):
    return density.dbscan(cat, 5.0, 5)


def _density(near: str, least: int) -> str:
    """Density clusters over neighbour pairs nb(a, b)."""
    return f"""{near}, core AS (SELECT a AS c FROM nb GROUP BY 1 HAVING count(*) + 1 >= {least}), ce AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),
    reach(src, dst) AS (SELECT c, c FROM core UNION SELECT r.src, ce.b FROM reach r JOIN ce ON ce.a = r.dst), comp AS (SELECT src AS c, min(dst) AS k FROM reach GROUP BY 1),
    num AS (SELECT c, (dense_rank() OVER (ORDER BY k) - 1)::INTEGER AS id FROM comp), bord AS (SELECT a, min(id) AS id FROM nb JOIN num ON num.c = nb.b WHERE a NOT IN (FROM core) GROUP BY 1)
    SELECT cat.row_idx, coalesce(num.id, bord.id, -1)::INTEGER AS cluster_id, num.id IS NOT NULL AS core FROM cat LEFT JOIN num ON num.c = cat.row_idx LEFT JOIN bord ON bord.a = cat.row_idx"""


@query("WITH RECURSIVE " + CAT + ", " + PLANE + ", " + _density(f"""g AS (SELECT xy.*, latitude, longitude, floor(x / 5.75e0)::BIGINT AS cx, floor(y / 5.75e0)::BIGINT AS cy FROM xy JOIN cat USING (row_idx)), o(i) AS (VALUES (-1), (0), (1)),
    nb AS (SELECT a.row_idx AS a, b.row_idx AS b FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx AND abs(a.timeMs - b.timeMs) <= 7 * 86400000
        AND abs(a.x - b.x) <= 1.15e0 * 5 AND abs(a.y - b.y) <= 1.15e0 * 5 AND {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 5)""", 4))
def st_dbscan(cat):
    return density.st_dbscan(cat, 5.0, 7.0, 4)


@query(f"""WITH {CAT}, {PLANE}, g AS (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM xy), o(i) AS (VALUES (-1), (0), (1)),
    nb AS (SELECT a.row_idx, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx),
    n4 AS (SELECT row_idx, d FROM nb WHERE d <= 5 QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY d) = 4) SELECT row_idx, round(d, 6) AS core_km FROM cat LEFT JOIN n4 USING (row_idx)""")
def optics_distances(cat):
    return density.optics_core_distances(cat, 5.0, 5).select("row_idx", *r6("core_km"))


@query("SELECT row_idx, TRUE AS at_nearest, TRUE AS at_mean FROM cat")
def kmeans(cat):
    """Every row is in the cluster of its nearest centre, and centres are near the means of their rows (the search stops at small moves)."""
    found = density.kmeans(cat, 5)
    xy = geo.projected(cat).select("row_idx", "x_km", "y_km")
    centres = found.groupBy("cluster_id", "centre_x_km", "centre_y_km").agg(F.count("*").alias("n"))
    near = xy.crossJoin(F.broadcast(centres)).groupBy("row_idx").agg(F.min(F.hypot(F.col("x_km") - F.col("centre_x_km"), F.col("y_km") - F.col("centre_y_km"))).alias("least"))  # five centres
    means = found.join(xy, "row_idx").groupBy("cluster_id").agg(F.hypot(F.avg("x_km") - F.first("centre_x_km"), F.avg("y_km") - F.first("centre_y_km")).alias("off"))
    return found.join(near, "row_idx").join(means, "cluster_id").select("row_idx", (F.col("distance_km") <= F.col("least") + 1e-6).alias("at_nearest"), (F.col("off") < 20).alias("at_mean"))


ETA = f"(c.timeMs - p.timeMs) / 86400000e0 * pow(greatest(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), 0.001e0), 1.6e0) * pow(10, -p.magnitude)"


PARENTS = f"""pa AS (SELECT c.row_idx, min(struct_pack(eta := {ETA}, t := p.timeMs, i := p.row_idx)) AS m FROM xy c JOIN xy p ON p.timeMs < c.timeMs GROUP BY 1),
    lk AS (SELECT row_idx, m.i AS parent, log10(m.eta) AS v FROM pa)"""


@query(f"WITH {CAT}, {PLANE}, {PARENTS} SELECT cat.row_idx, parent, round(v, 6) AS log10_eta FROM cat LEFT JOIN lk USING (row_idx)")
def nearest_links(cat):
    return links.nearest_parents(cat).select("row_idx", "parent", *r6("log10_eta"))


OTSU = """ov AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, greatest(3, least(100, ceil(sqrt(count(*)))))::BIGINT AS nb FROM ev),
    oh AS (SELECT greatest(0, least(nb - 1, floor((v - lo) / ((hi - lo) / nb))::BIGINT)) AS bin, count(*) AS c FROM ev, ov GROUP BY 1),
    op AS (SELECT s.bin, coalesce(c, 0) / n AS p, lo + (s.bin + 0.5e0) * ((hi - lo) / nb) AS x FROM (SELECT unnest(range(nb)) AS bin, n, lo, hi, nb FROM ov) s LEFT JOIN oh USING (bin)),
    orr AS (SELECT bin, x, sum(p) OVER (ORDER BY bin) AS w, sum(p * x) OVER (ORDER BY bin) AS m, sum(p * x) OVER () AS mt FROM op),
    os AS (SELECT bin, x, pow(mt * w - m, 2) / (w * (1 - w)) AS s FROM orr WHERE w > 0 AND w < 1 - 1e-12)"""


@query(f"WITH {CAT}, ev AS (SELECT magnitude AS v FROM cat), {OTSU} SELECT (SELECT n FROM ov) AS n, round(arg_min(x, struct_pack(s := -s, b := bin)), 6) AS threshold FROM os")
def otsu_threshold(cat):
    return links.otsu_threshold(cat, "magnitude").select("n", *r6("threshold"))


@query(f"""WITH RECURSIVE {CAT}, {PLANE}, {PARENTS}, ev AS (SELECT v FROM lk), {OTSU}, th AS (SELECT arg_min(x, struct_pack(s := -s, b := bin)) AS t FROM os),
    st AS (SELECT row_idx, parent FROM lk, th WHERE v <= t), up(n, a) AS (SELECT row_idx, parent FROM st UNION ALL SELECT up.n, st.parent FROM up JOIN st ON st.row_idx = up.a),
    top AS (SELECT n, a AS r FROM up WHERE a NOT IN (SELECT row_idx FROM st)), mem AS (SELECT n, r FROM top UNION SELECT r, r FROM top),
    num AS (SELECT r, (row_number() OVER (ORDER BY min(struct_pack(t := timeMs, i := row_idx))) - 1)::INTEGER AS id FROM mem JOIN cat ON cat.row_idx = mem.n GROUP BY 1)
    SELECT cat.row_idx, coalesce(id, -1)::INTEGER AS cluster_id FROM cat LEFT JOIN mem ON mem.n = cat.row_idx LEFT JOIN num USING (r)""")
def nearest_neighbour_clusters(cat):
    return links.nearest_neighbour_clusters(cat).select("row_idx", "cluster_id")


def _greedy(rows: str, order: str) -> str:
    """Mains: the highest rank left is taken again and again, and what its window covers leaves."""
    return f"""rk AS (SELECT row_idx AS i, row_number() OVER (ORDER BY {order}) AS r FROM {rows}),
    u(step, i, r) AS (SELECT 0, i, r FROM rk UNION ALL SELECT step + 1, u.i, u.r FROM u, (SELECT arg_min(i, r) AS top FROM u) t WHERE u.i <> t.top AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.main = t.top AND cov.dep = u.i)),
    mains AS (SELECT arg_min(i, r) AS main, min(r) AS r FROM u GROUP BY step)"""


def _windowed(radius: str, days: str, share: str = "1e0", order: str = "magnitude DESC, timeMs, row_idx") -> str:
    return f"""WITH RECURSIVE {CAT}, w AS (SELECT *, {radius} AS rad, ({days}) * 86400000e0 AS span FROM cat),
    cov AS (SELECT m.row_idx AS main, d.row_idx AS dep FROM w m JOIN cat d ON m.row_idx <> d.row_idx AND d.timeMs - m.timeMs <= m.span AND m.timeMs - d.timeMs <= m.span * {share}
        AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= m.rad), {_greedy("cat", order)},
    mem AS (SELECT dep, min(r) AS owner FROM cov JOIN mains USING (main) GROUP BY 1), num AS (SELECT owner, row_number() OVER (ORDER BY owner) - 1 AS id FROM (SELECT DISTINCT owner FROM mem)),
    lab AS (SELECT rk.i AS row_idx, greatest(coalesce(a.id, -1), coalesce(b.id, -1))::INTEGER AS cluster_id, mains.main IS NOT NULL AS is_main, mem.owner IS NOT NULL AS dependent
        FROM rk LEFT JOIN mains ON mains.main = rk.i LEFT JOIN mem ON mem.dep = rk.i LEFT JOIN num a ON a.owner = mem.owner LEFT JOIN num b ON b.owner = mains.r)"""


GK = ("pow(10, 0.1238e0 * magnitude + 0.983e0)", "CASE WHEN magnitude >= 6.5 THEN pow(10, 0.032e0 * magnitude + 2.7389e0) ELSE pow(10, 0.5409e0 * magnitude - 0.547e0) END")


@query(f"{_windowed(*GK)} SELECT row_idx, cluster_id, is_main, dependent FROM lab")
def gardner_knopoff(cat):
    return declustering.gardner_knopoff(cat)


@query(f"{_windowed(*GK, order='magnitude DESC, row_idx')} SELECT row_idx FROM lab WHERE is_main AND NOT dependent")
def gardner_knopoff_mainshocks(cat):
    return declustering.gardner_knopoff_mainshocks(cat).select("row_idx")


@query(f"{_windowed('exp(-1.024e0 + 0.804e0 * magnitude)', 'exp(-2.870e0 + 1.235e0 * magnitude)', '0.5e0')} SELECT row_idx, cluster_id, is_main, dependent FROM lab")
def uhrhammer(cat):
    return declustering.uhrhammer(cat, 0.5)


@query(f"""WITH RECURSIVE {CAT}, sup AS (SELECT DISTINCT d.row_idx FROM cat d JOIN cat m ON m.magnitude > d.magnitude AND m.timeMs < d.timeMs AND d.timeMs - m.timeMs < 3 * 365.25e0 * 86400000e0
        AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= 5 * pow(10, 0.59e0 * m.magnitude - 2.44e0) WHERE d.magnitude >= 4),
    valid AS (SELECT * FROM cat WHERE magnitude >= 4 AND row_idx NOT IN (FROM sup)),
    cov AS (SELECT m.row_idx AS main, d.row_idx AS dep FROM valid m JOIN cat d ON d.timeMs > m.timeMs AND d.timeMs - m.timeMs <= 864000000
        AND {km("m.latitude", "m.longitude", "d.latitude", "d.longitude")} <= greatest(10e0, 3 * pow(10, 0.59e0 * m.magnitude - 2.44e0))), {_greedy("valid", "magnitude DESC, row_idx")},
    num AS (SELECT main, r, (row_number() OVER (ORDER BY r) - 1)::INTEGER AS id FROM mains), mem AS (SELECT dep, min(id) AS id FROM cov JOIN num USING (main) WHERE dep NOT IN (SELECT main FROM mains) GROUP BY 1)
    SELECT cat.row_idx, coalesce(num.id, mem.id, -1)::INTEGER AS cluster_id FROM cat LEFT JOIN num ON num.main = cat.row_idx LEFT JOIN mem ON mem.dep = cat.row_idx""")
def hardebeck(cat):
    return declustering.hardebeck(cat, 4.0)


@query()
def step_magnitude(cat):
    return sequences.step_magnitude(cat)


@query()
def step_time(cat):
    return sequences.step_time(cat)


@query()
def reasenberg(cat):
    return sequences.reasenberg(cat)


@query()
def hdbscan(cat):
    """Of the whole catalogue; equal weights leave a choice, so tests compare with a restatement."""
    return hierarchy.hdbscan(cat).select("row_idx", "cluster_id", *r6("probability", "outlier_score"))


def _cores(radii: str, near: str, least: int) -> str:
    """Cores of several radii t(r) over neighbour pairs nb(a, b, d), and the smallest row k that each reaches over cores."""
    return f"""{near}, t(r) AS (VALUES {radii}), core AS (SELECT r, a AS c FROM nb, t WHERE d <= r GROUP BY r, a HAVING count(*) >= {least}),
    ce AS (SELECT t.r, a, b FROM nb JOIN t ON d <= t.r JOIN core x ON x.r = t.r AND x.c = a JOIN core y ON y.r = t.r AND y.c = b),
    reach(r, src, dst) AS (SELECT r, c, c FROM core UNION SELECT q.r, q.src, ce.b FROM reach q JOIN ce ON ce.r = q.r AND ce.a = q.dst), comp AS (SELECT r, src AS row_idx, min(dst) AS k FROM reach GROUP BY 1, 2)"""


@query("WITH RECURSIVE " + CAT + ", " + PLANE + ", " + _cores("(2e0), (3e0), (4e0)", f"""g AS (SELECT xy.*, latitude, longitude, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM xy JOIN cat USING (row_idx)), o(i) AS (VALUES (-1), (0), (1)),
    nb AS (SELECT a.row_idx AS a, b.row_idx AS b, {km("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS d FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx)""", 5)
    + " SELECT r AS radius_km, count(*) AS cores, count(*) - count(DISTINCT k) AS edges, count(DISTINCT k) AS components FROM comp GROUP BY r")
def spanning_tree_cuts(cat):
    """What is left of the tree of mutual reachability under some distances: a tree of each component."""
    tree, cores = spanning.spanning_tree(cat, 5)
    radii = F.explode(F.array(*[F.lit(x) for x in (2.0, 3.0, 4.0)])).alias("radius_km")
    held = cores.select("core", radii).filter("core <= radius_km").groupBy("radius_km").agg(F.count("*").alias("cores"))
    kept = tree.select("w", radii).filter("w <= radius_km").groupBy("radius_km").agg(F.count("*").alias("edges"))
    return held.join(kept, "radius_km", "left").select("radius_km", "cores", F.coalesce("edges", F.lit(0)).alias("edges"), (F.col("cores") - F.coalesce("edges", F.lit(0))).alias("components"))


@query("WITH RECURSIVE " + CAT + ", " + PLANE + ", " + _cores("(4e0)", """g AS (SELECT *, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy FROM xy), o(i) AS (VALUES (-1), (0), (1)),
    nb AS (SELECT a.row_idx AS a, b.row_idx AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM g a, o p, o q, g b WHERE b.cx = a.cx + p.i AND b.cy = a.cy + q.i AND a.row_idx <> b.row_idx)""", 4)
    + """, n4 AS (SELECT a AS row_idx, d FROM nb WHERE d <= 5 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 4)
    SELECT cat.row_idx, round(n4.d, 6) AS core_km, comp.k AS first_row FROM cat LEFT JOIN n4 ON n4.row_idx = cat.row_idx LEFT JOIN comp ON comp.row_idx = cat.row_idx""")
def optics_order(cat):
    """Core distances within 5 km, and the clusters that a cut of the reachability order at 4 km gives."""
    order = hierarchy.reachability_order(cat, 5.0, 5)
    return order.select("row_idx", *r6("core_km")).join(hierarchy.cut(order, 4.0), "row_idx")


NESTS = "SELECT row_idx, CASE WHEN row_idx % 4 = 0 THEN -1 ELSE (row_idx * 7919 % 50)::INTEGER END AS cluster_id FROM cat"


def _nests(cat):
    return cat.select("row_idx", F.when(F.col("row_idx") % 4 == 0, F.lit(-1)).otherwise((F.col("row_idx") * 7919 % 50).cast("int")).alias("cluster_id"))


@query(f"""WITH {CAT}, l AS ({NESTS}), s AS (SELECT cluster_id, count(*) AS n FROM l GROUP BY 1)
    SELECT sum(n)::BIGINT AS events, count(*) FILTER (cluster_id >= 0) AS clusters, (sum(n) FILTER (cluster_id >= 0))::BIGINT AS clustered, (sum(n) FILTER (cluster_id < 0))::BIGINT AS noise,
    round(100e0 * sum(n) FILTER (cluster_id >= 0) / sum(n), 6) AS cluster_percent, round(100 - 100e0 * sum(n) FILTER (cluster_id >= 0) / sum(n), 6) AS noise_percent,
    min(n) FILTER (cluster_id >= 0) AS smallest, max(n) FILTER (cluster_id >= 0) AS largest, round(avg(n) FILTER (cluster_id >= 0), 6) AS mean_size FROM s""")
def cluster_summary(cat):
    return clusters.result_summary(_nests(cat)).select("events", "clusters", "clustered", "noise", *r6("cluster_percent", "noise_percent"), "smallest", "largest", *r6("mean_size"))


@query(f"""WITH {CAT}, l AS ({NESTS}), s AS (SELECT cluster_id, count(*) AS n FROM l WHERE cluster_id >= 0 GROUP BY 1)
    SELECT row_idx, cluster_id, CASE WHEN cluster_id < 0 THEN 'noise' ELSE 'cluster_' || cluster_id END AS cluster_label, coalesce(n, 0)::BIGINT AS cluster_size FROM l LEFT JOIN s USING (cluster_id)""")
def cluster_sizes(cat):
    return clusters.with_sizes(_nests(cat)).select("row_idx", "cluster_id", "cluster_label", "cluster_size")


@query(f"""WITH {CAT}, l AS (SELECT cat.*, cluster_id FROM cat JOIN ({NESTS}) USING (row_idx) WHERE cluster_id >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY magnitude DESC, timeMs, row_idx) AS k FROM l),
    b AS (SELECT cluster_id, max(timeMs) FILTER (k = 1) AS top FROM r GROUP BY 1)
    SELECT cluster_id, count(*) AS events, {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("latitude", "longitude", "depth"))}, round(log10(sum(pow(10, 1.2e0 * magnitude))) / 1.2e0, 6) AS magnitude,
    max(magnitude) FILTER (k = 1) AS largest, max(timeMs) FILTER (k = 1) AS largest_ms, max(magnitude) FILTER (k = 2) AS second, round(greatest(0.001, (max(timeMs) - min(timeMs)) / 86400000e0), 6) AS days,
    round(100e0 * count(*) FILTER (timeMs < top) / count(*), 6) AS foreshock_percent, round((max(timeMs) FILTER (k = 2) - max(timeMs) FILTER (k = 1)) / 86400000e0, 6) AS dt_days,
    round(max(magnitude) FILTER (k = 1) - max(magnitude) FILTER (k = 2), 6) AS dm FROM r JOIN b USING (cluster_id) GROUP BY 1""")
def equivalent_events(cat):
    e = clusters.equivalent_events(cat, _nests(cat))
    return e.select("cluster_id", "events", *r6("latitude", "longitude", "depth", "magnitude"), "largest", "largest_ms", "second", *r6("days", "foreshock_percent", "dt_days", "dm"))


@query(f"SELECT row_idx, CASE WHEN cluster_id < 0 THEN '+' ELSE chr(65 + cluster_id % 26) END AS letter FROM ({NESTS})")
def annotated_events(cat):
    return clusters.annotated(cat, _nests(cat)).select("row_idx", "letter")


@query(f"""SELECT cat.row_idx, cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY round(magnitude, 1) DESC, timeMs, row_idx) = 1)::INTEGER AS is_largest,
    (row_number() OVER (PARTITION BY cluster_id ORDER BY timeMs, row_idx) = 1)::INTEGER AS is_first FROM cat JOIN ({NESTS}) l USING (row_idx) WHERE cluster_id >= 0""")
def marked_events(cat):
    return clusters.marked(cat, _nests(cat)).select("row_idx", "cluster_id", "is_largest", "is_first")


@query("SELECT 'Feature' AS type, 'Point' AS shape, longitude, latitude, -depth AS height, eventID, magnitude, timeMs FROM cat")
def export_geojson(cat):
    """Every feature of the export, its geometry and its properties."""
    kind = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<eventID: string, magnitude: double, timeMs: bigint>"
    f = sinks.geojson_features(cat).select(F.from_json("value", kind).alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("f.type", F.col("f.geometry.type").alias("shape"), at[0].alias("longitude"), at[1].alias("latitude"), at[2].alias("height"), "f.properties.*")


@query("SELECT row_idx, strftime(make_timestamp(timeMs * 1000), '%d/%m/%Y %H:%M:%S') AS shown, strftime(make_timestamp(timeMs * 1000), '%d/%m/%Y') AS day FROM cat")
def display_dates(cat):
    t = F.timestamp_millis("timeMs")
    return cat.select("row_idx", scalar.display_date(t, True).alias("shown"), scalar.display_date(t).alias("day"))


@query("""SELECT row_idx, round(pow(2, greatest(1, magnitude - 2)), 6) AS size, (CASE WHEN depth < 15 THEN 0 WHEN depth < 40 THEN 1 WHEN depth < 100 THEN 2 WHEN depth < 200 THEN 3 ELSE 4 END)::INTEGER AS depth_class,
    round(log10(pow(10, 1.5e0 * magnitude + 9.1e0)), 6) AS log_moment, round((timeMs - epoch_ms(TIMESTAMP '2024-01-01')) / (366 * 86400000e0) + 2024, 8) AS decimal_year FROM cat""")
def point_styles(cat):
    m = F.col("magnitude")
    return cat.select("row_idx", F.round(scalar.marker_size(m), 6).alias("size"), scalar.map_depth_class(F.col("depth")).alias("depth_class"), F.round(F.log10(scalar.moment_nm(m)), 6).alias("log_moment"), F.round(scalar.decimal_year(F.col("timeMs")), 8).alias("decimal_year"))
