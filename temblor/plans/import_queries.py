"""Registered import queries: the events are rendered to files as users have them, with faults, and read back.

Each file is written to the scratch folder and goes through the reader, the mapping
and the validation; the SQL states what must come out, straight from ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.functions import scalar
from temblor.operators import incremental, statistics, validation
from temblor.plans.catalogue_queries import CAT
from temblor.scratch import scratch_path
from temblor.sources import readers, sinks
from temblor.sources.events import catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function catalogue -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalogue(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {CAT} {sql}"
        return f

    return add


def rendered(lines: DataFrame, name: str, before: list[str] = (), after: list[str] = (), between: str = "") -> str:
    """Path of a folder of text files with ``lines`` (n, value) in order of n, each file between other lines.

    ``between`` ends every line but a file's last.  A task writes one range of n, so no task holds the table.
    """
    path = scratch_path(lines.sparkSession, name)
    ranges = lines.select(F.col("n").cast("double").alias("n"), "value").repartitionByRange("n").sortWithinPartitions("n")
    sinks.write_lines(ranges, path, before, after, between)
    return path


FAULTY = """CASE WHEN row_idx % 29 = 0 THEN NULL ELSE timeMs END AS timeMs, CASE WHEN row_idx % 17 = 0 THEN 95.5e0 ELSE latitude END AS latitude, longitude,
    CASE WHEN row_idx % 19 = 0 THEN NULL ELSE depth END AS depth, CASE WHEN row_idx % 13 = 0 THEN NULL ELSE magnitude END AS magnitude"""
ERROR = """CASE WHEN row_idx % 29 = 0 THEN 'invalid time' WHEN row_idx % 17 = 0 THEN 'latitude out of range' WHEN row_idx % 19 = 0 THEN 'invalid depth' WHEN row_idx % 13 = 0 THEN 'invalid magnitude' END"""
STAMP = "date_format(time, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def _faulty(cat: DataFrame) -> DataFrame:
    """The catalogue as a comma-separated file with comments, quoted places and planted faults."""
    cells = [
        "eventID", f"CASE WHEN row_idx % 29 = 0 THEN 'no date' ELSE {STAMP} END", "CASE WHEN row_idx % 17 = 0 THEN '95.5' ELSE string(latitude) END", "string(longitude)",
        "CASE WHEN row_idx % 19 = 0 THEN '' ELSE string(depth) END", "CASE WHEN row_idx % 13 = 0 THEN 'NaN' ELSE string(magnitude) END",
        "CASE row_idx % 3 WHEN 0 THEN '\"North, of \"\"Town\"\"\"' WHEN 1 THEN '' ELSE ' Sea ' END", "string(row_idx % 5)", "string(row_idx)",
    ]
    lines = cat.select(F.col("row_idx").alias("n"), F.expr(f"concat_ws(',', {', '.join(cells)})").alias("value"))
    notes = cat.filter("row_idx % 50 = 0").select((F.col("row_idx") + 0.5).alias("n"), F.element_at(F.array(F.lit("# note"), F.lit("  // note"), F.lit("%note")), (F.col("row_idx") % 3 + 1).cast("int")).alias("value"))
    path = rendered(lines.unionByName(notes), "faulty.csv", ["# exported", "", "PublicID,Origin_Time,Lat,Lon,Dep,Mag,Place,quality,line"])
    return validation.mapped(readers.read(cat.sparkSession, path))


@query(f"""SELECT eventID, {FAULTY}, CASE row_idx % 3 WHEN 0 THEN 'North, of "Town"' WHEN 1 THEN 'Unknown Location' ELSE 'Sea' END AS locality, (row_idx % 5)::DOUBLE AS quality, {ERROR} AS error FROM cat""")
def import_delimited(cat):
    rows = validation.typed(_faulty(cat), ["quality"])
    return rows.select("eventID", "timeMs", "latitude", "longitude", "depth", "magnitude", "locality", "quality", "error")


@query(f"""WITH {CAT}, f AS (SELECT {FAULTY}, {ERROR} AS error FROM cat) SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS invalid,
    round(100.0 * count(*) FILTER (error IS NULL) / count(*), 1)::DOUBLE AS success_rate, {", ".join(f"{g}({c}) FILTER (error IS NULL) AS {g}_{c}" for c in ("timeMs", "magnitude", "depth", "latitude", "longitude") for g in ("min", "max"))} FROM f""")
def import_statistics(cat):
    found = validation.import_statistics(_faulty(cat))
    return found.select("total", "valid", "invalid", F.col("success_rate").cast("double").alias("success_rate"), *[f"{g}_{c}" for c in ("timeMs", "magnitude", "depth", "latitude", "longitude") for g in ("min", "max")])


@query(f"SELECT error, CASE WHEN error LIKE 'invalid%' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM (SELECT {ERROR} AS error FROM cat) WHERE error IS NOT NULL GROUP BY 1, 2")
def import_error_counts(cat):
    return validation.error_counts(_faulty(cat))


@query(f"""WITH {CAT}, b AS (SELECT row_idx AS row, {ERROR} AS description FROM cat WHERE {ERROR} IS NOT NULL)
    (SELECT row, description FROM b ORDER BY row LIMIT 100) UNION ALL SELECT NULL, 'and ' || (count(*) - 100) || ' more' FROM b HAVING count(*) > 100""")
def import_error_report(cat):
    return validation.error_report(_faulty(cat), 100, "line")


@query(f"SELECT eventID, {FAULTY} FROM cat WHERE {ERROR} IS NULL")
def import_valid_rows(cat):
    good, _ = validation.split_valid(_faulty(cat))
    return good.select("eventID", "timeMs", "latitude", "longitude", "depth", "magnitude")


@query("SELECT count(*) AS data_rows, count(*) FILTER (row_idx % 50 = 0) + 1 AS comments, 'PublicID,Origin_Time,Lat,Lon,Dep,Mag,Place,quality,line' AS headers, (SELECT eventID FROM cat ORDER BY row_idx LIMIT 1) AS first_id FROM cat")
def import_preview(cat):
    lines = cat.select(F.col("row_idx").alias("n"), F.concat_ws(",", "eventID", *[F.lit("x")] * 8).alias("value"))
    notes = cat.filter("row_idx % 50 = 0").select((F.col("row_idx") + 0.5).alias("n"), F.lit("# note").alias("value")).union(cat.agg((F.min("row_idx") - 1).cast("double"), F.lit("# exported")))
    got = readers.preview(cat.sparkSession, rendered(lines.unionByName(notes), "shown.csv", ["PublicID,Origin_Time,Lat,Lon,Dep,Mag,Place,quality,line"]))
    return cat.sparkSession.createDataFrame([(got["total"], got["skipped_comments"], ",".join(got["headers"]), got["rows"][0]["PublicID"])], "data_rows long, comments long, headers string, first_id string")


STRICT = """CASE WHEN latitude NOT BETWEEN -48 AND -33 THEN 'latitude out of range' WHEN longitude NOT BETWEEN 165 AND 180 THEN 'longitude out of range'
    WHEN depth NOT BETWEEN 0 AND 300 THEN 'depth out of range' WHEN magnitude NOT BETWEEN 2.5 AND 4 THEN 'magnitude out of range' END"""


@query(f"SELECT eventID, (timeMs // 1000) * 1000 AS timeMs, depth, {STRICT} AS error FROM cat")
def import_semicolons_strict(cat):
    cells = F.concat_ws(";", "eventID", F.date_format("time", "dd/MM/yyyy HH:mm:ss"), *[F.col(c).cast("string") for c in ("latitude", "longitude", "depth", "magnitude")])
    path = rendered(cat.select(F.col("row_idx").alias("n"), cells.alias("value")), "days.txt", ["id;date;latitude;longitude;depth;magnitude"])
    rules = validation.Rules(min_latitude=-48, max_latitude=-33, min_longitude=165, max_depth=300, min_magnitude=2.5, max_magnitude=4, strict=True)
    return validation.mapped(readers.read(cat.sparkSession, path), rules=rules).select("eventID", "timeMs", "depth", "error")


@query("SELECT eventID, timeMs, latitude, magnitude FROM cat")
def import_split_dates(cat):
    parts = [F.date_format("time", p) for p in ("yyyy", "MM", "dd", "HH", "mm", "ss.SSS")]
    cells = F.concat_ws("\t", "eventID", *parts, *[F.col(c).cast("string") for c in ("latitude", "longitude", "depth", "magnitude")])
    path = rendered(cat.select(F.col("row_idx").alias("n"), cells.alias("value")), "parts.tsv", ["evid\tyear\tmonth\tday\thour\tminute\tsecond\tlat\tlon\tdepth\tml"])
    return validation.mapped(readers.read(cat.sparkSession, path)).filter("error is null").select("eventID", "timeMs", "latitude", "magnitude")


@query("SELECT eventID, timeMs, longitude, depth FROM cat")
def import_dat(cat):
    cells = F.concat_ws("   ", "eventID", *[F.col(c).cast("string") for c in ("timeMs", "latitude", "longitude", "depth", "magnitude")])
    path = rendered(cat.select(F.col("row_idx").alias("n"), F.concat(F.lit("  "), cells).alias("value")), "plain.dat", ["id time lat lon depth mag"])
    return validation.mapped(readers.read(cat.sparkSession, path)).filter("error is null").select("eventID", "timeMs", "longitude", "depth")


@query("SELECT eventID, timeMs, latitude, depth, error FROM (SELECT eventID, timeMs, latitude, depth, NULL::VARCHAR AS error FROM cat UNION ALL SELECT 'last', NULL, NULL, NULL, 'invalid time')")
def import_json(cat):
    one = F.to_json(F.struct(F.col("eventID").alias("publicID"), F.expr(STAMP).alias("time"), "latitude", "longitude", "depth", "magnitude"))
    last = cat.agg((F.max("row_idx") + 1).alias("n"), F.lit('{"publicID": "last"}').alias("value"))
    path = rendered(cat.select(F.col("row_idx").alias("n"), one.alias("value")).union(last), "array.json", ["["], ["]"], ",")
    return validation.mapped(readers.read(cat.sparkSession, path)).select("eventID", "timeMs", "latitude", "depth", "error")


@query("SELECT eventID, timeMs, latitude, longitude, -depth AS height, magnitude FROM cat")
def import_geojson(cat):
    """Through the exporter: features carry minus the depth as height."""
    lines = sinks.geojson_features(cat.select("row_idx", "longitude", "latitude", "depth", F.col("eventID").alias("publicid"), F.expr(STAMP).alias("time"), "magnitude"))
    every = lines.select(F.substring(F.get_json_object("value", "$.properties.publicid"), 3, 20).cast("double").alias("n"), "value")
    path = rendered(every, "collection.geojson", ['{"type":"FeatureCollection","features":['], ["]}"], ",")
    rows = validation.mapped(readers.read(cat.sparkSession, path))
    return rows.select("eventID", "timeMs", "latitude", "longitude", F.col("depth").alias("height"), "magnitude")


@query("""SELECT eventID, timeMs, latitude, longitude, depth, magnitude, 'Ml' AS magnitudeType FROM cat""")
def import_quakeml(cat):
    """Two origins and magnitudes an event, the second preferred; every third event has bare values."""
    value = lambda tag, v: F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))).otherwise(F.concat(F.lit(f"<{tag}><value>"), v, F.lit(f"</value></{tag}>")))
    text = lambda c: F.col(c).cast("string")
    mine = F.concat(value("time", F.expr(STAMP)), value("latitude", text("latitude")), value("longitude", text("longitude")), value("depth", (F.col("depth") * 1000).cast("decimal(20,3)").cast("string")))
    other = F.concat(value("time", F.lit("1999-01-01T00:00:00Z")), value("latitude", F.lit("1")), value("longitude", F.lit("2")), value("depth", F.lit("3")))
    event = F.concat(
        F.lit('<event publicID="smi:net/'), "eventID", F.lit('"><preferredOriginID>o2</preferredOriginID><preferredMagnitudeID>m2</preferredMagnitudeID><origin publicID="o1">'), other, F.lit('</origin><origin publicID="o2">'), mine,
        F.lit('</origin><magnitude publicID="m1">'), value("mag", F.lit("9")), F.lit('<type>Mw</type></magnitude><magnitude publicID="m2">'), value("mag", text("magnitude")), F.lit("<type>Ml</type></magnitude></event>"),
    )
    path = rendered(cat.select(F.col("row_idx").alias("n"), event.alias("value")), "events.qml", ["<eventParameters>"], ["</eventParameters>"])
    rows = validation.mapped(readers.read(cat.sparkSession, path)).filter("error is null")
    return rows.select("eventID", "timeMs", "latitude", "longitude", F.round("depth", 6).alias("depth"), "magnitude", "magnitudeType")


@query("""SELECT row_idx, round(-(row_idx % 89 + 1 + (row_idx % 60) / 60e0 + (row_idx % 59) / 3600e0), 9) AS dms, round(row_idx % 180 + (row_idx % 60) / 60e0, 9) AS dm, round(-(row_idx % 89 + 1.5e0), 9) AS plain,
    round(row_idx % 89 + 1.25e0, 9) AS automatic FROM cat""")
def import_coordinates(cat):
    m, s = (F.format_string("%d", F.col("row_idx") % k) for k in (60, 59))
    d = F.format_string("%d", F.col("row_idx") % 89 + 1)
    dms = F.concat(d, F.lit("°"), m, F.lit("'"), s, F.lit(".0\"S"))
    dm = F.concat(F.format_string("%d", F.col("row_idx") % 180), F.lit(" "), m, F.lit(".0 E"))
    found = [scalar.coordinate(dms, "dms").alias("dms"), scalar.coordinate(dm, "dm").alias("dm"), scalar.coordinate(F.concat(d, F.lit(".5 s")), "dms").alias("plain"), scalar.coordinate(F.concat(d, F.lit(".25deg"))).alias("automatic")]
    return cat.select("row_idx", *found).select("row_idx", *[F.round(c, 9).alias(c) for c in ("dms", "dm", "plain", "automatic")])


STYLES = {"dd/mm/yyyy": "dd/MM/yyyy HH:mm:ss", "mm/dd/yyyy": "MM/dd/yyyy HH:mm:ss", "yyyy-mm-dd": "yyyy-MM-dd HH:mm:ss", "yyyy/mm/dd": "yyyy/MM/dd HH:mm:ss", "iso8601": "yyyy-MM-dd'T'HH:mm:ss'Z'"}


@query(f"SELECT row_idx, {', '.join(f'timeMs // 1000 * 1000 AS t{i}' for i in range(len(STYLES) + 1))}, timeMs AS unix_ms, timeMs AS automatic FROM cat")
def import_times(cat):
    found = [F.unix_millis(scalar.parse_time(F.date_format("time", pattern), style)).alias(f"t{i}") for i, (style, pattern) in enumerate(STYLES.items())]
    found.append(F.unix_millis(scalar.parse_time((F.floor(F.col("timeMs") / 1000)).cast("string"), "unix")).alias(f"t{len(STYLES)}"))
    return cat.select("row_idx", *found, F.unix_millis(scalar.parse_time(F.col("timeMs").cast("string"), "unix_ms")).alias("unix_ms"), F.unix_millis(scalar.parse_time(F.expr(STAMP))).alias("automatic"))


@query("""SELECT header, field, n FROM (VALUES ('Lat_GN', 'latitude'), ('LON', 'longitude'), ('Mw', 'magnitude'), ('origintime', 'time'), ('evid', 'eventID'), ('rms', 'standardError')) AS t(header, field),
    (SELECT count(*) AS n FROM cat WHERE row_idx % 7 <> 0) UNION ALL SELECT 'missing', 'depth', count(*) FROM cat""")
def import_mapping(cat):
    """Fields that a file's headers suggest, with the values they have there, and the field that it lacks with the rows that lack it."""
    cells = F.concat_ws(",", *[F.when(F.col("row_idx") % 7 == 0, "").otherwise(F.col(c).cast("string")) for c in ("latitude", "longitude", "magnitude", "magnitude", "timeMs", "eventID", "depth", "eventType")])
    path = rendered(cat.select(F.col("row_idx").alias("n"), cells.alias("value")), "headers.csv", ["Lat_GN,LON,Mw,mb,origintime,evid,rms,colour"])
    rows = readers.read(cat.sparkSession, path)
    fields = validation.suggest_mapping([c for c in rows.columns if c != "row_idx"])
    lacks = sorted(validation.missing_fields(fields, {}))
    told = [F.struct(F.lit(h).alias("header"), F.lit(f).alias("field"), F.count_if(~scalar.is_missing(F.col(f"`{h}`"))).alias("n")) for h, f in fields.items()]
    told.append(F.struct(F.lit("missing").alias("header"), F.lit(",".join(lacks)).alias("field"), F.count("*").alias("n")))
    return rows.agg(F.array(*told).alias("t")).select(F.explode("t").alias("t")).select("t.*")


@query("""SELECT 'n' AS kind, CASE row_idx % 4 WHEN 0 THEN (row_idx % 100)::DOUBLE WHEN 1 THEN -1.5e0 ELSE 255e0 END AS number, NULL AS word, count(*) AS n FROM cat WHERE row_idx % 4 < 3 GROUP BY 2
    UNION ALL SELECT 't', NULL, CASE WHEN row_idx % 8 = 3 THEN 'abc' ELSE '12 km' END, count(*) FROM cat WHERE row_idx % 4 = 3 GROUP BY 3""")
def import_custom_values(cat):
    """A custom column of numbers and words keeps each value's kind."""
    value = F.expr("CASE row_idx % 4 WHEN 0 THEN string(row_idx % 100) WHEN 1 THEN '-1.5e0' WHEN 2 THEN '0xff' ELSE if(row_idx % 8 = 3, 'abc', '12 km') END")
    cells = F.concat_ws(",", "eventID", F.expr(STAMP), *[F.col(c).cast("string") for c in ("latitude", "longitude", "depth", "magnitude")], value)
    path = rendered(cat.select(F.col("row_idx").alias("n"), cells.alias("value")), "custom.csv", ["id,time,latitude,longitude,depth,magnitude,note"])
    rows = validation.per_value(validation.mapped(readers.read(cat.sparkSession, path)), ["note"])
    kind = F.when(F.schema_of_variant("note") == "STRING", "t").otherwise("n")
    rows = rows.select(kind.alias("kind"), F.when(kind == "n", F.try_variant_get("note", "$", "double")).alias("number"), F.when(kind == "t", F.try_variant_get("note", "$", "string")).alias("word"))
    return rows.groupBy("kind", "number", "word").agg(F.count("*").alias("n"))


TENTHS = "row_idx % 40 + 10"
#: By layout: hundredths without a point or numbers with one, and whether the card has a century.
LAYOUTS = {"hypoinverse": (True, False), "hypoinverse2000": (True, True), "hypo71": (False, False), "hypo71_2000": (False, True)}


def _card(layout: str) -> str:
    """SQL of a card of a layout: southern and eastern ones among them, four kinds of magnitudes, two places of the quarry mark."""
    bare, century = LAYOUTS[layout]
    decimals = lambda v: f"string(bigint(round(100 * ({v}))))" if bare else f"format_string('%.2f', double({v}))"
    cells = {
        "century": "string(year(time) div 100)", "year": "date_format(time, 'yy')", "month": "string(month(time))", "day": "string(day(time))", "hour": "string(hour(time))", "minute": "string(minute(time))", "second": decimals("second(time)"),
        "lat_deg": "string(30 + row_idx % 9)", "lat_sign": "if(row_idx % 2 = 0, 'S', 'N')", "lat_min": decimals("row_idx % 60"), "lon_deg": "string(170 + row_idx % 9)", "lon_sign": "if(row_idx % 3 = 0, 'e', 'W')", "lon_min": decimals("row_idx % 59"),
        "depth": decimals("row_idx % 100"), "remark": "CASE WHEN row_idx % 11 = 0 THEN 'Q ' WHEN row_idx % 13 = 0 THEN ' q' ELSE 'AB' END",
        "magnitude": decimals(f"({TENTHS}) / 10e0"), "amplitude_magnitude": f"if(row_idx % 4 in (1, 2), string({TENTHS} + row_idx % 4 - 2), '')", "duration_magnitude": f"if(row_idx % 4 = 1, string({TENTHS}), '')",
        "code1": "if(row_idx % 4 = 0, 'B', 'x')", "magnitude1": f"if(row_idx % 4 = 0, string(10 * ({TENTHS})), '999')", "code2": "if(row_idx % 4 = 3, 'L', ' ')", "magnitude2": f"if(row_idx % 4 = 3, string(10 * ({TENTHS})), '')",
    }
    if layout == "hypoinverse2000":
        cells |= dict.fromkeys(("amplitude_magnitude", "duration_magnitude", "magnitude1", "magnitude2"), "'111'")
    at, parts = 1, []
    for name, (first, width, *_) in sorted(readers.CARDS[layout].items(), key=lambda f: f[1][0]):
        parts += [f"space({first - at})", f"lpad({cells.get(name, repr(''))}, {width}, ' ')"]
        at = first + width
    return f"concat({', '.join(parts)})"


@query("SELECT layout, ((CASE WHEN full_year THEN year(t) ELSE 1900 + year(t) % 100 END))::INTEGER AS year, month(t)::INTEGER AS month, day(t)::INTEGER AS day, hour(t)::INTEGER AS hour, minute(t)::INTEGER AS minute, second(t)::DOUBLE AS second, "
    "round((CASE WHEN row_idx % 2 = 0 THEN -1 ELSE 1 END) * (30 + row_idx % 9 + (row_idx % 60) / 60e0), 6) AS latitude, round((CASE WHEN row_idx % 3 = 0 THEN 1 ELSE -1 END) * (170 + row_idx % 9 + (row_idx % 59) / 60e0), 6) AS longitude, "
    "(row_idx % 100)::DOUBLE AS depth, round((row_idx % 40 + 10) / 10e0, 2) AS magnitude, count(*) AS n "
    f"FROM (SELECT *, make_timestamp(timeMs * 1000) AS t FROM cat), (VALUES {', '.join(f'({k!r}, {c})' for k, (_, c) in LAYOUTS.items())}) l(layout, full_year) GROUP BY ALL")
def import_cards(cat):
    """Every event as a card of each layout; the magnitude of old cards is the preferred one of four."""
    out = None
    for layout in LAYOUTS:
        path = rendered(cat.select(F.col("row_idx").alias("n"), F.expr(_card(layout)).alias("value")), "cards.txt")
        got = readers.cards(cat.sparkSession, path, layout).withColumn("layout", F.lit(layout))
        out = got if out is None else out.union(got)
    keys = [*[F.col(c) for c in ("layout", "year", "month", "day", "hour", "minute", "second")], *[F.round(c, 6).alias(c) for c in ("latitude", "longitude")], "depth", F.round("magnitude", 2).alias("magnitude")]
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS read, count(*) FILTER (m >= 2 AND NOT q AND y BETWEEN 1900 AND 1950) AS accepted, count(*) FILTER (m >= 2 AND NOT q AND y NOT BETWEEN 1900 AND 1950) AS outside_years, count(*) FILTER (m < 2) AS below_magnitude, count(*) FILTER (m >= 2 AND q) AS blasts
    FROM (SELECT ({TENTHS}) / 10e0 AS m, row_idx % 11 = 0 OR row_idx % 13 = 0 AS q, 1900 + year(make_timestamp(timeMs * 1000)) % 100 AS y FROM cat)""")
def import_card_rejects(cat):
    path = rendered(cat.select(F.col("row_idx").alias("n"), F.expr(_card("hypoinverse")).alias("value")), "cards.txt")
    return readers.admitted(readers.cards(cat.sparkSession, path, "hypoinverse"), 2.0, 1900, 1950, "remark")[1]


@query("SELECT row_idx FROM cat WHERE timeMs BETWEEN (SELECT max(timeMs) FROM cat) - 10 * 86400000 AND (SELECT max(timeMs) FROM cat)")
def initial_load(cat):
    """A store that lacks the older half of the last ten days is filled up from the source."""
    now = cat.agg(F.max("timeMs").alias("t")).first().t
    stored = cat.filter(F.col("timeMs") > now - 5 * 86_400_000)
    return incremental.initial_load(stored, lambda a, b: cat.filter(F.col("timeMs").between(a, b)), now, 10).select("row_idx")


@query("SELECT (row_idx % 6)::VARCHAR AS grp, count(*) AS events FROM cat GROUP BY 1")
def values_of_few(cat):
    return statistics.top_values(cat.withColumn("few", F.col("row_idx") % 6), "few", 2).groupBy("grp").agg(F.count("*").alias("events"))
