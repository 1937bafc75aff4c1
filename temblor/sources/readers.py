"""Readers of catalogue files; each gives text columns and a row number, ready for mapping.

A path may be a folder of files of one kind, each with its own header.  ``row_idx``
ascends with the lines of a file and is unique over all files, not gapless.
"""

from __future__ import annotations

import io
import re
import statistics
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.sources import json_documents

FORMATS = {"quakeml": (".qml", ".quakeml", ".xml"), "delimited": (".csv", ".txt", ".tsv", ".tab"), "excel": (".xlsx",), "json": (".json", ".geojson"), "dat": (".dat",)}
COMMENT = r"^\s*(#|//|%)"


def format_of(path: str) -> str | None:
    """Format of a file by its extension; None for an unknown one."""
    low = path.lower()
    return next((name for name, ends in FORMATS.items() if low.endswith(ends)), None)


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Rows of a file or folder; ``kind`` is one of FORMATS, by default what the path ends in."""
    kind = kind or format_of(path)
    if kind is None:
        raise ValueError(f"no reader for {path}")
    return {"quakeml": quakeml, "delimited": delimited, "excel": excel, "json": json, "dat": dat}[kind](spark, path, **options)


def detect_delimiter(lines: list[str]) -> str:
    """Delimiter of the first lines: the one of most even and frequent use, which the first line must have."""
    best, out = -1.0, ","
    for d in (",", ";", "\t", "|"):
        counts = [line.count(d) for line in lines[:5]]
        if counts and counts[0] > 0:
            score = statistics.fmean(counts) / (statistics.pstdev(counts) + 1)
            if score > best:
                best, out = score, d
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with content that are no comments, numbered in file order."""
    text = spark.read.text(path).withColumn("row_idx", F.monotonically_increasing_id())
    return text.filter((F.trim("value") != "") & ~F.col("value").rlike(COMMENT))


def _split(lines: DataFrame, delimiter: str | None) -> DataFrame:
    head = lines.orderBy("row_idx").limit(6).collect()  # at most 6 lines
    if not head:
        raise ValueError("file is empty")
    if len(head) < 2:
        raise ValueError("file must have a header and at least one data row")
    sep = delimiter or detect_delimiter([r.value for r in head])
    schema_line = head[0].value
    names = [n.strip().strip('"').strip() for n in re.split(re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', schema_line)]
    seen: dict[str, int] = {}
    unique = []
    for i, n in enumerate(names):
        n = n or f"column_{i + 1}"
        seen[n] = seen.get(n, 0) + 1
        unique.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    schema = ", ".join(f"`{n.replace('`', '')}` string" for n in unique)
    rows = lines.filter(F.col("value") != schema_line)  # the header of every file
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return rows.select("row_idx", F.from_csv("value", schema, options).alias("c")).select("row_idx", "c.*")


def delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Delimited text with a header; comment lines start with #, // or %."""
    return _split(_lines(spark, path), delimiter)


def dat(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Delimited text, or columns parted by white space when the first lines have no delimiter."""
    lines = _lines(spark, path)
    first = [r.value for r in lines.orderBy("row_idx").limit(5).collect()]
    if not all(re.search(r"[,;\t|]", line) for line in first):
        lines = lines.withColumn("value", F.regexp_replace(F.trim("value"), r"\s+", ","))
        delimiter = ","
    return _split(lines, delimiter)


def preview(spark: SparkSession, path: str, rows: int = 10) -> dict:
    """Header, first rows (of the first file by name), number of data rows and of comment lines."""
    table = read(spark, path)
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    comments = spark.read.text(path).filter(F.col("value").rlike(COMMENT)).count() if format_of(path) in ("delimited", "dat") else 0
    return {"headers": [c for c in table.columns if c != "row_idx"], "rows": [r.asDict() for r in read(spark, first, **({"kind": format_of(path)})).orderBy("row_idx").limit(rows).collect()], "total": table.count(), "skipped_comments": comments}


def json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, a GeoJSON FeatureCollection, or an object whose first array has objects; values as text.

    A document of any size is shared by tasks (see :mod:`temblor.sources.json_documents`).
    """
    values, features = json_documents.objects(spark, path)
    table = json_documents.as_lines(values)
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    if not kinds:
        raise ValueError("no objects in an array")
    text = lambda c, k: (F.to_json(F.col(c)) if k.startswith(("struct", "array", "map")) else F.col(c).cast("string"))
    table = table.withColumn("row_idx", F.monotonically_increasing_id())
    if not (features and kinds.get("properties", "").startswith("struct")):
        return table.select("row_idx", *[text(f"`{n}`", k).alias(n) for n, k in kinds.items()])
    own = {f.name: f.dataType.simpleString() for f in table.schema["properties"].dataType if f.name not in ("longitude", "latitude")}
    at = F.when(F.col("geometry.type") == "Point", F.col("geometry.coordinates")) if kinds.get("geometry", "").startswith("struct") else F.lit(None).cast("array<double>")
    place = [F.coalesce(F.get(at, F.lit(i)).cast("string"), *([F.col(f"properties.{n}").cast("string")] if n in table.select("properties.*").columns else [])).alias(n) for i, n in enumerate(("longitude", "latitude", "depth"))]
    return table.select("row_idx", *place, *[text(f"properties.`{n}`", k).alias(n) for n, k in own.items() if n != "depth"])


def _xlsx_rows(content: bytes) -> list[list[str | None]]:
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iterfind(".//m:row", ns):
            cells: dict[int, str | None] = {}
            for cell in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]+", cell.get("r", "A1"))[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                value = cell.find("m:v", ns)
                if cell.get("t") == "s":
                    cells[at - 1] = shared[int(value.text)]
                elif cell.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
                else:
                    cells[at - 1] = None if value is None else value.text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of each workbook; the first workbook's header names the columns.  One task reads one workbook."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def header(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame([[p, [(n or f"column_{i + 1}").strip() for i, n in enumerate(_xlsx_rows(c)[0])]] for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "names"])

    first = files.agg(F.min("path").alias("path"))
    names = files.join(first, "path").mapInPandas(header, "path string, names array<string>").first().names

    def work(frames):
        import pandas as pd

        for pdf in frames:
            for content in pdf["content"]:
                yield pd.DataFrame([[None if v is None else str(v) for v in (r + [None] * len(names))[: len(names)]] for r in _xlsx_rows(content)[1:]], columns=names)

    rows = files.mapInPandas(work, ", ".join(f"`{n}` string" for n in names)).withColumn("row_idx", F.monotonically_increasing_id())
    return rows.select("row_idx", *[f"`{n}`" for n in names])


#: A quantity has its number in a ``value`` element, or bare between its own tags.
_QUANTITY = "struct<value:string,_VALUE:string>"
QUAKEML = f"""_publicID string, preferredOriginID string, preferredMagnitudeID string, type string,
    origin array<struct<_publicID:string,time:{_QUANTITY},latitude:{_QUANTITY},longitude:{_QUANTITY},depth:{_QUANTITY},evaluationMode:string,evaluationStatus:string>>,
    magnitude array<struct<_publicID:string,mag:{_QUANTITY},type:string>>, description array<struct<text:string,type:string>>"""


def quakeml(spark: SparkSession, path: str) -> DataFrame:
    """Events of QuakeML files: preferred origin and magnitude, else the first; depth in km, 0 if missing.

    The event id is the last part of the public id; rows that miss something keep nulls
    and fail validation later.
    """
    table = spark.read.format("xml").option("rowTag", "event").option("ignoreNamespace", "true").schema(QUAKEML).load(path)
    table = table.withColumn("row_idx", F.monotonically_increasing_id())
    pick = lambda items, wanted: F.coalesce(F.get(F.filter(items, lambda o: o["_publicID"] == F.col(wanted)), F.lit(0)), F.get(items, F.lit(0)))
    t = table.withColumn("o", pick("origin", "preferredOriginID")).withColumn("m", pick("magnitude", "preferredMagnitudeID"))
    number = lambda path: F.coalesce(F.col(f"{path}.value"), F.trim(F.col(f"{path}._VALUE")))
    region = F.get(F.filter("description", lambda d: d["type"] == "region name"), F.lit(0))["text"]
    return t.select(
        "row_idx",
        F.coalesce(F.element_at(F.split("_publicID", "/"), -1), F.concat(F.lit("qml_"), F.col("row_idx").cast("string"))).alias("eventID"),
        number("o.time").alias("time"),
        number("o.latitude").alias("latitude"),
        number("o.longitude").alias("longitude"),
        (F.coalesce(number("o.depth").try_cast("double"), F.lit(0.0)) / 1000).cast("string").alias("depth"),
        number("m.mag").alias("magnitude"),
        F.col("m.type").alias("magnitudeType"),
        F.col("o.evaluationMode").alias("evaluationMode"),
        F.col("o.evaluationStatus").alias("evaluationStatus"),
        region.alias("locality"),
        F.col("type").alias("eventType"),
    )


# Fields of four card formats as (first column from 1, width, decimals implied where no point is written).
CARDS = {
    "hypoinverse": {
        "year": (1, 2, 0), "month": (3, 2, 0), "day": (5, 2, 0), "hour": (7, 2, 0), "minute": (9, 2, 0), "second": (11, 4, 2),
        "lat_deg": (15, 2, 0), "lat_sign": (17, 1), "lat_min": (18, 4, 2), "lon_deg": (22, 3, 0), "lon_sign": (25, 1), "lon_min": (26, 4, 2), "depth": (30, 5, 2),
        "amplitude_magnitude": (35, 2, 1), "duration_magnitude": (68, 2, 1), "remark": (77, 2), "horizontal_error": (81, 4, 2), "vertical_error": (85, 4, 2),
        "code1": (115, 1), "magnitude1": (116, 3, 2), "code2": (122, 1), "magnitude2": (123, 3, 2),
    },
    "hypoinverse2000": {
        "century": (1, 2, 0), "year": (3, 2, 0), "month": (5, 2, 0), "day": (7, 2, 0), "hour": (9, 2, 0), "minute": (11, 2, 0), "second": (13, 4, 2),
        "lat_deg": (17, 2, 0), "lat_sign": (19, 1), "lat_min": (20, 4, 2), "lon_deg": (24, 3, 0), "lon_sign": (27, 1), "lon_min": (28, 4, 2), "depth": (32, 5, 2),
        "amplitude_magnitude": (37, 3, 2), "duration_magnitude": (71, 3, 2), "remark": (81, 2), "horizontal_error": (86, 4, 2), "vertical_error": (90, 4, 2),
        "code1": (123, 1), "magnitude1": (124, 3, 2), "code2": (130, 1), "magnitude2": (131, 3, 2), "magnitude": (148, 3, 2),
    },
    "hypo71": {
        "year": (1, 2, 0), "month": (3, 2, 0), "day": (5, 2, 0), "hour": (8, 2, 0), "minute": (10, 2, 0), "second": (13, 5, 2),
        "lat_deg": (18, 3, 0), "lat_sign": (21, 1), "lat_min": (22, 5, 2), "lon_deg": (28, 3, 0), "lon_sign": (31, 1), "lon_min": (32, 5, 2), "depth": (39, 5, 2),
        "magnitude": (47, 4, 2), "horizontal_error": (69, 4, 1), "vertical_error": (74, 4, 1), "quality": (79, 1),
    },
    "hypo71_2000": {
        "century": (1, 2, 0), "year": (3, 2, 0), "month": (5, 2, 0), "day": (7, 2, 0), "hour": (10, 2, 0), "minute": (12, 2, 0), "second": (15, 5, 2),
        "lat_deg": (20, 3, 0), "lat_sign": (23, 1), "lat_min": (24, 5, 2), "lon_deg": (29, 4, 0), "lon_sign": (33, 1), "lon_min": (34, 5, 2), "depth": (39, 7, 2),
        "magnitude": (48, 5, 2), "horizontal_error": (70, 5, 1), "vertical_error": (75, 5, 1), "quality": (81, 1),
    },
}
# Codes of the magnitudes that a card may carry besides its own two, and the order in which the first positive one is taken.
CODED = {"B": "regional", "L": "local"}
PREFERENCE = ("regional", "duration", "amplitude", "local")


def _card_number(field: tuple[int, int, int]) -> Column:
    """Number in a field: blanks count nothing, an empty field is 0, decimals are implied where no point is written."""
    first, width, decimals = field
    text = F.regexp_replace(F.substring("value", first, width), " ", "")
    number = text.try_cast("double")
    return F.when(text == "", 0.0).when(text.contains("."), number).otherwise(number / 10.0**decimals)


def cards(spark: SparkSession, path: str, layout: str | dict = "hypo71", preference: tuple[str, ...] = PREFERENCE) -> DataFrame:
    """Fixed-width location cards as numbers: time parts, latitude, longitude, depth, magnitude, errors, remark, quality.

    Latitudes are north unless marked S, longitudes west unless marked E, as the formats
    have it; years are of the 20th century where a card has none.  A layout without a
    magnitude of its own takes the first positive one of ``preference``, 0 if there is
    none.  Cards that hold no number where one belongs keep nulls.
    """
    spec = CARDS[layout] if isinstance(layout, str) else layout
    num = lambda k: _card_number(spec[k]) if k in spec else F.lit(0.0)
    text = lambda k: F.trim(F.substring("value", *spec[k][:2])) if k in spec else F.lit("")
    degrees = lambda k: num(f"{k}_deg") + num(f"{k}_min") / 60
    century = num("century") if "century" in spec else F.lit(19.0)
    if "magnitude" in spec:
        magnitude = num("magnitude")
    else:
        coded = lambda kind: F.greatest(*[F.when(F.upper(text(f"code{i}")).isin([c for c, of in CODED.items() if of == kind]), num(f"magnitude{i}")).otherwise(0.0) for i in (1, 2)])
        of = {"regional": coded("regional"), "local": coded("local"), "duration": num("duration_magnitude"), "amplitude": num("amplitude_magnitude")}
        magnitude = F.coalesce(*[F.when(of[p] > 0, of[p]) for p in preference], F.lit(0.0))
    whole = [F.col(c).cast("int").alias(c) for c in ("year", "month", "day", "hour", "minute")]
    out = _lines(spark, path).select(
        "row_idx", (century * 100 + num("year")).alias("year"), *[num(c).alias(c) for c in ("month", "day", "hour", "minute", "second")],
        F.when(F.upper(text("lat_sign")) == "S", -degrees("lat")).otherwise(degrees("lat")).alias("latitude"), F.when(F.upper(text("lon_sign")) == "E", degrees("lon")).otherwise(-degrees("lon")).alias("longitude"),
        num("depth").alias("depth"), magnitude.alias("magnitude"), num("horizontal_error").alias("horizontal_error"), num("vertical_error").alias("vertical_error"), text("remark").alias("remark"), text("quality").alias("quality"),
    )
    return out.select("row_idx", *whole, *out.columns[6:])


def free_format(spark: SparkSession, path: str) -> DataFrame:
    """Numbers parted by white space: year month day hour minute second latitude longitude depth magnitude."""
    names = ["year", "month", "day", "hour", "minute", "second", "latitude", "longitude", "depth", "magnitude"]
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).select("row_idx", *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def admitted(cards_: DataFrame, min_magnitude: float, first_year: int, last_year: int, remark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the tests of magnitude, quarry mark (a q in the remark) and year, and one row of reject counts.

    A row is counted at the first test that it fails.
    """
    small = F.coalesce(F.col("magnitude") < min_magnitude, F.lit(True))
    blast = F.coalesce(F.lower(F.col(remark)).contains("q"), F.lit(False)) if remark else F.lit(False)
    out = F.coalesce(~F.col("year").between(first_year, last_year), F.lit(True))
    counts = cards_.agg(F.count("*").alias("read"), F.count_if(~small & ~blast & ~out).alias("accepted"), F.count_if(~small & ~blast & out).alias("outside_years"), F.count_if(small).alias("below_magnitude"), F.count_if(~small & blast).alias("blasts"))
    return cards_.filter(~small & ~blast & ~out), counts
