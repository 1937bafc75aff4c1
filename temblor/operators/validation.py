"""Mapping of source columns, row validation, quarantine and import statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.functions import scalar
from temblor.schema import REQUIRED_FIELDS


@dataclass(frozen=True)
class Rules:
    """Bounds of a valid row.  Depth and magnitude ranges count only when ``strict``."""

    min_latitude: float = -90
    max_latitude: float = 90
    min_longitude: float = -180
    max_longitude: float = 180
    min_depth: float = 0
    max_depth: float = 1000
    min_magnitude: float = -2
    max_magnitude: float = 10
    min_year: int = 1800
    allow_future: bool = False
    strict: bool = False


DEFAULT = Rules()
NEW_ZEALAND = Rules(min_latitude=-48, max_latitude=-33, min_longitude=165, max_longitude=180, max_depth=700, max_magnitude=9)


def suggest_mapping(headers: list[str]) -> dict[str, str]:
    """Field of each header by its aliases; a field is given once, in order of headers."""
    out: dict[str, str] = {}
    for header in headers:
        low = header.lower().strip()
        for name, aliases in scalar.ALIASES.items():
            if low in aliases and name not in out.values():
                out[header] = name
                break
    return out


def date_parts(headers: list[str]) -> dict[str, str]:
    """Header of each part of a split date; empty unless year, month and day are there."""
    found = {part: h for part, names in scalar.DATE_PARTS.items() for h in headers if h.lower().strip() in names}
    return found if {"year", "month", "day"} <= set(found) else {}


def missing_fields(mapping: dict[str, str], parts: dict[str, str]) -> list[str]:
    have = set(mapping.values()) | ({"time"} if parts else set())
    return [f for f in REQUIRED_FIELDS if f != "eventID" and f not in have]


def mapped(raw: DataFrame, mapping: dict[str, str] | None = None, date_style: str = "auto", coordinate_style: str = "auto", rules: Rules = DEFAULT, now_ms: int | None = None, row: str = "row_idx") -> DataFrame:
    """Typed catalogue rows with ``error`` (null if valid), from text columns.

    The first rule that a row breaks names its error.  Unmapped columns stay: as
    numbers where every value of the column is one, else as text (see :func:`typed`).
    A missing eventID is ``csv_`` and the row number, a missing locality 'Unknown Location'.
    """
    mapping = suggest_mapping([c for c in raw.columns if c != row]) if mapping is None else mapping
    parts = date_parts([c for c in raw.columns if c != row])
    source = {f: h for h, f in mapping.items()}
    text = lambda f: F.when(~scalar.is_missing(F.col(f"`{source[f]}`")), F.col(f"`{source[f]}`").cast("string"))
    if parts and "time" not in source:
        number = lambda p, default: F.coalesce(scalar.leading_number(F.col(f"`{parts[p]}`")), F.lit(default)) if p in parts else F.lit(default)
        first = F.try_make_timestamp(scalar.leading_number(F.col(f"`{parts['year']}`")).cast("int"), number("month", 1.0).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        millis = F.unix_millis(first) + (((number("day", 1.0) - 1) * 86400 + number("hour", 0.0) * 3600 + number("minute", 0.0) * 60) * 1000 + F.floor(number("second", 0.0) * 1000 + 0.5)).cast("bigint")
        time = F.timestamp_millis(millis)
    else:
        time = scalar.parse_time(text("time"), date_style) if "time" in source else F.lit(None).cast("timestamp")
    value = lambda f, how: how(text(f)) if f in source else F.lit(None).cast("double")
    kept = [c for c in raw.columns if c != row and mapping.get(c) not in {*REQUIRED_FIELDS, "locality", "mmi"} and c not in parts.values()]
    parsed = F.struct(
        F.coalesce(text("eventID") if "eventID" in source else F.lit(None).cast("string"), F.concat(F.lit("csv_"), F.col(row).cast("string"))).alias("eventID"),
        time.alias("time"),
        value("latitude", lambda t: scalar.coordinate(t, coordinate_style)).alias("latitude"),
        value("longitude", lambda t: scalar.coordinate(t, coordinate_style)).alias("longitude"),
        value("depth", scalar.leading_number).alias("depth"),
        value("magnitude", scalar.leading_number).alias("magnitude"),
        F.coalesce(text("locality") if "locality" in source else F.lit(None).cast("string"), F.lit("Unknown Location")).alias("locality"),
        F.nullif(value("mmi", scalar.leading_number), F.lit(0.0)).alias("mmi"),
        *[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in kept],
    )
    # A row of a generator: a filter by ``error`` is not pushed below it, so nothing is parsed for the filter again.
    out = raw.select(F.col(row), F.inline(F.array(parsed))).withColumn("timeMs", F.unix_millis("time"))
    now = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    r, day = rules, 86_400_000
    checks = [
        (F.col("time").isNull(), "invalid time"),
        (F.lit(not r.allow_future) & (F.col("timeMs") > now + (0 if r.strict else day)), "time in the future"),
        (F.year("time") < r.min_year, f"year before {r.min_year}"),
        (F.col("latitude").isNull(), "invalid latitude"),
        (~F.col("latitude").between(r.min_latitude, r.max_latitude), "latitude out of range"),
        (F.col("longitude").isNull(), "invalid longitude"),
        (~F.col("longitude").between(r.min_longitude, r.max_longitude), "longitude out of range"),
        (F.col("depth").isNull(), "invalid depth"),
        (F.lit(r.strict) & ~F.col("depth").between(r.min_depth, r.max_depth), "depth out of range"),
        (F.col("magnitude").isNull(), "invalid magnitude"),
        (F.lit(r.strict) & ~F.col("magnitude").between(r.min_magnitude, r.max_magnitude), "magnitude out of range"),
    ]
    error = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        error = F.when(bad, F.lit(name)).otherwise(error)
    return out.withColumn("error", error)


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn text columns into numbers where every present value is one; one pass finds which."""
    if not columns:
        return df
    test = lambda c: F.every(scalar.is_missing(F.col(c)) | F.col(c).try_cast("double").isNotNull()).alias(c)
    ok = df.agg(*[test(c) for c in columns]).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if ok[c]})


NUMBER = r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)|0[xX][0-9a-fA-F]+)\s*$"


def per_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn text columns into VARIANT: each value a number where it reads as one, else the text as it stands.

    Empty and blank texts stay texts, null stays null.  ``0x`` numbers are hexadecimal.
    """
    out = {}
    for c in columns:
        text = F.col(c).cast("string")
        bare = F.trim(text)
        hexadecimal = F.conv(F.substring(bare, 3, 32), 16, 10).try_cast("double")
        number = F.when(F.lower(bare).startswith("0x"), hexadecimal).otherwise(bare.try_cast("double"))
        out[c] = F.when(text.rlike(NUMBER), number.cast("variant")).otherwise(text.cast("variant"))
    return df.withColumns(out)


def split_valid(checked: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine; ``fail_fast`` makes any invalid row an error when it is read."""
    if fail_fast:
        checked = checked.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("row "), F.col("row_idx").cast("string"), F.lit(": "), F.col("error")))))
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def import_statistics(checked: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: counts, success rate, ranges of the valid rows and up to five sample errors."""
    ok = F.col("error").isNull()
    spans = [f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in ("timeMs", "magnitude", "depth", "latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))]
    sample = checked.filter(~ok).orderBy("row_idx").limit(5).agg(F.sort_array(F.collect_list(F.struct("row_idx", "error"))).alias("samples"))
    out = checked.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.lit(skipped).alias("skipped"), *spans)
    return out.withColumn("success_rate", F.round(100.0 * F.col("valid") / F.nullif(F.col("total"), F.lit(0)), 1)).crossJoin(sample)


def error_counts(checked: DataFrame) -> DataFrame:
    """(error, severity, n): rows of each error; values that are missing or no values are errors, others warnings."""
    severity = F.when(F.col("error").startswith("invalid"), "error").otherwise("warning")
    return checked.filter("error is not null").groupBy("error").agg(F.count("*").alias("n")).select("error", severity.alias("severity"), "n")


def error_report(checked: DataFrame, most: int = 1000, row: str = "row_idx") -> DataFrame:
    """(row, description) of the first ``most`` faulty rows in order, and a last line, of row null, if there are more."""
    bad = checked.filter("error is not null").select(F.col(row).cast("bigint").alias("row"), F.col("error").alias("description"))
    more = bad.agg((F.count("*") - most).alias("n")).filter("n > 0")
    note = more.select(F.lit(None).cast("bigint").alias("row"), F.concat(F.lit("and "), F.col("n").cast("string"), F.lit(" more")).alias("description"))
    return bad.orderBy("row").limit(most).unionByName(note)


def quality_errors(cat: DataFrame, now_ms: int | None = None) -> list[str]:
    """Complaints about a whole catalogue: empty, or extremes out of bounds."""
    r = cat.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("magnitude", "depth", "timeMs") for n, f in (("lo", F.min), ("hi", F.max))], F.unix_millis(F.current_timestamp()).alias("now")).first()
    if not r.n:
        return ["no events"]
    out = []
    if r.lo_magnitude < -2 or r.hi_magnitude > 10:
        out.append(f"magnitude range {r.lo_magnitude:.1f} to {r.hi_magnitude:.1f} is outside -2 to 10")
    if r.lo_depth < 0 or r.hi_depth > 1000:
        out.append(f"depth range {r.lo_depth:.1f} to {r.hi_depth:.1f} km is outside 0 to 1000")
    if r.hi_timeMs > (r.now if now_ms is None else now_ms) + 86_400_000:
        out.append("some times lie in the future")
    return out
