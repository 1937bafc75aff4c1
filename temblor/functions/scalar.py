"""Scalar column functions of the catalogue: classes, moments, dates, units, parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

#: Header names by which a field is recognised, in order of preference.
ALIASES = {
    "latitude": ["latitude", "lat", "lat_gn", "lat_jr", "lat_sm", "y", "lat_deg", "latitude_deg"],
    "longitude": ["longitude", "lon", "long", "lng", "lon_gn", "lon_jr", "lon_sm", "x", "lon_deg", "longitude_deg"],
    "depth": ["depth", "depth_gn", "depth_jr", "depth_sm", "dep", "z", "depth_km"],
    "magnitude": ["magnitude", "mag", "mag_gn", "mag_sm", "mag_jr", "ml", "mw", "mb", "ms"],
    "time": ["time", "datetime", "date", "origin_time", "origintime", "timestamp"],
    "eventID": ["eventid", "event_id", "id", "publicid", "public_id", "quakeid", "earthquake_id", "evid"],
    "locality": ["locality", "location", "place", "region", "area", "description"],
    "mmi": ["mmi", "intensity", "modified_mercalli"],
    "azimuthalGap": ["azimuthal_gap", "gap", "azi_gap"],
    "magnitudeType": ["magnitude_type", "mag_type", "type_mag"],
    "evaluationStatus": ["evaluation_status", "status", "eval_status"],
    "usedStationCount": ["used_station_count", "station_count", "stations", "count_stations", "n_stations"],
    "minimumDistance": ["minimum_distance", "min_dist", "min_distance"],
    "standardError": ["standard_error", "std_error", "rms", "se"],
}
#: Header names of split date columns.
DATE_PARTS = {"year": ["year", "yr"], "month": ["month", "mon", "mo"], "day": ["day", "dy"], "hour": ["hour", "hr", "h"], "minute": ["minute", "min", "mi"], "second": ["second", "sec", "s"]}


def time_ms(time: Column) -> Column:
    """Epoch milliseconds, floored."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / 1000).cast("bigint")


def magnitude_bin(magnitude: Column) -> Column:
    return F.floor(magnitude).cast("bigint")


def depth_category(depth: Column) -> Column:
    """Up to 70 km shallow, up to 300 km intermediate, else deep."""
    return F.when(depth <= 70, "shallow").when(depth <= 300, "intermediate").otherwise("deep")


def depth_class(depth: Column) -> Column:
    """Histogram classes: below 70 km, below 300 km, deeper."""
    return F.when(depth < 70, "shallow").when(depth < 300, "intermediate").otherwise("deep")


def magnitude_class(magnitude: Column) -> Column:
    return F.when(magnitude < 3, "<3").when(magnitude < 4, "3-4").when(magnitude < 5, "4-5").when(magnitude < 6, "5-6").otherwise("6+")


def map_depth_class(depth: Column) -> Column:
    """Map classes 0 to 4 with edges 15, 40, 100 and 200 km."""
    return F.when(depth < 15, 0).when(depth < 40, 1).when(depth < 100, 2).when(depth < 200, 3).otherwise(4)


def marker_size(magnitude: Column) -> Column:
    return F.greatest(F.lit(2.0), F.pow(F.lit(2.0), magnitude - 2))


def scaled_size(value: Column, low: Column, high: Column, smallest: float = 2.0, largest: float = 20.0) -> Column:
    """Linear size between two bounds; the middle when all values are equal."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.5)
    return F.lit(smallest) + share * (largest - smallest)


def unit_share(value: Column, low: Column, high: Column) -> Column:
    """Position of a value between bounds, clamped to 0..1."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))).otherwise(0.5)


def moment_nm(magnitude: Column) -> Column:
    """Seismic moment in newton metres."""
    return F.pow(F.lit(10.0), 1.5 * magnitude + 9.1)


def cluster_moment(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 1.2 * magnitude)


def equivalent_magnitude(moment: Column) -> Column:
    return F.log10(moment) / 1.2


def days_since(time_ms_: Column, origin_ms: Column | int) -> Column:
    return (time_ms_ - origin_ms) / F.lit(float(DAY_MS))


def decimal_year(time_ms_: Column) -> Column:
    """Calendar year plus the share of it that has passed, in UTC."""
    t = F.timestamp_millis(time_ms_)
    start = F.unix_millis(F.date_trunc("year", t))
    stop = F.unix_millis(F.date_trunc("year", t) + F.expr("interval 1 year"))
    return F.year(t) + (time_ms_ - start) / (stop - start)


def field_unit(name: str) -> str:
    """Unit suffix of a field by its name."""
    low = name.lower()
    for part, unit in (("depth", " km"), ("distance", " km"), ("latitude", "°"), ("longitude", "°"), ("gap", "°"), ("time", "")):
        if part in low:
            return unit
    return ""


def display_date(time: Column, with_time: bool = False) -> Column:
    return F.coalesce(F.date_format(time, "dd/MM/yyyy HH:mm:ss" if with_time else "dd/MM/yyyy"), F.lit("Invalid Date"))


def iso_date(display: Column) -> Column:
    """yyyy-MM-dd of a dd/MM/yyyy text; null if it is none."""
    return F.date_format(F.try_to_timestamp(display, F.lit("dd/MM/yyyy")), "yyyy-MM-dd")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value worked out once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_missing(text: Column) -> Column:
    """Null, blank, nan, null or undefined."""
    t = F.trim(text.cast("string"))
    return t.isNull() | t.isin("", "null", "undefined") | (F.lower(t) == "nan")


def leading_number(text: Column) -> Column:
    """Number at the start of a text, as lenient parsers read it; null without one."""
    found = F.regexp_extract(text.cast("string"), r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return found.try_cast("double")


def first_valid_number(*columns: Column, sentinel: float = -9.0) -> Column:
    """First column that holds a number other than the sentinel."""
    return F.coalesce(*[F.nullif(leading_number(c), F.lit(sentinel)) for c in columns])


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def dms_degrees(text: Column) -> Column:
    """Degrees of a sexagesimal, decimal-minute or plain coordinate; S and W are negative."""
    return once(F.upper(F.trim(text)), _degrees)


def _degrees(t: Column) -> Column:
    dms = r"(-?)(\d+)[°:\s]+(\d+)[':\s]+(\d+\.?\d*)[\":\s]*([NSEW])?"
    dm = r"(-?)(\d+)[°:\s]+(\d+\.?\d*)[':\s]*([NSEW])?"
    part = lambda p, n: F.regexp_extract(t, p, n)
    num = lambda p, n: part(p, n).try_cast("double")

    def signed(value: Column, pattern: str, letter: int) -> Column:
        return F.when(part(pattern, letter).isin("S", "W"), -F.abs(value)).when(part(pattern, 1) == "-", -value).otherwise(value)

    seconds = signed(num(dms, 2) + num(dms, 3) / 60 + num(dms, 4) / 3600, dms, 5)
    minutes = signed(num(dm, 2) + num(dm, 3) / 60, dm, 4)
    plain = leading_number(F.regexp_replace(t, "[NSEW]", ""))
    return F.when(t.rlike(dms), seconds).when(t.rlike(dm), minutes).otherwise(F.when(t.rlike("[SW]"), -F.abs(plain)).otherwise(plain))


def coordinate(text: Column, style: str = "auto") -> Column:
    """Coordinate in degrees by style: decimal, dms, dm, or auto (a leading number, else sexagesimal)."""
    if style == "decimal":
        return leading_number(text)
    if style in ("dms", "dm"):
        return dms_degrees(text)
    return F.coalesce(leading_number(text), dms_degrees(text))


def _ordered_date(parts: Column, day_parts: Column, order: str) -> Column:
    """Timestamp of day, month and year parts in a given order; an overlong day rolls into the next month.

    ``parts`` are the date and the clock of a text, ``day_parts`` those of the date.
    """
    whole = lambda c: F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    clock = F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("00:00:00")), ":")

    def at(n: Column) -> Column:
        year = F.when(n["y"] < 50, n["y"] + 2000).when(n["y"] < 100, n["y"] + 1900).otherwise(n["y"])
        hour, minute = (F.coalesce(whole(F.get(n["clock"], F.lit(i))), F.lit(0)) for i in (0, 1))
        second = F.coalesce(leading_number(F.get(n["clock"], F.lit(2))), F.lit(0.0))
        ok = (F.size(day_parts) >= 3) & n["m"].between(1, 12) & n["d"].between(1, 31) & year.isNotNull()
        first = F.try_make_timestamp(year, n["m"], F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        millis = F.unix_millis(first) + ((n["d"] - 1) * 86400 + hour * 3600 + minute * 60).cast("bigint") * 1000 + F.floor(second * 1000 + 0.5)
        return F.when(ok, F.timestamp_millis(millis))

    return once(F.struct(*[whole(F.get(day_parts, F.lit(i))).alias(k) for i, k in enumerate(order)], clock.alias("clock")), at)


def _date_parts(t: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the parts of a text, and of the parts of its date."""
    return once(F.split(t, r"[\sT]+"), lambda parts: once(F.split(F.get(parts, F.lit(0)), r"[-/.]"), lambda days: f(parts, days)))


#: Date patterns in the order they are tried, and what a text of each begins with: only such a text is parsed.
DATE_PATTERNS = {"dd/MM/yyyy": r"^\d\d/\d\d/", "MM/dd/yyyy": r"^\d\d/\d\d/", "yyyy-MM-dd": r"^[+-]?\d{4,}-\d\d-\d\d( |$)", "dd-MM-yyyy": r"^\d\d-\d\d-", "yyyy/MM/dd": r"^[+-]?\d{4,}/\d\d/"}


def parse_time(text: Column, style: str = "auto") -> Column:
    """Timestamp of a text: unix, unix_ms, iso8601, dd/mm/yyyy, mm/dd/yyyy, yyyy-mm-dd, yyyy/mm/dd or auto.

    Auto reads digits as epoch seconds below 1e10, else milliseconds; then day-first
    and month-first dates, year-first dates and ISO texts, in that order, if the year
    lies in 1700..2100; then the order that the parts' sizes suggest.
    """
    return once(F.trim(text), lambda t: _parsed(t, style))


def _parsed(t: Column, style: str) -> Column:
    whole = F.regexp_extract(t, r"^([+-]?\d+)", 1).try_cast("bigint")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}"), F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.concat(t, F.lit("-01")))))
    if style == "unix":
        return F.timestamp_millis(whole * 1000)
    if style == "unix_ms":
        return F.timestamp_millis(whole)
    if style == "iso8601":
        return iso
    order = {"dd/mm/yyyy": "dmy", "mm/dd/yyyy": "mdy", "yyyy-mm-dd": "ymd", "yyyy/mm/dd": "ymd"}.get(style)
    if order:
        return _date_parts(t, lambda parts, days: _ordered_date(parts, days, order))
    digits = F.when(t.rlike(r"^\d+$"), once(whole, lambda n: F.when(n < 10_000_000_000, F.timestamp_millis(n * 1000)).otherwise(F.timestamp_millis(n))))
    recent = lambda got: F.when(F.year(got).between(1700, 2100), got)
    tried = [F.when(t.rlike(begins), once(F.try_to_timestamp(t, F.lit(pattern + "[ HH:mm:ss[.SSS]]")), recent)) for pattern, begins in DATE_PATTERNS.items()]

    def guessed(parts: Column, days: Column) -> Column:
        head, second = (F.regexp_extract(F.coalesce(F.get(days, F.lit(i)), F.lit("")), r"^\s*(\d+)", 1).try_cast("int") for i in (0, 1))
        ordered = lambda order: _ordered_date(parts, days, order)
        by_size = F.when(head > 31, ordered("ymd")).when(head > 12, ordered("dmy")).when(second > 12, ordered("mdy")).otherwise(ordered("dmy"))
        return F.when(F.size(days) >= 3, by_size)

    return F.coalesce(digits, *tried, iso, _date_parts(t, guessed))
