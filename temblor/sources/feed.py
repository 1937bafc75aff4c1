"""A paged catalogue service as a Spark data source: one partition for each month."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "eventID string, timeMs bigint, latitude double, longitude double, depth double, magnitude double, locality string, eventType string, magnitudeType string, evaluationStatus string, evaluationMode string, modificationTime string, issue string"
FULL_PAGE = 20_000
RETRY = (429, 500, 502, 503, 504)


def month_chunks(start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """[start, end) cut at month-long steps from start; the last one ends at end."""
    out, at, n = [], start, 0
    while at < end:
        n += 1
        month = start.month - 1 + n
        year, month = start.year + month // 12, month % 12 + 1
        last = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]
        nxt = min(start.replace(year=year, month=month, day=min(start.day, last)), end)
        out.append((at, nxt))
        at = nxt
    return out


def get_json(url: str, attempts: int = 3, wait: float = 0.6) -> dict:
    """A page; network errors and busy answers are tried again with growing, jittered waits."""
    for n in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or n == attempts:
                raise
        except urllib.error.URLError:
            if n == attempts:
                raise
        time.sleep(wait * 2 ** (n - 1) + random.uniform(0, 0.25))
    raise AssertionError("unreachable")


def features(fetch, start: datetime, end: datetime, full: int = FULL_PAGE):
    """(feature, issue) of an interval; a full page or a refusal halves it down to one day, then it is truncated.

    An interval that can't be read is told as failed; the others go on.
    """
    try:
        page = fetch(start, end)
        found = page.get("features", [])
        refused = False
    except urllib.error.URLError as e:
        if getattr(e, "code", None) != 400:
            yield None, "failed"
            return
        found, refused = [], True
    if (refused or len(found) >= full) and end - start > timedelta(hours=24):
        mid = start + (end - start) / 2
        yield from features(fetch, start, mid, full)
        yield from features(fetch, mid, end, full)
        return
    if refused or len(found) >= full:
        yield None, "truncated"
    for f in found:
        yield f, None


def row_of(feature: dict) -> tuple:
    """Columns of a GeoJSON feature; what is missing or unreadable is null."""
    p, g = feature.get("properties") or {}, (feature.get("geometry") or {}).get("coordinates") or []
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    try:
        at = datetime.fromisoformat(str(p.get("origintime") or p.get("time")).replace("Z", "+00:00"))
        ms = int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
    except ValueError:
        ms = None
    depth = number(p.get("depth")) if p.get("depth") is not None else number(g[2]) if len(g) > 2 else None
    return (p.get("publicid") or p.get("publicID"), ms, number(g[1]) if len(g) > 1 else None, number(g[0]) if g else None, depth, number(p.get("magnitude")), p.get("locality"), p.get("eventtype"), p.get("magnitudetype"), p.get("evaluationstatus"), p.get("evaluationmode"), p.get("modificationtime"), None)


class Chunk(InputPartition):
    def __init__(self, start: datetime, end: datetime):
        self.start, self.end = start, end


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        at = lambda k: datetime.fromisoformat(self.options[k].replace("Z", "+00:00")).astimezone(timezone.utc)
        return [Chunk(a, b) for a, b in month_chunks(at("start"), at("end"))]

    def read(self, partition):
        url, full = self.options["url"], int(self.options.get("fullpage", FULL_PAGE))

        def fetch(a, b):
            return get_json(url.format(start=a.strftime("%Y-%m-%dT%H:%M:%S"), end=b.strftime("%Y-%m-%dT%H:%M:%S"), minmag=self.options.get("minmag", "0")))

        for feature, issue in features(fetch, partition.start, partition.end, full):
            yield row_of(feature) if feature is not None else (None,) * 12 + (issue,)


class CatalogueFeed(DataSource):
    """``spark.read.format("catalogue_feed").option("url", "...{start}...{end}...{minmag}")`` with start and end.

    Register with ``spark.dataSource.register(CatalogueFeed)``.  Rows with an ``issue``
    tell of intervals that could not be read whole.
    """

    @classmethod
    def name(cls):
        return "catalogue_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(self.options)
