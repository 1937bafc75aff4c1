"""Geographic column expressions; all stay inside generated code."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor import schema

EARTH_KM = 6371.0
#: The search box of the network, west, south, east, north.
NETWORK_BOX = (163.0, -49.0, 179.9, -27.0)
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = (F.lit(x) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def search_radius_km(magnitude: Column) -> Column:
    """Rupture-length radius with a floor of 5 km."""
    return F.greatest(F.lit(5.0), rupture_length_km(magnitude))


def rupture_length_km(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 0.59 * magnitude - 2.44)


def projected(cat: DataFrame) -> DataFrame:
    """Add planar ``x_km, y_km`` about the mean of the catalogue; one aggregate row is broadcast."""
    mean = cat.agg(F.avg("latitude").alias("lat0"), F.avg("longitude").alias("lon0"))
    out = cat.crossJoin(F.broadcast(mean))
    x = (F.col("longitude") - F.col("lon0")) * 111.32 * F.cos(F.col("lat0") * math.pi / 180)
    return out.withColumn("x_km", x).withColumn("y_km", (F.col("latitude") - F.col("lat0")) * 110.57).drop("lat0", "lon0")


def in_box(box: tuple[float, float, float, float] = NETWORK_BOX) -> Column:
    west, south, east, north = box
    return F.col("longitude").between(west, east) & F.col("latitude").between(south, north)


def plottable() -> Column:
    """Finite coordinates in range."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-360, 360)


def parse_polygon(text: str) -> list[tuple[float, float]]:
    """Vertices (lon, lat) of ``POLYGON((...))``, ``((...))`` or one vertex a line; ``#`` starts a comment line.

    Raises ValueError on fewer than three vertices, unreadable numbers, a latitude
    beyond 90 or a longitude beyond 360 degrees.
    """
    body = text.strip()
    if not body:
        raise ValueError("polygon text is empty")
    ring = re.search(r"\(\((.*?)\)\)", body, re.S)
    if ring:
        items = ring.group(1).split(",")
    elif body.upper().startswith("POLYGON"):
        raise ValueError("invalid WKT polygon")
    else:
        items = [line for line in body.splitlines() if line.strip() and not line.strip().startswith("#")]
    out = []
    for item in items:
        numbers = re.split(r"[\s,]+", item.strip())
        try:
            lon, lat = float(numbers[0]), float(numbers[1])
        except (ValueError, IndexError):
            raise ValueError(f"invalid coordinate: {item.strip()!r}") from None
        if not -90 <= lat <= 90:
            raise ValueError(f"latitude out of range: {lat}")
        if not -360 <= lon <= 360:
            raise ValueError(f"longitude out of range: {lon}")
        out.append((lon, lat))
    if len(out) < 3:
        raise ValueError("a polygon needs at least 3 points")
    return out


def in_polygon(vertices: list[tuple[float, float]], lon: Column | None = None, lat: Column | None = None, wrap: bool = True) -> Column:
    """Ray casting against literal vertices; with ``wrap`` also at longitude +-360 degrees."""
    lon = F.col("longitude") if lon is None else lon
    lat = F.col("latitude") if lat is None else lat

    def inside(x: Column) -> Column:
        odd = F.lit(0)
        for (xi, yi), (xj, yj) in zip(vertices, [vertices[-1], *vertices[:-1]], strict=True):
            if yi == yj:
                continue
            crosses = ((F.lit(yi) > lat) != (F.lit(yj) > lat)) & (x < F.lit(xj - xi) * (lat - yi) / (yj - yi) + xi)
            odd = odd + crosses.cast("int")
        return odd % 2 == 1

    return inside(lon) | inside(lon + 360) | inside(lon - 360) if wrap else inside(lon)


def compass(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Eight-way direction from point 1 to point 2, without scaling longitude."""
    angle = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    index = F.floor(F.pmod(angle + 360, F.lit(360.0)) / 45 + 0.5).cast("int") % 8
    return F.element_at(F.array(*[F.lit(d) for d in COMPASS]), index + 1)


def nearest_place(lat: Column, lon: Column) -> Column:
    """Struct (d, no, name, plat, plon) of the nearest place nearer than 100 km, else null; the first wins ties."""
    places = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(name).alias("name"), F.lit(p_lat).alias("plat"), F.lit(p_lon).alias("plon")) for i, (name, p_lat, p_lon) in enumerate(schema.PLACES)])
    # One formula over a constant array: written out for each place the generated code would be too long to compile.
    away = F.transform(places, lambda p: F.struct(haversine_km(lat, lon, p["plat"], p["plon"]).alias("d"), p["no"].alias("no"), p["name"].alias("name"), p["plat"].alias("plat"), p["plon"].alias("plon")))
    return F.array_min(F.filter(away, lambda p: p["d"] < 100))


def region_name(lat: Column, lon: Column, fix_inverted_bounds: bool = False) -> Column:
    """Region by box, higher priority first, then order of definition.

    Most boxes are stored with their latitudes exchanged and then never match; with
    ``fix_inverted_bounds`` they do.
    """
    x = F.pmod(lon + 180, F.lit(360.0)) - 180
    x = F.when((lon >= -180) & (lon <= 180), lon).otherwise(x)
    out = F.lit(None).cast("string")
    for name, a, b, west, east, _ in reversed(sorted(schema.REGIONS, key=lambda r: -r[5])):
        low, high = (min(a, b), max(a, b)) if fix_inverted_bounds else (a, b)
        if low <= high:
            out = F.when(lat.between(low, high) & x.between(west, east), F.lit(name)).otherwise(out)
    return out


def locality_name(lat: Column, lon: Column, fix_inverted_bounds: bool = False, near: Column | None = None) -> Column:
    """Readable locality of a point; ``near`` is its nearest place if a column has it already."""
    near = nearest_place(lat, lon) if near is None else near
    way = compass(near["plat"], near["plon"], lat, lon)
    km = F.floor(near["d"] + 0.5).cast("bigint").cast("string")
    beyond = F.when(lat < -47, "South of New Zealand").when(lat > -34, "North of New Zealand").when((lon > 179) | (lon < -175), "East of New Zealand").when(lon < 166, "West of New Zealand").otherwise("New Zealand region")
    return F.when(near["d"] < 30, F.concat(F.lit("Near "), near["name"])).when(near["d"].isNotNull(), F.concat(km, F.lit(" km "), way, F.lit(" of "), near["name"])).otherwise(F.coalesce(region_name(lat, lon, fix_inverted_bounds), beyond))


# Fixed values of the ellipsoidal distance: a right angle and a degree in radians, squared ratio of the axes, mean radius in km and its variation.
HALF_PI, DEGREE, AXES, MEAN_KM, OBLATE = 1.570796, 1.745329e-02, 0.993231, 6371.227, 3.37853e-3


def ellipsoid_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Epicentral distance: the angle between geocentric positions times the radius at the mean latitude; 0 for equal positions."""
    polar = lambda lat: HALF_PI - F.atan(AXES * F.tan(lat * DEGREE))
    a, b = polar(lat1), polar(lat2)
    cos = F.sin(a) * F.sin(b) * F.cos((lon2 - lon1) * DEGREE) + F.cos(a) * F.cos(b)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
    up = F.cos(HALF_PI - (lat1 + lat2) * DEGREE / 2)
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(angle * MEAN_KM * (1 + OBLATE * (1 / 3 - up * up)))


def hypocentral_km(epicentral: Column, depth1: Column, depth2: Column, error1: Column | float = 0.0, error2: Column | float = 0.0) -> Column:
    """Distance with depth, less both location errors, at least 0."""
    r = F.sqrt(epicentral * epicentral + (depth1 - depth2) * (depth1 - depth2))
    return F.greatest(F.lit(0.0), r - error1 - error2)


def haversine_arrays(lat, lon, lats, lons):
    """Great-circle distance in km of numbers or arrays, for use inside tasks."""
    half = np.sin(np.radians(np.subtract(lats, lat)) / 2) ** 2
    half = half + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(np.subtract(lons, lon)) / 2) ** 2
    return 2 * EARTH_KM * np.arctan2(np.sqrt(half), np.sqrt(1 - half))
