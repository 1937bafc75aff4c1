"""Catalogue schema and static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORE = "eventID string, time timestamp, timeMs bigint, latitude double, longitude double, depth double, magnitude double, locality string"
OPTIONAL = "mmi double, azimuthalGap double, magnitudeStationCount double, minimumDistance double, standardError double, originError double, evaluationMethod string, usedPhaseCount double"
REQUIRED_FIELDS = ("time", "latitude", "longitude", "depth", "magnitude", "eventID")

#: Published aftershock models (id, region, a, b, p, c, Mcut).
REFERENCE_MODELS = [
    ("rj-1989", "California (Statewide)", -1.67, 0.91, 1.08, 0.05, 0.0),
    ("hardebeck-2019-scsn", "Southern California", -2.30, 1.0, 0.83, 0.0033, 0.0),
    ("hardebeck-2019-ncss", "Northern California", -2.64, 1.0, 0.96, 0.012, 0.0),
    ("hardebeck-2019-mendocino", "Mendocino", -3.18, 1.0, 1.15, 0.050, 0.0),
    ("hardebeck-2019-hydrothermal", "Hydrothermal", -1.79, 1.0, 0.94, 0.026, 0.0),
]

#: New Zealand regions (name, minLat, maxLat, minLon, maxLon, priority), in order of definition.
REGIONS = [
    ("Northland", -34.4, -36.5, 172.5, 174.8, 2),
    ("Auckland", -36.5, -37.5, 174.0, 175.5, 3),
    ("Waikato", -37.3, -38.7, 174.5, 176.3, 2),
    ("Bay of Plenty", -37.5, -38.3, 176.0, 177.5, 2),
    ("Gisborne", -37.8, -38.8, 177.5, 178.6, 2),
    ("Taranaki", -38.7, -39.8, 173.5, 175.0, 2),
    ("Hawke's Bay", -38.8, -40.2, 176.0, 177.5, 2),
    ("Manawatū-Whanganui", -39.2, -40.5, 174.5, 176.5, 2),
    ("Wellington", -40.5, -41.6, 174.5, 175.8, 3),
    ("Tasman", -40.7, -41.8, 172.0, 173.5, 2),
    ("Nelson", -41.0, -41.6, 172.8, 173.5, 2),
    ("Marlborough", -41.0, -42.3, 173.3, 174.5, 2),
    ("West Coast", -41.7, -44.3, 168.5, 171.5, 2),
    ("Canterbury", -42.5, -44.5, 170.5, 173.5, 2),
    ("Otago", -44.5, -46.3, 168.0, 171.0, 2),
    ("Southland", -45.5, -47.0, 166.5, 169.5, 2),
    ("Fiordland", -44.5, -46.5, 166.0, 168.5, 2),
    ("Kermadec Islands", -29.0, -32.0, -178.5, -177.0, 1),
    ("Chatham Islands", -44.5, -43.5, -177.0, -176.0, 1),
    ("East of North Island", -34.0, -41.5, 178.0, 180.0, 1),
    ("East of South Island", -41.5, -47.0, 174.0, 180.0, 1),
    ("North of New Zealand", -34.0, -29.0, 172.0, 179.0, 1),
]

#: Places (name, lat, lon), in order of definition.
PLACES = [
    ("Auckland", -36.85, 174.76),
    ("Wellington", -41.29, 174.78),
    ("Hamilton", -37.78, 175.28),
    ("Tauranga", -37.69, 176.17),
    ("Rotorua", -38.14, 176.25),
    ("Gisborne", -38.66, 178.02),
    ("New Plymouth", -39.06, 174.08),
    ("Napier", -39.49, 176.92),
    ("Hastings", -39.64, 176.84),
    ("Palmerston North", -40.35, 175.61),
    ("Whanganui", -39.93, 175.05),
    ("Christchurch", -43.53, 172.64),
    ("Dunedin", -45.87, 170.50),
    ("Invercargill", -46.41, 168.35),
    ("Nelson", -41.27, 173.28),
    ("Queenstown", -45.03, 168.66),
    ("Blenheim", -41.52, 173.95),
    ("Timaru", -44.40, 171.25),
    ("Greymouth", -42.45, 171.21),
    ("Kaikōura", -42.40, 173.68),
    ("Lake Taupō", -38.82, 176.08),
    ("Mt Ruapehu", -39.28, 175.57),
    ("Fiordland", -45.42, 167.72),
    ("Cook Strait", -41.35, 174.50),
]

#: Historical mainshocks (name, time, magnitude, latitude, longitude).
HISTORICAL = [
    ("1855 Wairarapa Earthquake", "1855-01-23T09:17:00Z", 8.2, -41.40, 175.30),
    ("1888 North Canterbury (Amuri) Earthquake", "1888-09-01T10:30:00Z", 7.3, -42.60, 172.70),
    ("1901 Cheviot Earthquake", "1901-11-16T03:45:00Z", 6.9, -42.65, 173.10),
    ("1929 Arthur's Pass Earthquake", "1929-03-09T10:50:00Z", 7.1, -42.90, 171.60),
    ("1929 Murchison Earthquake", "1929-06-17T10:17:00Z", 7.8, -41.73, 172.20),
    ("1931 Hawke's Bay (Napier) Earthquake", "1931-02-03T10:46:00Z", 7.8, -39.50, 176.85),
    ("1968 Inangahua Earthquake", "1968-05-24T05:24:00Z", 7.1, -41.80, 172.10),
    ("2009 Dusky Sound Earthquake", "2009-07-15T09:22:29Z", 7.8, -45.762, 166.562),
    ("2010 Darfield (Canterbury) Earthquake", "2010-09-03T16:35:46Z", 7.1, -43.522, 172.170),
    ("2011 Christchurch Earthquake", "2011-02-22T23:51:42Z", 6.3, -43.583, 172.680),
    ("2014 Eketāhuna Earthquake", "2014-01-20T02:52:00Z", 6.2, -40.62, 175.88),
    ("2016 Kaikōura Earthquake", "2016-11-13T11:02:56Z", 7.8, -42.693, 173.022),
]


def reference_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE_MODELS, "model string, region string, a double, b double, p double, c double, mcut double")


def regions(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(REGIONS)]
    return spark.createDataFrame(rows, "region_no int, name string, minLat double, maxLat double, minLon double, maxLon double, priority int")


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "place_no int, name string, lat double, lon double")


def historical_mainshocks(spark: SparkSession) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(HISTORICAL, "name string, t string, magnitude double, latitude double, longitude double")
    return rows.select("name", F.to_timestamp("t").alias("time"), (F.unix_millis(F.to_timestamp("t"))).alias("timeMs"), "magnitude", "latitude", "longitude")
