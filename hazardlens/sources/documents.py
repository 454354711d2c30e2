"""Landed source documents: GeoJSON quakes, per-place JSON and fire CSV.

Each ``read_*`` loads files; each transformation below it takes any DataFrame of
the same shape, so a stream or a derived table can feed it as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.constants import FIRE_DOWNLOAD_LIMIT
from hazardlens.functions import geo, text

FEATURE = (
    "struct<id:string,"
    "properties:struct<mag:double,place:string,time:bigint,tsunami:int,sig:int,status:string>,"
    "geometry:struct<type:string,coordinates:array<double>>>"
)
FEATURE_COLLECTION = f"features array<{FEATURE}>"
# ``current`` stays a map: a key that is present with a null value differs from an absent one.
PLACE_DOCUMENT = "location_name string, latitude double, longitude double, current map<string,string>"
FIRE_COLUMNS = [
    "latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite",
    "instrument", "confidence", "version", "bright_ti5", "frp", "daynight",
]


# --- earthquakes: GeoJSON feature collections -------------------------------

def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(path)


def parse_feature_collections(documents: DataFrame) -> DataFrame:
    """Collections held as JSON text in ``value``."""
    return documents.select(F.from_json("value", FEATURE_COLLECTION).alias("doc")).select("doc.*")


def features(collections: DataFrame) -> DataFrame:
    return collections.select(F.inline("features"))


def valid_quake_features(rows: DataFrame) -> DataFrame:
    """Features with an id, a non-zero time and at least two coordinates."""
    return rows.filter(
        (F.col("id") != "")
        & (F.col("properties.time") != 0)
        & (F.size("geometry.coordinates") >= 2)
    )


def quakes_from_features(rows: DataFrame) -> DataFrame:
    coordinate = lambda i: F.get("geometry.coordinates", F.lit(i))
    return rows.select(
        F.col("id").alias("event_id"),
        F.col("properties.mag").alias("magnitude"),
        F.coalesce("properties.place", F.lit("")).alias("place"),
        F.timestamp_millis("properties.time").alias("event_time"),
        coordinate(1).alias("latitude"),
        coordinate(0).alias("longitude"),
        coordinate(2).alias("depth_km"),
        (F.coalesce("properties.tsunami", F.lit(0)) != 0).alias("tsunami"),
        F.col("properties.sig").alias("significance"),
        F.coalesce("properties.status", F.lit("")).alias("status"),
    )


# --- weather and air quality: one document per place ------------------------

def read_place_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE_DOCUMENT).option("multiLine", True).json(path)


def parse_place_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.from_json("value", PLACE_DOCUMENT).alias("doc")).select("doc.*")


def _named_place() -> Column:
    return (F.size("current") > 0) & (F.col("location_name") != "")


def valid_weather_docs(documents: DataFrame) -> DataFrame:
    """The temperature key must be present; its value may be null."""
    return documents.filter(_named_place() & F.map_contains_key("current", "temperature_2m"))


def valid_air_quality_docs(documents: DataFrame) -> DataFrame:
    """A document needs an index or a PM2.5 value."""
    measured = F.col("current")["us_aqi"].isNotNull() | F.col("current")["pm2_5"].isNotNull()
    return documents.filter(_named_place() & measured)


def _observed_at(ingested_at: Column | None, local_offset_seconds: Column | None) -> Column:
    stated = text.parse_timestamp(F.col("current")["time"])
    if local_offset_seconds is not None:
        stated = stated - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), local_offset_seconds)
    return F.coalesce(stated, F.current_timestamp() if ingested_at is None else ingested_at)


def _from_current(measures: list[tuple[str, str, str]]) -> list[Column]:
    return [F.col("current")[key].try_cast(kind).alias(name) for key, name, kind in measures]


# Measure keys of the documents, our names and types.
WEATHER_MEASURES = [
    ("temperature_2m", "temperature_c", "double"),
    ("relative_humidity_2m", "humidity_pct", "double"),
    ("wind_speed_10m", "wind_speed_kmh", "double"),
    ("precipitation", "precipitation_mm", "double"),
    ("weather_code", "weather_code", "int"),
]
AIR_QUALITY_MEASURES = [
    ("us_aqi", "us_aqi", "int"),
    ("pm2_5", "pm2_5", "double"),
    ("pm10", "pm10", "double"),
    ("ozone", "ozone", "double"),
    ("nitrogen_dioxide", "nitrogen_dioxide", "double"),
    ("carbon_monoxide", "carbon_monoxide", "double"),
    ("sulphur_dioxide", "sulphur_dioxide", "double"),
]


def _place_rows(documents, measures, ingested_at, local_offset_seconds) -> DataFrame:
    return documents.select(
        "location_name", "latitude", "longitude", *_from_current(measures),
        _observed_at(ingested_at, local_offset_seconds).alias("observed_at"),
    )


def weather_from_docs(
    documents: DataFrame, ingested_at: Column | None = None, local_offset_seconds: Column | None = None
) -> DataFrame:
    """Flat rows; a document without a time gets its ingestion time.

    Times are taken as UTC unless the place's offset from UTC is given.
    """
    return _place_rows(documents, WEATHER_MEASURES, ingested_at, local_offset_seconds)


def air_quality_from_docs(
    documents: DataFrame, ingested_at: Column | None = None, local_offset_seconds: Column | None = None
) -> DataFrame:
    return _place_rows(documents, AIR_QUALITY_MEASURES, ingested_at, local_offset_seconds)


# --- wildfires: CSV with a header -------------------------------------------

def read_fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header; missing ones read as NULL."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    absent = {c: F.lit(None).cast("string") for c in FIRE_COLUMNS if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def brightest_fires(rows: DataFrame, limit: int = FIRE_DOWNLOAD_LIMIT) -> DataFrame:
    """The ``limit`` brightest raw detections; an unreadable brightness counts as 0."""
    brightness = F.coalesce(text.try_double("bright_ti4"), F.lit(0.0))
    ties = ["acq_date", "acq_time", "latitude", "longitude", "frp"]
    return rows.orderBy(brightness.desc(), *[F.col(c).desc_nulls_last() for c in ties]).limit(limit)


def valid_fire_rows(rows: DataFrame) -> DataFrame:
    """Numeric coordinates within range and a date."""
    located = geo.in_range("try_cast(latitude AS DOUBLE)", "try_cast(longitude AS DOUBLE)")
    return rows.filter(located & (F.col("acq_date") != ""))


def fires_from_rows(rows: DataFrame) -> DataFrame:
    """Typed measures (unreadable ones NULL); text columns default to ''."""
    number = text.try_double
    word = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        number("bright_ti4").alias("brightness"),
        number("scan").alias("scan"),
        number("track").alias("track"),
        word("acq_date"), word("acq_time"), word("satellite"), word("instrument"), word("confidence"),
        number("frp").alias("frp"),
        word("daynight"),
    )
