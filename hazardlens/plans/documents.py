"""Source documents written out from the derived feeds, with broken ones among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_collections(quakes: DataFrame) -> DataFrame:
    """GeoJSON texts; ids, times and coordinates go missing at fixed significances."""
    sig = F.col("significance")
    properties = F.struct(
        F.col("magnitude").alias("mag"),
        "place",
        F.when(sig % 23 == 0, F.lit(None)).when(sig % 29 == 0, F.lit(0)).otherwise(
            F.unix_millis("event_time")
        ).alias("time"),
        F.col("tsunami").cast("int").alias("tsunami"),
        sig.alias("sig"),
        "status",
    )
    coordinates = F.array("longitude", "latitude", "depth_km")
    geometry = F.struct(
        F.lit("Point").alias("type"),
        F.when(sig % 31 == 0, F.array().cast("array<double>")).otherwise(coordinates).alias("coordinates"),
    )
    feature = F.struct(
        F.when(sig % 19 == 0, F.lit("")).otherwise(F.col("event_id")).alias("id"),
        properties.alias("properties"),
        geometry.alias("geometry"),
    )
    return quakes.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))


def _place_document(df: DataFrame, current: Column, empty: Column, nameless: Column, sparse: Column) -> DataFrame:
    """``sparse`` documents leave null measures out instead of writing null."""
    name = F.when(nameless, F.lit("")).otherwise(F.col("location_name")).alias("location_name")

    def text(keep_nulls: str) -> Column:
        document = F.struct(name, "latitude", "longitude", current.alias("current"))
        return F.to_json(document, {"ignoreNullFields": keep_nulls})

    bare = F.to_json(F.struct(name, "latitude", "longitude", F.create_map().alias("current")))
    return df.select(F.when(empty, bare).when(sparse, text("true")).otherwise(text("false")).alias("value"))


def _time() -> Column:
    return F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm").alias("time")


def weather_documents(weather: DataFrame) -> DataFrame:
    current = F.struct(
        _time(),
        F.col("temperature_c").alias("temperature_2m"),
        F.col("humidity_pct").alias("relative_humidity_2m"),
        F.col("wind_speed_kmh").alias("wind_speed_10m"),
        F.col("precipitation_mm").alias("precipitation"),
        "weather_code",
    )
    humidity = F.col("humidity_pct").cast("int")
    return _place_document(weather, current, humidity == 60, humidity == 50, humidity % 7 == 0)


def air_quality_documents(air: DataFrame) -> DataFrame:
    """PM2.5 goes missing where nitrogen dioxide is below 15."""
    nitrogen = F.col("nitrogen_dioxide").cast("int")
    current = F.struct(
        _time(),
        "us_aqi",
        F.when(nitrogen >= 15, F.col("pm2_5")).alias("pm2_5"),
        "pm10", "ozone", "nitrogen_dioxide", "carbon_monoxide", "sulphur_dioxide",
    )
    return _place_document(air, current, nitrogen == 20, nitrogen == 21, nitrogen % 2 == 0)


def fire_rows(fires: DataFrame) -> DataFrame:
    """All-text detections; unreadable numbers, bad latitudes and missing dates among them."""
    track = F.round(F.col("track") * 10).cast("int")
    text = lambda c: F.col(c).cast("string")
    return fires.select(
        F.when(track == 3, F.lit("n/a")).when(track == 4, F.lit("999")).otherwise(text("latitude")).alias("latitude"),
        text("longitude").alias("longitude"),
        F.when(track == 0, F.lit("")).when(track == 1, F.lit("?")).otherwise(text("brightness")).alias("bright_ti4"),
        text("scan").alias("scan"),
        text("track").alias("track"),
        F.when(track == 5, F.lit("")).otherwise(text("acq_date")).alias("acq_date"),
        "acq_time", "satellite", "instrument", "confidence",
        text("frp").alias("frp"),
        "daynight",
    )
