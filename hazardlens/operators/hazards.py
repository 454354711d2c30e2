"""Analytics of a single hazard over its processed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.constants import MAGNITUDE_BINS
from hazardlens.functions import rules
from hazardlens.operators.common import AsOf, count_by, first_per_key, newest, newest_sql, recent, rounded, rounded_avg


# --- earthquakes: 30 days ---------------------------------------------------

def _month(quakes: DataFrame, as_of: AsOf) -> DataFrame:
    return recent(quakes, "event_time", as_of, days=30)


def quake_recent_count(quakes: DataFrame, as_of: AsOf = None) -> DataFrame:
    return _month(quakes, as_of).agg(F.count("*").alias("recent_count"))


def quake_recent(quakes: DataFrame, as_of: AsOf = None, limit: int = 50) -> DataFrame:
    return (
        _month(quakes, as_of)
        .orderBy(*newest(["event_time", "event_id"]))
        .limit(limit)
        .select("magnitude", "depth_km", "risk_category", "latitude", "longitude", "event_time")
    )


def quake_risk_categories(quakes: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_month(quakes, as_of), "risk_category")


def quake_depth_groups(quakes: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_month(quakes, as_of), rules.depth_group("depth_km").alias("depth_group"))


def quake_daily_trend(quakes: DataFrame, as_of: AsOf = None) -> DataFrame:
    day = F.date_trunc("day", "event_time").alias("day")
    return count_by(_month(quakes, as_of), day).orderBy("day")


def quake_magnitude_histogram(quakes: DataFrame, as_of: AsOf = None) -> DataFrame:
    """All bins in one row of conditional counts, turned into a row per bin."""
    magnitude = F.col("magnitude")
    counts, names, floor = [], [], None
    for name, ceiling in MAGNITUDE_BINS:
        inside = magnitude.isNotNull()
        if floor is not None:
            inside = inside & (magnitude >= floor)
        if ceiling is not None:
            inside = inside & (magnitude < ceiling)
        counts.append(F.count_if(inside).alias(name))
        names.append(name)
        floor = ceiling
    quoted = [F.col(f"`{name}`") for name in names]
    return _month(quakes, as_of).agg(*counts).unpivot([], quoted, "bin", "count")


# --- wildfires: 14 days -----------------------------------------------------

def _fortnight(fires: DataFrame, as_of: AsOf) -> DataFrame:
    return recent(fires, "acq_date", as_of, days=14)


def fire_severity_dist(fires: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_fortnight(fires, as_of), "fire_severity")


def fire_confidence_dist(fires: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_fortnight(fires, as_of), "detection_confidence")


def fire_growth_trend(fires: DataFrame, as_of: AsOf = None) -> DataFrame:
    return (
        _fortnight(fires, as_of)
        .groupBy("acq_date")
        .agg(F.count("*").alias("count"), rounded_avg("frp", missing=0.0).alias("avg_frp"))
        .orderBy("acq_date")
    )


def fire_active_top(fires: DataFrame, as_of: AsOf = None, limit: int = 100) -> DataFrame:
    return (
        recent(fires, "acq_date", as_of, days=3)
        .orderBy(*newest(["frp", "acq_date", "acq_time", "latitude", "longitude"]))
        .limit(limit)
        .select("latitude", "longitude", "frp", "fire_severity", "detection_confidence", "acq_date")
    )


def fire_grid_hotspots(
    fires: DataFrame, as_of: AsOf = None, min_detections: int = 5, limit: int = 10
) -> DataFrame:
    """Densest one-degree cells (coordinates rounded half away from zero)."""
    return (
        _fortnight(fires, as_of)
        .groupBy(
            (F.round("latitude", 0) + F.lit(0.0)).alias("latitude"),
            (F.round("longitude", 0) + F.lit(0.0)).alias("longitude"),
        )
        .agg(F.count("*").alias("fire_count"), rounded_avg("frp", missing=0.0).alias("avg_frp"))
        .filter(F.col("fire_count") >= min_detections)
        .orderBy(F.desc("fire_count"), "latitude", "longitude")
        .limit(limit)
    )


def fire_hotspot_tier(hotspots: DataFrame) -> DataFrame:
    return hotspots.withColumn("tier", rules.hotspot_tier("fire_count"))


# --- weather and air quality: 7 days ----------------------------------------

def _week(df: DataFrame, as_of: AsOf) -> DataFrame:
    return recent(df, "observed_at", as_of, days=7)


def weather_storm_dist(weather: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_week(weather, as_of), "storm_severity")


def weather_wind_dist(weather: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_week(weather, as_of), "wind_severity")


def _series(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each location's rows newest first.

    The series stay rows: the sort is a range partitioning on (location, time),
    which splits a location with many observations over several tasks, where an
    array per location would put it into one row.
    """
    return df.select("location_name", "observed_at", *columns).orderBy(
        "location_name", F.desc("observed_at")
    )


def weather_series_by_location(weather: DataFrame, as_of: AsOf = None) -> DataFrame:
    return _series(
        _week(weather, as_of),
        ["temperature_c", "precipitation_mm", "wind_speed_kmh", "storm_severity", "wind_severity"],
    )


def weather_alert_rows(weather: DataFrame, as_of: AsOf = None, limit: int = 20) -> DataFrame:
    return (
        _week(weather, as_of)
        .filter(F.col("storm_severity").isin("Severe", "Extreme"))
        .select("location_name", "storm_severity", "wind_speed_kmh", "observed_at")
        .orderBy(F.desc("observed_at"), "location_name")
        .limit(limit)
    )


def aq_category_dist(air: DataFrame, as_of: AsOf = None) -> DataFrame:
    return count_by(_week(air, as_of), "aqi_category")


def aq_regional_comparison(air: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Mean and maximum index per location; a location without readings leads."""
    return (
        _week(air, as_of)
        .groupBy("location_name")
        .agg(F.avg("us_aqi").alias("_avg"), F.max("us_aqi").alias("max_aqi"))
        .orderBy(F.desc_nulls_first("_avg"), "location_name")
        .select(
            "location_name",
            rounded("coalesce(_avg, 0D)", 1).alias("avg_aqi"),
            "max_aqi",
        )
    )


def aq_series_by_location(air: DataFrame, as_of: AsOf = None) -> DataFrame:
    return _series(_week(air, as_of), ["us_aqi", "pm2_5", "pm10", "aqi_category"])


def aq_hotspots(air: DataFrame, as_of: AsOf = None, limit: int = 20) -> DataFrame:
    return (
        _week(air, as_of)
        .filter(F.col("us_aqi") > 150)
        .select("location_name", "us_aqi", "aqi_category", "observed_at")
        .orderBy(F.desc("observed_at"), "location_name")
        .limit(limit)
        .withColumn("tier", rules.air_quality_tier("aqi_category"))
    )


def last_k_per_location(df: DataFrame, measure: str, as_of: AsOf = None, k: int = 48) -> DataFrame:
    """The newest ``k`` readings of each location within the week, oldest first."""
    readings = _week(df, as_of).select("location_name", "observed_at", measure)
    order = newest_sql(["observed_at", measure])
    return first_per_key(readings, ["location_name"], order, k).orderBy("location_name", "observed_at")
