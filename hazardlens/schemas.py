"""Declared schemas of the wire records and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def columns(ddl: str) -> T.StructType:
    """Schema from ``"name type, ..."``; every column is nullable. Needs no session."""
    fields = (item.split() for item in ddl.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


# Names and types of all columns.
WIRE = {
    "earthquakes": columns(
        "event_id string, magnitude double, place string, event_time string, latitude double, longitude double, depth_km double,"
        " tsunami boolean, significance int, status string"
    ),
    "weather": columns(
        "location_name string, latitude double, longitude double, temperature_c double, humidity_pct double,"
        " wind_speed_kmh double, precipitation_mm double, weather_code int, observed_at string"
    ),
    "air_quality": columns(
        "location_name string, latitude double, longitude double, us_aqi int, pm2_5 double, pm10 double, ozone double,"
        " nitrogen_dioxide double, carbon_monoxide double, sulphur_dioxide double, observed_at string"
    ),
    "wildfires": columns(
        "latitude double, longitude double, brightness double, scan double, track double, acq_date string, acq_time string,"
        " satellite string, instrument string, confidence string, frp double, daynight string"
    ),
}

_QUAKE = "event_id string, magnitude double, place string, event_time timestamp, latitude double, longitude double, depth_km double, tsunami boolean, significance int, status string"
_WEATHER = (
    "location_name string, latitude double, longitude double, temperature_c double, humidity_pct double, wind_speed_kmh double,"
    " precipitation_mm double, weather_code int, observed_at timestamp"
)
_AIR = (
    "location_name string, latitude double, longitude double, us_aqi int, pm2_5 double, pm10 double, ozone double, nitrogen_dioxide double,"
    " carbon_monoxide double, sulphur_dioxide double, observed_at timestamp"
)
_FIRE = (
    "latitude double, longitude double, brightness double, scan double, track double, acq_date date, acq_time string, satellite string,"
    " instrument string, confidence string, frp double, daynight string"
)

TABLES = {
    "earthquakes_raw": columns(f"{_QUAKE}, ingested_at timestamp, event_date date, batch_id bigint"),
    "weather_raw": columns(f"{_WEATHER}, ingested_at timestamp, event_date date, batch_id bigint"),
    "air_quality_raw": columns(f"{_AIR}, ingested_at timestamp, event_date date, batch_id bigint"),
    "wildfires_raw": columns(f"{_FIRE}, ingested_at timestamp, event_date date, batch_id bigint"),
    "earthquakes_processed": columns(
        f"{_QUAKE}, risk_category string, magnitude_band string, distance_group string, processed_at timestamp,"
        " event_date date, batch_id bigint"
    ),
    "weather_processed": columns(
        f"{_WEATHER}, heat_index double, rain_severity string, wind_severity string, storm_severity string,"
        " processed_at timestamp, event_date date, batch_id bigint"
    ),
    "air_quality_processed": columns(
        f"{_AIR}, aqi_category string, processed_at timestamp, event_date date, batch_id bigint"
    ),
    "wildfires_processed": columns(
        f"{_FIRE}, fire_severity string, detection_confidence string, processed_at timestamp, event_date date, batch_id bigint"
    ),
    "anomaly_events": columns(
        "source string, event_type string, severity string, description string, latitude double, longitude double, event_time timestamp,"
        " raw_data string, detected_at timestamp, event_date date, batch_id bigint"
    ),
    "data_quality_metrics": columns(
        "source string, total_records bigint, valid_records bigint, duplicates bigint, missing_fields bigint,"
        " malformed_records bigint, dropped_events bigint, validation_errors bigint, created_at timestamp, event_date date, batch_id bigint"
    ),
    "pipeline_metrics": columns(
        "source string, records_count bigint, processing_time_ms double, kafka_lag_ms double, db_write_latency_ms double,"
        " records_per_minute double, created_at timestamp, event_date date, batch_id bigint"
    ),
    "ingestion_logs": columns(
        "source string, status string, records_count bigint, latency_ms double, error_message string, created_at timestamp,"
        " event_date date, batch_id bigint"
    ),
    "risk_scores": columns(
        "region_name string, latitude double, longitude double, earthquake_score double, wildfire_score double,"
        " weather_score double, air_quality_score double, unified_score double, risk_level string, computed_at timestamp,"
        " event_date date, batch_id bigint"
    ),
    "risk_latest": columns(
        "region_name string, latitude double, longitude double, earthquake_score double, wildfire_score double,"
        " weather_score double, air_quality_score double, unified_score double, risk_level string, computed_at timestamp, batch_id bigint"
    ),
    "weather_latest": columns(
        f"{_WEATHER}, heat_index double, rain_severity string, wind_severity string, storm_severity string, batch_id bigint"
    ),
    "air_quality_latest": columns(f"{_AIR}, aqi_category string, batch_id bigint"),
    "series_points": columns(
        "metric string, source string, location_name string, ds timestamp, y double, event_date date, batch_id bigint"
    ),
    "events_per_hour": columns("source string, hour timestamp, count bigint, batch_id bigint"),
    "alerts": columns(
        "alert_type string, source string, severity string, title string, description string, latitude double, longitude double,"
        " region_name string, metadata string, record_key string, is_active boolean, created_at timestamp, resolved_at timestamp, event_date date, batch_id bigint"
    ),
    "forecasts": columns(
        "forecast_time timestamp, predicted_value double, lower_bound double, upper_bound double, generated_at timestamp,"
        " metric string, source string, horizon string, location_name string, place_bucket int"
    ),
    "analytics_snapshots": columns("snapshot_type string, section string, payload string, created_at timestamp, event_date date, batch_id bigint"),
    "quarantine": columns("source string, record string, batch_id bigint"),
}
