"""Every registered query: name -> function of (session, table folder)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.constants import INGESTION_SOURCES
from hazardlens.functions import geo, rules
from hazardlens.operators import (
    access, alerts, anomalies, cleaning, dashboard, forecast, hazards, quality, risk,
)
from hazardlens.operators.feeds import FEEDS
from hazardlens.plans import documents, streams
from hazardlens.plans.inputs import AS_OF, LOOKBACK_HOURS, Inputs
from hazardlens.sinks import exports, tables as table_sinks
from hazardlens.session import shared_dir
from hazardlens.sources import documents as docs, tables, wire

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register a function of the inputs under its own name."""
    add(build.__name__, build)
    return build


def add(name: str, build: Callable[[Inputs], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))


# --- sources ----------------------------------------------------------------

@query
def decode_json(i: Inputs) -> DataFrame:
    humidity = F.col("humidity_pct").cast("int")
    record = F.to_json(F.struct("*"))
    lines = i.raw("weather").select(
        F.when(humidity % 11 == 0, F.lit("{bad")).when(humidity % 13 == 0, F.lit("")).otherwise(record).alias("value")
    )
    decoded = wire.decode(i.landed(lines), "weather")
    return cleaning.normalize_timestamp(decoded, "observed_at").withColumn(
        "corrupt", F.col(wire.CORRUPT).isNotNull()
    ).drop(wire.CORRUPT)


@query
def src_geojson_quakes(i: Inputs) -> DataFrame:
    """Quakes from files of feature collections."""
    path = i.land_documents(documents.feature_collections(i.raw("earthquakes")))
    found = docs.features(docs.read_feature_collections(i.spark, path))
    return docs.quakes_from_features(docs.valid_quake_features(found))


@query
def valid_quake_features(i: Inputs) -> DataFrame:
    found = docs.features(docs.parse_feature_collections(i.landed(documents.feature_collections(i.raw("earthquakes")))))
    kept = docs.valid_quake_features(found)
    return kept.groupBy(F.col("properties.status").alias("status")).agg(F.count("*").alias("valid"))


@query
def src_weather_docs(i: Inputs) -> DataFrame:
    path = i.land_documents(documents.weather_documents(i.raw("weather")))
    parsed = docs.read_place_documents(i.spark, path)
    return docs.weather_from_docs(docs.valid_weather_docs(parsed))


@query
def valid_weather_docs(i: Inputs) -> DataFrame:
    parsed = docs.parse_place_documents(i.landed(documents.weather_documents(i.raw("weather"))))
    return docs.valid_weather_docs(parsed).groupBy("location_name").agg(F.count("*").alias("valid"))


@query
def src_air_quality_docs(i: Inputs) -> DataFrame:
    path = i.land_documents(documents.air_quality_documents(i.raw("air_quality")))
    parsed = docs.read_place_documents(i.spark, path)
    return docs.air_quality_from_docs(docs.valid_air_quality_docs(parsed))


@query
def valid_air_quality_docs(i: Inputs) -> DataFrame:
    parsed = docs.parse_place_documents(i.landed(documents.air_quality_documents(i.raw("air_quality"))))
    return docs.valid_air_quality_docs(parsed).groupBy("location_name").agg(F.count("*").alias("valid"))


@query
def src_fire_csv(i: Inputs) -> DataFrame:
    """Fires from CSV files with a header."""
    rows = docs.read_fire_csv(i.spark, i.land_csv(documents.fire_rows(i.raw("wildfires"))))
    return docs.fires_from_rows(docs.valid_fire_rows(rows))


@query
def valid_fire_rows(i: Inputs) -> DataFrame:
    kept = docs.valid_fire_rows(documents.fire_rows(i.raw("wildfires")))
    return kept.groupBy("acq_date").agg(F.count("*").alias("valid"))


@query
def topn_fires_by_brightness(i: Inputs) -> DataFrame:
    top = docs.brightest_fires(documents.fire_rows(i.raw("wildfires")), 500)
    return top.select("bright_ti4", "acq_date", "acq_time")


@query
def scan_processed(i: Inputs) -> DataFrame:
    root = shared_dir(i.spark, "scan")
    written = i.weather.withColumns({"processed_at": F.lit(AS_OF), "event_date": F.to_date("observed_at")})
    table_sinks.write_batch(written, root, "weather_processed", 0, partition_by=["event_date"])
    return tables.scan_table(i.spark, root, "weather_processed").drop("processed_at", "batch_id")


# --- cleaning ---------------------------------------------------------------

@query
def clean_string_nulls(i: Inputs) -> DataFrame:
    odd = F.when(F.col("significance") % 7 == 0, F.lit("NaN")).when(
        F.col("significance") % 11 == 0, F.lit("nan")
    ).when(F.col("significance") % 13 == 0, F.lit("NONE")).otherwise(F.col("status"))
    rows = i.raw("earthquakes").withColumn("status", odd)
    return cleaning.clean_string_nulls(rows, ["place", "status", "event_id"]).select(
        "event_id", "place", "status", "event_time"
    )


@query
def normalize_timestamps(i: Inputs) -> DataFrame:
    """Wire times in every accepted layout, and one that is not a time."""
    seconds = F.date_trunc("second", "event_time")
    shape = F.col("significance") % 6
    written = (
        F.when(shape == 0, F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(shape == 1, F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(shape == 2, F.date_format(seconds, "yyyy-MM-dd'T'HH:mm"))
        .when(shape == 3, F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"))
        .when(shape == 4, F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .otherwise(F.lit("not a time"))
    )
    rows = i.raw("earthquakes").select("significance", "depth_km", written.alias("event_time"))
    return cleaning.normalize_timestamp(rows, "event_time")


@query
def parse_acq_date(i: Inputs) -> DataFrame:
    written = F.when(F.col("scan") == 0, F.lit("2024-13-01")).when(
        F.col("scan") == 0.1, F.lit("01/02/2024")
    ).otherwise(F.col("acq_date").cast("string"))
    rows = i.raw("wildfires").select("scan", "track", written.alias("acq_date"))
    return cleaning.normalize_date(rows, "acq_date")


@query
def validate_coordinates(i: Inputs) -> DataFrame:
    return cleaning.validate_coordinates(i.raw("wildfires")).select(
        "latitude", "longitude", "acq_date", "acq_time"
    )


@query
def require_fields(i: Inputs) -> DataFrame:
    rows = cleaning.clean_string_nulls(i.raw("earthquakes"), ["place"])
    return cleaning.require_fields(rows, ["event_time", "place"]).select("event_id", "place", "event_time")


@query
def fill_defaults(i: Inputs) -> DataFrame:
    feed = FEEDS["earthquakes"]
    return cleaning.fill_defaults(i.raw("earthquakes"), feed.defaults).select(
        "event_id", "event_time", "magnitude", "depth_km"
    )


@query
def dedup_within_batch(i: Inputs) -> DataFrame:
    feed = FEEDS["earthquakes"]
    return cleaning.deduplicate(i.raw("earthquakes"), feed.key, feed.time)


@query
def skip_existing(i: Inputs) -> DataFrame:
    """All fires, against a table that holds those before the 20th."""
    target = i.fires.filter(F.col("acq_date") < "2024-01-20")
    return cleaning.skip_existing(i.fires, target, FEEDS["wildfires"].key).select(*FEEDS["wildfires"].key)


# --- enrichment -------------------------------------------------------------

@query
def risk_category(i: Inputs) -> DataFrame:
    return i.raw("earthquakes").select(
        "event_id", "magnitude", "event_time", rules.risk_category("magnitude").alias("risk_category")
    )


@query
def magnitude_band(i: Inputs) -> DataFrame:
    return i.raw("earthquakes").select(
        "event_id", "magnitude", "event_time", rules.magnitude_band("magnitude").alias("magnitude_band")
    )


@query
def distance_group(i: Inputs) -> DataFrame:
    return i.raw("earthquakes").select(
        "event_id", "depth_km", "event_time", rules.distance_group("depth_km").alias("distance_group")
    )


def _weather_rule(i: Inputs, **labels) -> DataFrame:
    return i.raw("weather").select(
        "location_name", "observed_at", "temperature_c", "humidity_pct", "wind_speed_kmh",
        "precipitation_mm", "weather_code", *[c.alias(n) for n, c in labels.items()],
    )


@query
def heat_index(i: Inputs) -> DataFrame:
    return _weather_rule(i, heat_index=rules.heat_index("temperature_c", "humidity_pct"))


@query
def rain_severity(i: Inputs) -> DataFrame:
    return _weather_rule(i, rain_severity=rules.rain_severity("precipitation_mm"))


@query
def wind_severity(i: Inputs) -> DataFrame:
    return _weather_rule(i, wind_severity=rules.wind_severity("wind_speed_kmh"))


@query
def storm_severity(i: Inputs) -> DataFrame:
    label = rules.storm_severity("wind_speed_kmh", "precipitation_mm", "weather_code")
    return _weather_rule(i, storm_severity=label)


@query
def aqi_category(i: Inputs) -> DataFrame:
    return i.raw("air_quality").select(
        "location_name", "observed_at", "us_aqi", rules.aqi_category("us_aqi").alias("aqi_category")
    )


@query
def fire_severity(i: Inputs) -> DataFrame:
    return i.raw("wildfires").select(
        "acq_date", "acq_time", "frp", rules.fire_severity("frp").alias("fire_severity")
    )


@query
def detection_confidence(i: Inputs) -> DataFrame:
    return i.raw("wildfires").select(
        "acq_date", "acq_time", "confidence",
        rules.detection_confidence("confidence").alias("detection_confidence"),
    )


for _name, _feed in FEEDS.items():
    add(f"enrich_{_name}", lambda i, f=_feed: f.process(i.raw(f.name)))


# --- anomalies --------------------------------------------------------------

def _anomalies(i: Inputs, name: str) -> DataFrame:
    """A feed's anomalies, with the columns read back from the JSON of the row that raised each."""
    rows = i.one(name)
    found = anomalies.anomalies_of(name, rows).withColumn("raw", F.from_json("raw_data", rows.schema))
    raw = [F.col(f"raw.{c}").alias(f"raw_{c}") for c in FEEDS[name].output]
    return found.select(*[c for c in found.columns if c not in ("raw", "raw_data")], *raw)


add("anomaly_quake", lambda i: _anomalies(i, "earthquakes"))
add("anomaly_weather", lambda i: _anomalies(i, "weather"))
add("anomaly_air_quality", lambda i: _anomalies(i, "air_quality"))


@query
def anomaly_wildfire(i: Inputs) -> DataFrame:
    """The coordinates in the text are compared as numbers, for engines write them differently."""
    number = lambda name: F.regexp_extract("description", f"{name}=([^,]+)", 1).cast("double")
    return _anomalies(i, "wildfires").withColumns({
        "described": F.regexp_replace("description", "lat=.*", ""),
        "described_latitude": number("lat"), "described_longitude": number("lon"),
    }).drop("description")


add("anomaly_events", lambda i: anomalies.anomaly_events(i.processed).drop("raw_data", "description"))


# --- quality and pipeline metrics -------------------------------------------

@query
def quality_funnel(i: Inputs) -> DataFrame:
    """Quakes by day of arrival, some of which lost their time on the way."""
    rows = i.raw("earthquakes").withColumns(
        {
            "batch_id": F.dayofmonth("event_time").cast("bigint"),
            "event_time": F.when(F.col("significance") % 17 != 0, F.col("event_time")),
        }
    )
    feed = FEEDS["earthquakes"]
    return quality.quality_funnel(feed.flag(rows), feed)


add("pipeline_throughput", lambda i: quality.pipeline_throughput(i.metrics))
add("pipeline_summary", lambda i: quality.pipeline_summary(i.metrics))
add("quality_summary", lambda i: quality.quality_summary(i.metrics))
add("recent_batches", lambda i: quality.recent_batches(i.metrics))
add("pipeline_health", lambda i: quality.pipeline_health(i.metrics, AS_OF, 72))
add("error_counts", lambda i: quality.error_counts(i.metrics, AS_OF))
add("ingestion_latency", lambda i: quality.ingestion_latency(i.logs, AS_OF, 72))


@query
def source_activity(i: Inputs) -> DataFrame:
    """One expected source has no log at all."""
    return quality.source_activity(i.logs, [*INGESTION_SOURCES, "tide_gauges"])


add("total_records", lambda i: quality.total_records(i.stored))


# --- dashboard --------------------------------------------------------------

add("dashboard_summary", lambda i: dashboard.dashboard_summary(i.stored, i.anomalies, i.alerts, AS_OF))
add("events_per_hour", lambda i: dashboard.events_per_hour(i.processed, AS_OF, 168))
add("events_per_hour_matrix", lambda i: dashboard.events_per_hour_matrix(i.processed, AS_OF, 24))
add("risk_distribution_by_source", lambda i: dashboard.risk_distribution_by_source(i.processed, AS_OF))
add("risk_distribution_matrix", lambda i: dashboard.risk_distribution_matrix(i.processed, AS_OF))
add("risk_level_distribution", lambda i: dashboard.risk_level_distribution(i.risk_scores))
add("regional_rankings", lambda i: dashboard.regional_rankings(i.risk_scores))
add("latest_risk_scores", lambda i: dashboard.latest_risk_scores(i.risk_scores))
add("markers_quakes", lambda i: dashboard.markers_quakes(i.quakes, AS_OF, 100))
add("markers_fires", lambda i: dashboard.markers_fires(i.fires, AS_OF, 100))
add("markers_weather", lambda i: dashboard.markers_weather(i.store("weather")))
add("markers_air_quality", lambda i: dashboard.markers_air_quality(i.store("air_quality")))
def _fields(rows: DataFrame, fields: str, **columns: str) -> DataFrame:
    """Columns read back from the JSON entries: SQL expressions over the given fields."""
    parsed = rows.withColumn("entry", F.from_json("payload", fields)).select("section", "entry.*")
    return parsed.select("section", *[F.expr(sql).alias(name) for name, sql in columns.items()])


@query
def analytics_snapshot(i: Inputs) -> DataFrame:
    """A snapshot written twice by the same run, and its entries read back."""
    for _ in range(2):
        snapshot = dashboard.analytics_snapshot(i.stored, i.anomalies, i.alerts, i.risk_scores, AS_OF)
        table_sinks.append_snapshot(snapshot, i.root, 7)
    return _fields(
        tables.scan_table(i.spark, i.root, "analytics_snapshots"),
        "source string, hour timestamp, label string, count bigint, risk_level string, regions bigint, region_name string,"
        " rank bigint, unified_score double, total_events bigint, total_anomalies bigint, active_alerts bigint,"
        " events_last_hour bigint",
        name="coalesce(source, region_name)", label="coalesce(label, risk_level)", at="hour",
        value="coalesce(count, regions, rank, total_events)", score="unified_score",
        anomalies="total_anomalies", alerts="active_alerts", last_hour="events_last_hour",
    )


@query
def live_payload(i: Inputs) -> DataFrame:
    """The entries of a live message, read back."""
    return _fields(
        dashboard.live_payload(i.stored, i.anomalies, i.alerts, i.risk_scores, AS_OF),
        "region_name string, title string, event_id string, location_name string, risk_level string, severity string,"
        " risk_category string, fire_severity string, storm_severity string, aqi_category string, computed_at timestamp,"
        " created_at timestamp, event_time timestamp, acq_date date, observed_at timestamp, unified_score double,"
        " magnitude double, frp double, wind_speed_kmh double, us_aqi double, total_events double",
        name="CASE WHEN section = 'alerts' THEN title ELSE coalesce(event_id, location_name, region_name) END",
        label="coalesce(risk_level, severity, risk_category, fire_severity, storm_severity, aqi_category)",
        at="coalesce(computed_at, created_at, event_time, CAST(acq_date AS TIMESTAMP), observed_at)",
        value="coalesce(unified_score, magnitude, frp, wind_speed_kmh, us_aqi, total_events)",
    )


# --- single hazards ---------------------------------------------------------

for _f in (
    hazards.quake_recent_count, hazards.quake_recent, hazards.quake_risk_categories,
    hazards.quake_depth_groups, hazards.quake_daily_trend, hazards.quake_magnitude_histogram,
):
    add(_f.__name__, lambda i, f=_f: f(i.quakes, AS_OF))
for _f in (
    hazards.fire_severity_dist, hazards.fire_confidence_dist, hazards.fire_growth_trend,
    hazards.fire_active_top,
):
    add(_f.__name__, lambda i, f=_f: f(i.fires, AS_OF))
add("fire_grid_hotspots", lambda i: hazards.fire_grid_hotspots(i.fires, AS_OF))
add("fire_hotspot_tier", lambda i: hazards.fire_hotspot_tier(hazards.fire_grid_hotspots(i.fires, AS_OF)))
for _f in (
    hazards.weather_storm_dist, hazards.weather_wind_dist, hazards.weather_series_by_location,
    hazards.weather_alert_rows,
):
    add(_f.__name__, lambda i, f=_f: f(i.weather, AS_OF))
for _f in (
    hazards.aq_category_dist, hazards.aq_regional_comparison, hazards.aq_series_by_location,
    hazards.aq_hotspots,
):
    add(_f.__name__, lambda i, f=_f: f(i.air, AS_OF))
add("last_k_per_location", lambda i: hazards.last_k_per_location(i.air, "us_aqi", AS_OF))
add("last_k_temperature", lambda i: hazards.last_k_per_location(i.weather, "temperature_c", AS_OF))


# --- risk -------------------------------------------------------------------

@query
def haversine_km(i: Inputs) -> DataFrame:
    """Distance of every located quake from New York."""
    quakes = cleaning.validate_coordinates(i.raw("earthquakes"))
    distance = geo.haversine_km("40.7128D", "-74.0060D", "latitude", "longitude")
    return quakes.select("event_id", "event_time", F.round(distance, 6).alias("distance_km"))


@query
def events_within_radius(i: Inputs) -> DataFrame:
    pairs = risk.within_radius(i.quakes, i.regions)
    return pairs.select("region_name", "event_id", F.round("distance_km", 6).alias("distance_km"))


add("quake_score", lambda i: risk.quake_score(i.quakes, i.regions, AS_OF, LOOKBACK_HOURS))
add("fire_score", lambda i: risk.fire_score(i.fires, i.regions, AS_OF))
add("weather_score", lambda i: risk.weather_score(i.latest("weather"), i.regions))
add("air_quality_score", lambda i: risk.air_quality_score(i.latest("air_quality"), i.regions))
add("unified_risk", lambda i: risk.unified_risk(i.processed, i.regions, AS_OF, latest=i.latest_observations))
add(
    "risk_level",
    lambda i: i.events.select("event_id", rules.risk_level("value").alias("risk_level")),
)


# --- alerts -----------------------------------------------------------------

def _alerts_of_rule(i: Inputs, rule: alerts.AlertRule) -> DataFrame:
    """New alerts of a rule, with the columns read back from their metadata."""
    rows = i.store(rule.source)
    raised = alerts.raise_alerts(rows, rule, i.alerts_of(rule.alert_type), AS_OF, LOOKBACK_HOURS)
    fields = T.StructType([T.StructField(rule.key, T.StringType()), *(rows.schema[c] for c in rule.details if c != rule.key)])
    details = [F.col(f"meta.{c}").alias(f"meta_{c}") for c in rule.details]
    read = raised.withColumn("meta", F.from_json("metadata", fields))
    return read.select(*[c for c in raised.columns if c != "metadata"], *details, F.col(f"meta.{rule.key}").alias("meta_key"))


for _type, _rule in alerts.RULES.items():
    add(f"alert_{_type}", lambda i, r=_rule: _alerts_of_rule(i, r))


@query
def alert_cooldown(i: Inputs) -> DataFrame:
    """Quake ids left after the cool-down of the earlier alerts."""
    rule = alerts.MAJOR_EARTHQUAKE
    rows = alerts.candidates(i.store("earthquakes"), rule, AS_OF, LOOKBACK_HOURS)
    return alerts.suppress_repeats(rows, rule, i.alerts_of(rule.alert_type), AS_OF).select("event_id", "magnitude")


add(
    "alert_rows",
    lambda i: alerts.new_alerts(i.stored, i.alerts, AS_OF, LOOKBACK_HOURS).drop("metadata", "resolved_at"),
)


@query
def alerts_active(i: Inputs) -> DataFrame:
    """The 200 newest; metadata is left out as a text whose layout is engine-specific."""
    return alerts.active_alerts(i.alerts, 200).drop("metadata")


@query
def alerts_history(i: Inputs) -> DataFrame:
    page = alerts.alert_history(i.alerts, alert_type="major_earthquake", severity="Critical", limit=20, offset=5)
    return page.total


@query
def alerts_history_rows(i: Inputs) -> DataFrame:
    """A page of the history with the record each alert is about."""
    page = alerts.alert_history(i.alerts, alert_type="extreme_aqi", limit=100, offset=3)
    return page.rows.select(
        "alert_type", "source", "severity", "title", "region_name", "is_active", "created_at",
        F.get_json_object("metadata", "$.record_id").alias("record_key"),
    )


# --- forecasts --------------------------------------------------------------

def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("y", F.round(F.col("y").cast("double"), 6))


add("series_aqi_hourly", lambda i: _rounded(forecast.series_aqi_hourly(i.air, AS_OF)))
add("series_temperature_hourly", lambda i: _rounded(forecast.series_temperature_hourly(i.weather, AS_OF)))
add("series_fire_daily", lambda i: forecast.series_fire_daily(i.fires, AS_OF))
add("series_quake_hourly", lambda i: forecast.series_quake_hourly(i.quakes, AS_OF))


@query
def series_clean(i: Inputs) -> DataFrame:
    """Event values as text, some of them unreadable."""
    raw = i.events.select(
        "event_type",
        F.when(F.col("event_id") % 19 == 0, F.lit("soon")).otherwise(F.col("ts").cast("string")).alias("ds"),
        F.when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("y"),
    )
    return forecast.series_clean(raw)


@query
def series_min_points(i: Inputs) -> DataFrame:
    """Users' value series; only those with enough points stay."""
    points = i.events.select(F.col("user_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    return forecast.series_long_enough(points, ["user_id"])


add("forecast_horizons", lambda i: forecast.forecast_horizons(i.series))
add("forecast_additive", lambda i: i.forecasts)


@query
def forecast_replace(i: Inputs) -> DataFrame:
    """Stored twice; the second run replaces the first."""
    root = shared_dir(i.spark, "forecasts")
    table_sinks.replace_forecasts(i.forecasts.withColumn("predicted_value", F.lit(0.0)), root)
    table_sinks.replace_forecasts(i.forecasts, root)
    return tables.scan_table(i.spark, root, "forecasts").drop("place_bucket")


add("forecast_lookup", lambda i: forecast.forecast_lookup(i.forecasts, "us_aqi", "air_quality", "Tokyo", "7d"))
add("forecast_coverage", lambda i: forecast.forecast_coverage(i.forecasts))


# --- access and sinks -------------------------------------------------------

@query
def paginated_query(i: Inputs) -> DataFrame:
    page = access.list_quakes(i.quakes, min_magnitude=2.0, limit=50, offset=25)
    return page.rows


@query
def paginated_deep(i: Inputs) -> DataFrame:
    """Fires share their time with all others of the day; the page is found by position."""
    ties = ["acq_time", "latitude", "longitude"]
    page = access.paginate(i.store("wildfires"), [], "acq_date", ties, limit=40, offset=333, near_rows=60)
    return page.rows.select("acq_date", *ties)


@query
def paginated_after(i: Inputs) -> DataFrame:
    """The page behind a given row."""
    page = access.paginate(i.quakes, [], "event_time", ["event_id"], limit=30, after=[dt.datetime(2024, 1, 20), "eq500"])
    return page.rows


add("paginated_total", lambda i: access.list_quakes(i.quakes, min_magnitude=2.0).total)
add("list_quakes", lambda i: access.list_quakes(i.quakes, 1.0, "Medium").rows)
add("list_weather", lambda i: access.list_weather(i.weather, "Tokyo", 20.0, "Severe").rows)
add("list_air_quality", lambda i: access.list_air_quality(i.air, "Mumbai", 100, "Hazardous", limit=500).rows)
add("list_wildfires", lambda i: access.list_wildfires(i.fires, "Extreme", 300.0).rows.drop("processed_at"))
add(
    "list_anomalies",
    lambda i: access.list_anomalies(i.anomalies, "weather", "Critical", "severe_weather_event").rows.drop("raw_data"),
)


@query
def export_csv(i: Inputs) -> DataFrame:
    path = shared_dir(i.spark, "export")
    exports.export_csv(i.quakes, "earthquakes", path, 300)
    rows = i.spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in i.quakes.dtypes])


@query
def export_json(i: Inputs) -> DataFrame:
    document = exports.export_document(i.air, "air_quality", 300, AS_OF)
    schema = f"data_type string, count bigint, records array<{i.air.schema.simpleString()}>"
    parsed = document.select(F.from_json("value", schema).alias("d")).select("d.*")
    return parsed.select("data_type", "count", F.inline("records"))


# --- streaming --------------------------------------------------------------

for _name, _build in streams.STREAMS.items():
    add(_name, _build)
