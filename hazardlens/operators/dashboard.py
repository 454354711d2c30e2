"""Cross-hazard dashboard analytics over the processed tables.

``processed`` maps a feed name to its processed table. The fire table carries
``processed_at``, which stands in for its event time in the hourly views.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.constants import RISK_LEVELS, SOURCES
from hazardlens.operators.common import (
    EXACT_JSON, AsOf, count_by, first_per_key, moment, newest, newest_sql, positioned, recent, union_all,
)
from hazardlens.sources.tables import StoredTable, Table, counted

EVENT_CLOCK = {
    "earthquakes": "event_time",
    "wildfires": "processed_at",
    "weather": "observed_at",
    "air_quality": "observed_at",
}
RISK_LABEL = {
    "earthquakes": "risk_category",
    "wildfires": "fire_severity",
    "weather": "storm_severity",
    "air_quality": "aqi_category",
}


def checked_limit(limit: int, low: int, high: int) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must lie between {low} and {high}, not {limit}")
    return limit


def _recent_events(processed: dict[str, Table], as_of: AsOf, hours: int) -> DataFrame:
    """(source, ts) of the last hours' events of the four feeds."""
    def feed(name: str) -> DataFrame:
        clock = EVENT_CLOCK[name]
        rows = recent(processed[name], clock, as_of, hours=hours)
        return rows.select(F.lit(name).alias("source"), F.col(clock).alias("ts"))

    return union_all([feed(name) for name in SOURCES])


def dashboard_summary(
    processed: dict[str, Table], anomalies: DataFrame, alerts: DataFrame, as_of: AsOf = None
) -> DataFrame:
    """One row of totals.

    Totals of stored tables come from their logs and the last hour needs only its own files,
    so they are counted apart and their one-row counts put together.
    """
    def named(df: Table, name: str) -> DataFrame:
        return counted(df).select(F.lit(name).alias("what"), "n")

    parts = [named(processed[name], f"total_{name}") for name in SOURCES]
    parts += [
        named(anomalies, "total_anomalies"),
        named(alerts.filter("is_active"), "active_alerts"),
        named(_recent_events(processed, as_of, 1), "events_last_hour"),
    ]
    totals = [f"total_{name}" for name in SOURCES]

    def total(*names: str) -> Column:
        return F.sum(F.when(F.col("what").isin(*names), F.col("n")))

    return union_all(parts).agg(
        total(*totals).alias("total_events"),
        *[total(n).alias(n) for n in [*totals, "total_anomalies", "active_alerts", "events_last_hour"]],
    )


def events_per_hour(processed: dict[str, Table], as_of: AsOf = None, hours: int = 24) -> DataFrame:
    checked_limit(hours, 1, 168)
    events = _recent_events(processed, as_of, hours)
    return count_by(events, "source", F.date_trunc("hour", "ts").alias("hour")).orderBy("source", "hour")


def events_per_hour_matrix(processed: dict[str, Table], as_of: AsOf = None, hours: int = 24) -> DataFrame:
    """Hours x sources; an hour appears if any source has it, empty cells are 0."""
    checked_limit(hours, 1, 168)
    events = _recent_events(processed, as_of, hours)
    cells = [F.count_if(F.col("source") == name).alias(name) for name in SOURCES]
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(*cells).orderBy("hour")


def _recent_labels(processed: dict[str, Table], as_of: AsOf, days: int) -> DataFrame:
    def labels(name: str) -> DataFrame:
        time = "acq_date" if name == "wildfires" else EVENT_CLOCK[name]
        rows = recent(processed[name], time, as_of, days=days)
        return rows.select(F.lit(name).alias("source"), F.col(RISK_LABEL[name]).alias("label"))

    return union_all([labels(name) for name in SOURCES])


def risk_distribution_by_source(processed: dict[str, Table], as_of: AsOf = None, days: int = 7) -> DataFrame:
    return count_by(_recent_labels(processed, as_of, days), "source", "label")


def risk_distribution_matrix(processed: dict[str, Table], as_of: AsOf = None, days: int = 7) -> DataFrame:
    """Labels x sources, empty cells 0."""
    cells = [F.count_if(F.col("source") == name).alias(name) for name in SOURCES]
    return _recent_labels(processed, as_of, days).groupBy("label").agg(*cells)


def latest_risk_scores(risk_scores: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Newest score row of every region, of those computed from ``since`` on if it is given.

    The table of newest scores that is kept beside the history (``risk_latest``) gives the same rows.
    """
    if since is not None:
        risk_scores = risk_scores.filter(F.col("event_date" if "event_date" in risk_scores.columns else "computed_at") >= F.lit(since))
    rest = [c for c in risk_scores.columns if c not in ("region_name", "computed_at")]
    return first_per_key(risk_scores, ["region_name"], newest_sql(["computed_at", *rest]))


def risk_level_distribution(risk_scores: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Regions per current level; a level without regions is reported as 0."""
    level = F.coalesce("risk_level", F.lit("Low"))
    counts = latest_risk_scores(risk_scores, since).agg(
        *[F.count_if(level == name).alias(name) for name in RISK_LEVELS]
    )
    return counts.unpivot([], RISK_LEVELS, "risk_level", "regions")


def regional_rankings(risk_scores: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Current regions by unified score, numbered from the riskiest.

    Regions are range-sorted by score and name, so any number of them may share a score.
    """
    latest = latest_risk_scores(risk_scores, since)
    ranked = positioned(latest, [F.col("unified_score").desc_nulls_last(), F.col("region_name")], "_position")
    return ranked.select(
        (F.col("_position") + 1).cast("int").alias("rank"),
        "region_name", "unified_score", "risk_level",
        "earthquake_score", "wildfire_score", "weather_score", "air_quality_score",
    ).orderBy("rank")


def markers_quakes(quakes: DataFrame, as_of: AsOf = None, limit: int = 500) -> DataFrame:
    return (
        recent(quakes, "event_time", as_of, days=7)
        .select("event_id", "magnitude", "place", "latitude", "longitude", "risk_category", "event_time")
        .orderBy(*newest(["event_time", "event_id"]))
        .limit(checked_limit(limit, 1, 2000))
    )


def markers_fires(fires: DataFrame, as_of: AsOf = None, limit: int = 500) -> DataFrame:
    return (
        recent(fires, "acq_date", as_of, days=3)
        .select("latitude", "longitude", "frp", "fire_severity", "detection_confidence", "acq_date", "acq_time")
        .orderBy(*newest(["frp", "acq_date", "acq_time", "latitude", "longitude"]))
        .drop("acq_time")
        .limit(checked_limit(limit, 1, 2000))
    )


def _near_latest(df: Table, since: dt.date | None, hours: int = 6) -> DataFrame:
    """Rows not older than ``hours`` before the newest observation of the table.

    The log of a stored table knows the newest, and which files reach back that far. Of another
    frame a caller who knows a day on or before that leaves older folders unread by ``since``.
    """
    if isinstance(df, StoredTable):
        newest = df.highest("observed_at")
        if newest is None:
            return df.rows
        first = newest - hours * 3_600_000_000
        return df.not_before("observed_at", first).filter(F.col("observed_at") >= F.timestamp_micros(F.lit(first)))
    if since is not None:
        df = df.filter(F.col("event_date" if "event_date" in df.columns else "observed_at") >= F.lit(since))
    newest_at = df.select(F.max("observed_at")).scalar()
    return df.filter(F.col("observed_at") >= newest_at - F.make_dt_interval(F.lit(0), F.lit(hours)))


def markers_weather(weather: Table, since: dt.date | None = None) -> DataFrame:
    return (
        _near_latest(weather, since)
        .select(
            "location_name", "latitude", "longitude", "storm_severity", "wind_speed_kmh",
            "temperature_c", "observed_at",
        )
        .orderBy(F.desc("observed_at"), "location_name")
    )


def markers_air_quality(air: Table, since: dt.date | None = None) -> DataFrame:
    return (
        _near_latest(air, since)
        .select("location_name", "latitude", "longitude", "us_aqi", "aqi_category", "observed_at")
        .orderBy(F.desc_nulls_last("us_aqi"), F.desc("observed_at"), "location_name")
    )


def _entries(section: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.to_json(F.struct("*"), EXACT_JSON).alias("payload"))


def analytics_snapshot(
    processed: dict[str, Table],
    anomalies: DataFrame,
    alerts: DataFrame,
    risk_scores: DataFrame,
    as_of: AsOf = None,
) -> DataFrame:
    """The dashboard state to append to the snapshot table.

    One row per entry with its JSON: a section with many entries (regions) stays
    distributed instead of growing a single document.
    """
    sections = {
        "summary": dashboard_summary(processed, anomalies, alerts, as_of),
        "events_per_hour": events_per_hour(processed, as_of, 24),
        "risk_distribution": risk_distribution_by_source(processed, as_of),
        "unified_risk": risk_level_distribution(risk_scores),
        "regional_rankings": regional_rankings(risk_scores),
    }
    rows = union_all([_entries(name, df) for name, df in sections.items()])
    return rows.select(
        F.lit("dashboard").alias("snapshot_type"),
        "section",
        "payload",
        moment(as_of).alias("created_at"),
    )


def live_payload(
    processed: dict[str, Table],
    anomalies: DataFrame,
    alerts: DataFrame,
    risk_scores: DataFrame,
    as_of: AsOf = None,
    markers: int = 200,
    newest_alerts: int = 10,
) -> DataFrame:
    """What dashboards are sent: summary, current scores, newest alerts, map markers."""
    from hazardlens.operators.alerts import active_alerts

    sections = {
        "summary": dashboard_summary(processed, anomalies, alerts, as_of),
        "risk_scores": latest_risk_scores(risk_scores),
        "alerts": active_alerts(alerts, newest_alerts),
        "markers.earthquakes": markers_quakes(processed["earthquakes"], as_of, markers),
        "markers.wildfires": markers_fires(processed["wildfires"], as_of, markers),
        "markers.weather": markers_weather(processed["weather"]),
        "markers.air_quality": markers_air_quality(processed["air_quality"]),
    }
    return union_all([_entries(name, df) for name, df in sections.items()])
