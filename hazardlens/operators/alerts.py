"""Alert rules, cool-down suppression and alert queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.operators.access import Page, paginate
from hazardlens.operators.common import EXACT_JSON, AsOf, moment, newest, recent, union_all
from hazardlens.sources.tables import Table


@dataclass(frozen=True)
class AlertRule:
    """One rule: which rows raise it, how far back, and how long it stays quiet."""

    alert_type: str
    source: str
    condition: Callable[[], Column]
    time: str
    lookback_hours: int
    cooldown_hours: int
    critical: Callable[[], Column]
    title: Callable[[], Column]
    description: Callable[[], Column]
    key: str
    record_key: Callable[[], Column]
    details: tuple[str, ...]
    region: Callable[[], Column]


def _shown(name: str) -> Column:
    """A value as alert texts print it, ``None`` included."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _key_of(*names: str) -> Column:
    """Natural key as one text; NULL parts keep their place."""
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def _no_region() -> Column:
    return F.lit(None).cast("string")


MAJOR_EARTHQUAKE = AlertRule(
    alert_type="major_earthquake",
    source="earthquakes",
    condition=lambda: F.col("magnitude") >= 6.0,
    time="event_time",
    lookback_hours=1,
    cooldown_hours=24,
    critical=lambda: F.col("magnitude") >= 7.0,
    title=lambda: _joined(F.format_string("M%.1f", "magnitude"), " Earthquake — ", _shown("place")),
    description=lambda: _joined(
        "Magnitude ", _shown("magnitude"), " earthquake detected at ", _shown("place"),
        ". Risk category: ", _shown("risk_category"), ".",
    ),
    key="event_id",
    record_key=lambda: F.col("event_id"),
    details=("magnitude",),
    region=_no_region,
)

EXTREME_AQI = AlertRule(
    alert_type="extreme_aqi",
    source="air_quality",
    condition=lambda: F.col("us_aqi") > 300,
    time="observed_at",
    lookback_hours=2,
    cooldown_hours=6,
    critical=lambda: F.col("us_aqi") > 400,
    title=lambda: _joined("Extreme AQI — ", _shown("location_name"), " (", _shown("us_aqi"), ")"),
    description=lambda: _joined(
        "Air quality index of ", _shown("us_aqi"), " detected at ", _shown("location_name"),
        ". Category: ", _shown("aqi_category"), ".",
    ),
    key="record_id",
    record_key=lambda: _key_of("location_name", "observed_at"),
    details=("location_name", "observed_at", "us_aqi"),
    region=lambda: F.col("location_name"),
)

SEVERE_WEATHER = AlertRule(
    alert_type="severe_weather",
    source="weather",
    condition=lambda: F.col("storm_severity").isin("Severe", "Extreme"),
    time="observed_at",
    lookback_hours=2,
    cooldown_hours=6,
    critical=lambda: F.col("storm_severity") == "Extreme",
    title=lambda: _joined(
        "Severe Weather — ", _shown("location_name"), " (", _shown("storm_severity"), ")"
    ),
    description=lambda: _joined(
        _shown("storm_severity"), " weather at ", _shown("location_name"),
        ". Wind: ", _shown("wind_speed_kmh"), " km/h, Precipitation: ",
        _shown("precipitation_mm"), " mm.",
    ),
    key="record_id",
    record_key=lambda: _key_of("location_name", "observed_at"),
    details=("location_name", "observed_at", "storm_severity"),
    region=lambda: F.col("location_name"),
)

MAJOR_WILDFIRE = AlertRule(
    alert_type="major_wildfire",
    source="wildfires",
    condition=lambda: (F.col("frp") >= 200.0) | (F.col("fire_severity") == "Extreme"),
    time="acq_date",
    lookback_hours=24,
    cooldown_hours=12,
    critical=lambda: F.coalesce("frp", F.lit(0.0)) >= 500.0,
    # Whole megawatts, halves to the even neighbour.
    title=lambda: _joined(
        "Major Wildfire — FRP ", F.bround("frp", 0).cast("bigint").cast("string"), " MW"
    ),
    description=lambda: _joined(
        "Major wildfire detected at (", F.format_string("%.2f, %.2f", "latitude", "longitude"),
        "). FRP: ", _shown("frp"), " MW, Severity: ", _shown("fire_severity"),
        ", Confidence: ", _shown("detection_confidence"), ".",
    ),
    key="record_id",
    record_key=lambda: _key_of("latitude", "longitude", "acq_date", "acq_time"),
    details=("latitude", "longitude", "acq_date", "acq_time", "frp"),
    region=_no_region,
)

RULES = {
    rule.alert_type: rule
    for rule in (MAJOR_EARTHQUAKE, EXTREME_AQI, SEVERE_WEATHER, MAJOR_WILDFIRE)
}


RULES_BY_SOURCE = {rule.source: rule for rule in RULES.values()}


def candidates(df: Table, rule: AlertRule, as_of: AsOf = None, lookback_hours: int | None = None) -> DataFrame:
    """Rows that meet the rule within its look-back, before suppression."""
    hours = rule.lookback_hours if lookback_hours is None else lookback_hours
    if rule.time == "acq_date":
        rows = recent(df, "acq_date", as_of, days=max(hours // 24, 1))
    else:
        rows = recent(df, rule.time, as_of, hours=hours)
    return rows.filter(rule.condition())


def suppress_repeats(
    rows: DataFrame, rule: AlertRule, alerts: Table, as_of: AsOf = None, cooldown_hours: int | None = None
) -> DataFrame:
    """Drop rows whose record already raised this alert within the cool-down.

    An anti join on the alert's record key; alerts without one suppress nothing. Of a stored
    alert table only the files of alerts that still cool are opened, however many are stored.
    """
    hours = rule.cooldown_hours if cooldown_hours is None else cooldown_hours
    cooling = recent(alerts, "created_at", as_of, hours=hours).filter(F.col("alert_type") == rule.alert_type)
    known = cooling.select(F.col("record_key").alias("_key"))
    keyed = rows.withColumn("_key", rule.record_key())
    return keyed.join(known.filter(F.col("_key").isNotNull()), "_key", "left_anti").drop("_key")


def alert_rows(rows: DataFrame, rule: AlertRule, as_of: AsOf = None) -> DataFrame:
    metadata = F.struct(rule.record_key().alias(rule.key), *[F.col(c) for c in rule.details])
    return rows.select(
        F.lit(rule.alert_type).alias("alert_type"),
        F.lit(rule.source).alias("source"),
        F.when(rule.critical(), F.lit("Critical")).otherwise(F.lit("High")).alias("severity"),
        rule.title().alias("title"),
        rule.description().alias("description"),
        "latitude",
        "longitude",
        rule.region().alias("region_name"),
        F.to_json(metadata, EXACT_JSON).alias("metadata"),
        rule.record_key().alias("record_key"),
        F.lit(True).alias("is_active"),
        moment(as_of).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def raise_alerts(
    df: Table,
    rule: AlertRule,
    alerts: Table | None = None,
    as_of: AsOf = None,
    lookback_hours: int | None = None,
    cooldown_hours: int | None = None,
) -> DataFrame:
    """New alerts of one rule."""
    rows = candidates(df, rule, as_of, lookback_hours)
    if alerts is not None:
        rows = suppress_repeats(rows, rule, alerts, as_of, cooldown_hours)
    return alert_rows(rows, rule, as_of)


def new_alerts(
    processed: dict[str, Table],
    alerts: Table | None = None,
    as_of: AsOf = None,
    lookback_hours: int | None = None,
) -> DataFrame:
    """New alerts of all rules."""
    return union_all(
        [raise_alerts(processed[r.source], r, alerts, as_of, lookback_hours) for r in RULES.values()]
    )


def active_alerts(alerts: Table, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError(f"limit must lie between 1 and 200, not {limit}")
    return (
        alerts.filter("is_active")
        .select(
            "alert_type", "source", "severity", "title", "description", "latitude", "longitude",
            "region_name", "metadata", "record_key", "created_at",
        )
        .orderBy(*newest(["created_at", "alert_type", "record_key"]))
        .limit(limit)
    )


def alert_history(
    alerts: Table,
    alert_type: str | None = None,
    severity: str | None = None,
    limit: int = 100,
    offset: int = 0,
    after: Sequence[object] | None = None,
) -> Page:
    return paginate(
        alerts,
        [("alert_type", "=", alert_type or None), ("severity", "=", severity or None)],
        time="created_at",
        ties=["alert_type", "record_key"],
        limit=limit,
        offset=offset,
        after=after,
    )
