"""The four hazard feeds and their clean -> deduplicate -> enrich pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import geo, rules
from hazardlens.operators import cleaning


def enrich_earthquakes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "risk_category": rules.risk_category("magnitude"),
            "magnitude_band": rules.magnitude_band("magnitude"),
            "distance_group": rules.distance_group("depth_km"),
        }
    )


def enrich_weather(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "heat_index": rules.heat_index("temperature_c", "humidity_pct"),
            "rain_severity": rules.rain_severity("precipitation_mm"),
            "wind_severity": rules.wind_severity("wind_speed_kmh"),
            "storm_severity": rules.storm_severity("wind_speed_kmh", "precipitation_mm", "weather_code"),
        }
    )


def enrich_air_quality(df: DataFrame) -> DataFrame:
    return df.withColumn("aqi_category", rules.aqi_category("us_aqi"))


def enrich_wildfires(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fire_severity": rules.fire_severity("frp"),
            "detection_confidence": rules.detection_confidence("confidence"),
        }
    )


@dataclass(frozen=True)
class Feed:
    """What distinguishes one feed: its keys, defaults and enrichment."""

    name: str
    key: tuple[str, ...]
    time: str
    text: tuple[str, ...]
    required: tuple[str, ...]
    enrich: Callable[[DataFrame], DataFrame]
    output: tuple[str, ...]
    defaults: dict[str, float] = field(default_factory=dict)
    dated: bool = False

    def typed(self, df: DataFrame) -> DataFrame:
        """Records as received, with the event time parsed (NULL where it cannot be)."""
        normalize = cleaning.normalize_date if self.dated else cleaning.normalize_timestamp
        return normalize(df, self.time)

    def parse(self, df: DataFrame) -> DataFrame:
        """``typed`` with missing-value texts replaced by NULL."""
        return self.typed(cleaning.clean_string_nulls(df, self.text))

    def flag(self, df: DataFrame) -> DataFrame:
        """Parsed rows with one flag per validation step instead of a filter per step."""
        present = F.expr(" AND ".join(f"{name} IS NOT NULL" for name in self.required))
        in_range = F.coalesce(geo.in_range(), F.lit(False))
        return self.parse(df).withColumns({"_parsed": present, "_in_range": in_range})

    def finish(self, flagged: DataFrame) -> DataFrame:
        """Valid rows of a flagged frame: deduplicated, defaulted and enriched."""
        helpers = [c for c in flagged.columns if c.startswith("_")]
        valid = flagged.filter("_parsed and _in_range").drop(*helpers)
        unique = cleaning.deduplicate(valid, self.key, self.time)
        return self.enrich(cleaning.fill_defaults(unique, self.defaults))

    def process(self, df: DataFrame, processed_at: Column | None = None) -> DataFrame:
        """Raw records to processed rows, optionally stamped."""
        done = self.finish(self.flag(df)).select(*self.output)
        return done if processed_at is None else done.withColumn("processed_at", processed_at)


EARTHQUAKES = Feed(
    name="earthquakes",
    key=("event_id",),
    time="event_time",
    text=("place", "status", "event_id"),
    required=("event_time", "event_id"),
    defaults={"magnitude": 0.0, "depth_km": 0.0},
    enrich=enrich_earthquakes,
    output=(
        "event_id", "magnitude", "place", "event_time", "latitude", "longitude", "depth_km",
        "tsunami", "significance", "status", "risk_category", "magnitude_band", "distance_group",
    ),
)

WEATHER = Feed(
    name="weather",
    key=("location_name", "observed_at"),
    time="observed_at",
    text=("location_name",),
    required=("observed_at", "location_name"),
    defaults={"wind_speed_kmh": 0.0, "precipitation_mm": 0.0},
    enrich=enrich_weather,
    output=(
        "location_name", "latitude", "longitude", "temperature_c", "humidity_pct",
        "wind_speed_kmh", "precipitation_mm", "weather_code", "observed_at", "heat_index",
        "rain_severity", "wind_severity", "storm_severity",
    ),
)

AIR_QUALITY = Feed(
    name="air_quality",
    key=("location_name", "observed_at"),
    time="observed_at",
    text=("location_name",),
    required=("observed_at", "location_name"),
    enrich=enrich_air_quality,
    output=(
        "location_name", "latitude", "longitude", "us_aqi", "pm2_5", "pm10", "ozone",
        "nitrogen_dioxide", "carbon_monoxide", "sulphur_dioxide", "observed_at", "aqi_category",
    ),
)

WILDFIRES = Feed(
    name="wildfires",
    key=("latitude", "longitude", "acq_date", "acq_time"),
    time="acq_date",
    text=("satellite", "instrument", "confidence", "daynight", "acq_time"),
    required=("acq_date",),
    defaults={"frp": 0.0},
    enrich=enrich_wildfires,
    output=(
        "latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time",
        "satellite", "instrument", "confidence", "frp", "daynight", "fire_severity",
        "detection_confidence",
    ),
    dated=True,
)

FEEDS = {feed.name: feed for feed in (EARTHQUAKES, WEATHER, AIR_QUALITY, WILDFIRES)}
