"""Registered streaming queries over the given table.

The feeds are landed as JSON lines and subscribed to; queries without a wire format
read the table itself as a file stream.

Each run writes to a fresh folder below the shared checkpoint folder, processes all
available input and returns the table it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.operators import alerts
from hazardlens.operators.feeds import EARTHQUAKES, FEEDS
from hazardlens.plans import feeds
from hazardlens.plans.inputs import AS_OF, LOOKBACK_HOURS, Inputs
from hazardlens.session import shared_dir
from hazardlens.sources import tables, wire
from hazardlens.streaming import etl, live

ALL_AVAILABLE = {"availableNow": True}


def _run_feed(i: Inputs, name: str, **options) -> str:
    """Stream one feed end to end through its JSON wire format."""
    root = shared_dir(i.spark, f"stream-{name}")
    lines = wire.subscribe_files(i.spark, i.land(wire.encode(i.raw(name))))
    running = etl.start_feed(
        lines, FEEDS[name], f"{root}/tables", f"{root}/checkpoint", ALL_AVAILABLE,
        processed_at=F.lit(AS_OF), **options,
    )
    running.awaitTermination()
    return f"{root}/tables"


def _etl(name: str):
    def build(i: Inputs) -> DataFrame:
        root = _run_feed(i, name)
        return tables.scan_table(i.spark, root, f"{name}_processed").select(*FEEDS[name].output)

    return build


def sink_raw(i: Inputs) -> DataFrame:
    root = _run_feed(i, "weather")
    return tables.scan_table(i.spark, root, "weather_raw").drop("ingested_at", "event_date", "batch_id")


def sink_processed(i: Inputs) -> DataFrame:
    root = _run_feed(i, "wildfires")
    stored = tables.scan_table(i.spark, root, "wildfires_processed")
    return stored.groupBy("event_date", "fire_severity").agg(F.count("*").alias("rows"))


def stream_quality(i: Inputs) -> DataFrame:
    root = _run_feed(i, "earthquakes")
    counters = [
        "total_records", "valid_records", "duplicates", "missing_fields", "malformed_records",
        "dropped_events", "validation_errors",
    ]
    stored = tables.scan_table(i.spark, root, "data_quality_metrics")
    return stored.groupBy("source").agg(*[F.sum(c).alias(c) for c in counters])


def stream_ingestion_logs(i: Inputs) -> DataFrame:
    root = _run_feed(i, "weather")
    logs = tables.scan_table(i.spark, root, "ingestion_logs")
    return logs.groupBy("source", "status").agg(F.sum("records_count").alias("records"))


def stream_alerts(i: Inputs) -> DataFrame:
    """Alerts of all four feeds, each raised by the rule of its source."""
    root = shared_dir(i.spark, "stream-all")
    streams = {name: wire.subscribe_files(i.spark, i.land(wire.encode(i.raw(name)))) for name in FEEDS}
    running = etl.start_all(
        streams, f"{root}/tables", f"{root}/checkpoints", ALL_AVAILABLE, alert_rules=alerts.RULES_BY_SOURCE,
        processed_at=F.lit(AS_OF), as_of=AS_OF, lookback_hours=LOOKBACK_HOURS,
    )
    for query in running:
        query.awaitTermination()
    stored = tables.scan_table(i.spark, f"{root}/tables", "alerts")
    key = F.coalesce(*[F.get_json_object("metadata", f"$.{k}") for k in ("event_id", "record_id")])
    return stored.select(
        "alert_type", "source", "severity", "title", "description", "region_name", "is_active", key.alias("record_key")
    )


def src_json_stream(i: Inputs) -> DataFrame:
    """Weather records landed as JSON lines, then subscribed to, decoded and stored."""
    root = shared_dir(i.spark, "json-stream")
    lines = wire.subscribe_files(i.spark, i.land(wire.encode(i.raw("weather"))))
    decoded = wire.decode(lines, "weather")
    typed = FEEDS["weather"].typed(decoded).drop(wire.CORRUPT)
    live.append_stream(typed, f"{root}/out", f"{root}/checkpoint", ALL_AVAILABLE).awaitTermination()
    return i.spark.read.schema(typed.schema).parquet(f"{root}/out")


def stream_events_per_hour(i: Inputs) -> DataFrame:
    """Every hour, open ones included."""
    root = shared_dir(i.spark, "events-per-hour")
    events = feeds.stream_events(i.spark, i.sf_dir).select(F.col("event_type").alias("source"), "ts")
    live.stream_events_per_hour(events, root, f"{root}/checkpoint", ALL_AVAILABLE).awaitTermination()
    return live.hourly_counts(i.spark, root)


def _dedup(i: Inputs) -> DataFrame:
    root = shared_dir(i.spark, "dedup")
    records = feeds.feed(i.spark, feeds.stream_events(i.spark, i.sf_dir), "earthquakes")
    live.stream_dedup(records, EARTHQUAKES, root, f"{root}/checkpoint", ALL_AVAILABLE).awaitTermination()
    return live.first_arrivals(i.spark, root, records.schema)


def stream_dedup(i: Inputs) -> DataFrame:
    return _dedup(i).select("event_id")


def dedup_across_batches(i: Inputs) -> DataFrame:
    """How many arrivals came through, and of how many ids."""
    return _dedup(i).agg(F.count("*").alias("arrivals"), F.count_distinct("event_id").alias("ids"))


STREAMS = {
    "src_json_stream": src_json_stream,
    **{f"stream_etl_{name}": _etl(name) for name in FEEDS},
    "sink_raw": sink_raw,
    "sink_processed": sink_processed,
    "stream_quality": stream_quality,
    "stream_ingestion_logs": stream_ingestion_logs,
    "stream_alerts": stream_alerts,
    "stream_events_per_hour": stream_events_per_hour,
    "stream_dedup": stream_dedup,
    "dedup_across_batches": dedup_across_batches,
}
