"""Data-quality funnel and pipeline metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.constants import INGESTION_SOURCES, SOURCES
from hazardlens.operators.common import (
    AsOf, first_per_key, newest, newest_sql, recent, rounded, rounded_avg, small_table, union_all,
)
from hazardlens.operators.feeds import Feed
from hazardlens.sources.tables import StoredTable, Table, counted


def quality_funnel(flagged: DataFrame, feed: Feed, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Counters of every validation step, in one pass over the flagged records.

    Distinct keys are counted as structs, so a key with a NULL part counts too.
    The distinct step groups by (batch, key) first and is combined map-side.
    """
    valid = F.col("_parsed") & F.col("_in_range")
    counts = flagged.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("_parsed").alias("parsed"),
        F.count_if(valid).alias("in_range"),
        F.count_distinct(F.when(valid, F.struct(*feed.key))).alias("unique"),
    )
    return counts.select(
        F.lit(feed.name).alias("source"),
        *by,
        F.col("total").alias("total_records"),
        F.col("unique").alias("valid_records"),
        (F.col("in_range") - F.col("unique")).alias("duplicates"),
        (F.col("total") - F.col("parsed")).alias("missing_fields"),
        (F.col("total") - F.col("parsed")).alias("malformed_records"),
        (F.col("total") - F.col("unique")).alias("dropped_events"),
        (F.col("parsed") - F.col("in_range")).alias("validation_errors"),
    )


def records_per_minute(records: Column, milliseconds: Column) -> Column:
    rate = F.try_divide(records, milliseconds / 60000.0)
    return F.when(milliseconds > 0, rate).otherwise(F.lit(0.0))


def pipeline_throughput(batches: DataFrame) -> DataFrame:
    """Throughput of logged batches: records, times in ms, records per minute."""
    rate = records_per_minute(F.col("records_count"), F.col("processing_time_ms"))
    return batches.withColumn("_rate", rate).select(
        "source",
        "batch_id",
        "records_count",
        rounded("processing_time_ms", 2).alias("processing_time_ms"),
        rounded("db_write_latency_ms", 2).alias("db_write_latency_ms"),
        rounded("_rate", 2).alias("records_per_minute"),
    )


def _only(df: DataFrame, source: str | None) -> DataFrame:
    return df if source is None else df.filter(F.col("source") == source)


def pipeline_summary(metrics: DataFrame, source: str | None = None) -> DataFrame:
    averages = ["processing_time_ms", "records_per_minute", "db_write_latency_ms"]
    return (
        _only(metrics, source)
        .groupBy("source")
        .agg(
            F.count("*").alias("total_batches"),
            F.sum("records_count").alias("total_records"),
            *[rounded_avg(c).alias(f"avg_{c}") for c in averages],
            F.max("created_at").alias("last_batch_at"),
        )
        .orderBy("source")
    )


def quality_summary(metrics: DataFrame, source: str | None = None) -> DataFrame:
    totals = {
        "total_ingested": "total_records",
        "total_valid": "valid_records",
        "total_duplicates": "duplicates",
        "total_missing_fields": "missing_fields",
        "total_malformed": "malformed_records",
        "total_dropped": "dropped_events",
        "total_validation_errors": "validation_errors",
    }
    return (
        _only(metrics, source)
        .groupBy("source")
        .agg(
            F.count("*").alias("total_batches"),
            *[F.sum(column).alias(name) for name, column in totals.items()],
        )
        .orderBy("source")
    )


def recent_batches(metrics: Table, source: str | None = None, limit: int = 20) -> DataFrame:
    """The newest batches; of a stored table only the files that can hold them are opened."""
    if isinstance(metrics, StoredTable):
        metrics = (metrics if source is None else metrics.of_source(source)).newest("created_at", limit)
    return (
        _only(metrics, source)
        .select(
            "source", "batch_id", "records_count", "processing_time_ms", "records_per_minute",
            "db_write_latency_ms", "created_at",
        )
        .orderBy(*newest(["created_at", "source", "batch_id"]))
        .limit(limit)
    )


def pipeline_health(metrics: Table, as_of: AsOf = None, hours: int = 1) -> DataFrame:
    return (
        recent(metrics, "created_at", as_of, hours=hours)
        .groupBy("source")
        .agg(
            F.max("created_at").alias("last_batch"),
            rounded_avg("processing_time_ms", missing=0.0).alias("avg_processing_ms"),
            rounded_avg("records_per_minute", missing=0.0).alias("avg_throughput"),
            F.sum("records_count").alias("total_processed"),
        )
    )


def error_counts(metrics: Table, as_of: AsOf = None, hours: int = 24) -> DataFrame:
    """Sum of the three error counters per source (they overlap, as stored)."""
    errors = F.col("dropped_events") + F.col("validation_errors") + F.col("malformed_records")
    return (
        recent(metrics, "created_at", as_of, hours=hours)
        .groupBy("source")
        .agg(F.sum(errors).alias("errors"))
    )


def ingestion_latency(logs: Table, as_of: AsOf = None, hours: int = 1) -> DataFrame:
    return (
        recent(logs, "created_at", as_of, hours=hours)
        .filter(F.col("status") == "success")
        .groupBy("source")
        .agg(rounded_avg("latency_ms", missing=0.0).alias("avg_latency_ms"))
    )


def source_activity(logs: DataFrame, expected: Sequence[str] = tuple(INGESTION_SOURCES)) -> DataFrame:
    """Newest ingestion log of each expected source; ``no_data`` where there is none."""
    names = list(expected)
    wanted = logs.select("source", "status", "records_count", "latency_ms", "created_at").filter(F.col("source").isin(names))
    latest = first_per_key(wanted, ["source"], newest_sql(["created_at", "status", "records_count", "latency_ms"]))
    dim = small_table(logs.sparkSession, [(n,) for n in names], "source")
    # A stored latency of zero is reported as missing.
    latency = F.when(F.col("latency_ms") != 0, rounded("latency_ms", 2))
    return dim.join(latest, "source", "left").select(
        "source",
        F.coalesce("status", F.lit("no_data")).alias("status"),
        "records_count",
        latency.alias("latency_ms"),
        F.col("created_at").alias("last_run"),
    )


def total_records(processed: dict[str, Table]) -> DataFrame:
    """Rows over the four processed tables; those of stored tables come from their logs."""
    parts = [counted(processed[name]) for name in SOURCES]
    return union_all(parts).agg(F.sum("n").alias("total_records"))
