"""The streaming pipeline: one query per feed, every micro-batch through the batch operators."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from hazardlens.constants import INGESTION_NAME, STREAM_TRIGGER
from hazardlens.operators import alerts as alerting
from hazardlens.operators.anomalies import anomalies_of
from hazardlens.operators.cleaning import skip_existing
from hazardlens.operators.common import AsOf
from hazardlens.operators.feeds import FEEDS, Feed
from hazardlens.operators.quality import pipeline_throughput, quality_funnel
from hazardlens.schemas import TABLES
from hazardlens.sinks.tables import REDUCED, latest_per, write_batch
from hazardlens.sources.tables import open_table
from hazardlens.sources.wire import CORRUPT, decode
from hazardlens.streaming.live import only_new, query_of, split_new_keys, with_new_keys

BatchFunction = Callable[[DataFrame, int], None]


def _not_stored_yet(rows: DataFrame, feed: Feed, root: str, writer: str, batch_id: int) -> DataFrame:
    """Rows new to the processed table, whatever other batches have written.

    The batch's own rows are left out, so a replay decides as the first attempt did. Where the
    event date follows from the key, only the dates of this batch are read; otherwise (quakes, in
    a batch whose stream does not mark new keys) the key column of the whole table is.
    """
    stored = open_table(rows.sparkSession, root, f"{feed.name}_processed", missing_is_empty=True).besides(writer, batch_id)
    if feed.time in feed.key:
        days = [r.event_date for r in rows.select("event_date").distinct().collect()]
        known = stored.of_days(days)
    else:
        known = stored.rows
    return skip_existing(rows, known, feed.key)


def _together(*jobs: Callable[[], None]) -> None:
    """Run writes that do not depend on each other at the same time; the first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def feed_writer(
    feed: Feed,
    root: str,
    processed_at: Column | None = None,
    alert_rule: alerting.AlertRule | None = None,
    as_of: AsOf = None,
    lookback_hours: int | None = None,
) -> BatchFunction:
    """What happens to one micro-batch of decoded records.

    The decoded batch and its final rows are each persisted once and feed all
    sinks. Every sink replaces the batch's own rows, and errors are not caught: a
    failed batch is replayed from the checkpoint with the same result.
    """
    stamp = F.current_timestamp() if processed_at is None else processed_at

    def log_ingestion(spark: SparkSession, writer: str, batch_id: int, records: int, started: float, error: str | None) -> None:
        """What became of a batch; a replay replaces the entry of the failed attempt."""
        status = "success" if error is None else "error"
        row = [(status, records, (time.time() - started) * 1000, error)]
        schema = "status string, records_count long, latency_ms double, error_message string"
        entry = spark.createDataFrame(row, schema).withColumn("created_at", stamp)
        write_batch(entry, root, "ingestion_logs", batch_id, source=INGESTION_NAME[feed.name], dated_by="created_at", writer=writer)

    def process(batch: DataFrame, batch_id: int) -> None:
        started, writer = time.time(), query_of(batch)
        try:
            store_batch(batch, writer, batch_id, started)
        except Exception as error:
            log_ingestion(batch.sparkSession, writer, batch_id, 0, started, str(error)[:500])
            raise

    def store_batch(batch: DataFrame, writer: str, batch_id: int, started: float) -> None:
        spark = batch.sparkSession
        marked = batch.persist(StorageLevel.MEMORY_AND_DISK)
        batch, new_keys = split_new_keys(marked, feed.key)
        flagged = feed.flag(batch)
        write_ms = {"raw": 0.0, "processed": 0.0}

        def write_raw() -> None:
            writing = time.time()
            raw_columns = [f.name for f in TABLES[f"{feed.name}_raw"] if f.name in flagged.columns]
            raw = feed.typed(batch).select(*raw_columns).withColumn("ingested_at", stamp)
            write_batch(raw, root, f"{feed.name}_raw", batch_id, dated_by="ingested_at", writer=writer)
            if CORRUPT in flagged.columns:
                bad = flagged.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"))
                write_batch(bad, root, "quarantine", batch_id, source=feed.name, writer=writer)
            write_ms["raw"] = (time.time() - writing) * 1000

        def write_processed() -> None:
            done = feed.finish(flagged).select(*feed.output)
            dated = done.withColumn("event_date", F.to_date(feed.time)).persist(StorageLevel.MEMORY_AND_DISK)
            fresh = dated if new_keys is None else only_new(dated, new_keys, feed.key)
            # The first batch of a stream also meets keys that the table got before.
            if new_keys is None or batch_id == 0:
                fresh = _not_stored_yet(fresh, feed, root, writer, batch_id)
            fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                writing = time.time()
                processed = fresh.withColumn("processed_at", stamp)
                write_batch(processed, root, f"{feed.name}_processed", batch_id, partition_by=["event_date"], writer=writer)
                write_ms["processed"] = (time.time() - writing) * 1000
                enriched = fresh.drop("event_date")
                jobs = [lambda: write_anomalies(enriched)]
                if alert_rule is not None:
                    jobs.append(lambda: write_alerts(enriched))
                if f"{feed.name}_latest" in REDUCED:
                    newest = latest_per("location_name", feed.time)(enriched)
                    jobs.append(lambda: write_batch(newest, root, f"{feed.name}_latest", batch_id, writer=writer))
                _together(*jobs)
            finally:
                fresh.unpersist()
                dated.unpersist()

        def write_anomalies(enriched: DataFrame) -> None:
            anomalies = anomalies_of(feed.name, enriched).withColumn("detected_at", stamp)
            write_batch(anomalies, root, "anomaly_events", batch_id, source=feed.name, dated_by="detected_at", writer=writer)

        def write_alerts(enriched: DataFrame) -> None:
            stored = open_table(spark, root, "alerts", missing_is_empty=True).of_source(feed.name)
            raised = alerting.raise_alerts(enriched, alert_rule, stored.besides(writer, batch_id), as_of, lookback_hours)
            write_batch(raised, root, "alerts", batch_id, source=feed.name, dated_by="created_at", writer=writer)

        def write_quality() -> None:
            metrics = spark.createDataFrame([counts], counts.__fields__).withColumn("created_at", stamp)
            write_batch(metrics, root, "data_quality_metrics", batch_id, source=feed.name, dated_by="created_at", writer=writer)

        def write_throughput() -> None:
            row = [(feed.name, batch_id, counts.valid_records, (time.time() - started) * 1000, sum(write_ms.values()))]
            schema = (
                "source string, batch_id long, records_count long, processing_time_ms double,"
                " db_write_latency_ms double"
            )
            throughput = pipeline_throughput(spark.createDataFrame(row, schema)).withColumns(
                {"kafka_lag_ms": F.lit(None).cast("double"), "created_at": stamp}
            )
            write_batch(throughput, root, "pipeline_metrics", batch_id, source=feed.name, dated_by="created_at", writer=writer)

        try:
            counts = quality_funnel(flagged.withColumn("batch_id", F.lit(batch_id)), feed).first()
            if counts is None:
                return
            _together(write_raw, write_processed)
            _together(
                write_quality, write_throughput,
                lambda: log_ingestion(spark, writer, batch_id, counts.total_records, started, None),
            )
        finally:
            marked.unpersist()

    return process


def _with_new_quakes(records: DataFrame, feed: Feed, root: str, checkpoint: str) -> DataFrame:
    """Records with the keys that are new, where a key does not tell its day.

    A stream that begins on a table which has rows already gets their keys first, as a table beside
    its checkpoint; from then on no stored row is read.
    """
    spark, keys = records.sparkSession, list(feed.key)
    known = f"{checkpoint}-known"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets/0")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stored = open_table(spark, root, f"{feed.name}_processed", missing_is_empty=True)
        stored.select(*keys).write.mode("overwrite").parquet(known)
    schema = T.StructType([f for f in TABLES[f"{feed.name}_processed"] if f.name in keys])
    valid = feed.flag(records).filter("_parsed and _in_range")
    return with_new_keys(records, valid, keys, spark.readStream.schema(schema).parquet(known))


def start_feed(
    raw: DataFrame,
    feed: Feed,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    **writer_options,
) -> StreamingQuery:
    """Start the query of one feed over a stream with a JSON ``value`` column."""
    records = decode(raw, feed.name)
    if feed.time not in feed.key:
        records = _with_new_quakes(records, feed, root, checkpoint)
    return (
        records.writeStream.queryName(f"{feed.name}-{checkpoint.rsplit('/', 1)[-1]}")
        .foreachBatch(feed_writer(feed, root, **writer_options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": STREAM_TRIGGER}))
        .start()
    )


def start_all(
    streams: dict[str, DataFrame],
    root: str,
    checkpoints: str,
    trigger: dict | None = None,
    alert_rules: dict[str, alerting.AlertRule] | None = None,
    **writer_options,
) -> list[StreamingQuery]:
    """One independent query per feed, each with its own checkpoint and its source's alert rule."""
    rules = alerting.RULES_BY_SOURCE if alert_rules is None else alert_rules
    return [
        start_feed(
            raw, FEEDS[name], root, f"{checkpoints}/{name}", trigger, alert_rule=rules.get(name), **writer_options
        )
        for name, raw in streams.items()
    ]


def run_forever(spark: SparkSession) -> None:
    """Wait until any query ends; a failed one raises here."""
    spark.streams.awaitAnyTermination()
