"""Hourly counts and deduplication across batches.

Neither has a watermark, so no record is dropped for being late: hourly counts are added up from
those of the batches, and the keys seen before are kept in Spark's state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from hazardlens.operators.common import first_per_key
from hazardlens.operators.feeds import Feed
from hazardlens.session import use_keyed_state
from hazardlens.sinks.tables import reduced, write_batch
from hazardlens.sources.tables import open_table


def query_of(batch: DataFrame) -> str:
    """Identity of the query whose micro-batch this is; it stays with the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def events_per_hour(events: DataFrame) -> DataFrame:
    """Events per source and hour of a stream with columns ``source`` and ``ts``."""
    return (
        events.groupBy("source", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("count"))
    )


def stream_events_per_hour(events: DataFrame, root: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Store each batch's counts per hour; they add up when they are read and when files are folded.

    There is no state: a batch counts its own events, so late ones count in their hour at any time,
    and a closed hour costs nothing. A replayed batch replaces its counts.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        write_batch(events_per_hour(batch), root, "events_per_hour", batch_id, writer=query_of(batch))

    return (
        events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def hourly_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events per source and hour of all batches."""
    return reduced(spark, root, "events_per_hour").drop("batch_id")


#: Marks the rows of a stream that name a key which was never there before.
NEW_KEY = "_new_key"
#: Marks keys that were stored before the stream began.
_KNOWN = "_known"


def with_new_keys(records: DataFrame, valid: DataFrame, keys: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """``records``, and a row with ``NEW_KEY`` for each key that ``valid`` holds for the first time.

    The keys seen are Spark's state, exact and without a watermark, in a keyed store: what a batch
    costs depends on its own keys, not on those seen before. The record that stays is chosen among
    the batch's own, so it does not depend on their order in the stream. ``known`` is a stream of
    keys that are not new.
    """
    use_keyed_state(records.sparkSession)
    arrived = valid.select(*keys, F.lit(False).alias(_KNOWN))
    if known is not None:
        arrived = arrived.unionByName(known.select(*keys, F.lit(True).alias(_KNOWN)))
    new = arrived.dropDuplicates(list(keys)).filter(~F.col(_KNOWN)).drop(_KNOWN)
    return records.withColumn(NEW_KEY, F.lit(False)).unionByName(new.withColumn(NEW_KEY, F.lit(True)), allowMissingColumns=True)


def split_new_keys(batch: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """A batch's records and its new keys; None if its stream does not mark them."""
    if NEW_KEY not in batch.columns:
        return batch, None
    return batch.filter(~F.col(NEW_KEY)).drop(NEW_KEY), batch.filter(NEW_KEY).select(*keys)


def only_new(rows: DataFrame, new_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is new, NULL-safe on every part."""
    named = new_keys.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys]
    return rows.join(named, same, "left_semi")


def stream_dedup(records: DataFrame, feed: Feed, root: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Store the first arrival of every natural key, however late it is.

    Repeats within a batch go by the feed's order; whether a key was there in an earlier batch is
    Spark's keyed state, see ``with_new_keys``. No stored row is read.
    """
    keys = list(feed.key)

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows, new_keys = split_new_keys(batch, keys)
            rest = [c for c in rows.columns if c not in keys and c != feed.time]
            order = ", ".join(f"`{c}` ASC NULLS LAST" for c in [feed.time, *rest])
            first = first_per_key(only_new(rows, new_keys, keys), keys, order)
            # Kept by the day of arrival: one day per batch, however old its records are.
            arrived = first.withColumn("event_date", F.current_date())
            write_batch(arrived, root, "first_arrivals", batch_id, partition_by=["event_date"], schema=_arrivals(rows.schema), writer=query_of(batch))
        finally:
            batch.unpersist()

    return (
        with_new_keys(records, records, keys).writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _arrivals(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("event_date", T.DateType()), T.StructField("batch_id", T.LongType())])


def first_arrivals(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows that ``stream_dedup`` has stored."""
    stored = open_table(spark, root, "first_arrivals", missing_is_empty=True, schema=_arrivals(schema))
    return stored.drop("event_date", "batch_id")


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Write an append-mode stream to parquet, each row exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
