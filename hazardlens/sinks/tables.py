"""Table sinks that survive a replayed batch or a lost executor."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.constants import JDBC_ATTEMPTS, JDBC_BATCH_SIZE, JDBC_DELAY_SECONDS
from hazardlens.operators.common import first_per_key, newest_sql
from hazardlens.schemas import TABLES
from hazardlens.sources.tables import open_table, scan_table
from hazardlens.tablelog import NO_DAY, Log


def write_batch(
    df: DataFrame, root: str, table: str, batch_id: int,
    source: str | None = None, partition_by: Sequence[str] = (), dated_by: str | None = None,
    schema: T.StructType | None = None, writer: str = "",
) -> None:
    """Replace what one batch holds in a table, in one step that readers see whole or not at all.

    A table that several streams share has a log for each ``source``, so that their commits do not
    meet. Rows are kept by their ``event_date`` if that is given in ``partition_by`` or follows from
    the time ``dated_by``: a look-back reads the files of its days only. Writing the same batch again
    replaces its own earlier attempt and nothing else; ``writer`` tells apart queries that number
    their batches each on its own. Tables of ``REDUCED`` keep one row per key.
    """
    folder = f"{root}/{table}" + (f"/source={source}" if source else "")
    rows = df.drop("batch_id", "source") if source else df.drop("batch_id")
    if dated_by:
        rows = rows.withColumn("event_date", F.to_date(dated_by))
    dated = bool(dated_by) or "event_date" in partition_by
    log = Log(df.sparkSession, folder, f"{root}/{table}")
    log.replace_batch(rows, schema or TABLES[table], dated, batch_id, writer, REDUCED.get(table))


def compact(spark: SparkSession, root: str, table: str, before: dt.date | None = None, at: int = 2) -> None:
    """Fold the small files of closed days, or of all days, into few; one step per day.

    The newest batch of each writer is left as it is, for it may be replayed.
    """
    stored = open_table(spark, root, table)
    for _, log, head in stored.logs:
        days = [d for d in head["days"] if before is None or d < str(before)]
        newest: dict[str, int] = {}
        for f in log.files(head):
            newest[f.writer] = max(newest.get(f.writer, f.last_batch), f.last_batch)
        log.fold(
            stored.schema_of_table, NO_DAY not in head["days"], lambda f, newest=newest: f.last_batch >= newest[f.writer],
            days, REDUCED.get(table), at, together=True,
        )


def latest_per(key: str, time: str) -> Callable[[DataFrame], DataFrame]:
    """The newest row of every ``key``; ties go by the other columns, the batch last."""
    def reduce(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, time, "batch_id", "event_date")]
        return first_per_key(rows, [key], newest_sql([time, *rest, *(c for c in ("batch_id",) if c in rows.columns)]))

    return reduce


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "hour").agg(F.sum("count").alias("count"), F.max("batch_id").alias("batch_id"))


def _last_written(rows: DataFrame) -> DataFrame:
    return first_per_key(rows, ["metric", "source", "location_name", "ds"], newest_sql(["batch_id", "y"]))


#: Tables whose small files are reduced to one row per key when they are folded. A reader reduces
#: what is there once more, as unfolded files may repeat a key.
REDUCED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "weather_latest": latest_per("location_name", "observed_at"),
    "air_quality_latest": latest_per("location_name", "observed_at"),
    "risk_latest": latest_per("region_name", "computed_at"),
    "events_per_hour": _added_up,
    "series_points": _last_written,
}


def reduced(spark: SparkSession, root: str, table: str, missing_is_empty: bool = False) -> DataFrame:
    """One row per key of a table of ``REDUCED``: a folded base and at most a few dozen batches."""
    return REDUCED[table](open_table(spark, root, table, missing_is_empty).rows)


#: Folders per metric and horizon that the places of forecasts are dealt to.
PLACE_BUCKETS = 32


def replace_forecasts(forecasts: DataFrame, root: str, max_records_per_file: int = 1_000_000) -> None:
    """Replace the stored forecasts of every (metric, source, horizon, location) given.

    Folders are by metric, horizon and a bucket of the place, so their number does not grow with
    the places. The buckets concerned are rewritten with the other series they hold.
    """
    series = ["metric", "source", "horizon", "location_name"]
    folders = ["metric", "horizon", "place_bucket"]
    bucket = F.pmod(F.xxhash64("source", "location_name"), F.lit(PLACE_BUCKETS)).cast("int")
    new = forecasts.withColumn("place_bucket", bucket)
    stored = scan_table(forecasts.sparkSession, root, "forecasts", missing_is_empty=True)
    concerned = new.select(*folders).distinct()
    given = new.select(*[F.col(c).alias(f"_new_{c}") for c in series]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in series]
    others = stored.join(concerned, folders, "left_semi").join(given, same, "left_anti")
    (
        new.unionByName(others.select(*new.columns)).hint("rebalance", *[F.col(c) for c in folders])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*folders)
        .parquet(f"{root}/forecasts")
    )


def append_series(points: DataFrame, root: str, run_id: int) -> None:
    """Keep the points of a cycle; those of an earlier cycle for the same instants give way to them."""
    write_batch(points, root, "series_points", run_id, dated_by="ds")


def series_points(spark: SparkSession, root: str, since: dt.datetime) -> DataFrame:
    """The points that are kept, of the days from ``since`` on."""
    return _last_written(open_table(spark, root, "series_points").not_before("ds", since))


def append_snapshot(snapshot: DataFrame, root: str, run_id: int) -> None:
    """Add a snapshot; the same run again replaces its own."""
    write_batch(snapshot, root, "analytics_snapshots", run_id, dated_by="created_at")


def append_risk_scores(scores: DataFrame, root: str, run_id: int) -> None:
    """Add the scores of a run, and keep the newest of every region at hand; the same run again
    replaces its own."""
    write_batch(scores, root, "risk_scores", run_id, dated_by="computed_at")
    write_batch(scores, root, "risk_latest", run_id)


def with_retries(
    write: Callable[[], None],
    attempts: int = JDBC_ATTEMPTS,
    delay_seconds: float = JDBC_DELAY_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
) -> None:
    """Run a write up to ``attempts`` times, waiting a little longer after each failure."""
    for attempt in range(1, attempts + 1):
        try:
            return write()
        except Exception:
            if attempt == attempts:
                raise
            sleep(delay_seconds * attempt)


def append_jdbc(
    df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
    batch_size: int = JDBC_BATCH_SIZE, **retry,
) -> None:
    """Append to a database table, at least once.

    Each partition commits on its own, so a repeated attempt can repeat rows; give
    the target a unique key, or use ``write_batch`` where that is not possible.
    """
    settings = {"batchsize": str(batch_size), "reWriteBatchedInserts": "true", **(properties or {})}
    with_retries(
        lambda: df.write.jdbc(url=url, table=table, mode="append", properties=settings), **retry
    )
