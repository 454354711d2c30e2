"""Stored tables with declared schemas, read through their commit logs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from hazardlens.schemas import TABLES
from hazardlens.tablelog import DataFile, Log, read_files, since_epoch

#: Columns whose day is the ``event_date`` that stored tables are kept by: the event's own time in the
#: processed tables, the time of writing in alerts, anomalies, scores, metrics and logs.
DATED_BY = {"event_time", "observed_at", "acq_date", "created_at", "computed_at", "detected_at", "ds"}

#: Tables without a commit log: whole folders of theirs are replaced.
PLAIN = {"forecasts"}


class StoredTable:
    """A table as its logs have it at this moment.

    It can be used like the DataFrame of all its rows. What knows more about the rows it wants asks
    for them by ``not_before``, ``newest``, ``of_days`` or ``of_source``: then only files that can
    hold such rows are opened. Counts and newest instants come from the logs alone.
    """

    def __init__(
        self, spark: SparkSession, base: str, schema: T.StructType, logs: list[tuple[str, Log, dict]],
        left_out: Callable[[DataFile], bool] | None = None,
    ) -> None:
        self.spark, self.base, self.schema_of_table, self.logs, self.left_out = spark, base, schema, logs, left_out

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.rows, name)

    @cached_property
    def rows(self) -> DataFrame:
        return self._read(lambda day: True, lambda file: True)

    def _files(self, day: Callable[[dict], bool], file: Callable[[DataFile], bool]) -> list[tuple[Log, DataFile]]:
        return [
            (log, f) for _, log, head in self.logs
            for f in log.files(head, [d for d, summary in head["days"].items() if day(summary)])
            if file(f) and not (self.left_out and self.left_out(f))
        ]

    def _read(self, day: Callable[[dict], bool], file: Callable[[DataFile], bool]) -> DataFrame:
        paths = [f"{log.folder}/{f.path}" for log, f in self._files(day, file)]
        return read_files(self.spark, self.base, paths, self.schema_of_table)

    def of_source(self, source: str) -> StoredTable:
        """The part that one source's stream has written."""
        own = [own for own in self.logs if own[0] == source]
        return StoredTable(self.spark, self.base, self.schema_of_table, own, self.left_out)

    def besides(self, writer: str, batch_id: int) -> StoredTable:
        """The rows without those of an earlier attempt at a writer's newest batch. Counts and
        newest instants still include it."""
        own = lambda f: f.writer == writer and f.first_batch == f.last_batch == batch_id
        return StoredTable(self.spark, self.base, self.schema_of_table, self.logs, own)

    def of_days(self, days: Sequence[dt.date | str]) -> DataFrame:
        """The rows of some event days."""
        names = {str(day) for day in days}
        found = [
            (log, f) for _, log, head in self.logs for f in log.files(head, [d for d in head["days"] if d in names])
            if not (self.left_out and self.left_out(f))
        ]
        return read_files(self.spark, self.base, [f"{log.folder}/{f.path}" for log, f in found], self.schema_of_table)

    def _number(self, column: str, moment: dt.date | int) -> int:
        """A bound of a column as the logs have its values."""
        if isinstance(moment, int):
            return moment
        is_instant = isinstance(moment, dt.datetime)
        if self.schema_of_table[column].dataType == T.DateType():
            return since_epoch(moment.date() if is_instant else moment)
        return since_epoch(moment if is_instant else dt.datetime.combine(moment, dt.time()))

    def not_before(self, column: str, moment: dt.date | int) -> DataFrame:
        """Every row whose ``column`` is ``moment`` or later, and others of the same files."""
        least = self._number(column, moment)
        late = lambda high: high.get(column, least - 1) >= least
        return self._read(lambda day: late(day["high"]), lambda file: late(file.high))

    def not_after(self, column: str, moment: dt.date | None) -> DataFrame:
        """Every row whose ``column`` is ``moment`` or earlier or null, and others of the same files."""
        most = None if moment is None else self._number(column, moment)
        early = lambda low, held, rows: held.get(column, 0) < rows or (most is not None and low[column] <= most)
        return self._read(lambda day: early(day["low"], day["held"], day["rows"]), lambda f: early(f.low, f.held, f.rows))

    def newest(self, column: str, k: int) -> DataFrame:
        """The ``k`` rows with the largest ``column``, and others of the same files.

        Files that begin at some instant or later hold ``k`` rows that are as new; so none but those
        that reach that instant can hold a newer one. With fewer rows than ``k`` it is the table.
        """
        days = sorted((d for _, _, head in self.logs for d in head["days"].values() if column in d["low"]), key=lambda d: -d["low"][column])
        least = _reached([(d["low"][column], d["held"][column]) for d in days], k)
        if least is None:
            return self.rows
        found = self._files(lambda day: day["high"].get(column, least - 1) >= least, lambda f: f.high.get(column, least - 1) >= least)
        nearer = _reached(sorted(((f.low[column], f.held[column]) for _, f in found), reverse=True), k)
        least = least if nearer is None else max(least, nearer)
        paths = [f"{log.folder}/{f.path}" for log, f in found if f.high[column] >= least]
        return read_files(self.spark, self.base, paths, self.schema_of_table)

    def count(self) -> int:
        return sum(d["rows"] for _, _, head in self.logs for d in head["days"].values())

    def rows_by_day(self) -> dict[str, int]:
        """Rows per event day."""
        found: dict[str, int] = {}
        for _, _, head in self.logs:
            for day, summary in head["days"].items():
                found[day] = found.get(day, 0) + summary["rows"]
        return found

    def highest(self, column: str) -> int | None:
        """The largest value of a time column, in microseconds or days since 1970."""
        return max((d["high"][column] for _, _, head in self.logs for d in head["days"].values() if column in d["high"]), default=None)

    def is_dated_by(self, column: str) -> bool:
        """Whether the rows are kept by the day of ``column``."""
        return "event_date" in self.schema_of_table.names and column in DATED_BY


def counted(table: Table, name: str = "n") -> DataFrame:
    """The number of rows as a one-row frame; that of a stored table comes from its logs."""
    if isinstance(table, StoredTable):
        return table.spark.range(1).select(F.lit(table.count()).cast("long").alias(name))
    return table.agg(F.count("*").alias(name))


def _reached(begins: Sequence[tuple[int, int]], k: int) -> int | None:
    """The instant from which on parts hold ``k`` values, given (first instant, values), newest first."""
    held = 0
    for low, values in begins:
        held += values
        if held >= k:
            return low
    return None


Table = DataFrame | StoredTable


def open_table(
    spark: SparkSession, root: str, table: str, missing_is_empty: bool = False, schema: T.StructType | None = None
) -> StoredTable:
    """A table below ``root``. One that does not exist is an error unless the caller says that it may
    not have been written yet."""
    base = f"{root}/{table}"
    logs = [("", Log(spark, base)), *((s, Log(spark, f"{base}/source={s}", base)) for s in _sources(spark, base))]
    committed = [(source, log, head) for source, log in logs if (head := log.head()) is not None]
    if not committed and not missing_is_empty:
        spark.read.schema("path string").parquet(f"{base}/_log/head.json")  # says what is missing
    return StoredTable(spark, base, schema or TABLES[table], committed)


def _sources(spark: SparkSession, base: str) -> list[str]:
    """Sources that share a table; each has a folder of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/source=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(status.getPath().getName().split("=", 1)[1] for status in found)


def scan_table(spark: SparkSession, root: str, table: str, missing_is_empty: bool = False) -> DataFrame:
    """All rows of a table, see ``open_table``."""
    if table not in PLAIN:
        return open_table(spark, root, table, missing_is_empty).rows
    schema = TABLES[table]
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as missing:
        if not missing_is_empty or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def scan_days(spark: SparkSession, root: str, table: str, days: Sequence[dt.date]) -> DataFrame:
    """The given days of a stored table. Days without rows, and a table not written yet, are empty."""
    return open_table(spark, root, table, missing_is_empty=True).of_days(days)


def scan_processed(spark: SparkSession, root: str) -> dict[str, StoredTable]:
    """The four processed tables by feed name."""
    feeds = ["earthquakes", "weather", "air_quality", "wildfires"]
    return {feed: open_table(spark, root, f"{feed}_processed") for feed in feeds}
