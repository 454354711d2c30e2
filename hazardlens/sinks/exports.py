"""CSV and JSON exports of the newest rows of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.operators.common import AsOf, moment, newest
from hazardlens.operators.dashboard import checked_limit
from hazardlens.sources.tables import StoredTable, Table

# Exportable datasets and the time each is ordered by.
EXPORT_ORDER = {
    "earthquakes": "event_time",
    "weather": "observed_at",
    "air_quality": "observed_at",
    "wildfires": "acq_date",
    "anomalies": "detected_at",
    "alerts": "created_at",
}
DEFAULT_LIMIT, MAX_LIMIT = 1000, 5000


def export_rows(df: Table, data_type: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest ``limit`` rows, ties broken by the remaining columns. Of a stored table only the
    files that can hold them are opened."""
    if data_type not in EXPORT_ORDER:
        raise ValueError(f"Unknown data type: {data_type}")
    time = EXPORT_ORDER[data_type]
    checked_limit(limit, 1, MAX_LIMIT)
    if isinstance(df, StoredTable):
        df = df.newest(time, limit)
    rest = [c for c in df.columns if c != time]
    return df.orderBy(*newest([time, *rest])).limit(limit)


def _iso_times(df: DataFrame) -> DataFrame:
    times = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times})


def export_csv(df: Table, data_type: str, path: str, limit: int = DEFAULT_LIMIT) -> None:
    rows = _iso_times(export_rows(df, data_type, limit))
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_document(df: Table, data_type: str, limit: int = DEFAULT_LIMIT, as_of: AsOf = None) -> DataFrame:
    """The export as one JSON text: an envelope around at most ``MAX_LIMIT`` records."""
    rows = _iso_times(export_rows(df, data_type, limit))
    records = rows.agg(F.count("*").alias("count"), F.collect_list(F.struct("*")).alias("records"))
    envelope = F.struct(
        F.lit(data_type).alias("data_type"),
        moment(as_of).cast("timestamp").alias("exported_at"),
        "count",
        "records",
    )
    return records.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def export_json(df: Table, data_type: str, path: str, limit: int = DEFAULT_LIMIT, as_of: AsOf = None) -> None:
    export_document(df, data_type, limit, as_of).write.mode("overwrite").text(path)
