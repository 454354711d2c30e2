"""Building blocks shared by the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.session import shared_dir
from hazardlens.sources.tables import DATED_BY, StoredTable, Table

AsOf = dt.datetime | Column | None


def moment(as_of: AsOf) -> Column:
    """The instant a query looks back from; the clock unless one is given."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def instant(spark: SparkSession, as_of: AsOf) -> dt.datetime:
    """The same instant as a value, as far as it is known while a plan is made."""
    if isinstance(as_of, dt.datetime):
        return as_of
    return spark.range(1).select(moment(as_of).cast("timestamp")).first()[0]


def recent(df: Table, column: str, as_of: AsOf, *, hours: int = 0, days: int = 0) -> DataFrame:
    """Rows whose ``column`` is not older than the look-back; there is no upper bound.

    Dates look back whole days. Of a stored table only the files that reach into the look-back
    are opened, whatever ``column`` it is by; the same bound on ``event_date`` leaves only the
    folders of the look-back of other tables to be read.
    """
    start = moment(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours))
    first_day = F.to_date(start)
    if isinstance(df, StoredTable):
        from_ = instant(df.spark, as_of) - dt.timedelta(days=days, hours=hours)
        # The day as seen here may be ahead of the session's.
        df = df.not_before(column, from_.date() - dt.timedelta(days=1) if column == "acq_date" else from_)
    kept = df.filter(F.col(column) >= (first_day if column == "acq_date" else start))
    if column in DATED_BY and "event_date" in df.columns:
        kept = kept.filter(F.col("event_date") >= first_day)
    return kept


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def count_by(df: DataFrame, *keys: str | Column, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def newest(columns: Sequence[str]) -> list[Column]:
    """Descending order over all columns: a total order, NULL last."""
    return [F.col(c).desc_nulls_last() for c in columns]


def newest_sql(columns: Sequence[str]) -> str:
    """``newest`` as the text of an ORDER BY."""
    return ", ".join(f"`{c}` DESC NULLS LAST" for c in columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, k: int = 1) -> DataFrame:
    """The first ``k`` rows of every key in the given ORDER BY.

    The rank filter becomes a group limit below the shuffle, so each map task
    sends at most ``k`` rows of a key: a hot key does not reach one reducer whole.
    """
    partition = ", ".join(f"`{c}`" for c in keys)
    rank = F.expr(f"row_number() OVER (PARTITION BY {partition} ORDER BY {order})")
    return df.withColumn("_rank", rank).filter(f"_rank <= {k}").drop("_rank")


def positioned(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its position from 0 in a total order, without a window over all rows.

    The rows are range-sorted once into a table of the shared folder; a row's position is
    the rows in the ranges before its own, a table of one row per range, plus its place in it.
    Rows that share their first sort columns spread over ranges by the others.
    """
    sorted_rows = df.sort(*order).withColumn("_place", F.monotonically_increasing_id())
    folder = shared_dir(df.sparkSession, "positioned")
    sorted_rows.write.parquet(folder)
    placed = df.sparkSession.read.schema(sorted_rows.schema).parquet(folder)
    placed = placed.withColumn("_range", F.shiftrightunsigned("_place", 33))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(ranges.select("_range", before.alias("_before")), "_range")
        .withColumn(name, F.col("_before") + within)
        .drop("_range", "_place", "_before")
    )


#: JSON texts keep the microseconds of an instant.
EXACT_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def rounded(number: str, digits: int) -> Column:
    """A number rounded through a decimal, halves away from zero.

    Ten decimals absorb the last-bit differences that the order of a distributed sum
    leaves, so the rounded value does not depend on the partitioning.
    """
    return F.expr(f"CAST(round(CAST({number} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)")


def rounded_avg(column: str, digits: int = 2, missing: float | None = None) -> Column:
    mean = f"avg({column})"
    return rounded(mean if missing is None else f"coalesce({mean}, {missing}D)", digits)


def small_table(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A fixed list as a local relation: its exact size is known to the planner."""
    def sql(value: str | float | int) -> str:
        return f"{value!r}D" if isinstance(value, float) else repr(value)

    values = ", ".join("(" + ", ".join(map(sql, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
