"""Filtered, paged access to the stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import eq, ge, gt, le, lt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.operators.common import newest, positioned
from hazardlens.sources.tables import StoredTable, Table, counted

_TESTS = {"=": eq, ">=": ge, "<=": le, ">": gt, "<": lt}

Filter = tuple[str, str, object]


class Page(NamedTuple):
    """One page of rows and, as a one-row frame, the number of all matches."""

    rows: DataFrame
    total: DataFrame


def apply_filters(df: Table, filters: Sequence[Filter]) -> DataFrame:
    """AND of (column, operator, value); a filter without a value is skipped."""
    active = [_TESTS[op](F.col(c), F.lit(v)) for c, op, v in filters if v is not None]
    return reduce(DataFrame.filter, active, df.rows if isinstance(df, StoredTable) else df)


#: Rows that a task keeps at most for a page by its offset.
NEAR_ROWS = 5_000


def paginate(
    df: Table,
    filters: Sequence[Filter],
    time: str,
    ties: Sequence[str],
    limit: int = 50,
    offset: int = 0,
    max_limit: int = 500,
    after: Sequence[object] | None = None,
    near_rows: int = NEAR_ROWS,
) -> Page:
    """Rows ``offset`` to ``offset + limit``, newest first, ties in a fixed order.

    ``after`` holds the sort values (time, then ties) of the last row of the page before:
    the next page is then a top-k of ``limit`` rows, however deep it is, and only reads
    what is not newer. An offset within ``near_rows`` is a top-k as well.

    In a stored table a deeper page is found by position: the days' row counts (from the log,
    or counted where there are filters) leave all days out but those that hold the page, and
    counts behind a few dozen sampled rows narrow these until the rest is a near page. Nothing
    is written. Of another frame the matches are sorted into ranges once and the rows are taken
    at their positions; no task holds more than its range.
    """
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must lie between 1 and {max_limit}, not {limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    columns = [time, *ties]
    order = newest(columns)
    unfiltered = after is None and all(value is None for _, _, value in filters)
    total = counted(df, "total_count") if unfiltered else counted(apply_filters(df, filters), "total_count")
    stored = isinstance(df, StoredTable)
    if after is not None:
        rows = apply_filters(df.not_after(time, after[0]) if stored else df, filters)
        rows = rows.filter(_behind(columns, after))
    elif stored and unfiltered and offset + limit <= near_rows:
        rows = df.newest(time, offset + limit)
    elif stored and df.is_dated_by(time) and offset + limit > near_rows:
        rows, offset = _days_of_page(df, filters, offset, limit)
    else:
        rows = apply_filters(df, filters)
    if stored and offset + limit > near_rows:
        rows, offset = _narrowed(rows, columns, offset, limit, near_rows)
    if offset + limit <= near_rows:
        return Page(rows.orderBy(*order).offset(offset).limit(limit), total)
    ranked = positioned(rows, order, "_position")
    page = ranked.filter(F.col("_position").between(offset, offset + limit - 1)).orderBy("_position")
    return Page(page.drop("_position"), total)


def _days_of_page(table: StoredTable, filters: Sequence[Filter], offset: int, limit: int) -> tuple[DataFrame, int]:
    """The matches of the days that hold a page, and the page's offset among them."""
    if all(value is None for _, _, value in filters):
        counts = {None if day == "null" else dt.date.fromisoformat(day): n for day, n in table.rows_by_day().items()}
    else:
        by_day = apply_filters(table.rows, filters).groupBy("event_date").agg(F.count("*").alias("n"))
        counts = {r.event_date: r.n for r in by_day.collect()}
    days, before, skipped = [], 0, 0
    for day in sorted(counts, key=lambda d: (d is not None, d or dt.date.min), reverse=True):
        if before + counts[day] <= offset:
            skipped = before + counts[day]
        elif before < offset + limit:
            days.append(day)
        before += counts[day]
    return apply_filters(table.of_days([day or "null" for day in days]), filters), offset - skipped


#: Rows sampled to narrow a page's surroundings, and the most rounds of that.
SPLITTERS, ROUNDS = 48, 6


def _narrowed(rows: DataFrame, columns: Sequence[str], offset: int, limit: int, near_rows: int) -> tuple[DataFrame, int]:
    """Rows around a page and the page's offset among them, near where the sort values allow it."""
    for _ in range(ROUNDS):
        if offset + limit <= near_rows:
            break
        sampled = rows.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SPLITTERS).collect()
        if not sampled:
            return rows, 0
        behind = [_behind(columns, row) for row in sampled]
        # How many rows come before the end of each sampled row's equals.
        upto = rows.agg(*[F.count_if(~b).alias(f"n{i}") for i, b in enumerate(behind)]).first()
        first = max((i for i in range(len(behind)) if upto[i] <= offset), key=lambda i: upto[i], default=None)
        last = min((i for i in range(len(behind)) if upto[i] >= offset + limit), key=lambda i: upto[i], default=None)
        if first is None and (last is None or upto[last] == max(upto)):
            break
        if first is not None:
            rows, offset = rows.filter(behind[first]), offset - upto[first]
        if last is not None:
            rows = rows.filter(~behind[last])
    return rows, offset


def _behind(columns: Sequence[str], values: Sequence[object]) -> Column:
    """Rows that come after the given sort values when all columns descend with NULL last."""
    behind = F.lit(False)
    for column, value in reversed(list(zip(columns, values, strict=True))):
        if value is None:
            behind = F.col(column).isNull() & behind
        else:
            smaller = F.coalesce(F.col(column) < F.lit(value), F.lit(True))
            behind = smaller | ((F.col(column) == F.lit(value)) & behind)
    return F.coalesce(behind, F.lit(False))


def list_quakes(
    quakes: Table, min_magnitude: float | None = None, risk_category: str | None = None,
    limit: int = 50, offset: int = 0, after: Sequence[object] | None = None,
) -> Page:
    filters = [("magnitude", ">=", min_magnitude), ("risk_category", "=", risk_category)]
    return paginate(quakes, filters, "event_time", ["event_id"], limit, offset, after=after)


def list_weather(
    weather: Table, location: str | None = None, min_wind: float | None = None,
    storm_severity: str | None = None, limit: int = 50, offset: int = 0, after: Sequence[object] | None = None,
) -> Page:
    filters = [
        ("location_name", "=", location),
        ("wind_speed_kmh", ">=", min_wind),
        ("storm_severity", "=", storm_severity),
    ]
    return paginate(weather, filters, "observed_at", ["location_name"], limit, offset, after=after)


def list_air_quality(
    air: Table, location: str | None = None, min_aqi: int | None = None,
    aqi_category: str | None = None, limit: int = 50, offset: int = 0, after: Sequence[object] | None = None,
) -> Page:
    filters = [
        ("location_name", "=", location),
        ("us_aqi", ">=", min_aqi),
        ("aqi_category", "=", aqi_category),
    ]
    return paginate(air, filters, "observed_at", ["location_name"], limit, offset, after=after)


def list_wildfires(
    fires: Table, severity: str | None = None, min_frp: float | None = None,
    limit: int = 50, offset: int = 0, after: Sequence[object] | None = None,
) -> Page:
    """The severity filter is an equality."""
    filters = [("fire_severity", "=", severity), ("frp", ">=", min_frp)]
    return paginate(fires, filters, "acq_date", ["acq_time", "latitude", "longitude"], limit, offset, after=after)


def list_anomalies(
    anomalies: Table, source: str | None = None, severity: str | None = None,
    event_type: str | None = None, limit: int = 50, offset: int = 0, after: Sequence[object] | None = None,
) -> Page:
    filters = [
        ("source", "=", source),
        ("severity", "=", severity),
        ("event_type", "=", event_type),
    ]
    ties = ["source", "event_time", "latitude", "longitude", "description"]
    return paginate(anomalies, filters, "detected_at", ties, limit, offset, after=after)
