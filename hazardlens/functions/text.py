"""Tolerant parsing of raw text columns, by column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens.constants import NULL_TEXT_ANY_CASE, NULL_TEXT_EXACT


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def null_if_missing(column: str) -> Column:
    """NULL for the texts that stand for a missing value; no trimming."""
    missing = f"{column} IN ({_listed(NULL_TEXT_EXACT)}) OR lower({column}) IN ({_listed(NULL_TEXT_ANY_CASE)})"
    return F.expr(f"CASE WHEN {missing} THEN NULL ELSE {column} END")


def parse_timestamp(text: Column) -> Column:
    """ISO text (offset, seconds and ``T`` optional) to a timestamp, else NULL.

    The engine's own text-to-timestamp conversion accepts every layout the feeds
    use, so a single non-throwing attempt replaces a chain of explicit patterns.
    """
    return F.try_to_timestamp(text)


def parse_date(column: str) -> Column:
    """``yyyy-MM-dd`` text to a date, else NULL."""
    return F.expr(f"CAST(try_to_timestamp({column}, 'yyyy-MM-dd') AS DATE)")


def try_double(column: str) -> Column:
    return F.expr(f"try_cast({column} AS DOUBLE)")
