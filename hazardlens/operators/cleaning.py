"""Record validation and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.functions import geo, text
from hazardlens.operators.common import first_per_key, newest_sql


def clean_string_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text.null_if_missing(c) for c in names if c in df.columns})


def normalize_timestamp(df: DataFrame, name: str) -> DataFrame:
    """Parse a text column to a timestamp; an already typed column is kept."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    return df.withColumn(name, text.parse_timestamp(F.col(name)))


def normalize_date(df: DataFrame, name: str) -> DataFrame:
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df
    return df.withColumn(name, text.parse_date(name))


def validate_coordinates(df: DataFrame) -> DataFrame:
    return df.filter(geo.in_range())


def require_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names))


def fill_defaults(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Replace NULL (not NaN) by the given values."""
    return df.withColumns({c: F.expr(f"coalesce({c}, {v}D)") for c, v in defaults.items()}) if defaults else df


def deduplicate(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """One row per natural key: the newest, then a total order on the rest.

    NULL parts of a key count as equal.
    """
    rest = [c for c in df.columns if c not in keys and c != time]
    order = newest_sql(([] if time in keys else [time]) + rest)
    return first_per_key(df, keys, order)


def skip_existing(incoming: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose natural key is not in the target yet, NULL-safe on every part.

    One anti join; adaptive execution picks the strategy from the sizes it meets.
    """
    known = target.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    same: list[Column] = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    return incoming.join(known, same, "left_anti")
