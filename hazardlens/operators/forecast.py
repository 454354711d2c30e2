"""Time series and additive trend-and-season forecasts for all series at once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import constants as C
from hazardlens.operators.common import AsOf, moment, recent, union_all
from hazardlens.sources.tables import StoredTable, Table

SERIES = ["metric", "source", "location_name"]


# Days that each series looks back.
HOURLY_DAYS, DAILY_DAYS = 30, 60


def _hourly_means(rows: DataFrame, measure: str) -> DataFrame:
    hour = F.date_trunc("hour", "observed_at").alias("ds")
    return rows.groupBy("location_name", hour).agg(F.avg(measure).alias("y"))


def _counts(rows: DataFrame, time: Column) -> DataFrame:
    return rows.groupBy(time.alias("ds")).agg(F.count("*").alias("y"))


def series_aqi_hourly(air: Table, as_of: AsOf = None) -> DataFrame:
    return _hourly_means(recent(air, "observed_at", as_of, days=HOURLY_DAYS), "us_aqi")


def series_temperature_hourly(weather: Table, as_of: AsOf = None) -> DataFrame:
    return _hourly_means(recent(weather, "observed_at", as_of, days=HOURLY_DAYS), "temperature_c")


def series_fire_daily(fires: Table, as_of: AsOf = None) -> DataFrame:
    return _counts(recent(fires, "acq_date", as_of, days=DAILY_DAYS), F.col("acq_date").cast("timestamp"))


def series_quake_hourly(quakes: Table, as_of: AsOf = None) -> DataFrame:
    return _counts(recent(quakes, "event_time", as_of, days=HOURLY_DAYS), F.date_trunc("hour", "event_time"))


def series_clean(series: DataFrame) -> DataFrame:
    """Timestamp and number where the raw values allow it; other points drop out."""
    as_time = F.col("ds").try_cast("timestamp")
    as_number = F.col("y").try_cast("double")
    typed = series.withColumns({"ds": as_time, "y": as_number})
    return typed.dropna(subset=["ds", "y"]).filter(~F.isnan("y"))


def _tagged(series: DataFrame, metric: str, source: str) -> DataFrame:
    location = F.col("location_name") if "location_name" in series.columns else F.lit(None).cast("string")
    return series_clean(series).select(
        F.lit(metric).alias("metric"), F.lit(source).alias("source"),
        location.alias("location_name"), "ds", "y",
    )


def all_series(processed: dict[str, Table], as_of: AsOf = None) -> DataFrame:
    """Every forecast series in one long table."""
    return union_all(
        [
            _tagged(series_aqi_hourly(processed["air_quality"], as_of), "us_aqi", "air_quality"),
            _tagged(series_temperature_hourly(processed["weather"], as_of), "temperature_c", "weather"),
            _tagged(series_fire_daily(processed["wildfires"], as_of), "fire_count", "wildfires"),
            _tagged(series_quake_hourly(processed["earthquakes"], as_of), "event_count", "earthquakes"),
        ]
    )


def changed_series(processed: dict[str, StoredTable], since: dt.datetime | None) -> DataFrame:
    """Every point of the days whose rows were written from ``since`` on, late ones included.

    Of the stored tables only the files of these days are opened, and those that were written
    since. Without ``since`` it is every point there is.
    """
    def rows(name: str) -> DataFrame:
        table = processed[name]
        if since is None:
            return table.rows
        written = table.not_before("processed_at", since).filter(F.col("processed_at") >= F.lit(since))
        return table.of_days([r.event_date for r in written.select("event_date").distinct().collect()])

    quakes, fires = rows("earthquakes"), rows("wildfires")
    return union_all(
        [
            _tagged(_hourly_means(rows("air_quality"), "us_aqi"), "us_aqi", "air_quality"),
            _tagged(_hourly_means(rows("weather"), "temperature_c"), "temperature_c", "weather"),
            _tagged(_counts(fires, F.col("acq_date").cast("timestamp")), "fire_count", "wildfires"),
            _tagged(_counts(quakes, F.date_trunc("hour", "event_time")), "event_count", "earthquakes"),
        ]
    )


def kept_series(points: Table, as_of: AsOf = None) -> DataFrame:
    """The series that ``all_series`` gives, from the points that are kept of them."""
    daily = F.col("metric") == "fire_count"
    start = moment(as_of) - F.make_dt_interval(F.when(daily, DAILY_DAYS).otherwise(HOURLY_DAYS))
    first = F.when(daily, F.to_date(start).cast("timestamp")).otherwise(start)
    return recent(points, "ds", as_of, days=DAILY_DAYS + 1).filter(F.col("ds") >= first).select(*SERIES, "ds", "y")


def series_long_enough(series: DataFrame, keys: Sequence[str] = SERIES, minimum: int = C.FORECAST_MIN_POINTS) -> DataFrame:
    """Points of the series that have at least ``minimum`` points."""
    long = series.groupBy(*keys).agg(F.count("*").alias("_points")).filter(F.col("_points") >= minimum)
    wanted = long.select(*[F.col(k).alias(f"_long_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_long_{k}")) for k in keys]
    return series.join(wanted, same, "left_semi")


def forecast_horizons(series: DataFrame, keys: Sequence[str] = SERIES, horizons: Sequence[tuple] = C.FORECAST_HORIZONS) -> DataFrame:
    """Future steps of every series: counted from its last point, history excluded."""
    last = series.groupBy(*keys).agg(F.max("ds").alias("last_ds"))
    return _future_steps(last, horizons).drop("last_ds")


def _future_steps(last: DataFrame, horizons: Sequence[tuple]) -> DataFrame:
    """Rows with ``last_ds`` exploded into horizon, step and forecast time."""
    plans = F.array(
        *[
            F.struct(F.lit(name).alias("horizon"), F.lit(steps).alias("_steps"), F.lit(unit).alias("_unit"))
            for name, steps, unit in horizons
        ]
    )
    hours = F.when(F.col("_unit") == "day", F.lit(24)).otherwise(F.lit(1)) * F.col("step")
    return (
        last.select("*", F.inline(plans))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_steps"))))
        .withColumn("forecast_time", F.col("last_ds") + F.make_dt_interval(F.lit(0), hours))
        .drop("_steps", "_unit")
    )


def _hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600.0


def _effect(effects: str, slot: Column) -> Column:
    """Seasonal effect of a slot; a slot without history has none."""
    return F.coalesce(F.try_element_at(F.col(effects), slot), F.lit(0.0))


#: Instant that hours are counted from while a trend is fitted.
_ORIGIN = "timestamp'2000-01-01 00:00:00'"


def fit_additive(series: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series: linear trend, hour-of-day and weekday effects, residual spread.

    Hash aggregates only. The points are read twice: for the trend, and for the residuals'
    count, sum and sum of squares per hour and weekday. The effects and the spread follow from
    these 168 cells at most. The weekday effect is used for series with more than
    ``FORECAST_WEEKLY_ABOVE_POINTS`` points.
    """
    t = _hours_between(F.col("ds"), F.expr(_ORIGIN))
    key_columns = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    null_flags = [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    joined = [f"_k{i}" for i in range(len(keys))] + [f"_n{i}" for i in range(len(keys))]
    points = series.select(*keys, *key_columns, *null_flags, "ds", "y", t.alias("_t"))
    trend = points.groupBy(*joined).agg(
        *[F.first(k).alias(k) for k in keys],
        F.count("*").alias("_points"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.min("_t").alias("_first"),
        F.avg("_t").alias("_mean_t"),
        F.avg("y").alias("_mean_y"),
        F.coalesce(F.regr_slope("y", "_t"), F.lit(0.0)).alias("slope"),
    ).filter(F.col("_points") >= C.FORECAST_MIN_POINTS)
    line = F.col("_mean_y") + F.col("slope") * (F.col("_t") - F.col("_mean_t"))
    cells = (
        points.select(*joined, "ds", "y", "_t")
        .join(trend.select(*joined, "slope", "_mean_y", "_mean_t"), joined)
        .select(*joined, F.hour("ds").alias("_hour"), F.dayofweek("ds").alias("_day"), (F.col("y") - line).alias("_r"))
        .groupBy(*joined, "_hour", "_day")
        .agg(F.count("*").alias("_n"), F.sum("_r").alias("_s"), F.sum(F.col("_r") * F.col("_r")).alias("_q"))
    )
    per_series = cells.groupBy(*joined).agg(F.collect_list(F.struct("_hour", "_day", "_n", "_s", "_q")).alias("_cells"))
    weekly = F.col("_points") > C.FORECAST_WEEKLY_ABOVE_POINTS

    def effects(slot: str, total: Callable[[Column], Column]) -> Column:
        """Mean of what ``total`` leaves of the cells' sums, per slot."""
        def of(s: Column) -> Column:
            mine = F.filter("_cells", lambda c: c[slot] == s)
            sums = F.aggregate(mine, F.lit(0.0), lambda a, c: a + total(c))
            counts = F.aggregate(mine, F.lit(0).cast("long"), lambda a, c: a + c["_n"])
            return F.struct(s.alias("slot"), (sums / counts).alias("effect"))

        slots = F.array_distinct(F.transform("_cells", lambda c: c[slot]))
        return F.map_from_entries(F.transform(slots, of))

    def effect_of(c: Column) -> Column:
        return F.element_at(F.col("hour_effects"), c["_hour"]) + F.element_at(F.col("day_effects"), c["_day"])

    none = F.transform_values("day_effects", lambda k, v: F.lit(0.0))
    fitted = (
        trend.join(per_series, joined)
        .withColumn("hour_effects", effects("_hour", lambda c: c["_s"]))
        .withColumn(
            "day_effects",
            effects("_day", lambda c: c["_s"] - c["_n"] * F.element_at(F.col("hour_effects"), c["_hour"])),
        )
        .withColumn("day_effects", F.when(weekly, F.col("day_effects")).otherwise(none))
    )
    squares = F.aggregate(
        "_cells", F.lit(0.0),
        lambda a, c: a + c["_q"] - 2 * effect_of(c) * c["_s"] + c["_n"] * effect_of(c) * effect_of(c),
    )
    left = F.aggregate("_cells", F.lit(0.0), lambda a, c: a + c["_s"] - c["_n"] * effect_of(c))
    variance = (squares - left * left / F.col("_points")) / (F.col("_points") - 1)
    return fitted.select(
        *keys, "first_ds", "last_ds", "slope",
        (F.col("_mean_y") + F.col("slope") * (F.col("_first") - F.col("_mean_t"))).alias("base"),
        "hour_effects", "day_effects",
        F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)).alias("spread"),
    )


def forecast_additive(
    series: DataFrame,
    as_of: AsOf = None,
    keys: Sequence[str] = SERIES,
    horizons: Sequence[tuple] = C.FORECAST_HORIZONS,
) -> DataFrame:
    """Value and 80 % interval for every future step of every series."""
    steps = _future_steps(fit_additive(series, keys), horizons)
    t = _hours_between(F.col("forecast_time"), F.col("first_ds"))
    value = (
        F.col("base")
        + F.col("slope") * t
        + _effect("hour_effects", F.hour("forecast_time"))
        + _effect("day_effects", F.dayofweek("forecast_time"))
    )
    margin = F.col("spread") * C.FORECAST_INTERVAL_Z
    return steps.select(
        *keys,
        "horizon",
        "forecast_time",
        F.round(value, 4).alias("predicted_value"),
        F.round(value - margin, 4).alias("lower_bound"),
        F.round(value + margin, 4).alias("upper_bound"),
        moment(as_of).cast("timestamp").alias("generated_at"),
    )


HORIZON_NAMES = [name for name, _, _ in C.FORECAST_HORIZONS]


def forecast_lookup(
    forecasts: DataFrame,
    metric: str | None = None,
    source: str | None = None,
    location: str | None = None,
    horizon: str = "24h",
) -> DataFrame:
    if horizon not in HORIZON_NAMES:
        raise ValueError(f"horizon must be one of {HORIZON_NAMES}, not {horizon}")
    wanted = {"horizon": horizon, "metric": metric, "source": source, "location_name": location}
    rows = forecasts
    for column, value in wanted.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.select(
        "metric", "source", "location_name", "horizon", "forecast_time", "predicted_value",
        "lower_bound", "upper_bound", "generated_at",
    ).orderBy("forecast_time", "metric", "source", "location_name")


def forecast_coverage(forecasts: DataFrame, horizon: str = "24h") -> DataFrame:
    """Stored points per metric and location; series without a location are global."""
    return (
        forecasts.filter(F.col("horizon") == horizon)
        .groupBy("metric", "source", F.coalesce("location_name", F.lit("Global")).alias("location"))
        .agg(F.count("*").alias("points"), F.max("generated_at").alias("generated_at"))
    )
