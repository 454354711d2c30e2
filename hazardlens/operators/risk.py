"""Regional risk: radius join, per-hazard scores and the unified score."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import constants as C
from hazardlens.functions import geo, rules
from hazardlens.operators.common import AsOf, moment, recent, small_table
from hazardlens.sources.tables import Table

_KM_PER_DEGREE = math.pi * C.EARTH_RADIUS_KM / 180.0


def monitored_regions(spark: SparkSession) -> DataFrame:
    return small_table(spark, C.MONITORED_LOCATIONS, "region_name, region_lat, region_lon")


#: Sides of grid cells in degrees; all divide the circle of longitudes.
CELL_SIDES = (1.0, 2.0, 3.0, 5.0, 10.0, 15.0, 30.0, 45.0, 90.0)
#: Most cells that a radius spans. A circle's box has at most ``2 * SPAN + 1`` rows of cells, so a
#: region lists no more cells for a radius of thousands of km than for one of hundreds.
SPAN = 8


def cell_side(radius_km: float) -> float:
    """The smallest side of which a radius spans at most ``SPAN``."""
    return next((side for side in CELL_SIDES if radius_km / _KM_PER_DEGREE <= SPAN * side), CELL_SIDES[-1])


def region_cells(regions: DataFrame, radius_km: float, cell_degrees: float | None = None) -> DataFrame:
    """Regions exploded into the grid cells their search circle can touch.

    The circle's bounding box spans ``dlat`` degrees each way and, measured at the
    latitude nearest a pole, ``dlon``; once the box reaches a pole every column of
    the grid belongs to it. Columns wrap at the antimeridian.
    """
    cell_degrees = cell_degrees or cell_side(radius_km)
    columns = int(360 / cell_degrees)
    dlat = radius_km / _KM_PER_DEGREE
    farthest = f"abs(region_lat) + {dlat!r}D"
    dlon = (
        f"CASE WHEN {farthest} >= 90D THEN 180D"
        f" ELSE least(180D, {dlat!r}D / cos(radians({farthest}))) END"
    )
    spans = regions.filter(geo.in_range("region_lat", "region_lon")).selectExpr(
        "*",
        f"floor((region_lon - {dlon} + 180D) / {cell_degrees!r}D) AS _west",
        f"floor((region_lon + {dlon} + 180D) / {cell_degrees!r}D) AS _east",
        f"CAST(floor(greatest(region_lat - {dlat!r}D, -90D) / {cell_degrees!r}D) AS INT) AS _south",
        f"CAST(floor(least(region_lat + {dlat!r}D, 90D) / {cell_degrees!r}D) AS INT) AS _north",
    )
    # A box as wide as the grid lists each column once.
    east = f"least(_east, _west + {columns - 1})"
    return (
        spans.selectExpr("*", "explode(sequence(_south, _north)) AS cell_y")
        .selectExpr(*regions.columns, "cell_y", f"explode(sequence(_west, {east})) AS _x")
        .selectExpr(*regions.columns, "cell_y", f"CAST(pmod(_x, {columns}) AS INT) AS cell_x")
    )


def near_regions(
    events: DataFrame, cells: DataFrame, radius_km: float, cell_degrees: float | None = None
) -> DataFrame:
    """Events of a cell paired with the regions of that cell, kept if close enough."""
    cell_degrees = cell_degrees or cell_side(radius_km)
    located = events.filter(geo.in_range()).withColumns(
        {
            "cell_y": geo.cell_y("latitude", cell_degrees),
            "cell_x": geo.cell_x("longitude", cell_degrees),
        }
    )
    distance = geo.haversine_km("region_lat", "region_lon", "latitude", "longitude")
    return (
        located.join(cells, ["cell_y", "cell_x"])
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= radius_km)
        .drop("cell_y", "cell_x")
    )


def within_radius(
    events: DataFrame,
    regions: DataFrame,
    radius_km: float = C.RISK_RADIUS_KM,
    cell_degrees: float | None = None,
) -> DataFrame:
    """Events paired with every region whose centre is at most ``radius_km`` away.

    An equi-join on grid cells finds the candidates, the exact distance decides. There is
    no hint: adaptive execution picks the join and splits cells that hold too many events.
    """
    return near_regions(events, region_cells(regions, radius_km, cell_degrees), radius_km, cell_degrees)


def _capped(score: str) -> Column:
    return F.expr(f"least(greatest({score}, 0D), 100D)")


def _for_all_regions(regions: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    return (
        regions.select("region_name")
        .join(scores, "region_name", "left")
        .select("region_name", F.coalesce(name, F.lit(0.0)).alias(name))
    )


def _quake_peaks(
    quakes: DataFrame, cells: DataFrame, as_of: AsOf, lookback_hours: int, radius_km: float
) -> DataFrame:
    boost = F.expr("least(coalesce(magnitude, 0D) * 5, 25D)")
    scored = recent(quakes, "event_time", as_of, hours=lookback_hours).select(
        "latitude", "longitude",
        (rules.risk_weight("risk_category", "earthquakes") + boost).alias("_points"),
    )
    return (
        near_regions(scored, cells, radius_km)
        .groupBy("region_name")
        .agg(_capped("max(_points)").alias("earthquake_score"))
    )


def quake_score(
    quakes: DataFrame, regions: DataFrame, as_of: AsOf = None,
    lookback_hours: int = C.RISK_LOOKBACK_HOURS, radius_km: float = C.RISK_RADIUS_KM,
) -> DataFrame:
    """Worst quake near each region: weight of its category plus a magnitude boost."""
    peaks = _quake_peaks(quakes, region_cells(regions, radius_km), as_of, lookback_hours, radius_km)
    return _for_all_regions(regions, peaks, "earthquake_score")


def _fire_peaks(
    fires: DataFrame, cells: DataFrame, as_of: AsOf, lookback_hours: int, radius_km: float
) -> DataFrame:
    days = max(lookback_hours // 24, 1)
    boost = F.expr("least(coalesce(frp, 0D) / 5, 20D)")
    scored = recent(fires, "acq_date", as_of, days=days).select(
        "latitude", "longitude",
        (rules.risk_weight("fire_severity", "wildfires") + boost).alias("_points"),
    )
    # Two points per detection once there are more than three.
    crowded = "greatest(max(_points), 0D) + CASE WHEN count(*) > 3 THEN 2 * count(*) ELSE 0 END"
    return (
        near_regions(scored, cells, radius_km)
        .groupBy("region_name")
        .agg(_capped(crowded).alias("wildfire_score"))
    )


def fire_score(
    fires: DataFrame, regions: DataFrame, as_of: AsOf = None,
    lookback_hours: int = C.RISK_LOOKBACK_HOURS, radius_km: float = C.RISK_RADIUS_KM,
) -> DataFrame:
    """Worst fire near each region, raised by two per detection when there are over three."""
    peaks = _fire_peaks(fires, region_cells(regions, radius_km), as_of, lookback_hours, radius_km)
    return _for_all_regions(regions, peaks, "wildfire_score")


def _latest_points(df: DataFrame, regions: DataFrame, points: Column, name: str, since: dt.date | None) -> DataFrame:
    """Points of the newest observation at each region's location.

    Rows are scored before they are grouped: time and points are both fixed-width,
    so ``max_by`` runs as a hash aggregate with a map-side combine and the table is
    neither sorted nor shuffled whole. (location, time) is unique in these tables.

    There is no limit on how old the newest observation may be unless the caller knows
    one: ``since`` leaves older folders of a stored table unread. The table of newest
    observations that is kept beside the history has no history to read.
    """
    if since is not None:
        df = df.filter(F.col("event_date" if "event_date" in df.columns else "observed_at") >= F.lit(since))
    return (
        df.select(F.col("location_name").alias("region_name"), "observed_at", points.alias("_points"))
        .join(regions.select("region_name"), "region_name", "left_semi")
        .groupBy("region_name")
        .agg(_capped("max_by(_points, observed_at)").alias(name))
    )


def _weather_latest(weather: DataFrame, regions: DataFrame, since: dt.date | None) -> DataFrame:
    # Floors set by hurricane wind, gale wind and heavy rain.
    wind_floor = F.expr("CASE wind_severity WHEN 'Hurricane' THEN 90D WHEN 'Gale' THEN 60D END")
    rain_floor = F.expr("CASE WHEN precipitation_mm >= 50 THEN 85D END")
    points = F.greatest(rules.risk_weight("storm_severity", "weather"), wind_floor, rain_floor)
    return _latest_points(weather, regions, points, "weather_score", since)


def weather_score(weather: DataFrame, regions: DataFrame, since: dt.date | None = None) -> DataFrame:
    return _for_all_regions(regions, _weather_latest(weather, regions, since), "weather_score")


def _air_latest(air: DataFrame, regions: DataFrame, since: dt.date | None) -> DataFrame:
    # Floor for an index above 300.
    floor = F.expr("CASE WHEN us_aqi > 300 THEN 95D END")
    points = F.greatest(rules.risk_weight("aqi_category", "air_quality"), floor)
    return _latest_points(air, regions, points, "air_quality_score", since)


def air_quality_score(air: DataFrame, regions: DataFrame, since: dt.date | None = None) -> DataFrame:
    return _for_all_regions(regions, _air_latest(air, regions, since), "air_quality_score")


def unified_risk(
    processed: dict[str, Table],
    regions: DataFrame,
    as_of: AsOf = None,
    lookback_hours: int = C.RISK_LOOKBACK_HOURS,
    radius_km: float = C.RISK_RADIUS_KM,
    since: dt.date | None = None,
    latest: dict[str, Table] | None = None,
) -> DataFrame:
    """One scored row per region; the level follows the unrounded unified score.

    Weather and air quality count with their newest observation: the one of ``latest``, the tables
    kept of them (``weather_latest``, ``air_quality_latest``), or searched from ``since`` on.
    """
    newest = processed if latest is None else latest
    cells = region_cells(regions, radius_km)
    parts = [
        _quake_peaks(processed["earthquakes"], cells, as_of, lookback_hours, radius_km),
        _fire_peaks(processed["wildfires"], cells, as_of, lookback_hours, radius_km),
        _weather_latest(newest["weather"], regions, since),
        _air_latest(newest["air_quality"], regions, since),
    ]
    joined = regions
    for part in parts:
        joined = joined.join(part, "region_name", "left")
    scored = joined.fillna(0.0, subset=list(C.RISK_SHARES))
    unified = F.expr(" + ".join(f"{name} * {share!r}D" for name, share in C.RISK_SHARES.items()))
    return scored.withColumn("_unified", unified).select(
        "region_name",
        F.col("region_lat").alias("latitude"),
        F.col("region_lon").alias("longitude"),
        *[F.round(name, 2).alias(name) for name in C.RISK_SHARES],
        F.round("_unified", 2).alias("unified_score"),
        rules.risk_level("_unified").alias("risk_level"),
        moment(as_of).alias("computed_at"),
    )
