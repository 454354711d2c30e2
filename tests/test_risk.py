"""The radius join against brute force, and its strategies against each other."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import risk


def by_hand(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(a)))


REGIONS = [
    ("north pole", 90.0, 0.0), ("near south pole", -88.5, 77.0), ("date line east", 10.0, 179.9),
    ("date line west", -20.0, -179.9), ("corner", 0.0, 180.0), ("paris", 48.85, 2.35), ("high", 71.0, 25.0),
]


def make(spark, count=3000, hot=0):
    rng = random.Random(5)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(count)]
    rows += [(r[1] + rng.uniform(-3, 3), ((r[2] + rng.uniform(-5, 5) + 180) % 360) - 180) for r in REGIONS for _ in range(150)]
    rows = [(max(-90.0, min(90.0, a)), b) for a, b in rows]
    rows += [(48.9, 2.3)] * hot
    rows += [(90.0, -180.0), (-90.0, 180.0), (0.0, -180.0), (0.0, 180.0)]
    rows = [(i, a, b) for i, (a, b) in enumerate(rows)]
    events = spark.createDataFrame(rows + [(-1, None, 5.0), (-2, 5.0, None), (-3, 91.0, 0.0)], "id int, latitude double, longitude double")
    regions = spark.createDataFrame(REGIONS, "region_name string, region_lat double, region_lon double")
    return rows, events, regions


@pytest.mark.parametrize("radius", [50.0, 500.0, 3000.0, 25000.0])
def test_radius_join_equals_brute_force(spark, radius):
    rows, events, regions = make(spark)
    expected = {
        (name, i) for i, a, b in rows for name, lat, lon in REGIONS if by_hand(lat, lon, a, b) <= radius
    }
    pairs = risk.within_radius(events, regions, radius).select("region_name", "id").collect()
    assert len(pairs) == len(set(pairs))
    assert {tuple(p) for p in pairs} == expected


def test_both_strategies_agree_on_a_hot_cell(spark):
    """A third of all events in one place; a merge join gives the broadcast's pairs."""
    _, events, regions = make(spark, hot=2000)
    key = ["region_name", "id"]
    small = sorted(risk.within_radius(events, regions, 500.0).select(*key).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = risk.within_radius(events, regions, 500.0)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert small == sorted(large.select(*key).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grid_size_does_not_change_the_result(spark):
    _, events, regions = make(spark)
    counts = {
        degrees: risk.within_radius(events, regions, 500.0, degrees).count() for degrees in (0.5, 1.0, 5.0, 90.0)
    }
    assert len(set(counts.values())) == 1


def score_inputs(spark):
    regions = spark.createDataFrame([("A", 0.0, 0.0), ("B", 50.0, 50.0)], "region_name string, region_lat double, region_lon double")
    return regions, F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_fire_crowding(spark):
    """Up to three detections count by the worst one; more add two points each."""
    regions, as_of = score_inputs(spark)
    def fires(n, frp=5.0):
        rows = [(0.1 * i, 0.0, frp, "Low") for i in range(n)]
        df = spark.createDataFrame(rows, "latitude double, longitude double, frp double, fire_severity string")
        return df.withColumn("acq_date", F.lit("2024-01-30").cast("date"))

    def score(n, frp=5.0):
        return {r.region_name: r.wildfire_score for r in risk.fire_score(fires(n, frp), regions, as_of).collect()}

    assert score(3) == {"A": 16.0, "B": 0.0}
    assert score(4) == {"A": 24.0, "B": 0.0}
    assert score(60) == {"A": 100.0, "B": 0.0}
    assert score(1, 1e6)["A"] == 35.0


def test_quake_boost_and_unlisted_label(spark):
    regions, as_of = score_inputs(spark)
    rows = [(0.0, 0.0, None, "Odd"), (50.0, 50.0, 9.0, "Critical")]
    quakes = spark.createDataFrame(rows, "latitude double, longitude double, magnitude double, risk_category string")
    quakes = quakes.withColumn("event_time", as_of)
    scores = {r.region_name: r.earthquake_score for r in risk.quake_score(quakes, regions, as_of).collect()}
    assert scores == {"A": 10.0, "B": 100.0}


def test_latest_observation_has_no_age_limit(spark, tmp_path):
    """A place last seen long ago is scored from the older folders of a stored table."""
    from hazardlens.sinks.tables import write_batch
    from hazardlens.sources.tables import scan_table

    rows = [
        ("A", "2024-01-30 10:00:00", "Severe"), ("A", "2024-01-30 11:00:00", "Minor"),
        ("B", "2023-02-01 00:00:00", "Extreme"), ("B", "2023-01-01 00:00:00", "None"),
    ]
    df = spark.createDataFrame(rows, "location_name string, observed_at string, storm_severity string").withColumns(
        {"observed_at": F.to_timestamp("observed_at"), "wind_severity": F.lit("Calm"),
         "precipitation_mm": F.lit(0.0), "event_date": F.to_date("observed_at")}
    )
    write_batch(df, str(tmp_path), "weather_processed", 0, partition_by=["event_date"])
    regions, _ = score_inputs(spark)
    for table in (df.drop("event_date"), scan_table(spark, str(tmp_path), "weather_processed")):
        scores = {r.region_name: r.weather_score for r in risk.weather_score(table, regions).collect()}
        assert scores == {"A": 20.0, "B": 100.0}
        late = risk.weather_score(table, regions, dt.date(2024, 1, 1)).collect()
        assert {r.region_name: r.weather_score for r in late} == {"A": 20.0, "B": 0.0}
