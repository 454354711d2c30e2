"""Cleaning, quality, paging, alerts, forecasts, sinks and exports on small frames."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import access, alerts, cleaning, dashboard, forecast, hazards, quality
from hazardlens.operators.feeds import EARTHQUAKES, WILDFIRES
from hazardlens.sinks import exports, tables as sinks
from hazardlens.sources.tables import scan_table

AS_OF = dt.datetime(2024, 1, 31)


def test_dedup_keeps_newest_and_treats_null_keys_as_equal(spark):
    rows = [
        (1.0, 2.0, "2024-01-01", None, 5.0), (1.0, 2.0, "2024-01-01", None, 7.0), (1.0, 2.0, "2024-01-01", "0100", 1.0),
        (1.0, 2.0, "2024-01-02", None, 5.0),
    ]
    df = spark.createDataFrame(rows, "latitude double, longitude double, acq_date string, acq_time string, frp double")
    out = cleaning.deduplicate(df, WILDFIRES.key, "acq_date").collect()
    assert sorted((r.acq_date, r.acq_time or "", r.frp) for r in out) == [
        ("2024-01-01", "", 7.0), ("2024-01-01", "0100", 1.0), ("2024-01-02", "", 5.0),
    ]


def test_dedup_does_not_depend_on_the_partitioning(spark):
    rng = random.Random(1)
    rows = [(f"eq{rng.randrange(40)}", rng.randrange(3), rng.random()) for _ in range(3000)]
    # One key holds a third of all rows.
    rows += [("hot", rng.randrange(3), rng.random()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "event_id string, event_time int, magnitude double")
    results = [
        sorted(map(tuple, cleaning.deduplicate(d, ["event_id"], "event_time").collect()))
        for d in (df.repartition(1), df.repartition(13), df.repartition(5, "magnitude"))
    ]
    assert results[0] == results[1] == results[2] and len(results[0]) == 41
    best = max((t, m) for k, t, m in rows if k == "hot")
    assert ("hot", *best) in results[0]


def test_skip_existing_is_null_safe(spark):
    schema = "latitude double, longitude double, acq_date string, acq_time string"
    incoming = spark.createDataFrame([(1.0, 1.0, "d", None), (1.0, 1.0, "d", "0100"), (2.0, 1.0, "d", None)], schema)
    target = spark.createDataFrame([(1.0, 1.0, "d", None), (2.0, 1.0, "d", "0200")], schema)
    left = cleaning.skip_existing(incoming, target, WILDFIRES.key)
    assert sorted((r.latitude, r.acq_time or "") for r in left.collect()) == [(1.0, "0100"), (2.0, "")]


def test_fill_defaults_keeps_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,)], "magnitude double")
    out = [r.magnitude for r in cleaning.fill_defaults(df, {"magnitude": 0.0}).collect()]
    assert out[0] == 0.0 and out[1] != out[1] and out[2] == 2.0


def funnel(spark, total, parsed, in_range, unique):
    rows = []
    for n in range(total):
        key = min(n, unique - 1) if n < in_range else n
        rows.append((f"eq{key}", n < parsed, n < in_range))
    df = spark.createDataFrame(rows, "event_id string, _parsed boolean, _in_range boolean").withColumn("batch_id", F.lit(1))
    return quality.quality_funnel(df, EARTHQUAKES).first()


def test_quality_funnel_counts(spark):
    r = funnel(spark, 100, 95, 90, 85)
    assert (r.total_records, r.valid_records, r.malformed_records, r.missing_fields) == (100, 85, 5, 5)
    assert (r.validation_errors, r.duplicates, r.dropped_events) == (5, 5, 15)
    r = funnel(spark, 50, 50, 50, 50)
    assert (r.valid_records, r.malformed_records, r.validation_errors, r.duplicates, r.dropped_events) == (50, 0, 0, 0, 0)
    r = funnel(spark, 100, 0, 0, 1)
    assert (r.valid_records, r.malformed_records, r.dropped_events) == (0, 100, 100)


def test_throughput_of_an_instant_batch(spark):
    df = spark.createDataFrame([("s", 1, 10, 0.0, 1.0), ("s", 2, 30, 1500.0, 1.0)],
                               "source string, batch_id long, records_count long, processing_time_ms double, db_write_latency_ms double")
    assert [r.records_per_minute for r in quality.pipeline_throughput(df).orderBy("batch_id").collect()] == [0.0, 1200.0]


def test_source_activity_lists_silent_sources(spark):
    rows = [("a", "success", 1, 5.0, 1), ("a", "error", 2, 0.0, 2), ("x", "success", 1, 1.0, 3)]
    logs = spark.createDataFrame(rows, "source string, status string, records_count int, latency_ms double, created_at int")
    out = {r.source: r for r in quality.source_activity(logs, ["a", "b"]).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"].status, out["a"].records_count, out["a"].latency_ms) == ("error", 2, None)
    assert (out["b"].status, out["b"].last_run) == ("no_data", None)


# --- paging -----------------------------------------------------------------

def timed_rows(spark, count=4000):
    rng = random.Random(3)
    start = dt.datetime(2023, 11, 5)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(90 * 86400)), rng.random()) for i in range(count)]
    # A third of all rows in the same second, and some without a time.
    rows += [(count + i, start + dt.timedelta(days=40), rng.random()) for i in range(count // 2)]
    rows += [(-1 - i, None, rng.random()) for i in range(50)]
    return rows, spark.createDataFrame(rows, "event_id int, event_time timestamp, magnitude double")


@pytest.mark.parametrize("near_rows", [5_000, 60])
@pytest.mark.parametrize("offset", [0, 49, 1000, 2333, 5990, 6040, 7000])
def test_pages_equal_slices_of_the_sorted_rows(spark, near_rows, offset):
    rows, df = timed_rows(spark)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]), reverse=True)
    page = access.paginate(df, [], "event_time", ["event_id"], 50, offset, near_rows=near_rows)
    assert [r.event_id for r in page.rows.collect()] == [r[0] for r in ordered[offset:offset + 50]]
    assert page.total.first().total_count == len(rows)


def test_pages_after_a_row_continue_there(spark):
    rows, df = timed_rows(spark, 300)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]), reverse=True)
    got, after = [], None
    while True:
        page = access.paginate(df, [], "event_time", ["event_id"], 120, after=after).rows.collect()
        if not page:
            break
        got += [r.event_id for r in page]
        after = [page[-1].event_time, page[-1].event_id]
    assert got == [r[0] for r in ordered]


def test_deep_pages_hold_no_long_top_k(spark):
    same_time = spark.range(20_000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS event_time")
    page = access.paginate(same_time, [], "event_time", ["event_id"], 50, 15_000).rows
    assert "TakeOrderedAndProject(limit=15050" not in page._jdf.queryExecution().executedPlan().toString()
    assert [r.event_id for r in page.collect()] == list(range(4999, 4949, -1))


def test_regions_of_equal_score_rank_in_several_tasks(spark):
    import hazardlens.operators.dashboard as dashboard
    from hazardlens.operators import common

    n = 200_000
    scores = spark.range(0, n, 1, 8).selectExpr(
        "concat('r', lpad(id, 7, '0')) AS region_name", "0D AS latitude", "0D AS longitude", "0D AS earthquake_score",
        "0D AS wildfire_score", "0D AS weather_score", "0D AS air_quality_score", "0D AS unified_score",
        "'Low' AS risk_level", "timestamp'2024-01-01' AS computed_at",
    )
    order = [F.col("unified_score").desc(), F.col("region_name")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few MB would share one task
    try:
        placed = common.positioned(dashboard.latest_risk_scores(scores), order, "position")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.filter("region_name = 'r0123456'").first().position == 123_456
    files = spark.read.parquet(*placed.inputFiles()).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 3 and max(r["count"] for r in files) < n / 2
    ranked = dashboard.regional_rankings(scores).filter("rank in (1, 200000)").collect()
    assert sorted((r["rank"], r.region_name) for r in ranked) == [(1, "r0000000"), (n, "r0199999")]


def test_filters_without_a_value_are_skipped(spark):
    rows, df = timed_rows(spark, 100)
    filters = [("magnitude", ">=", 0.5), ("event_id", "=", None)]
    assert access.apply_filters(df, filters).count() == sum(r[2] >= 0.5 for r in rows)


@pytest.mark.parametrize("limit", [0, 501])
def test_page_size_bounds(spark, limit):
    with pytest.raises(ValueError):
        access.paginate(spark.range(1), [], "id", [], limit)


def test_bounds_of_other_queries(spark):
    with pytest.raises(ValueError):
        alerts.active_alerts(spark.range(1), 201)
    with pytest.raises(ValueError):
        dashboard.events_per_hour({}, AS_OF, 169)
    with pytest.raises(ValueError):
        forecast.forecast_lookup(spark.range(1), horizon="1y")
    with pytest.raises(ValueError):
        exports.export_rows(spark.range(1), "volcanoes")


# --- dashboard --------------------------------------------------------------

def scores(spark):
    rows = [
        ("A", 50.0, "High", 1), ("A", 80.0, "Critical", 2), ("B", 80.0, "Critical", 2), ("C", 10.0, "Low", 1),
        ("D", 90.0, "Critical", 1), ("E", 10.0, "Low", 5),
    ]
    df = spark.createDataFrame(rows, "region_name string, unified_score double, risk_level string, computed_at int")
    return df.withColumns({c: F.lit(1.0) for c in ["earthquake_score", "wildfire_score", "weather_score", "air_quality_score"]})


def test_rankings_number_ties_by_name(spark):
    ranked = dashboard.regional_rankings(scores(spark)).collect()
    assert [(r["rank"], r.region_name) for r in ranked] == [(1, "D"), (2, "A"), (3, "B"), (4, "C"), (5, "E")]


def test_every_risk_level_is_listed(spark):
    counts = {r.risk_level: r.regions for r in dashboard.risk_level_distribution(scores(spark)).collect()}
    assert counts == {"Low": 2, "Moderate": 0, "High": 0, "Critical": 3}


def test_locations_without_readings_lead_the_comparison(spark):
    rows = [("A", 10), ("A", 21), ("B", None), ("C", 30)]
    df = spark.createDataFrame(rows, "location_name string, us_aqi int").withColumn("observed_at", F.lit(AS_OF))
    out = [(r.location_name, r.avg_aqi, r.max_aqi) for r in hazards.aq_regional_comparison(df, AS_OF).collect()]
    assert out == [("B", 0.0, None), ("C", 30.0, 30), ("A", 15.5, 21)]


# --- alerts -----------------------------------------------------------------

def quakes(spark, *rows):
    df = spark.createDataFrame(rows, "event_id string, magnitude double, place string, event_time timestamp")
    return df.withColumns({"latitude": F.lit(1.5), "longitude": F.lit(2.5), "risk_category": F.lit("High")})


def test_default_lookback_and_texts(spark):
    df = quakes(spark, ("a", 7.0, "Tokyo", AS_OF - dt.timedelta(minutes=59)), ("b", 6.5, None, AS_OF),
                ("c", 9.0, "old", AS_OF - dt.timedelta(minutes=61)), ("d", 5.9, "weak", AS_OF))
    out = {r.title: r for r in alerts.raise_alerts(df, alerts.MAJOR_EARTHQUAKE, None, AS_OF).collect()}
    assert set(out) == {"M7.0 Earthquake — Tokyo", "M6.5 Earthquake — None"}
    first = out["M7.0 Earthquake — Tokyo"]
    assert first.severity == "Critical" and first.region_name is None and first.is_active
    assert first.description == "Magnitude 7.0 earthquake detected at Tokyo. Risk category: High."
    assert json.loads(first.metadata) == {"event_id": "a", "magnitude": 7.0}


def test_cooldown_window_and_keyless_alerts(spark):
    df = quakes(spark, ("a", 7.0, "x", AS_OF), ("b", 7.0, "x", AS_OF), ("c", 7.0, "x", AS_OF))
    rule = alerts.MAJOR_EARTHQUAKE
    past = [
        ("major_earthquake", "a", AS_OF - dt.timedelta(hours=24)),
        ("major_earthquake", "b", AS_OF - dt.timedelta(hours=24, minutes=1)),
        ("major_earthquake", None, AS_OF),
        ("extreme_aqi", "c", AS_OF),
    ]
    log = spark.createDataFrame(past, "alert_type string, record_key string, created_at timestamp")
    left = alerts.raise_alerts(df, rule, log, AS_OF)
    assert {json.loads(r.metadata)["event_id"] for r in left.collect()} == {"b", "c"}


def test_wildfire_megawatts_round_half_to_even(spark):
    rows = [(1.0, 2.0, frp, dt.date(2024, 1, 30), None) for frp in (202.5, 203.5, 500.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, frp double, acq_date date, acq_time string")
    df = df.withColumns({"fire_severity": F.lit("Extreme"), "detection_confidence": F.lit("High")})
    out = alerts.raise_alerts(df, alerts.MAJOR_WILDFIRE, None, AS_OF).orderBy("title").collect()
    assert [r.title for r in out] == [f"Major Wildfire — FRP {n} MW" for n in (202, 204, 500)]
    assert [r.severity for r in out] == ["High", "High", "Critical"]
    assert "(1.00, 2.00). FRP: 202.5 MW" in out[0].description


# --- forecasts --------------------------------------------------------------

def hourly(spark, points, f):
    start = dt.datetime(2024, 1, 1)
    rows = [("m", "s", None, start + dt.timedelta(hours=h), float(f(h))) for h in range(points)]
    return spark.createDataFrame(rows, "metric string, source string, location_name string, ds timestamp, y double")


def test_short_series_are_not_forecast(spark):
    assert forecast.forecast_additive(hourly(spark, 9, lambda h: h), AS_OF).count() == 0
    assert forecast.series_long_enough(hourly(spark, 9, lambda h: h)).count() == 0
    assert forecast.series_long_enough(hourly(spark, 10, lambda h: h)).count() == 10


def test_forecast_of_trend_and_daily_season(spark):
    """A line plus a zero-mean daily pattern is continued exactly, whole days given."""
    def f(h):
        return 5 + 0.25 * h + (3 if h % 24 < 12 else -3)

    out = forecast.forecast_additive(hourly(spark, 24 * 14, f), AS_OF).filter("horizon = '24h'").orderBy("forecast_time").collect()
    assert len(out) == 24
    assert out[0].forecast_time == dt.datetime(2024, 1, 15)
    for step, r in enumerate(out):
        assert abs(r.predicted_value - f(24 * 14 + step)) < 1.5
        assert r.lower_bound <= r.predicted_value <= r.upper_bound


def test_horizons(spark):
    out = forecast.forecast_additive(hourly(spark, 48, lambda h: h), AS_OF)
    counts = {r.horizon: r["count"] for r in out.groupBy("horizon").count().collect()}
    assert counts == {"24h": 24, "7d": 168, "30d": 720, "30d_fixed": 30}
    last = out.groupBy("horizon").agg(F.max("forecast_time").alias("t"))
    ends = {r.horizon: r.t for r in last.collect()}
    assert ends["30d"] == dt.datetime(2024, 1, 2, 23) + dt.timedelta(days=720)


def test_replacing_forecasts_keeps_other_series(spark, tmp_path):
    old = forecast.forecast_additive(hourly(spark, 48, lambda h: h), AS_OF)
    other = old.withColumn("location_name", F.lit("Tokyo"))
    sinks.replace_forecasts(old.unionByName(other), str(tmp_path))
    sinks.replace_forecasts(old.withColumn("predicted_value", F.lit(-1.0)), str(tmp_path))
    stored = scan_table(spark, str(tmp_path), "forecasts")
    assert stored.filter("location_name is null").select("predicted_value").distinct().collect()[0][0] == -1.0
    assert stored.filter("location_name = 'Tokyo' and predicted_value <> -1").count() > 900
    assert stored.count() == 2 * 942


def test_forecast_folders_do_not_grow_with_places(spark, tmp_path):
    one = forecast.forecast_additive(hourly(spark, 12, lambda h: h), AS_OF, horizons=[("24h", 2, "hour")])
    places = spark.range(400).select(F.concat(F.lit("p"), "id").alias("place"))
    many = one.crossJoin(places).withColumn("location_name", F.col("place")).drop("place")
    sinks.replace_forecasts(many, str(tmp_path))
    folders = scan_table(spark, str(tmp_path), "forecasts").select("metric", "horizon", "place_bucket").distinct()
    assert folders.count() == sinks.PLACE_BUCKETS
    sinks.replace_forecasts(many.filter("location_name = 'p7'").withColumn("predicted_value", F.lit(-1.0)), str(tmp_path))
    stored = scan_table(spark, str(tmp_path), "forecasts")
    assert stored.count() == 800
    assert {r.location_name for r in stored.filter("predicted_value = -1").collect()} == {"p7"}


def test_fit_has_no_window(spark):
    plan = forecast.fit_additive(hourly(spark, 48, lambda h: h))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_appended_runs_replace_themselves(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1.0, AS_OF)], "region_name string, unified_score double, computed_at timestamp")
    for run in (0, 1, 1):
        sinks.append_risk_scores(scores, str(tmp_path), run)
    assert scan_table(spark, str(tmp_path), "risk_scores").count() == 2
    snapshot = spark.createDataFrame(
        [("dashboard", "s", "{}", AS_OF)], "snapshot_type string, section string, payload string, created_at timestamp"
    )
    for run in (4, 4):
        sinks.append_snapshot(snapshot, str(tmp_path), run)
    assert scan_table(spark, str(tmp_path), "analytics_snapshots").count() == 1


# --- sinks ------------------------------------------------------------------

def test_a_missing_table_is_an_error_unless_expected(spark, tmp_path):
    assert scan_table(spark, str(tmp_path), "alerts", missing_is_empty=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_table(spark, str(tmp_path), "alerts")


def test_retries_wait_longer_each_time_and_give_up():
    waits, calls = [], []

    def write():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        sinks.with_retries(write, 3, 2, waits.append)
    assert len(calls) == 3 and waits == [2, 4]

    def second_time():
        calls.append(1)
        if len(calls) < 5:
            raise OSError("down")

    sinks.with_retries(second_time, 3, 2, waits.append)
    assert waits == [2, 4, 2]


def test_exports(spark, tmp_path):
    rows = [(f"eq{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 'with "quotes", comma') for i in range(20)]
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, place string")
    exports.export_csv(df, "earthquakes", str(tmp_path / "csv"), 5)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("event_time").collect()
    assert [r.event_id for r in back] == [f"eq{i}" for i in range(15, 20)]
    assert back[0].event_time.startswith("2024-01-01T15:00:00")
    exports.export_json(df, "earthquakes", str(tmp_path / "json"), 3, AS_OF)
    document = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert document["data_type"] == "earthquakes" and document["count"] == 3
    assert sorted(r["event_id"] for r in document["records"]) == ["eq17", "eq18", "eq19"]
