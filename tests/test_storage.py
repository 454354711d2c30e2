"""Stored tables: atomic batches, folding, and which files a reader opens."""

import datetime as dt
import glob
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from hazardlens import tablelog
from hazardlens.operators import access, alerts, dashboard, quality, risk
from hazardlens.operators.feeds import EARTHQUAKES
from hazardlens.plans import feeds
from hazardlens.sinks import exports, tables as sinks
from hazardlens.sources import wire
from hazardlens.sources.tables import counted, open_table, scan_table
from hazardlens.streaming import etl, live

NOW = {"availableNow": True}
DAY = dt.datetime(2024, 1, 10)


def quakes(spark, ids, at, magnitude=3.0):
    """Quakes of some ids; ``at`` is a SQL expression over ``id``."""
    return spark.createDataFrame([(i,) for i in ids], "id long").select(
        F.format_string("q%05d", "id").alias("event_id"), F.lit(magnitude).alias("magnitude"), F.expr(at).alias("event_time"),
        F.lit("reviewed").alias("status"),
    ).withColumn("event_date", F.to_date("event_time"))


def write(spark, root, batch_id, ids, at):
    sinks.write_batch(quakes(spark, ids, at), root, "earthquakes_processed", batch_id, partition_by=["event_date"])


def files_of(frame):
    return {os.path.basename(f) for f in frame.inputFiles()}


@pytest.fixture(scope="module")
def month(spark, tmp_path_factory):
    """Twenty days of fifty quakes each, a batch per two days."""
    root = str(tmp_path_factory.mktemp("month"))
    for batch in range(10):
        write(spark, root, batch, range(100 * batch, 100 * batch + 100),
              "timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(id div 50 as int), cast(id % 24 as int), cast(id % 50 as int))")
    return root


def test_many_batches_of_a_day_stay_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tablelog, "FOLD_AT", 4)
    root = str(tmp_path)
    for batch in range(14):
        write(spark, root, batch, range(3 * batch, 3 * batch + 3), "timestamp'2024-01-10 00:00:00' + make_dt_interval(0, 0, cast(id as int))")
    table = open_table(spark, root, "earthquakes_processed")
    # Three of the first level, the newest, and less than four of each level above.
    assert len(table.rows.inputFiles()) <= 4 + 3 + 3 and table.count() == 42
    assert sorted(r.event_id for r in table.select("event_id").collect()) == [f"q{i:05d}" for i in range(42)]
    assert {r.batch_id for r in table.select("batch_id").distinct().collect()} == set(range(14))
    # The newest batch can still be replaced, and an old one taken out of a folded file.
    write(spark, root, 13, [900], "timestamp'2024-01-10 00:00:00'")
    write(spark, root, 3, [901], "timestamp'2024-01-11 00:00:00'")
    ids = {r.event_id for r in scan_table(spark, root, "earthquakes_processed").select("event_id").collect()}
    assert ids == {f"q{i:05d}" for i in [*range(9), *range(12, 39), 900, 901]}
    sinks.compact(spark, root, "earthquakes_processed")
    table = open_table(spark, root, "earthquakes_processed")
    assert table.count() == 38 == table.rows.count() and len(table.rows.inputFiles()) <= 4


def test_readers_see_committed_files_only(spark, tmp_path, month):
    root = str(tmp_path)
    shutil.copytree(f"{month}/earthquakes_processed", f"{root}/earthquakes_processed")
    before = scan_table(spark, root, "earthquakes_processed").count()
    # What a failed attempt leaves, and folders that a listing would trip over.
    some = glob.glob(f"{root}/earthquakes_processed/commit=*/event_date=2024-01-05")[0]
    shutil.copytree(some, f"{root}/earthquakes_processed/commit=lost/event_date=2024-01-05")
    os.makedirs(f"{root}/earthquakes_processed/odd=1")
    with open(f"{root}/earthquakes_processed/odd=1/x.parquet", "w") as out:
        out.write("no parquet")
    assert scan_table(spark, root, "earthquakes_processed").count() == before == 1000


def test_a_replaced_batch_is_never_missing(spark, tmp_path):
    """A frame planned before a replay still reads what it was planned on."""
    write(spark, str(tmp_path), 0, range(5), "timestamp'2024-01-10 00:00:00'")
    planned = scan_table(spark, str(tmp_path), "earthquakes_processed")
    write(spark, str(tmp_path), 0, range(5, 7), "timestamp'2024-01-10 00:00:00'")
    assert planned.count() == 5
    assert scan_table(spark, str(tmp_path), "earthquakes_processed").count() == 2


def test_an_unfinished_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    write(spark, root, 0, range(5), "timestamp'2024-01-10 00:00:00'")
    monkeypatch.setattr(tablelog.Log, "_switch", lambda self, head: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        write(spark, root, 0, range(9), "timestamp'2024-01-10 00:00:00'")
    monkeypatch.undo()
    assert scan_table(spark, root, "earthquakes_processed").count() == 5
    write(spark, root, 0, range(9), "timestamp'2024-01-10 00:00:00'")
    assert scan_table(spark, root, "earthquakes_processed").count() == 9


def test_lookbacks_and_newest_rows_open_their_files_only(spark, month):
    table = open_table(spark, month, "earthquakes_processed")
    every = files_of(table.rows)
    late = table.not_before("event_time", dt.datetime(2024, 1, 19))
    assert len(files_of(late)) <= len(every) / 8
    assert late.filter(F.col("event_time") >= dt.datetime(2024, 1, 19)).count() == 100
    exported = exports.export_rows(table, "earthquakes", 60)
    assert len(files_of(exported)) <= len(every) / 8
    whole = exports.export_rows(table.rows, "earthquakes", 60)
    assert [tuple(r) for r in exported.collect()] == [tuple(r) for r in whole.collect()]
    assert files_of(table.newest("event_time", 5000)) == every


def test_totals_need_no_data_file(spark, tmp_path, month):
    root = str(tmp_path)
    shutil.copytree(f"{month}/earthquakes_processed", f"{root}/earthquakes_processed")
    for folder in glob.glob(f"{root}/earthquakes_processed/commit=*"):
        shutil.rmtree(folder)
    table = open_table(spark, root, "earthquakes_processed")
    assert counted(table).first().n == 1000
    assert quality.total_records({n: table for n in feeds.FEEDS}).first().total_records == 4000


@pytest.mark.parametrize("offset", [0, 40, 333, 560, 955, 990, 2000])
@pytest.mark.parametrize("magnitude", [None, 1.0])
def test_deep_pages_open_the_files_of_their_days(spark, month, offset, magnitude, monkeypatch):
    monkeypatch.setattr(access, "positioned", None)  # nothing is written
    table = open_table(spark, month, "earthquakes_processed")
    page = access.paginate(table, [("magnitude", ">=", magnitude)], "event_time", ["event_id"], 30, offset, near_rows=35)
    order = [F.desc_nulls_last("event_time"), F.desc_nulls_last("event_id")]
    wanted = table.rows.orderBy(*order).collect()[offset : offset + 30]
    assert [r.event_id for r in page.rows.collect()] == [r.event_id for r in wanted]
    assert page.total.first().total_count == 1000
    if 0 < offset < 1000 and (offset > 5 or magnitude is None):
        assert len(files_of(page.rows)) <= len(files_of(table.rows)) / 4


def test_following_pages_of_lists(spark, month):
    table = open_table(spark, month, "earthquakes_processed")
    got, after = [], None
    while True:
        page = access.list_quakes(table, min_magnitude=1.0, limit=400, after=after).rows.collect()
        if not page:
            break
        got += [r.event_id for r in page]
        after = [page[-1].event_time, page[-1].event_id]
    order = [F.desc("event_time"), F.desc("event_id")]
    assert got == [r.event_id for r in table.rows.orderBy(*order).collect()]
    behind = access.list_quakes(table, after=[dt.datetime(2024, 1, 3), "q"]).rows
    assert len(files_of(behind)) <= len(files_of(table.rows)) / 4


def test_current_state_needs_no_history(spark, tmp_path):
    """The tables of newest rows answer when every older folder is damaged."""
    root = str(tmp_path)
    line = {"location_name": "A", "latitude": 1.0, "longitude": 2.0, "wind_speed_kmh": 10.0}
    write_weather = etl.feed_writer(etl.FEEDS["weather"], root)
    for batch, (day, wind) in enumerate([(5, 130.0), (9, 10.0), (7, 90.0)]):
        rows = [json.dumps({**line, "location_name": p, "wind_speed_kmh": wind, "observed_at": f"2024-01-{day:02d}T0{batch}:00:00Z"}) for p in ("A", "B")[: 2 - batch % 2]]
        write_weather(wire.decode(spark.createDataFrame([(r,) for r in rows], "value string"), "weather"), batch)
    for batch, score in enumerate([10.0, 80.0]):
        scores = spark.createDataFrame(
            [("A", score, DAY + dt.timedelta(days=batch)), *([("B", 5.0, DAY)] if batch == 0 else [])],
            "region_name string, unified_score double, computed_at timestamp",
        )
        sinks.append_risk_scores(scores.withColumn("risk_level", F.lit("High")), root, batch)
    for table in ("weather_processed", "weather_raw", "risk_scores"):
        for path in glob.glob(f"{root}/{table}/commit=*/**/*.parquet", recursive=True):
            with open(path, "wb") as out:
                out.write(b"broken")
    newest = sinks.reduced(spark, root, "weather_latest")
    assert {(r.location_name, r.observed_at.day) for r in newest.collect()} == {("A", 9), ("B", 7)}
    regions = spark.createDataFrame([("A", 1.0, 2.0), ("B", 1.0, 2.0)], "region_name string, region_lat double, region_lon double")
    assert {r.region_name: r.weather_score > 50 for r in risk.weather_score(newest, regions).collect()} == {"A": False, "B": True}
    current = sinks.reduced(spark, root, "risk_latest")
    assert {r.region_name: r.unified_score for r in dashboard.latest_risk_scores(current.drop("batch_id")).collect()} == {"A": 80.0, "B": 5.0}


def test_markers_open_the_newest_files(spark, tmp_path):
    root = str(tmp_path)
    for day in range(1, 9):
        rows = spark.createDataFrame([("A", 1.0, 2.0, dt.datetime(2024, 1, day, 12))], "location_name string, latitude double, longitude double, observed_at timestamp")
        sinks.write_batch(rows.withColumn("event_date", F.to_date("observed_at")), root, "weather_processed", day, partition_by=["event_date"])
    table = open_table(spark, root, "weather_processed")
    found = dashboard.markers_weather(table)
    assert [r.observed_at.day for r in found.collect()] == [8] and len(files_of(found)) == 1


def test_cooling_alerts_open_the_files_of_the_cooldown(spark, tmp_path):
    root = str(tmp_path)
    for day in range(8):
        made = DAY - dt.timedelta(days=7 - day)
        row = [("major_earthquake", f"q{day}", made)]
        sinks.write_batch(spark.createDataFrame(row, "alert_type string, record_key string, created_at timestamp"), root, "alerts", day, source="earthquakes", dated_by="created_at")
    stored = open_table(spark, root, "alerts").of_source("earthquakes")
    rows = spark.createDataFrame([(f"q{day}",) for day in range(8)], "event_id string")
    left = alerts.suppress_repeats(rows, alerts.MAJOR_EARTHQUAKE, stored, DAY + dt.timedelta(hours=1))
    assert {r.event_id for r in left.collect()} == {f"q{day}" for day in range(7)}
    assert len(files_of(stored.not_before("created_at", DAY - dt.timedelta(hours=23)))) == 1
    replayed = alerts.suppress_repeats(rows, alerts.MAJOR_EARTHQUAKE, stored.besides("", 7), DAY + dt.timedelta(hours=1))
    assert replayed.count() == 8


def test_hourly_counts_add_up_over_folded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tablelog, "FOLD_AT", 3)
    root = str(tmp_path)

    def count(batch, hours):
        events = spark.createDataFrame([("s", DAY + dt.timedelta(hours=h)) for h in hours], "source string, ts timestamp")
        sinks.write_batch(live.events_per_hour(events), root, "events_per_hour", batch)

    for batch in range(8):
        count(batch, [0, 0, batch])
    count(7, [0, 5])  # the newest batch once more
    found = {r.hour.hour: r["count"] for r in live.hourly_counts(spark, root).collect()}
    assert found == {0: 16, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1}
    assert len(open_table(spark, root, "events_per_hour").rows.inputFiles()) <= 5


def land(folder, part, records):
    path = folder / f"{part:03d}.json"
    path.write_text("\n".join(map(json.dumps, records)) + "\n")
    os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))


def quake(i, day=20, **more):
    return {"event_id": f"q{i}", "event_time": f"2024-01-{day:02d}T00:00:00Z", "latitude": 1.0, "longitude": 2.0, "magnitude": 3.0, **more}


def test_a_late_batch_costs_what_an_early_one_costs(spark, tmp_path):
    """Batches of new keys and one old key each: neither stored rows nor much state is read."""
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(12):
        land(folder, part, [quake(100 * part + i) for i in range(100)] + [quake(0, 1)])
    records = EARTHQUAKES.typed(wire.decode(wire.subscribe_files(spark, str(folder), 1), "earthquakes"))
    query = live.stream_dedup(records, EARTHQUAKES, f"{tmp_path}/out", f"{tmp_path}/cp", NOW)
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    read = [s["customMetrics"]["rocksdbTotalBytesRead"] for s in state]
    assert [s["numRowsTotal"] for s in state] == [100 * (n + 1) for n in range(12)]
    assert read[11] <= 2 * read[4] + 10_000
    assert live.first_arrivals(spark, f"{tmp_path}/out", records.schema).count() == 1200


def test_quakes_are_stored_once_over_failures_and_new_checkpoints(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", f"{tmp_path}/tables"
    folder.mkdir()
    land(folder, 0, [quake(1), quake(2), quake(2, 21)])
    land(folder, 1, [quake(3, latitude=99.0), quake(2), quake(4)])
    land(folder, 2, [quake(3), quake(1, 5), quake(5)])

    def start(checkpoint):
        stream = wire.subscribe_files(spark, str(folder), 1)
        etl.start_feed(stream, EARTHQUAKES, root, f"{tmp_path}/{checkpoint}", NOW).awaitTermination()

    stored_batch, failing = etl.write_batch, {"left": 1}

    def flaky(df, where, table, batch_id, **more):
        stored_batch(df, where, table, batch_id, **more)
        if table == "earthquakes_processed" and batch_id == 1 and failing["left"]:
            failing["left"] = 0
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(etl, "write_batch", flaky)
    with pytest.raises(Exception, match="lost after writing"):
        start("cp")
    monkeypatch.undo()
    start("cp")
    ids = lambda: sorted(r.event_id for r in scan_table(spark, root, "earthquakes_processed").collect())
    assert ids() == ["q1", "q2", "q3", "q4", "q5"]
    land(folder, 3, [quake(2), quake(6)])
    start("another")
    assert ids() == ["q1", "q2", "q3", "q4", "q5", "q6"]


def test_a_forecast_cycle_reads_the_days_that_changed(spark, tmp_path, sf_dir):
    """Two cycles, the second with late rows: the same series as from the whole history."""
    from hazardlens.operators import forecast

    root, as_of = str(tmp_path), feeds.AS_OF
    events = feeds.read_events(spark, sf_dir)
    early, late = dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2)
    times = {name: feed.time for name, feed in etl.FEEDS.items()}
    rows = {name: feeds.processed_feed(spark, events, name).drop("processed_at") for name in times}

    def store(name, batch, frame, at):
        stamped = frame.withColumns({"processed_at": F.lit(at), "event_date": F.to_date(times[name])})
        sinks.write_batch(stamped, root, f"{name}_processed", batch, partition_by=["event_date"])

    # The last days come with the second cycle, and a fifth of a day of two weeks before.
    newer = {n: (F.col(t) >= "2024-01-28") | ((F.to_date(t) == "2024-01-14") & (F.abs(F.hash("latitude", "longitude", t)) % 5 == 0)) for n, t in times.items()}
    for name in times:
        store(name, 0, rows[name].filter(~newer[name]), early)
    tables = {name: open_table(spark, root, f"{name}_processed") for name in times}
    sinks.append_series(forecast.changed_series(tables, None), root, 0)
    for name in times:
        store(name, 1, rows[name].filter(newer[name]), late)
    wanted = forecast.all_series(rows, as_of)
    wanted = sorted((r.metric, r.location_name or "", r.ds, round(r.y, 9)) for r in wanted.collect())
    # Days without anything new are damaged.
    for path in glob.glob(f"{root}/*_processed/commit=*/event_date=*/*.parquet"):
        if os.path.basename(os.path.dirname(path))[11:] not in ("2024-01-14", "2024-01-28", "2024-01-29", "2024-01-30", "2024-01-31"):
            with open(path, "wb") as out:
                out.write(b"broken")
    tables = {name: open_table(spark, root, f"{name}_processed") for name in times}
    sinks.append_series(forecast.changed_series(tables, late), root, 1)
    kept = forecast.kept_series(sinks.series_points(spark, root, as_of - dt.timedelta(days=62)), as_of)
    assert sorted((r.metric, r.location_name or "", r.ds, round(r.y, 9)) for r in kept.collect()) == wanted
    assert len(wanted) > 400
