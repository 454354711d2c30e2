"""The streaming pipeline over several micro-batches, with repeats and broken input."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import alerts
from hazardlens.operators.feeds import EARTHQUAKES, FEEDS, WEATHER
from hazardlens.plans import feeds
from hazardlens.sources import wire
from hazardlens.sources.tables import scan_days, scan_table
from hazardlens.streaming import etl, live

NOW = {"availableNow": True}


def land(spark, tmp_path, name, sf_dir, files=5):
    """The feed as JSON lines in several files, in order of event time."""
    raw = feeds.feed(spark, feeds.read_events(spark, sf_dir), name)
    time = FEEDS[name].time
    lines = wire.encode(raw.orderBy(time)).collect()
    folder = tmp_path / f"landing-{name}"
    folder.mkdir()
    size = -(-len(lines) // files)
    for part in range(files):
        chunk = [r.value for r in lines[part * size:(part + 1) * size]]
        path = folder / f"{part}.json"
        path.write_text("\n".join(chunk) + "\n")
        # The file stream takes files by modification time.
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    return raw, folder


def run(spark, folder, name, root, files_per_batch=1, **options):
    stream = wire.subscribe_files(spark, str(folder), files_per_batch)
    query = etl.start_feed(stream, FEEDS[name], f"{root}/tables", f"{root}/checkpoint-{name}", NOW, **options)
    query.awaitTermination()
    return f"{root}/tables"


@pytest.mark.parametrize("name", list(FEEDS))
def test_stream_stores_the_batch_keys_once(spark, tmp_path, sf_dir, name):
    """Five micro-batches store what one batch over all files stores."""
    feed = FEEDS[name]
    raw, folder = land(spark, tmp_path, name, sf_dir)
    root = run(spark, folder, name, tmp_path)
    stored = scan_table(spark, root, f"{name}_processed")
    assert stored.select("batch_id").distinct().count() > 1
    ours = sorted(map(str, stored.select(*feed.key).collect()))
    batch = sorted(map(str, feed.process(raw).select(*feed.key).collect()))
    assert ours == batch
    raw_rows = scan_table(spark, root, f"{name}_raw").count()
    assert raw_rows == raw.count()


def test_broken_lines(spark, tmp_path):
    good = {"location_name": "Tokyo", "latitude": 1.0, "longitude": 2.0, "temperature_c": 30.0, "observed_at": "2024-01-01T00:00:00Z"}
    lines = [
        json.dumps(good),
        "{bad", "", "null", "[]",
        json.dumps({**good, "temperature_c": "warm", "observed_at": "2024-01-01T01:00"}),
        json.dumps({**good, "location_name": "none"}),
        json.dumps({**good, "latitude": 95.0}),
        json.dumps(good),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(lines) + "\n")
    root = run(spark, folder, "weather", tmp_path)
    stored = scan_table(spark, root, "weather_processed").orderBy("observed_at").collect()
    assert [(r.temperature_c, r.observed_at.hour) for r in stored] == [(30.0, 0), (None, 1)]
    quality = scan_table(spark, root, "data_quality_metrics").first()
    assert (quality.source, quality.valid_records, quality.duplicates, quality.validation_errors) == ("weather", 2, 1, 1)
    # {bad, null, [] and the nameless record; an empty line is no record.
    assert (quality.total_records, quality.malformed_records, quality.missing_fields) == (8, 4, 4)
    quarantined = {r.record for r in scan_table(spark, root, "quarantine").collect()}
    assert "{bad" in quarantined and any("warm" in r for r in quarantined)
    metrics = scan_table(spark, root, "pipeline_metrics").first()
    assert metrics.records_count == 2 and metrics.kafka_lag_ms is None and metrics.records_per_minute > 0


def tables_of(spark, root, names):
    return {n: sorted(map(str, scan_table(spark, root, n).drop("raw_data").collect())) for n in names}


def test_a_batch_reads_the_folders_of_its_days_only(spark, tmp_path):
    """Batches of a day each: the last one's look at the stored table does not grow."""
    root = str(tmp_path / "tables")
    read = []
    write = etl.feed_writer(WEATHER, root)
    for batch_id in range(12):
        day = f"2024-01-{batch_id + 1:02d}"
        rows = [json.dumps({"location_name": p, "latitude": 1.0, "longitude": 2.0, "temperature_c": 3.0, "observed_at": f"{day}T0{h}:00:00Z"})
                for p in ("A", "B") for h in range(3)]
        batch = wire.decode(spark.createDataFrame([(r,) for r in rows], "value string"), "weather")
        write(batch, batch_id)
        days = [dt.date(2024, 1, batch_id + 1)]
        read.append(len(scan_days(spark, root, "weather_processed", days).inputFiles()))
    assert read == [1] * 12
    assert scan_table(spark, root, "weather_processed").count() == 12 * 6


def test_replayed_batch_changes_nothing(spark, tmp_path, sf_dir):
    raw, folder = land(spark, tmp_path, "earthquakes", sf_dir, files=2)
    root = str(tmp_path / "tables")
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp")
    write = etl.feed_writer(EARTHQUAKES, root, stamp, alerts.MAJOR_EARTHQUAKE, F.lit(feeds.AS_OF), 24 * 60)
    batches = [wire.decode(spark.read.text(str(folder / f"{n}.json")), "earthquakes") for n in range(2)]
    for number, batch in enumerate(batches):
        write(batch, number)
    names = ["earthquakes_raw", "earthquakes_processed", "anomaly_events", "alerts", "data_quality_metrics"]
    before = tables_of(spark, root, names)
    assert all(before[n] for n in names)
    write(batches[1], 1)
    write(batches[0], 0)
    assert tables_of(spark, root, names) == before


def test_failed_batch_fails_the_query_and_is_taken_up_again(spark, tmp_path, sf_dir):
    _, folder = land(spark, tmp_path, "weather", sf_dir, files=3)
    root = f"{tmp_path}/tables"
    write = etl.feed_writer(WEATHER, root)
    failing = {"left": 1}

    def flaky(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 1 and failing["left"]:
            failing["left"] -= 1
            raise RuntimeError("lost after writing")

    def start():
        stream = wire.decode(wire.subscribe_files(spark, str(folder), 1), "weather")
        return (
            stream.writeStream.foreachBatch(flaky).option("checkpointLocation", f"{tmp_path}/cp").trigger(**NOW).start()
        )

    with pytest.raises(Exception, match="lost after writing"):
        start().awaitTermination()
    start().awaitTermination()
    logs = scan_table(spark, root, "ingestion_logs").collect()
    assert {(r.source, r.status, r.batch_id) for r in logs} == {("open_meteo_weather", "success", b) for b in range(3)}
    assert sum(r.records_count for r in logs) == feeds.feed(spark, feeds.read_events(spark, sf_dir), "weather").count()
    keys = scan_table(spark, root, "weather_processed").select(*WEATHER.key)
    batch = WEATHER.process(feeds.feed(spark, feeds.read_events(spark, sf_dir), "weather")).select(*WEATHER.key)
    assert sorted(map(str, keys.collect())) == sorted(map(str, batch.collect()))


def test_alerts_are_raised_once(spark, tmp_path, sf_dir):
    """The same files delivered again in a later batch raise no second alert."""
    _, folder = land(spark, tmp_path, "air_quality", sf_dir, files=2)
    (folder / "9.json").write_text((folder / "0.json").read_text())
    root = run(
        spark, folder, "air_quality", tmp_path, alert_rule=alerts.EXTREME_AQI,
        as_of=F.lit(feeds.AS_OF), lookback_hours=24 * 60,
    )
    raised = scan_table(spark, root, "alerts")
    keys = raised.select(F.get_json_object("metadata", "$.record_id"))
    assert raised.count() == keys.distinct().count() > 0
    severe = scan_table(spark, root, "air_quality_processed").filter("us_aqi > 300").count()
    assert raised.count() == severe


def test_all_four_feeds_share_the_tables(spark, tmp_path, sf_dir):
    streams = {n: wire.subscribe_files(spark, str(land(spark, tmp_path, n, sf_dir, 2)[1]), 1) for n in FEEDS}
    queries = etl.start_all(streams, f"{tmp_path}/tables", f"{tmp_path}/checkpoints", NOW)
    for query in queries:
        query.awaitTermination()
    quality = scan_table(spark, f"{tmp_path}/tables", "data_quality_metrics")
    assert {r.source: r["count"] for r in quality.groupBy("source").count().collect()} == {n: 2 for n in FEEDS}


def test_dedup_across_micro_batches(spark, tmp_path, sf_dir):
    raw, folder = land(spark, tmp_path, "earthquakes", sf_dir, files=4)
    records = EARTHQUAKES.typed(wire.decode(wire.subscribe_files(spark, str(folder), 1), "earthquakes"))
    live.stream_dedup(records, EARTHQUAKES, f"{tmp_path}/out", f"{tmp_path}/cp", NOW).awaitTermination()
    ids = [r.event_id for r in live.first_arrivals(spark, f"{tmp_path}/out", records.schema).collect()]
    assert len(ids) == len(set(ids)) == raw.select("event_id").distinct().count()


def test_a_record_that_is_ten_days_late_is_no_repeat(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    days = [("a", 20), ("b", 21), ("late", 11), ("c", 22), ("a", 5)]
    for part, (event_id, day) in enumerate(days):
        record = {"event_id": event_id, "event_time": f"2024-01-{day:02d}T00:00:00Z", "latitude": 1.0, "longitude": 2.0}
        path = folder / f"{part}.json"
        path.write_text(json.dumps(record) + "\n")
        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    records = EARTHQUAKES.typed(wire.decode(wire.subscribe_files(spark, str(folder), 1), "earthquakes"))
    live.stream_dedup(records, EARTHQUAKES, f"{tmp_path}/out", f"{tmp_path}/cp", NOW).awaitTermination()
    found = live.first_arrivals(spark, f"{tmp_path}/out", records.schema).orderBy("event_id").collect()
    assert [(r.event_id, r.event_time.day) for r in found] == [("a", 20), ("b", 21), ("c", 22), ("late", 11)]


def test_hourly_counts_of_all_hours(spark, tmp_path, sf_dir):
    raw, folder = land(spark, tmp_path, "weather", sf_dir, files=4)
    typed = WEATHER.typed(wire.decode(wire.subscribe_files(spark, str(folder), 1), "weather"))
    events = typed.select(F.lit("weather").alias("source"), F.col("observed_at").alias("ts"))
    live.stream_events_per_hour(events, f"{tmp_path}/out", f"{tmp_path}/cp", NOW).awaitTermination()
    ours = {r.hour: r["count"] for r in live.hourly_counts(spark, f"{tmp_path}/out").collect()}
    every = {r.observed_at: r["count"] for r in raw.groupBy("observed_at").count().collect()}
    assert ours == every
