"""What the physical plans must and must not contain."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import alerts, dashboard, hazards, quality, risk
from hazardlens.operators.common import first_per_key, newest_sql
from hazardlens.plans.catalog import QUERIES
from hazardlens.plans.inputs import AS_OF, Inputs
from hazardlens.schemas import TABLES
from hazardlens.sinks.tables import write_batch
from hazardlens.sources.tables import scan_table

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["enrich_earthquakes", "dedup_within_batch", "last_k_per_location", "latest_risk_scores"])
def test_per_key_ranks_are_limited_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    partial = re.search(r"Exchange hashpartitioning.*?WindowGroupLimit[^\n]*Partial", plan, re.S)
    assert partial, plan


@pytest.mark.parametrize(
    "name", ["markers_quakes", "markers_fires", "quake_recent", "fire_active_top", "fire_grid_hotspots", "weather_alert_rows",
             "aq_hotspots", "alerts_active", "recent_batches", "topn_fires_by_brightness", "paginated_query"]
)
def test_top_k(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf_dir))


def test_latest_scores_use_a_hash_aggregate(spark, sf_dir):
    plan = plan_of(QUERIES["weather_score"](spark, sf_dir))
    assert "partial_max_by" in plan and "SortAggregate" not in plan


def test_scan_reads_needed_columns_and_pushes_filters(spark, sf_dir):
    plan = plan_of(QUERIES["series_quake_hourly"](spark, sf_dir))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "EqualTo(event_type,error)" in scan
    assert "props" not in scan.split("ReadSchema")[1]


def test_lookback_prunes_folders(spark, sf_dir):
    stored = Inputs(spark, sf_dir).store("weather").rows
    plan = plan_of(hazards.weather_storm_dist(stored, AS_OF))
    assert re.search(r"PartitionFilters: \[[^]]*event_date#\d+ >= 2024-01-24", plan)
    plan = plan_of(hazards.weather_storm_dist(stored))
    assert "event_date" in re.search(r"PartitionFilters: \[([^]]*)\]", plan).group(1)


@pytest.mark.parametrize("table, rows", [
    ("alerts", lambda t: alerts.suppress_repeats(
        t.select(F.col("record_key").alias("event_id"), F.lit(1).alias("x")), alerts.MAJOR_EARTHQUAKE, t, AS_OF)),
    ("pipeline_metrics", lambda t: quality.pipeline_health(t, AS_OF)),
    ("data_quality_metrics", lambda t: quality.error_counts(t, AS_OF)),
    ("ingestion_logs", lambda t: quality.ingestion_latency(t, AS_OF)),
    ("risk_scores", lambda t: dashboard.regional_rankings(t, AS_OF.date())),
])
def test_lookbacks_on_logs_prune_folders(spark, tmp_path, table, rows):
    """Fifty days of a log: only the days of the look-back are read."""
    schema = TABLES[table]
    time = "computed_at" if table == "risk_scores" else "created_at"
    days = spark.range(50).select(F.expr("timestamp'2024-01-31 00:00:00' - make_dt_interval(int(id))").alias("at"))
    log = days.select(*[(F.col("at") if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    write_batch(log.drop("event_date"), str(tmp_path), table, 0, dated_by=time)
    stored = scan_table(spark, str(tmp_path), table)
    read = rows(stored)
    if table != "risk_scores":  # its range-sorted table stands between
        assert re.search(r"PartitionFilters: \[[^]]*event_date#\d+ >= 2024-01-3", plan_of(read))
        pruned = stored.filter(F.col("event_date") >= (AS_OF - dt.timedelta(hours=24)).date())
        assert len(pruned.inputFiles()) == 50 and pruned.select(F.input_file_name()).distinct().count() == 2
    else:
        assert read.count() == 1


def test_a_first_day_prunes_the_search_for_the_newest(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    stored, day = inputs.store("weather").rows, AS_OF.date() - dt.timedelta(days=3)
    for frame in (risk.weather_score(stored, inputs.regions, day), dashboard.markers_weather(stored, day)):
        assert re.search(r"PartitionFilters: \[[^]]*event_date#\d+ >= 2024-01-28", plan_of(frame))


def test_a_hot_key_leaves_each_task_as_one_row(spark):
    """Half a million rows of one key: the exchange carries a row per map task."""
    df = spark.range(0, 500_000, 1, 8).select((F.col("id") % 1).alias("k"), F.col("id").alias("t"))
    out = first_per_key(df, ["k"], newest_sql(["t"]))
    assert out.collect()[0].t == 499_999
    assert 0 < shuffle_records(out) <= 8


def shuffle_records(df):
    """Rows written by the only shuffle of an executed adaptive plan."""
    def find(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            return node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            return find(node.executedPlan())
        if name in ("ShuffleQueryStageExec", "ResultQueryStageExec", "BroadcastQueryStageExec"):
            return find(node.plan())
        children = node.children()
        for position in range(children.size()):
            found = find(children.apply(position))
            if found is not None:
                return found
        return None

    return find(df._jdf.queryExecution().executedPlan())
