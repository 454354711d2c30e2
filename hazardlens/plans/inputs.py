"""Tables the registered queries start from, all derived from ``events``."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.operators import alerts, anomalies, forecast, risk
from hazardlens.operators.common import union_all
from hazardlens.operators.dashboard import EVENT_CLOCK
from hazardlens.operators.feeds import FEEDS
from hazardlens.plans import feeds
from hazardlens.session import shared_dir, use_utc
from hazardlens.sinks.tables import append_risk_scores, latest_per, reduced, write_batch
from hazardlens.sources.tables import StoredTable, open_table, scan_table

AS_OF = feeds.AS_OF
LOOKBACK_HOURS = 72
SCORED_AT = [dt.datetime(2024, 1, 30), AS_OF]
ALERTED_AT = [dt.datetime(2024, 1, 30, 6), dt.datetime(2024, 1, 30, 20)]


class Inputs:
    """Lazily derived inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir
        self._stored: dict[str, StoredTable] = {}

    @cached_property
    def events(self) -> DataFrame:
        return feeds.read_events(self.spark, self.sf_dir)

    def raw(self, name: str) -> DataFrame:
        return feeds.feed(self.spark, self.events, name)

    def land(self, texts: DataFrame) -> str:
        """Texts written as the lines of files, the way a feed would deliver them."""
        folder = shared_dir(self.spark, "landing")
        texts.select("value").write.text(folder)
        return folder

    def land_documents(self, texts: DataFrame, per_file: int = 500) -> str:
        """JSON texts as files of one JSON array each, the way a download is kept."""
        folder = shared_dir(self.spark, "documents")
        numbered = texts.withColumn("part", F.floor(F.monotonically_increasing_id() / per_file))
        arrays = numbered.groupBy("part").agg(F.array_join(F.collect_list("value"), ",").alias("all"))
        arrays.select("part", F.concat(F.lit("["), "all", F.lit("]")).alias("value")).write.partitionBy("part").text(folder)
        return folder

    def land_csv(self, rows: DataFrame) -> str:
        folder = shared_dir(self.spark, "csv")
        rows.write.option("header", True).csv(folder)
        return folder

    def landed(self, texts: DataFrame) -> DataFrame:
        return self.spark.read.text(self.land(texts))

    @cached_property
    def processed(self) -> dict[str, DataFrame]:
        return {name: self.one(name) for name in FEEDS}

    def one(self, name: str) -> DataFrame:
        return feeds.processed_feed(self.spark, self.events, name)

    @property
    def quakes(self) -> DataFrame:
        return self.one("earthquakes")

    @property
    def weather(self) -> DataFrame:
        return self.one("weather")

    @property
    def air(self) -> DataFrame:
        return self.one("air_quality")

    @property
    def fires(self) -> DataFrame:
        return self.one("wildfires")

    @property
    def logs(self) -> DataFrame:
        return self.raw("ingestion_logs")

    @property
    def metrics(self) -> DataFrame:
        return self.raw("metrics")

    @property
    def anomalies(self) -> DataFrame:
        found = anomalies.anomaly_events(self.stored)
        return found.withColumn("detected_at", F.col("event_time"))

    @property
    def regions(self) -> DataFrame:
        return risk.monitored_regions(self.spark)

    @cached_property
    def root(self) -> str:
        return shared_dir(self.spark, "tables")

    def store(self, name: str) -> StoredTable:
        """A processed table, written once for queries that read it repeatedly."""
        if name not in self._stored:
            dated = self.one(name).withColumn("event_date", F.to_date(FEEDS[name].time))
            write_batch(dated, self.root, f"{name}_processed", 0, partition_by=["event_date"])
            self._stored[name] = open_table(self.spark, self.root, f"{name}_processed")
        return self._stored[name]

    def latest(self, name: str) -> DataFrame:
        """The newest observation of every place, from the table that is kept of it."""
        newest = latest_per("location_name", FEEDS[name].time)(self.one(name))
        write_batch(newest, self.root, f"{name}_latest", 0)
        return reduced(self.spark, self.root, f"{name}_latest")

    @property
    def latest_observations(self) -> dict[str, DataFrame]:
        self.events, self.root  # shared by the jobs
        with ThreadPoolExecutor(2) as jobs:
            return dict(zip(("weather", "air_quality"), jobs.map(self.latest, ("weather", "air_quality"))))

    @property
    def stored(self) -> dict[str, StoredTable]:
        """All processed tables; their write jobs do not depend on each other."""
        self.events, self.root  # shared by the jobs
        with ThreadPoolExecutor(len(FEEDS)) as jobs:
            return dict(zip(FEEDS, jobs.map(self.store, FEEDS)))

    def known_at(self, name: str, moment: dt.datetime) -> DataFrame:
        """A processed table as it stood at an earlier moment."""
        return self.store(name).filter(F.col(EVENT_CLOCK[name]) < F.lit(moment))

    @cached_property
    def risk_scores(self) -> DataFrame:
        """The newest scores that are kept beside the history, after a run at each of ``SCORED_AT``."""
        self.stored  # written at the same time
        for run, moment in enumerate(SCORED_AT):
            known = {n: self.known_at(n, moment) for n in FEEDS}
            append_risk_scores(risk.unified_risk(known, self.regions, moment), self.root, run)
        return reduced(self.spark, self.root, "risk_latest").drop("batch_id")

    def alerts_of(self, *alert_types: str) -> DataFrame:
        """The alert table after two runs, the second subject to the first one's cool-down."""
        rules = [alerts.RULES[t] for t in alert_types]
        if len(rules) == len(FEEDS):
            self.stored  # written at the same time
        for run, moment in enumerate(ALERTED_AT):
            earlier = open_table(self.spark, self.root, "alerts", missing_is_empty=True)
            known = {r.source: self.known_at(r.source, moment) for r in rules}
            raised = [
                alerts.raise_alerts(known[r.source], r, earlier, moment, LOOKBACK_HOURS) for r in rules
            ]
            write_batch(union_all(raised), self.root, "alerts", run, dated_by="created_at")
        return scan_table(self.spark, self.root, "alerts").drop("batch_id")

    @cached_property
    def alerts(self) -> DataFrame:
        return self.alerts_of(*alerts.RULES)

    @cached_property
    def series(self) -> DataFrame:
        return forecast.all_series(self.processed, AS_OF)

    @cached_property
    def forecasts(self) -> DataFrame:
        return forecast.forecast_additive(self.series, AS_OF)
