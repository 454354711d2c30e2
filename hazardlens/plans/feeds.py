"""Hazard feeds derived from the ``events`` table.

Each feed is one SELECT that Spark and the SQL oracle run alike; only the inputs
named in braces differ.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.constants import MONITORED_LOCATIONS
from hazardlens.operators.common import small_table
from hazardlens.operators.feeds import FEEDS

AS_OF = dt.datetime(2024, 1, 31)

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

FEED_SQL = {
    "earthquakes": """
select 'eq' || cast(e.event_id - e.event_id % 11 as varchar(20)) as event_id,
  case when e.event_id % 53 = 0 then null else round(e.value / 15e0, 1) end as magnitude,
  case when e.event_id % 29 = 0 then 'null' when e.event_id % 31 = 0 then ''
       else 'Zone ' || cast(e.user_id as varchar(20)) end as place,
  e.ts as event_time,
  case when e.event_id % 3 = 0 then l.rlat + cast(e.event_id % 13 - 6 as double)
       else cast((e.event_id * 37) % 1840 as double) / 10e0 - 92e0 end as latitude,
  case when e.event_id % 3 = 0 then l.rlon + cast(e.event_id % 7 - 3 as double)
       else cast((e.event_id * 73) % 3640 as double) / 10e0 - 182e0 end as longitude,
  case when e.event_id % 41 = 0 then null else cast((e.event_id * 17) % 6500 as double) / 10e0 end as depth_km,
  e.event_id % 10 = 0 as tsunami,
  cast(e.event_id % 1000 as int) as significance,
  case when e.event_id % 2 = 0 then 'reviewed' else 'automatic' end as status
from {events} e join {loc} l on e.user_id % 5 = l.loc_id where e.event_type = 'error'
""",
    "weather": """
select l.location_name, l.rlat as latitude, l.rlon as longitude,
  case when e.event_id % 47 = 0 then null else cast((e.event_id * 7) % 400 as double) / 10e0 end as temperature_c,
  cast((e.event_id * 13) % 81 + 20 as double) as humidity_pct,
  case when e.event_id % 43 = 0 then null else round(e.value, 1) end as wind_speed_kmh,
  case when e.event_id % 3 = 0 then cast((e.event_id * 11) % 700 as double) / 10e0 else 0e0 end as precipitation_mm,
  cast(case e.event_id % 12 when 0 then 97 when 1 then 95 when 2 then 65 when 3 then 61 else 0 end as int) as weather_code,
  date_trunc('hour', e.ts) as observed_at
from {events} e join {loc} l on e.user_id % 5 = l.loc_id where e.event_type = 'view'
""",
    "air_quality": """
select l.location_name, l.rlat as latitude, l.rlon as longitude,
  case when e.event_id % 37 = 0 then null else cast(floor(e.value * 3e0) as int) end as us_aqi,
  e.value * 0.36e0 as pm2_5, e.value * 0.75e0 as pm10, 30e0 + cast(e.event_id % 20 as double) as ozone,
  cast(e.event_id % 30 as double) as nitrogen_dioxide, cast(e.event_id % 9 as double) / 10e0 as carbon_monoxide,
  cast(e.event_id % 7 as double) as sulphur_dioxide, date_trunc('hour', e.ts) as observed_at
from {events} e join {loc} l on e.user_id % 5 = l.loc_id where e.event_type = 'click'
""",
    "wildfires": """
select case when e.event_id % 3 = 0 then l.rlat + cast(e.event_id % 9 - 4 as double)
       else cast((e.event_id * 37) % 1840 as double) / 10e0 - 92e0 end as latitude,
  case when e.event_id % 3 = 0 then l.rlon + cast(e.event_id % 5 - 2 as double)
       else cast((e.event_id * 73) % 3640 as double) / 10e0 - 182e0 end as longitude,
  295e0 + cast(e.event_id % 70 as double) as brightness, cast(e.event_id % 20 as double) / 10e0 as scan,
  cast(e.event_id % 17 as double) / 10e0 as track, cast(e.ts as date) as acq_date,
  case when e.event_id % 61 = 0 then null
       else lpad(cast(extract(hour from e.ts) * 100 + extract(minute from e.ts) as varchar(8)), 4, '0') end as acq_time,
  'N' as satellite, 'VIIRS' as instrument,
  case e.event_id % 7 when 0 then 'high' when 1 then 'Nominal' when 2 then 'low' when 3 then '85' when 4 then '40'
       when 5 then 'n' else null end as confidence,
  case when e.event_id % 59 = 0 then null else round(e.value * 4e0, 1) end as frp,
  case when extract(hour from e.ts) between 6 and 17 then 'D' else 'N' end as daynight
from {fire_events} e join {loc} l on e.user_id % 5 = l.loc_id
where e.event_type = 'purchase'
""",
    "ingestion_logs": """
select case e.user_id % 4 when 0 then 'usgs_earthquakes' when 1 then 'open_meteo_weather'
       when 2 then 'open_meteo_air_quality' else 'nasa_firms_wildfires' end as source,
  case when e.event_id % 9 = 0 then 'error' else 'success' end as status,
  cast(e.user_id as int) as records_count, e.value as latency_ms, e.ts as created_at
from {events} e where e.event_type = 'signup'
""",
    "metrics": """
select case e.user_id % 4 when 0 then 'earthquakes' when 1 then 'weather' when 2 then 'air_quality'
       else 'wildfires' end as source, e.event_id as batch_id, cast(e.user_id as int) as records_count,
  e.value * 10e0 as processing_time_ms, e.value as db_write_latency_ms,
  case when e.value > 0e0 then cast(e.user_id as double) / (e.value * 10e0 / 60000e0) else 0e0 end as records_per_minute,
  cast(e.user_id + e.event_id % 3 + e.event_id % 2 + e.event_id % 4 as int) as total_records,
  cast(e.user_id as int) as valid_records, cast(e.event_id % 3 as int) as duplicates,
  cast(e.event_id % 2 as int) as missing_fields, cast(e.event_id % 2 as int) as malformed_records,
  cast(e.event_id % 3 + e.event_id % 2 + e.event_id % 4 as int) as dropped_events,
  cast(e.event_id % 4 as int) as validation_errors, e.ts as created_at
from {events} e where e.event_type = 'signup'
""",
}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_times(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a file stream (the glob also fits a folder of part files)."""
    return _event_times(spark.readStream.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet*"))


def _event_times(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def feed(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    """Raw records of one feed; every tenth fire detection is delivered twice."""
    places = [(i, n, lat, lon) for i, (n, lat, lon) in enumerate(MONITORED_LOCATIONS)]
    loc = small_table(spark, places, "loc_id, location_name, rlat, rlon")
    inputs = {"events": events, "loc": loc}
    if name == "wildfires":
        copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        inputs["fire_events"] = events.withColumn("copy_no", F.explode(copies))
    text = FEED_SQL[name]
    return spark.sql(text, **{k: v for k, v in inputs.items() if "{" + k + "}" in text})


def fire_processed_at():
    """A stand-in for the load time of a fire row: its acquisition time."""
    minutes = "coalesce(int(substr(acq_time, 1, 2)) * 60 + int(substr(acq_time, 3, 2)), 0)"
    return F.expr(f"timestamp(acq_date) + make_dt_interval(0, 0, {minutes})")


def processed_feed(spark: SparkSession, events: DataFrame, name: str) -> DataFrame:
    raw = feed(spark, events, name)
    stamp = {"wildfires": fire_processed_at()}.get(name)
    return FEEDS[name].process(raw, stamp)
