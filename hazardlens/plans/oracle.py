"""SQL counterparts of the registered queries, for an independent engine.

Every text is a full statement over the given tables. Shared steps (feeds, cleaned
tables, earlier risk and alert runs) are common table expressions.
"""

from __future__ import annotations

from hazardlens.operators.alerts import RULES
from hazardlens.operators.feeds import FEEDS
from hazardlens.plans.feeds import FEED_SQL

AS_OF = "timestamp '2024-01-31 00:00:00'"
AS_OF_DATE = "date '2024-01-31'"

LOC = """select * from (values (0, 'New York', 40.7128e0, -74.0060e0), (1, 'London', 51.5074e0, -0.1278e0),
  (2, 'Tokyo', 35.6762e0, 139.6503e0), (3, 'Mumbai', 19.0760e0, 72.8777e0),
  (4, 'São Paulo', -23.5505e0, -46.6333e0)) as l(loc_id, location_name, rlat, rlon)"""

FIRE_EVENTS = (
    "(select e.* from events e join (values (0), (1)) as c(copy_no)"
    " on c.copy_no = 0 or e.event_id % 10 = 0)"
)


def _null_text(column: str) -> str:
    return (
        f"case when {column} = '' or lower({column}) in ('null', 'none') or {column} = 'NaN'"
        f" then null else {column} end"
    )


def _order(columns: str) -> str:
    return ", ".join(f"{c} desc nulls last" for c in columns.split())


def _rounded(number: str, digits: int = 2) -> str:
    return f"cast(round(cast({number} as decimal(38, 10)), {digits}) as double)"


def risk_category(m: str) -> str:
    return f"case when {m} >= 7 then 'Critical' when {m} >= 5 then 'High' when {m} >= 3 then 'Medium' else 'Low' end"


def magnitude_band(m: str) -> str:
    return (
        f"case when {m} >= 8 then 'Great' when {m} >= 7 then 'Major' when {m} >= 6 then 'Strong'"
        f" when {m} >= 5 then 'Moderate' when {m} >= 4 then 'Light' when {m} >= 2 then 'Minor' else 'Micro' end"
    )


def distance_group(d: str) -> str:
    return f"case when {d} > 300 then 'Deep' when {d} >= 70 then 'Intermediate' else 'Shallow' end"


HEAT_INDEX = """case when temperature_c >= 27 and humidity_pct >= 40 then round(
    -8.78469475556e0 + 1.61139411e0 * temperature_c + 2.33854883889e0 * humidity_pct
    - 0.14611605e0 * temperature_c * humidity_pct - 0.012308094e0 * temperature_c * temperature_c
    - 0.0164248277778e0 * humidity_pct * humidity_pct
    + 0.002211732e0 * temperature_c * temperature_c * humidity_pct
    + 0.00072546e0 * temperature_c * humidity_pct * humidity_pct
    - 0.000003582e0 * temperature_c * temperature_c * humidity_pct * humidity_pct, 2)
  else temperature_c end"""
RAIN = """case when precipitation_mm is null or precipitation_mm <= 0 then 'None' when precipitation_mm < 2.5 then 'Light'
  when precipitation_mm < 7.5 then 'Moderate' when precipitation_mm < 50 then 'Heavy' else 'Extreme' end"""
WIND = """case when wind_speed_kmh is null or wind_speed_kmh < 20 then 'Calm' when wind_speed_kmh < 40 then 'Breezy'
  when wind_speed_kmh < 75 then 'Strong' when wind_speed_kmh < 120 then 'Gale' else 'Hurricane' end"""
STORM = """case when wind_speed_kmh >= 120 or precipitation_mm >= 50 or weather_code in (97, 99) then 'Extreme'
  when wind_speed_kmh >= 75 or precipitation_mm >= 25 or weather_code in (95, 96) then 'Severe'
  when wind_speed_kmh >= 40 or precipitation_mm >= 7.5 or weather_code in (65, 67, 75, 77, 82, 86) then 'Moderate'
  when wind_speed_kmh >= 20 or precipitation_mm >= 2.5 then 'Minor' else 'None' end"""
AQI = """case when us_aqi is null then 'Unknown' when us_aqi <= 50 then 'Good' when us_aqi <= 100 then 'Moderate'
  when us_aqi <= 150 then 'Poor' when us_aqi <= 200 then 'Very Poor' else 'Hazardous' end"""
FIRE = "case when frp >= 200 then 'Extreme' when frp >= 50 then 'High' when frp >= 10 then 'Medium' else 'Low' end"
CONFIDENCE = """case lower(confidence) when 'high' then 'High' when 'nominal' then 'Nominal' when 'low' then 'Low'
  else case when try_cast(confidence as int) >= 80 then 'High' when try_cast(confidence as int) >= 30 then 'Nominal'
  else 'Low' end end"""

IN_RANGE = "latitude between -90 and 90 and longitude between -180 and 180"

CTES: dict[str, str] = {"loc": LOC}
for _name, _sql in FEED_SQL.items():
    _table = _name if _name in ("ingestion_logs", "metrics") else f"{_name}_feed"
    CTES[_table] = _sql.format(events="events", loc="loc", fire_events=FIRE_EVENTS).strip()

CTES["quakes_clean"] = f"""
select {_null_text('event_id')} as event_id, magnitude, {_null_text('place')} as place, event_time, latitude,
  longitude, depth_km, tsunami, significance, {_null_text('status')} as status from earthquakes_feed"""
CTES["earthquakes"] = f"""
select event_id, coalesce(magnitude, 0e0) as magnitude, place, event_time, latitude, longitude,
  coalesce(depth_km, 0e0) as depth_km, tsunami, significance, status,
  {risk_category('magnitude')} as risk_category, {magnitude_band('magnitude')} as magnitude_band,
  {distance_group('depth_km')} as distance_group
from (select *, row_number() over (partition by event_id order by
    {_order('event_time magnitude place latitude longitude depth_km tsunami significance status')}) as rn
  from quakes_clean where event_time is not null and event_id is not null and {IN_RANGE}) where rn = 1"""
CTES["weather"] = f"""
select location_name, latitude, longitude, temperature_c, humidity_pct, wind_speed_kmh, precipitation_mm,
  weather_code, observed_at, {HEAT_INDEX} as heat_index, {RAIN} as rain_severity, {WIND} as wind_severity,
  {STORM} as storm_severity
from (select location_name, latitude, longitude, temperature_c, humidity_pct,
    coalesce(wind_speed_kmh, 0e0) as wind_speed_kmh, coalesce(precipitation_mm, 0e0) as precipitation_mm,
    weather_code, observed_at,
    row_number() over (partition by location_name, observed_at order by
      {_order('latitude longitude temperature_c humidity_pct weather_feed.wind_speed_kmh weather_feed.precipitation_mm weather_code')}) as rn
  from weather_feed where {IN_RANGE}) where rn = 1"""
CTES["air_quality"] = f"""
select location_name, latitude, longitude, us_aqi, pm2_5, pm10, ozone, nitrogen_dioxide, carbon_monoxide,
  sulphur_dioxide, observed_at, {AQI} as aqi_category
from (select *, row_number() over (partition by location_name, observed_at order by
    {_order('latitude longitude us_aqi pm2_5 pm10 ozone nitrogen_dioxide carbon_monoxide sulphur_dioxide')}) as rn
  from air_quality_feed where {IN_RANGE}) where rn = 1"""
CTES["wildfires"] = f"""
select latitude, longitude, brightness, scan, track, acq_date, acq_time, satellite, instrument, confidence, frp,
  daynight, {FIRE} as fire_severity, {CONFIDENCE} as detection_confidence,
  cast(acq_date as timestamp) + to_minutes(coalesce(cast(substr(acq_time, 1, 2) as int) * 60
    + cast(substr(acq_time, 3, 2) as int), 0)) as processed_at
from (select latitude, longitude, brightness, scan, track, acq_date, acq_time, satellite, instrument, confidence,
    coalesce(frp, 0e0) as frp, daynight,
    row_number() over (partition by latitude, longitude, acq_date, acq_time order by
      {_order('brightness scan track satellite instrument confidence wildfires_feed.frp daynight')}) as rn
  from wildfires_feed where {IN_RANGE}) where rn = 1"""

ANOMALY = {
    "earthquakes": """select 'earthquakes' as source, 'high_magnitude_earthquake' as event_type,
  case when magnitude >= 7 then 'Critical' else 'High' end as severity,
  'Earthquake magnitude ' || cast(magnitude as varchar) || ' at ' || coalesce(place, 'unknown location') as description,
  latitude, longitude, event_time from earthquakes where magnitude >= 6""",
    "weather": """select 'weather' as source, 'severe_weather_event' as event_type,
  case when storm_severity = 'Extreme' then 'Critical' else 'High' end as severity,
  'Severe weather at ' || coalesce(location_name, 'unknown') || ': wind=' || cast(wind_speed_kmh as varchar)
    || 'km/h, precip=' || cast(precipitation_mm as varchar) || 'mm' as description,
  latitude, longitude, observed_at as event_time from weather
where wind_speed_kmh >= 120 or precipitation_mm >= 50 or storm_severity = 'Extreme'""",
    "air_quality": """select 'air_quality' as source, 'hazardous_air_quality' as event_type,
  case when us_aqi > 500 then 'Critical' else 'High' end as severity,
  'Hazardous AQI ' || cast(us_aqi as varchar) || ' at ' || coalesce(location_name, 'unknown') as description,
  latitude, longitude, observed_at as event_time from air_quality where us_aqi > 300""",
    "wildfires": """select 'wildfires' as source, 'extreme_wildfire' as event_type,
  case when frp >= 500 then 'Critical' else 'High' end as severity, '' as description,
  latitude, longitude, cast(acq_date as timestamp) as event_time from wildfires where frp >= 200""",
}
CTES["anomalies"] = " union all ".join(ANOMALY.values())


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


HAV_REGION = _hav("l.rlat", "l.rlon", "x.latitude", "x.longitude")


def quake_score(as_of: str, hours: int, upto: bool = False) -> str:
    bound = f" and x.event_time < {as_of}" if upto else ""
    return f"""select l.location_name as region_name, least(greatest(coalesce(max(
    case when x.event_id is null then null else
    case x.risk_category when 'Critical' then 100e0 when 'High' then 75e0 when 'Medium' then 45e0 when 'Low' then 15e0 else 10e0 end
    + least(coalesce(x.magnitude, 0e0) * 5e0, 25e0) end), 0e0), 0e0), 100e0) as earthquake_score
  from loc l left join earthquakes x on x.event_time >= {as_of} - interval {hours} hour{bound} and {HAV_REGION} <= 500
  group by l.location_name"""


def fire_score(as_of: str, days: int, upto: bool = False) -> str:
    bound = f" and x.processed_at < {as_of}" if upto else ""
    return f"""select region_name, least(peak + case when n > 3 then 2e0 * n else 0e0 end, 100e0) as wildfire_score
  from (select l.location_name as region_name, count(x.latitude) as n, greatest(coalesce(max(
    case when x.latitude is null then null else
    case x.fire_severity when 'Extreme' then 100e0 when 'High' then 75e0 when 'Medium' then 45e0 when 'Low' then 15e0 else 10e0 end
    + least(coalesce(x.frp, 0e0) / 5e0, 20e0) end), 0e0), 0e0) as peak
  from loc l left join wildfires x on x.acq_date >= cast({as_of} as date) - {days}{bound} and {HAV_REGION} <= 500
  group by l.location_name)"""


def weather_score(as_of: str | None = None) -> str:
    bound = f" where observed_at < {as_of}" if as_of else ""
    return f"""select l.location_name as region_name, case when w.observed_at is null then 0e0 else least(100e0, greatest(
    case w.storm_severity when 'Extreme' then 100e0 when 'Severe' then 75e0 when 'Moderate' then 45e0 when 'Minor' then 20e0 else 5e0 end,
    case w.wind_severity when 'Hurricane' then 90e0 when 'Gale' then 60e0 else 0e0 end,
    case when w.precipitation_mm >= 50 then 85e0 else 0e0 end)) end as weather_score
  from loc l left join (select * from (select *, row_number() over (partition by location_name order by observed_at desc) as newest
    from weather{bound}) where newest = 1) w on w.location_name = l.location_name"""


def air_score(as_of: str | None = None) -> str:
    bound = f" where observed_at < {as_of}" if as_of else ""
    return f"""select l.location_name as region_name, coalesce(least(100e0, greatest(
    case a.aqi_category when 'Hazardous' then 100e0 when 'Very Poor' then 80e0 when 'Poor' then 55e0
      when 'Moderate' then 30e0 when 'Good' then 10e0 when 'Unknown' then 5e0 end,
    case when a.us_aqi > 300 then 95e0 else 0e0 end)), 0e0) as air_quality_score
  from loc l left join (select * from (select *, row_number() over (partition by location_name order by observed_at desc) as newest
    from air_quality{bound}) where newest = 1) a on a.location_name = l.location_name"""


def risk_run(as_of: str, upto: bool) -> str:
    return f"""select region_name, latitude, longitude, round(earthquake_score, 2) as earthquake_score,
  round(wildfire_score, 2) as wildfire_score, round(weather_score, 2) as weather_score,
  round(air_quality_score, 2) as air_quality_score, round(u, 2) as unified_score,
  case when u >= 75 then 'Critical' when u >= 50 then 'High' when u >= 25 then 'Moderate' else 'Low' end as risk_level,
  {as_of} as computed_at
from (select l.location_name as region_name, l.rlat as latitude, l.rlon as longitude, q.earthquake_score,
    f.wildfire_score, w.weather_score, a.air_quality_score,
    q.earthquake_score * 0.3e0 + f.wildfire_score * 0.25e0 + w.weather_score * 0.25e0 + a.air_quality_score * 0.2e0 as u
  from loc l join ({quake_score(as_of, 24, upto)}) q on q.region_name = l.location_name
  join ({fire_score(as_of, 1, upto)}) f on f.region_name = l.location_name
  join ({weather_score(as_of if upto else None)}) w on w.region_name = l.location_name
  join ({air_score(as_of if upto else None)}) a on a.region_name = l.location_name)"""


CTES["risk_scores"] = " union all ".join(
    risk_run(f"timestamp '2024-01-{day} 00:00:00'", True) for day in (30, 31)
)
CTES["latest_scores"] = """
select * exclude (newest) from (select *, row_number() over (partition by region_name order by computed_at desc) as newest
  from risk_scores) where newest = 1"""

# Alert rules: natural key kept as one text, so that runs can be compared.
_ALERTS = {
    "major_earthquake": dict(
        table="earthquakes", source="earthquakes", cooldown=24, clock="event_time",
        where="magnitude >= 6", recent="event_time >= {t} - interval 72 hour", critical="magnitude >= 7",
        title="printf('M%.1f', magnitude) || ' Earthquake — ' || coalesce(place, 'None')",
        description="'Magnitude ' || cast(magnitude as varchar) || ' earthquake detected at ' || coalesce(place, 'None')"
        " || '. Risk category: ' || risk_category || '.'",
        region="cast(null as varchar)", key="event_id",
    ),
    "extreme_aqi": dict(
        table="air_quality", source="air_quality", cooldown=6, clock="observed_at",
        where="us_aqi > 300", recent="observed_at >= {t} - interval 72 hour", critical="us_aqi > 400",
        title="'Extreme AQI — ' || location_name || ' (' || cast(us_aqi as varchar) || ')'",
        description="'Air quality index of ' || cast(us_aqi as varchar) || ' detected at ' || location_name"
        " || '. Category: ' || aqi_category || '.'",
        region="location_name", key="location_name || '|' || cast(observed_at as varchar)",
    ),
    "severe_weather": dict(
        table="weather", source="weather", cooldown=6, clock="observed_at",
        where="storm_severity in ('Severe', 'Extreme')", recent="observed_at >= {t} - interval 72 hour",
        critical="storm_severity = 'Extreme'",
        title="'Severe Weather — ' || location_name || ' (' || storm_severity || ')'",
        description="storm_severity || ' weather at ' || location_name || '. Wind: ' || cast(wind_speed_kmh as varchar)"
        " || ' km/h, Precipitation: ' || cast(precipitation_mm as varchar) || ' mm.'",
        region="location_name", key="location_name || '|' || cast(observed_at as varchar)",
    ),
    "major_wildfire": dict(
        table="wildfires", source="wildfires", cooldown=12, clock="processed_at",
        where="(frp >= 200 or fire_severity = 'Extreme')", recent="acq_date >= cast({t} as date) - 3",
        critical="frp >= 500",
        title="'Major Wildfire — FRP ' || cast(cast(round_even(frp, 0) as bigint) as varchar) || ' MW'",
        description="'Major wildfire detected at (' || printf('%.2f', latitude) || ', ' || printf('%.2f', longitude)"
        " || '). FRP: ' || cast(frp as varchar) || ' MW, Severity: ' || fire_severity || ', Confidence: '"
        " || detection_confidence || '.'",
        region="cast(null as varchar)",
        key="cast(latitude as varchar) || '|' || cast(longitude as varchar) || '|' || cast(acq_date as varchar)"
        " || '|' || coalesce(acq_time, '')",
    ),
}


def alert_run(alert_type: str, t: str, upto: bool, log: str | None, more: str = "") -> str:
    r = _ALERTS[alert_type]
    known = f" and {r['clock']} < {t}" if upto else ""
    quiet = ""
    if log:
        quiet = (
            f" and not exists (select 1 from {log} h where h.alert_type = '{alert_type}'"
            f" and h.created_at >= {t} - interval {r['cooldown']} hour and h.record_key = {r['key']})"
        )
    return f"""select '{alert_type}' as alert_type, '{r['source']}' as source,
  case when {r['critical']} then 'Critical' else 'High' end as severity, {r['title']} as title,
  {r['description']} as description, latitude, longitude, {r['region']} as region_name, true as is_active,
  {t} as created_at, {r['key']} as record_key{more}
from {r['table']} where {r['where']} and {r['recent'].format(t=t)}{known}{quiet}"""


T1, T2 = "timestamp '2024-01-30 06:00:00'", "timestamp '2024-01-30 20:00:00'"
CTES["alerts_first"] = " union all ".join(alert_run(a, T1, True, None) for a in _ALERTS)
CTES["alerts"] = "select * from alerts_first union all " + " union all ".join(
    alert_run(a, T2, True, "alerts_first") for a in _ALERTS
)
CTES["alerts_new"] = " union all ".join(alert_run(a, AS_OF, False, "alerts") for a in _ALERTS)

CTES["event_clock"] = """
select 'earthquakes' as source, event_time as ts from earthquakes
union all select 'wildfires', processed_at from wildfires
union all select 'weather', observed_at from weather
union all select 'air_quality', observed_at from air_quality"""
CTES["labels_7d"] = f"""
select 'earthquakes' as source, risk_category as label from earthquakes where event_time >= {AS_OF} - interval 7 day
union all select 'wildfires', fire_severity from wildfires where acq_date >= {AS_OF_DATE} - 7
union all select 'weather', storm_severity from weather where observed_at >= {AS_OF} - interval 7 day
union all select 'air_quality', aqi_category from air_quality where observed_at >= {AS_OF} - interval 7 day"""

# Forecast series and the additive model.
CTES["series"] = f"""
select 'us_aqi' as metric, 'air_quality' as source, location_name, date_trunc('hour', observed_at) as ds, avg(us_aqi) as y
  from air_quality where observed_at >= {AS_OF} - interval 30 day and us_aqi is not null group by all
union all
select 'temperature_c', 'weather', location_name, date_trunc('hour', observed_at), avg(temperature_c)
  from weather where observed_at >= {AS_OF} - interval 30 day and temperature_c is not null group by all
union all
select 'fire_count', 'wildfires', null, cast(acq_date as timestamp), cast(count(*) as double)
  from wildfires where acq_date >= {AS_OF_DATE} - 60 group by all
union all
select 'event_count', 'earthquakes', null, date_trunc('hour', event_time), cast(count(*) as double)
  from earthquakes where event_time >= {AS_OF} - interval 30 day group by all"""
CTES["points"] = """
select *, (epoch(ds) - epoch(min(ds) over s)) / 3600e0 as t, min(ds) over s as first_ds, max(ds) over s as last_ds,
  count(*) over s as n, extract(hour from ds) as h, extract(dow from ds) as w
from series window s as (partition by metric, source, location_name)"""
CTES["trend"] = """
select metric, source, location_name, regr_slope(y, t) as slope, regr_intercept(y, t) as base
from points where n >= 10 group by all"""
CTES["detrended"] = """
select p.*, g.slope, g.base, p.y - g.base - g.slope * p.t as r
from points p join trend g on g.metric = p.metric and g.source = p.source
  and g.location_name is not distinct from p.location_name"""
CTES["by_hour"] = "select metric, source, location_name, h, avg(r) as hour_effect from detrended group by all"
CTES["dehoured"] = """
select d.*, d.r - b.hour_effect as r2 from detrended d join by_hour b on b.metric = d.metric and b.source = d.source
  and b.location_name is not distinct from d.location_name and b.h = d.h"""
CTES["by_day"] = """
select metric, source, location_name, w, case when max(n) > 48 then avg(r2) else 0e0 end as day_effect
from dehoured group by all"""
CTES["spread"] = """
select d.metric, d.source, d.location_name, stddev_samp(d.r2 - b.day_effect) as spread,
  any_value(slope) as slope, any_value(base) as base, any_value(first_ds) as first_ds, any_value(last_ds) as last_ds
from dehoured d join by_day b on b.metric = d.metric and b.source = d.source
  and b.location_name is not distinct from d.location_name and b.w = d.w
group by all"""
CTES["horizons"] = """
select 'x' as k, '24h' as horizon, cast(i as int) as step, 1 as hours from range(1, 25) t(i)
union all select 'x', '7d', cast(i as int), 1 from range(1, 169) t(i)
union all select 'x', '30d', cast(i as int), 24 from range(1, 721) t(i)
union all select 'x', '30d_fixed', cast(i as int), 24 from range(1, 31) t(i)"""
CTES["forecast_values"] = """
select s.metric, s.source, s.location_name, f.horizon, s.last_ds + to_hours(f.step * f.hours) as forecast_time,
  s.base + s.slope * (epoch(s.last_ds + to_hours(f.step * f.hours)) - epoch(s.first_ds)) / 3600e0
    + coalesce(bh.hour_effect, 0e0) + coalesce(bd.day_effect, 0e0) as v, s.spread * 1.28155e0 as m
from spread s join horizons f on true
left join by_hour bh on bh.metric = s.metric and bh.source = s.source
  and bh.location_name is not distinct from s.location_name
  and bh.h = extract(hour from s.last_ds + to_hours(f.step * f.hours))
left join by_day bd on bd.metric = s.metric and bd.source = s.source
  and bd.location_name is not distinct from s.location_name
  and bd.w = extract(dow from s.last_ds + to_hours(f.step * f.hours))"""
CTES["forecasts"] = f"""
select metric, source, location_name, horizon, forecast_time, round(v, 4) as predicted_value,
  round(v - m, 4) as lower_bound, round(v + m, 4) as upper_bound, {AS_OF} as generated_at from forecast_values"""

WITH = "with " + ",\n".join(f"{name} as ({text})" for name, text in CTES.items()) + "\n"

QUAKE_COLUMNS = (
    "event_id, magnitude, place, event_time, latitude, longitude, depth_km, tsunami, significance, status,"
    " risk_category, magnitude_band, distance_group"
)
FIRE_COLUMNS = (
    "latitude, longitude, brightness, scan, track, acq_date, acq_time, satellite, instrument, confidence, frp,"
    " daynight, fire_severity, detection_confidence"
)
ALERT_COLUMNS = "alert_type, source, severity, title, description, latitude, longitude, region_name, is_active, created_at, record_key"

Q30 = f"from earthquakes where event_time >= {AS_OF} - interval 30 day"
F14 = f"from wildfires where acq_date >= {AS_OF_DATE} - 14"
W7 = f"from weather where observed_at >= {AS_OF} - interval 7 day"
A7 = f"from air_quality where observed_at >= {AS_OF} - interval 7 day"
HOTSPOTS = f"""select round(latitude) + 0e0 as latitude, round(longitude) + 0e0 as longitude, count(*) as fire_count,
  {_rounded('coalesce(avg(frp), 0e0)')} as avg_frp {F14} group by 1, 2 having count(*) >= 5
  order by fire_count desc, latitude, longitude limit 10"""

QUAKE_FEATURE_OK = (
    "significance % 19 <> 0 and significance % 23 <> 0 and significance % 29 <> 0 and significance % 31 <> 0"
)
WEATHER_DOC_OK = (
    "humidity_pct <> 60 and humidity_pct <> 50 and not (cast(humidity_pct as int) % 7 = 0 and temperature_c is null)"
)
AIR_DOC_OK = "nitrogen_dioxide not in (20, 21) and (us_aqi is not null or nitrogen_dioxide >= 15)"
FIRE_ROW_OK = f"cast(round(track * 10) as int) not in (3, 4, 5) and {IN_RANGE}"
BRIGHT = "case when cast(round(track * 10) as int) in (0, 1) then {0} else brightness end"
FUNNEL_COLUMNS = """'earthquakes' as source{by}, count(*) as total_records, count(distinct case when ok and inside then event_id end) as valid_records,
  count(case when ok and inside then 1 end) - count(distinct case when ok and inside then event_id end) as duplicates,
  count(*) - count(case when ok then 1 end) as missing_fields, count(*) - count(case when ok then 1 end) as malformed_records,
  count(*) - count(distinct case when ok and inside then event_id end) as dropped_events,
  count(case when ok then 1 end) - count(case when ok and inside then 1 end) as validation_errors"""
SUM_COLUMNS = {
    "total_ingested": "total_records", "total_valid": "valid_records", "total_duplicates": "duplicates",
    "total_missing_fields": "missing_fields", "total_malformed": "malformed_records",
    "total_dropped": "dropped_events", "total_validation_errors": "validation_errors",
}
SOURCES = ["earthquakes", "wildfires", "weather", "air_quality"]
CELLS = ", ".join(f"count(case when source = '{s}' then 1 end) as {s}" for s in SOURCES)
FEED_ROWS = "location_name, observed_at, temperature_c, humidity_pct, wind_speed_kmh, precipitation_mm, weather_code"



def _with_raw(source: str) -> str:
    """A feed's anomalies with every column of the row that raised them."""
    before, _, behind = ANOMALY[source].rpartition(f"from {source}")
    return before.rstrip() + "".join(f", {c} as raw_{c}" for c in FEEDS[source].output) + f" from {source}{behind}"


BODIES: dict[str, str] = {
    "decode_json": """select case when h % 11 <> 0 then location_name end as location_name,
  case when h % 11 <> 0 then latitude end as latitude, case when h % 11 <> 0 then longitude end as longitude,
  case when h % 11 <> 0 then temperature_c end as temperature_c, case when h % 11 <> 0 then humidity_pct end as humidity_pct,
  case when h % 11 <> 0 then wind_speed_kmh end as wind_speed_kmh, case when h % 11 <> 0 then precipitation_mm end as precipitation_mm,
  case when h % 11 <> 0 then weather_code end as weather_code, case when h % 11 <> 0 then observed_at end as observed_at,
  h % 11 = 0 as corrupt
from (select *, cast(humidity_pct as int) as h from weather_feed) where h % 11 = 0 or h % 13 <> 0""",
    "src_geojson_quakes": f"""select event_id, magnitude, place, date_trunc('milliseconds', event_time) as event_time,
  latitude, longitude, depth_km, tsunami, significance, status from earthquakes_feed where {QUAKE_FEATURE_OK}""",
    "valid_quake_features": f"select status, count(*) as valid from earthquakes_feed where {QUAKE_FEATURE_OK} group by status",
    "src_weather_docs": f"""select location_name, latitude, longitude, temperature_c, humidity_pct, wind_speed_kmh,
  precipitation_mm, weather_code, observed_at from weather_feed where {WEATHER_DOC_OK}""",
    "valid_weather_docs": f"select location_name, count(*) as valid from weather_feed where {WEATHER_DOC_OK} group by location_name",
    "src_air_quality_docs": f"""select location_name, latitude, longitude, us_aqi,
  case when nitrogen_dioxide >= 15 then pm2_5 end as pm2_5, pm10, ozone, nitrogen_dioxide, carbon_monoxide,
  sulphur_dioxide, observed_at from air_quality_feed where {AIR_DOC_OK}""",
    "valid_air_quality_docs": f"select location_name, count(*) as valid from air_quality_feed where {AIR_DOC_OK} group by location_name",
    "src_fire_csv": f"""select latitude, longitude, {BRIGHT.format('null')} as brightness, scan, track,
  cast(acq_date as varchar) as acq_date, coalesce(acq_time, '') as acq_time, satellite, instrument,
  coalesce(confidence, '') as confidence, frp, daynight from wildfires_feed where {FIRE_ROW_OK}""",
    "valid_fire_rows": f"""select cast(acq_date as varchar) as acq_date, count(*) as valid from wildfires_feed
where {FIRE_ROW_OK} group by all""",
    "topn_fires_by_brightness": """select bright_ti4, acq_date, acq_time from (select
    case cast(round(track * 10) as int) when 0 then '' when 1 then '?' else cast(brightness as varchar) end as bright_ti4,
    case cast(round(track * 10) as int) when 5 then '' else cast(acq_date as varchar) end as acq_date, acq_time,
    case cast(round(track * 10) as int) when 3 then 'n/a' when 4 then '999' else cast(latitude as varchar) end as la,
    cast(longitude as varchar) as lo, cast(frp as varchar) as fr from wildfires_feed)
order by coalesce(try_cast(bright_ti4 as double), 0e0) desc, acq_date desc nulls last, acq_time desc nulls last,
  la desc nulls last, lo desc nulls last, fr desc nulls last limit 500""",
    "scan_processed": "select *, cast(observed_at as date) as event_date from weather",
    "clean_string_nulls": """select event_id,
  case when place = '' or lower(place) in ('null', 'none') then null else place end as place,
  case when significance % 7 = 0 then null when significance % 11 = 0 then 'nan' when significance % 13 = 0 then null
    else status end as status, event_time from earthquakes_feed""",
    "normalize_timestamps": """select significance, depth_km, case significance % 6
  when 2 then date_trunc('minute', event_time) when 4 then date_trunc('second', event_time) - interval 330 minute
  when 5 then null else date_trunc('second', event_time) end as event_time from earthquakes_feed""",
    "parse_acq_date": """select scan, track, case when scan = 0 or scan = 0.1e0 then null else acq_date end as acq_date
from wildfires_feed""",
    "validate_coordinates": f"select latitude, longitude, acq_date, acq_time from wildfires_feed where {IN_RANGE}",
    "require_fields": "select event_id, place, event_time from earthquakes_feed where place <> '' and place <> 'null'",
    "fill_defaults": """select event_id, event_time, coalesce(magnitude, 0e0) as magnitude, coalesce(depth_km, 0e0) as depth_km
from earthquakes_feed""",
    "dedup_within_batch": f"""select * exclude (rn) from (select *, row_number() over (partition by event_id order by
  {_order('event_time magnitude place latitude longitude depth_km tsunami significance status')}) as rn
  from earthquakes_feed) where rn = 1""",
    "skip_existing": """select latitude, longitude, acq_date, acq_time from wildfires i
where not exists (select 1 from wildfires t where t.acq_date < date '2024-01-20' and t.latitude = i.latitude
  and t.longitude = i.longitude and t.acq_date = i.acq_date and t.acq_time is not distinct from i.acq_time)""",
    "risk_category": f"select event_id, magnitude, event_time, {risk_category('magnitude')} as risk_category from earthquakes_feed",
    "magnitude_band": f"select event_id, magnitude, event_time, {magnitude_band('magnitude')} as magnitude_band from earthquakes_feed",
    "distance_group": f"select event_id, depth_km, event_time, {distance_group('depth_km')} as distance_group from earthquakes_feed",
    "heat_index": f"select {FEED_ROWS}, {HEAT_INDEX} as heat_index from weather_feed",
    "rain_severity": f"select {FEED_ROWS}, {RAIN} as rain_severity from weather_feed",
    "wind_severity": f"select {FEED_ROWS}, {WIND} as wind_severity from weather_feed",
    "storm_severity": f"select {FEED_ROWS}, {STORM} as storm_severity from weather_feed",
    "aqi_category": f"select location_name, observed_at, us_aqi, {AQI} as aqi_category from air_quality_feed",
    "fire_severity": f"select acq_date, acq_time, frp, {FIRE} as fire_severity from wildfires_feed",
    "detection_confidence": f"select acq_date, acq_time, confidence, {CONFIDENCE} as detection_confidence from wildfires_feed",
    "enrich_earthquakes": f"select {QUAKE_COLUMNS} from earthquakes",
    "enrich_weather": "select * from weather",
    "enrich_air_quality": "select * from air_quality",
    "enrich_wildfires": f"select {FIRE_COLUMNS} from wildfires",
    "anomaly_quake": _with_raw("earthquakes"),
    "anomaly_weather": _with_raw("weather"),
    "anomaly_air_quality": _with_raw("air_quality"),
    "anomaly_wildfire": f"""select * exclude (description), 'Extreme wildfire FRP=' || cast(raw_frp as varchar) || ' at ' as described,
  latitude as described_latitude, longitude as described_longitude from ({_with_raw("wildfires")})""",
    "anomaly_events": "select * exclude (description) from anomalies",
    "quality_funnel": f"""select {FUNNEL_COLUMNS.format(by=', batch_id')}
from (select event_id, cast(extract(day from event_time) as bigint) as batch_id, significance % 17 <> 0 as ok,
  {IN_RANGE} as inside from quakes_clean) group by batch_id""",
    "pipeline_throughput": f"""select source, batch_id, records_count, {_rounded('processing_time_ms')} as processing_time_ms,
  {_rounded('db_write_latency_ms')} as db_write_latency_ms, {_rounded('case when processing_time_ms > 0 then records_count / (processing_time_ms / 60000e0) else 0e0 end')} as records_per_minute from metrics""",
    "pipeline_summary": f"""select source, count(*) as total_batches, cast(sum(records_count) as bigint) as total_records,
  {_rounded('avg(processing_time_ms)')} as avg_processing_time_ms, {_rounded('avg(records_per_minute)')} as avg_records_per_minute,
  {_rounded('avg(db_write_latency_ms)')} as avg_db_write_latency_ms, max(created_at) as last_batch_at
from metrics group by source order by source""",
    "quality_summary": "select source, count(*) as total_batches, "
    + ", ".join(f"cast(sum({c}) as bigint) as {n}" for n, c in SUM_COLUMNS.items())
    + " from metrics group by source order by source",
    "recent_batches": """select source, batch_id, records_count, processing_time_ms, records_per_minute, db_write_latency_ms,
  created_at from metrics order by created_at desc, source desc, batch_id desc limit 20""",
    "pipeline_health": f"""select source, max(created_at) as last_batch, {_rounded('avg(processing_time_ms)')} as avg_processing_ms,
  {_rounded('avg(records_per_minute)')} as avg_throughput, cast(sum(records_count) as bigint) as total_processed
from metrics where created_at >= {AS_OF} - interval 72 hour group by source""",
    "error_counts": f"""select source, cast(sum(dropped_events + validation_errors + malformed_records) as bigint) as errors
from metrics where created_at >= {AS_OF} - interval 24 hour group by source""",
    "ingestion_latency": f"""select source, {_rounded('avg(latency_ms)')} as avg_latency_ms from ingestion_logs
where created_at >= {AS_OF} - interval 72 hour and status = 'success' group by source""",
    "source_activity": f"""select n.source, coalesce(l.status, 'no_data') as status, l.records_count,
  case when l.latency_ms <> 0 then {_rounded('l.latency_ms')} end as latency_ms, l.created_at as last_run
from (values ('usgs_earthquakes'), ('open_meteo_weather'), ('open_meteo_air_quality'), ('nasa_firms_wildfires'),
  ('tide_gauges')) as n(source)
left join (select * from (select *, row_number() over (partition by source order by created_at desc, status desc,
    records_count desc, latency_ms desc) as newest from ingestion_logs)
  where newest = 1) l on l.source = n.source""",
    "total_records": "select cast(count(*) as bigint) as total_records from event_clock",
    "dashboard_summary": f"""select count(*) as total_events,
  count(case when source = 'earthquakes' then 1 end) as total_earthquakes, count(case when source = 'wildfires' then 1 end) as total_wildfires,
  count(case when source = 'weather' then 1 end) as total_weather, count(case when source = 'air_quality' then 1 end) as total_air_quality,
  (select count(*) from anomalies) as total_anomalies, (select count(*) from alerts where is_active) as active_alerts,
  count(case when ts >= {AS_OF} - interval 1 hour then 1 end) as events_last_hour from event_clock""",
    "events_per_hour": f"""select source, date_trunc('hour', ts) as hour, count(*) as count from event_clock
where ts >= {AS_OF} - interval 168 hour group by 1, 2""",
    "events_per_hour_matrix": f"""select date_trunc('hour', ts) as hour, {CELLS} from event_clock
where ts >= {AS_OF} - interval 24 hour group by 1""",
    "risk_distribution_by_source": "select source, label, count(*) as count from labels_7d group by source, label",
    "risk_distribution_matrix": f"select label, {CELLS} from labels_7d group by label",
    "risk_level_distribution": """select v.risk_level, count(s.region_name) as regions
from (values ('Low'), ('Moderate'), ('High'), ('Critical')) as v(risk_level)
left join latest_scores s on s.risk_level = v.risk_level group by v.risk_level""",
    "regional_rankings": """select cast(row_number() over (order by unified_score desc, region_name) as int) as rank, region_name,
  unified_score, risk_level, earthquake_score, wildfire_score, weather_score, air_quality_score from latest_scores""",
    "latest_risk_scores": "select * from latest_scores",
    "markers_quakes": f"""select event_id, magnitude, place, latitude, longitude, risk_category, event_time from earthquakes
where event_time >= {AS_OF} - interval 7 day order by event_time desc, event_id desc limit 100""",
    "markers_fires": f"""select latitude, longitude, frp, fire_severity, detection_confidence, acq_date from wildfires
where acq_date >= {AS_OF_DATE} - 3 order by {_order('frp acq_date acq_time latitude longitude')} limit 100""",
    "markers_weather": """select location_name, latitude, longitude, storm_severity, wind_speed_kmh, temperature_c, observed_at
from weather where observed_at >= (select max(observed_at) - interval 6 hour from weather)""",
    "markers_air_quality": """select location_name, latitude, longitude, us_aqi, aqi_category, observed_at
from air_quality where observed_at >= (select max(observed_at) - interval 6 hour from air_quality)""",
    "quake_recent_count": f"select count(*) as recent_count {Q30}",
    "quake_recent": f"""select magnitude, depth_km, risk_category, latitude, longitude, event_time {Q30}
order by event_time desc, event_id desc limit 50""",
    "quake_risk_categories": f"select risk_category, count(*) as count {Q30} group by 1",
    "quake_depth_groups": f"""select case when depth_km is null then 'Unknown' when depth_km < 70 then 'Shallow'
  when depth_km < 300 then 'Intermediate' else 'Deep' end as depth_group, count(*) as count {Q30} group by 1""",
    "quake_daily_trend": f"select date_trunc('day', event_time) as day, count(*) as count {Q30} group by 1",
    "quake_magnitude_histogram": f"""select b.bin, count(m.magnitude) as count
from (values ('0-2'), ('2-4'), ('4-6'), ('6-8'), ('8+')) as b(bin)
left join (select magnitude, case when magnitude < 2 then '0-2' when magnitude < 4 then '2-4' when magnitude < 6 then '4-6'
  when magnitude < 8 then '6-8' else '8+' end as bin {Q30}) m on m.bin = b.bin group by b.bin""",
    "fire_severity_dist": f"select fire_severity, count(*) as count {F14} group by 1",
    "fire_confidence_dist": f"select detection_confidence, count(*) as count {F14} group by 1",
    "fire_growth_trend": f"select acq_date, count(*) as count, {_rounded('coalesce(avg(frp), 0e0)')} as avg_frp {F14} group by 1",
    "fire_active_top": f"""select latitude, longitude, frp, fire_severity, detection_confidence, acq_date from wildfires
where acq_date >= {AS_OF_DATE} - 3 order by {_order('frp acq_date acq_time latitude longitude')} limit 100""",
    "fire_grid_hotspots": HOTSPOTS,
    "fire_hotspot_tier": f"""select *, case when fire_count > 20 then 'High' when fire_count > 10 then 'Moderate' else 'Low' end as tier
from ({HOTSPOTS})""",
    "weather_storm_dist": f"select storm_severity, count(*) as count {W7} group by 1",
    "weather_wind_dist": f"select wind_severity, count(*) as count {W7} group by 1",
    "weather_series_by_location": f"""select location_name, observed_at, temperature_c, precipitation_mm, wind_speed_kmh,
  storm_severity, wind_severity {W7}""",
    "weather_alert_rows": f"""select location_name, storm_severity, wind_speed_kmh, observed_at {W7}
and storm_severity in ('Severe', 'Extreme') order by observed_at desc, location_name limit 20""",
    "aq_category_dist": f"select aqi_category, count(*) as count {A7} group by 1",
    "aq_regional_comparison": f"""select location_name, {_rounded('coalesce(avg(us_aqi), 0e0)', 1)} as avg_aqi, max(us_aqi) as max_aqi
{A7} group by 1""",
    "aq_series_by_location": f"select location_name, observed_at, us_aqi, pm2_5, pm10, aqi_category {A7}",
    "aq_hotspots": f"""select location_name, us_aqi, aqi_category, observed_at, case aqi_category when 'Hazardous' then 'Critical'
  when 'Very Poor' then 'High' else 'Moderate' end as tier {A7} and us_aqi > 150
order by observed_at desc, location_name limit 20""",
    "last_k_per_location": f"""select location_name, observed_at, us_aqi from (select *,
  row_number() over (partition by location_name order by observed_at desc) as k {A7}) where k <= 48""",
    "last_k_temperature": f"""select location_name, observed_at, temperature_c from (select *,
  row_number() over (partition by location_name order by observed_at desc) as k {W7}) where k <= 48""",
    "haversine_km": f"""select event_id, event_time, round({_hav('40.7128e0', '-74.006e0', 'latitude', 'longitude')}, 6) as distance_km
from earthquakes_feed where {IN_RANGE}""",
    "events_within_radius": f"""select l.location_name as region_name, x.event_id, round({HAV_REGION}, 6) as distance_km
from earthquakes x join loc l on {HAV_REGION} <= 500""",
    "quake_score": quake_score(AS_OF, 72),
    "fire_score": fire_score(AS_OF, 1),
    "weather_score": weather_score(),
    "air_quality_score": air_score(),
    "unified_risk": risk_run(AS_OF, False),
    "risk_level": """select event_id, case when value >= 75 then 'Critical' when value >= 50 then 'High'
  when value >= 25 then 'Moderate' else 'Low' end as risk_level from events""",
    "alert_cooldown": """select event_id, magnitude from earthquakes where event_id in
  (select record_key from alerts_new where alert_type = 'major_earthquake')""",
    "alert_rows": f"select {ALERT_COLUMNS} from alerts_new",
    "alerts_active": f"""select {ALERT_COLUMNS.replace(' is_active,', '')} from alerts where is_active
order by created_at desc, alert_type desc, record_key desc limit 200""",
    "alerts_history_rows": """select alert_type, source, severity, title, region_name, is_active, created_at, record_key
from alerts where alert_type = 'extreme_aqi'
order by created_at desc, record_key desc limit 100 offset 3""",
    "alerts_history": """select count(*) as total_count from alerts
where alert_type = 'major_earthquake' and severity = 'Critical'""",
    "series_aqi_hourly": f"""select location_name, date_trunc('hour', observed_at) as ds, round(avg(us_aqi), 6) as y
from air_quality where observed_at >= {AS_OF} - interval 30 day group by 1, 2""",
    "series_temperature_hourly": f"""select location_name, date_trunc('hour', observed_at) as ds, round(avg(temperature_c), 6) as y
from weather where observed_at >= {AS_OF} - interval 30 day group by 1, 2""",
    "series_fire_daily": f"""select cast(acq_date as timestamp) as ds, count(*) as y from wildfires
where acq_date >= {AS_OF_DATE} - 60 group by 1""",
    "series_quake_hourly": f"""select date_trunc('hour', event_time) as ds, count(*) as y from earthquakes
where event_time >= {AS_OF} - interval 30 day group by 1""",
    "series_clean": """select event_type, ts as ds, cast(user_id as double) as y from events
where event_id % 19 <> 0 and event_id % 17 <> 0""",
    "series_min_points": """select user_id, ts as ds, value as y from events
where user_id in (select user_id from events group by user_id having count(*) >= 10)""",
    "forecast_horizons": """select s.metric, s.source, s.location_name, f.horizon, f.step,
  s.last_ds + to_hours(f.step * f.hours) as forecast_time
from (select metric, source, location_name, max(ds) as last_ds from series group by all) s join horizons f on true""",
    "forecast_additive": "select * from forecasts",
    "forecast_replace": "select * from forecasts",
    "forecast_lookup": """select * from forecasts where metric = 'us_aqi' and source = 'air_quality'
and location_name = 'Tokyo' and horizon = '7d'""",
    "forecast_coverage": """select metric, source, coalesce(location_name, 'Global') as location, count(*) as points,
  max(generated_at) as generated_at from forecasts where horizon = '24h' group by all""",
    "paginated_query": f"""select {QUAKE_COLUMNS} from earthquakes where magnitude >= 2
order by event_time desc, event_id desc limit 50 offset 25""",
    "paginated_deep": """select acq_date, acq_time, latitude, longitude from wildfires
order by acq_date desc nulls last, acq_time desc nulls last, latitude desc, longitude desc limit 40 offset 333""",
    "paginated_after": f"""select {QUAKE_COLUMNS} from earthquakes where event_time < timestamp '2024-01-20 00:00:00'
or (event_time = timestamp '2024-01-20 00:00:00' and event_id < 'eq500') order by event_time desc, event_id desc limit 30""",
    "paginated_total": "select count(*) as total_count from earthquakes where magnitude >= 2",
    "list_quakes": f"""select {QUAKE_COLUMNS} from earthquakes where magnitude >= 1 and risk_category = 'Medium'
order by event_time desc, event_id desc limit 50""",
    "list_weather": """select * from weather where location_name = 'Tokyo' and wind_speed_kmh >= 20 and storm_severity = 'Severe'
order by observed_at desc limit 50""",
    "list_air_quality": """select * from air_quality where location_name = 'Mumbai' and us_aqi >= 100
and aqi_category = 'Hazardous' order by observed_at desc limit 500""",
    "list_wildfires": f"""select {FIRE_COLUMNS} from wildfires where fire_severity = 'Extreme' and frp >= 300
order by {_order('acq_date acq_time latitude longitude')} limit 50""",
    "list_anomalies": """select *, event_time as detected_at from anomalies where source = 'weather' and severity = 'Critical'
and event_type = 'severe_weather_event' order by event_time desc, latitude desc, longitude desc, description desc limit 50""",
    "export_csv": f"""select {QUAKE_COLUMNS} from earthquakes order by
  {_order('event_time event_id')} limit 300""",
    "export_json": f"""select 'air_quality' as data_type, cast(least(300, (select count(*) from air_quality)) as bigint) as count,
  * from (select * from air_quality order by {_order('observed_at location_name')} limit 300)""",
    "src_json_stream": "select * from weather_feed",
    "stream_etl_earthquakes": f"select {QUAKE_COLUMNS} from earthquakes",
    "stream_etl_weather": "select * from weather",
    "stream_etl_air_quality": "select * from air_quality",
    "stream_etl_wildfires": f"select {FIRE_COLUMNS} from wildfires",
    "sink_raw": "select * from weather_feed",
    "sink_processed": "select acq_date as event_date, fire_severity, count(*) as rows from wildfires group by 1, 2",
    "stream_quality": f"""select {FUNNEL_COLUMNS.format(by='')}
from (select event_id, true as ok, {IN_RANGE} as inside from quakes_clean)""",
    "stream_alerts": "select alert_type, source, severity, title, description, region_name, is_active, record_key from ("
    + " union all ".join(alert_run(a, AS_OF, False, None) for a in _ALERTS) + ")",
    "stream_events_per_hour": """select event_type as source, date_trunc('hour', ts) as hour, count(*) as count from events
group by 1, 2""",
    "stream_ingestion_logs": """select 'open_meteo_weather' as source, 'success' as status, count(*) as records
from weather_feed""",
    "stream_dedup": "select distinct event_id from earthquakes_feed",
    "dedup_across_batches": """select count(distinct event_id) as arrivals, count(distinct event_id) as ids
from earthquakes_feed""",
}
_NOTHING = "null as anomalies, null as alerts, null as last_hour"
BODIES["analytics_snapshot"] = f"""
select 'summary' as section, cast(null as varchar) as name, cast(null as varchar) as label, cast(null as timestamp) as at,
  total_events as value, cast(null as double) as score, total_anomalies as anomalies, active_alerts as alerts,
  events_last_hour as last_hour from ({BODIES['dashboard_summary']})
union all select 'events_per_hour', source, null, hour, count, null, {_NOTHING}
  from ({BODIES['events_per_hour'].replace('168 hour', '24 hour')})
union all select 'risk_distribution', source, label, null, count, null, {_NOTHING}
  from ({BODIES['risk_distribution_by_source']})
union all select 'unified_risk', null, risk_level, null, regions, null, {_NOTHING} from ({BODIES['risk_level_distribution']})
union all select 'regional_rankings', region_name, risk_level, null, rank, unified_score, {_NOTHING}
  from ({BODIES['regional_rankings']})"""
BODIES["live_payload"] = f"""
select 'summary' as section, cast(null as varchar) as name, cast(null as varchar) as label, cast(null as timestamp) as at,
  cast(total_events as double) as value from ({BODIES['dashboard_summary']})
union all select 'risk_scores', region_name, risk_level, computed_at, unified_score from latest_scores
union all select * from (select 'alerts', title, severity, created_at, cast(null as double) from alerts where is_active
  order by created_at desc, alert_type desc, record_key desc limit 10)
union all select 'markers.earthquakes', event_id, risk_category, event_time, magnitude
  from ({BODIES['markers_quakes'].replace('limit 100', 'limit 200')})
union all select 'markers.wildfires', null, fire_severity, cast(acq_date as timestamp), frp
  from ({BODIES['markers_fires'].replace('limit 100', 'limit 200')})
union all select 'markers.weather', location_name, storm_severity, observed_at, wind_speed_kmh
  from ({BODIES['markers_weather']})
union all select 'markers.air_quality', location_name, aqi_category, observed_at, cast(us_aqi as double)
  from ({BODIES['markers_air_quality']})"""
for _alert in _ALERTS:
    BODIES[f"alert_{_alert}"] = alert_run(
        _alert, AS_OF, False, "alerts",
        "".join(f", {c} as meta_{c}" for c in RULES[_alert].details)
        + f", {_ALERTS[_alert]['key']} as meta_key, cast(null as timestamp) as resolved_at",
    )


def oracle_sql() -> dict[str, str]:
    return {name: WITH + body for name, body in BODIES.items()}
