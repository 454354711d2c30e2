"""Landed source files: GeoJSON, place documents and CSV, with their broken variants."""

import datetime as dt
import json

from pyspark.sql import functions as F

from hazardlens.sources import documents as docs


def feature(**changes):
    base = {
        "id": "us1",
        "properties": {"mag": 5.5, "place": "10km N of X", "time": 1700000000000, "tsunami": 1, "sig": 465, "status": "reviewed"},
        "geometry": {"type": "Point", "coordinates": [-117.5, 35.7, 10.2]},
    }
    base.update(changes)
    return base


def test_feature_collections(spark, tmp_path):
    features = [
        feature(),
        feature(id=""),
        feature(id=None),
        feature(properties={"mag": 1.0}),
        feature(properties={"mag": 1.0, "time": 0}),
        feature(geometry={"type": "Point", "coordinates": []}),
        feature(geometry={"type": "Point", "coordinates": [1.0]}),
        feature(id="us2", geometry={"type": "Point", "coordinates": [1.0, 2.0]}, properties={"time": 1700000000123}),
    ]
    (tmp_path / "hour.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
    (tmp_path / "empty.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    found = docs.features(docs.read_feature_collections(spark, str(tmp_path)))
    rows = docs.quakes_from_features(docs.valid_quake_features(found)).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == ["us1", "us2"]
    full, sparse = rows
    assert (full.magnitude, full.place, full.latitude, full.longitude, full.depth_km) == (5.5, "10km N of X", 35.7, -117.5, 10.2)
    assert full.tsunami is True and full.significance == 465 and full.status == "reviewed"
    assert full.event_time == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert (sparse.magnitude, sparse.place, sparse.depth_km, sparse.tsunami, sparse.status) == (None, "", None, False, "")
    assert sparse.event_time == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)


def place(current, name="Tokyo"):
    return {"location_name": name, "latitude": 35.6, "longitude": 139.6, "current": current, "current_units": {}}


def write_documents(path, documents):
    for number, document in enumerate(documents):
        (path / f"{number}.json").write_text(json.dumps(document, indent=1))


def test_weather_documents(spark, tmp_path):
    good = {
        "time": "2024-01-15T12:30", "temperature_2m": 22.5, "relative_humidity_2m": 60, "wind_speed_10m": 15.0,
        "precipitation": 0.0, "weather_code": 3,
    }
    without_time = {k: v for k, v in good.items() if k != "time"}
    write_documents(
        tmp_path,
        [place(good), place({}), place(good, name=""), place({"time": "2024-01-15T12:00"}),
         place({**good, "temperature_2m": None}, "London"), place(without_time, "Mumbai")],
    )
    parsed = docs.valid_weather_docs(docs.read_place_documents(spark, str(tmp_path)))
    arrived = dt.datetime(2024, 2, 1)
    rows = {r.location_name: r for r in docs.weather_from_docs(parsed, F.lit(arrived)).collect()}
    assert set(rows) == {"Tokyo", "London", "Mumbai"}
    tokyo = rows["Tokyo"]
    assert (tokyo.temperature_c, tokyo.humidity_pct, tokyo.wind_speed_kmh, tokyo.precipitation_mm, tokyo.weather_code) == (22.5, 60.0, 15.0, 0.0, 3)
    assert tokyo.observed_at == dt.datetime(2024, 1, 15, 12, 30)
    assert rows["London"].temperature_c is None
    assert rows["Mumbai"].observed_at == arrived


def test_local_time_shift(spark, tmp_path):
    write_documents(tmp_path, [place({"time": "2024-01-15T12:30", "temperature_2m": 1.0})])
    parsed = docs.read_place_documents(spark, str(tmp_path))
    row = docs.weather_from_docs(parsed, local_offset_seconds=F.lit(9 * 3600)).first()
    assert row.observed_at == dt.datetime(2024, 1, 15, 3, 30)


def test_air_quality_documents(spark, tmp_path):
    write_documents(
        tmp_path,
        [place({"time": "2024-01-15T12:00", "us_aqi": 42, "pm2_5": 8.5, "pm10": 15.0, "ozone": 60.0,
                "nitrogen_dioxide": 20.0, "carbon_monoxide": 300.0, "sulphur_dioxide": 5.0}),
         place({"time": "2024-01-15T12:00", "us_aqi": 7}, "AQI only"),
         place({"time": "2024-01-15T12:00", "us_aqi": None, "pm2_5": 3.0}, "PM only"),
         place({"time": "2024-01-15T12:00", "pm10": 3.0}, "neither"),
         place({"us_aqi": 1}, ""), place({}, "empty")],
    )
    parsed = docs.valid_air_quality_docs(docs.read_place_documents(spark, str(tmp_path)))
    rows = {r.location_name: r for r in docs.air_quality_from_docs(parsed).collect()}
    assert set(rows) == {"Tokyo", "AQI only", "PM only"}
    assert (rows["Tokyo"].us_aqi, rows["Tokyo"].pm2_5, rows["Tokyo"].carbon_monoxide) == (42, 8.5, 300.0)
    assert rows["PM only"].us_aqi is None


def test_fire_csv(spark, tmp_path):
    lines = [
        "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,frp,daynight",
        "34.5,-118.2,330.5,0.4,0.4,2024-01-15,0930,N,VIIRS,nominal,12.5,D",
        "999,0,300,0.4,0.4,2024-01-15,0930,N,VIIRS,nominal,1,D",
        "abc,0,300,0.4,0.4,2024-01-15,0930,N,VIIRS,nominal,1,D",
        "10,10,300,0.4,0.4,,0930,N,VIIRS,nominal,1,D",
        "11,11,,x,0.4,2024-01-16,,N,VIIRS,,bad,N",
        "12,12,400.1,0.4,0.4,2024-01-16,0100,N,VIIRS,high,2,N",
    ]
    (tmp_path / "day.csv").write_text("\n".join(lines) + "\n")
    raw = docs.read_fire_csv(spark, str(tmp_path))
    rows = docs.fires_from_rows(docs.valid_fire_rows(raw)).orderBy("latitude").collect()
    assert [r.latitude for r in rows] == [11.0, 12.0, 34.5]
    poor = rows[0]
    assert (poor.brightness, poor.scan, poor.frp, poor.acq_time, poor.confidence) == (None, None, None, "", "")
    assert rows[2].brightness == 330.5 and rows[2].acq_time == "0930"
    top = docs.brightest_fires(raw, 2).collect()
    assert [r.bright_ti4 for r in top] == ["400.1", "330.5"]
