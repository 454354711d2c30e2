"""Boundary tables of the classification rules, on the real expressions."""

import math

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import geo, rules, text


def labels(spark, kind, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").withColumn("label", expression)
    return [r.label for r in df.orderBy("i").collect()]


CASES = [
    ("risk_category", "double",
     [(7.0, "Critical"), (9.5, "Critical"), (6.99, "High"), (5.0, "High"), (4.99, "Medium"), (3.0, "Medium"),
      (2.99, "Low"), (0.0, "Low"), (None, "Low")]),
    ("magnitude_band", "double",
     [(8.0, "Great"), (7.99, "Major"), (7.0, "Major"), (6.0, "Strong"), (5.0, "Moderate"), (4.0, "Light"),
      (3.99, "Minor"), (2.0, "Minor"), (1.99, "Micro"), (None, "Micro")]),
    ("distance_group", "double",
     [(300.1, "Deep"), (300.0, "Intermediate"), (70.0, "Intermediate"), (69.9, "Shallow"), (None, "Shallow")]),
    ("depth_group", "double",
     [(300.0, "Deep"), (299.9, "Intermediate"), (70.0, "Intermediate"), (69.9, "Shallow"), (None, "Unknown")]),
    ("rain_severity", "double",
     [(None, "None"), (0.0, "None"), (-1.0, "None"), (0.1, "Light"), (2.5, "Moderate"), (7.5, "Heavy"),
      (49.9, "Heavy"), (50.0, "Extreme")]),
    ("wind_severity", "double",
     [(None, "Calm"), (19.9, "Calm"), (20.0, "Breezy"), (40.0, "Strong"), (75.0, "Gale"), (119.9, "Gale"),
      (120.0, "Hurricane")]),
    ("aqi_category", "int",
     [(None, "Unknown"), (0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"), (101, "Poor"),
      (150, "Poor"), (151, "Very Poor"), (200, "Very Poor"), (201, "Hazardous")]),
    ("fire_severity", "double",
     [(None, "Low"), (9.9, "Low"), (10.0, "Medium"), (50.0, "High"), (199.9, "High"), (200.0, "Extreme")]),
    ("detection_confidence", "string",
     [("high", "High"), ("HIGH", "High"), ("Nominal", "Nominal"), ("low", "Low"), ("80", "High"), ("79", "Nominal"),
      ("30", "Nominal"), ("29", "Low"), ("n", "Low"), ("", "Low"), (None, "Low"), ("85.5", "High"),
      ("79.9", "Nominal"), (" 85 ", "High"), ("1e2", "Low"), ("12345678901", "Low"), ("-90", "Low")]),
    ("risk_level", "double",
     [(80.0, "Critical"), (75.0, "Critical"), (74.99, "High"), (60.0, "High"), (50.0, "High"), (30.0, "Moderate"),
      (25.0, "Moderate"), (24.99, "Low"), (10.0, "Low"), (0.0, "Low")]),
    ("hotspot_tier", "int", [(21, "High"), (20, "Moderate"), (11, "Moderate"), (10, "Low")]),
    ("air_quality_tier", "string", [("Hazardous", "Critical"), ("Very Poor", "High"), ("Poor", "Moderate")]),
]


@pytest.mark.parametrize("rule,kind,cases", CASES, ids=[c[0] for c in CASES])
def test_boundaries(spark, rule, kind, cases):
    values, expected = zip(*cases)
    assert labels(spark, kind, values, getattr(rules, rule)("x")) == list(expected)


@pytest.mark.parametrize(
    "wind,rain,code,expected",
    [
        (120.0, 0.0, 0, "Extreme"), (0.0, 50.0, 0, "Extreme"), (0.0, 0.0, 97, "Extreme"), (0.0, 0.0, 99, "Extreme"),
        (119.9, 0.0, 0, "Severe"), (75.0, None, None, "Severe"), (None, 25.0, None, "Severe"), (0.0, 0.0, 95, "Severe"),
        (40.0, 0.0, 0, "Moderate"), (0.0, 7.5, 0, "Moderate"), (0.0, 0.0, 82, "Moderate"), (None, None, 65, "Moderate"),
        (20.0, 0.0, 0, "Minor"), (0.0, 2.5, 0, "Minor"), (19.9, 2.4, 61, "None"), (None, None, None, "None"),
    ],
)
def test_storm_severity(spark, wind, rain, code, expected):
    df = spark.createDataFrame([(wind, rain, code)], "w double, r double, c int")
    assert df.select(rules.storm_severity("w", "r", "c")).first()[0] == expected


def test_heat_index(spark):
    def by_hand(t, rh):
        if t is None or rh is None or t < 27 or rh < 40:
            return t
        c = [-8.78469475556, 1.61139411, 2.33854883889, -0.14611605, -0.012308094, -0.0164248277778,
             0.002211732, 0.00072546, -0.000003582]
        terms = [1, t, rh, t * rh, t * t, rh * rh, t * t * rh, t * rh * rh, t * t * rh * rh]
        return round(sum(a * b for a, b in zip(c, terms)), 2)

    pairs = [(26.9, 90.0), (27.0, 39.9), (27.0, 40.0), (35.0, 70.0), (40.5, 55.0), (None, 50.0), (30.0, None)]
    df = spark.createDataFrame(pairs, "t double, rh double")
    ours = [r[0] for r in df.select(rules.heat_index("t", "rh")).collect()]
    for got, (t, rh) in zip(ours, pairs):
        want = by_hand(t, rh)
        assert got == want or math.isclose(got, want, abs_tol=0.011)


def test_missing_texts(spark):
    values = ["", "null", "NULL", "Null", "none", "None", "NaN", "nan", " ", "ok", " null", None]
    expected = [None] * 7 + ["nan", " ", "ok", " null", None]
    assert labels(spark, "string", values, text.null_if_missing("x")) == expected


ACCEPTED = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss"]


def test_timestamps_agree_with_explicit_layouts(spark):
    """One parse gives what trying every accepted layout in turn gives."""
    values = [
        "2024-03-01T10:20:30Z", "2024-03-01T10:20:30+00:00", "2024-03-01T10:20:30+05:30", "2024-03-01T10:20:30",
        "2024-03-01T10:20", "2024-03-01 10:20:30", "2024-03-01", "2024-03-01T10:20:30.123456+00:00",
        "2024-03-01T10:20:30.5Z", "2024-13-01T00:00:00", "2024-02-30T00:00:00", "tomorrow", "", None,
        "01/02/2024", "2024-03-01T25:00:00", "1709288430",
    ]
    tries = [F.try_to_timestamp("x", F.lit(layout)) for layout in ACCEPTED] + [F.try_to_timestamp("x")]
    expected = labels(spark, "string", values, F.coalesce(*tries))
    assert labels(spark, "string", values, text.parse_timestamp(F.col("x"))) == expected
    assert sum(v is not None for v in expected) >= 9


def test_dates(spark):
    import datetime as dt

    values = ["2024-01-05", "2024-13-01", "05/01/2024", "", None]
    assert labels(spark, "string", values, text.parse_date("x")) == [dt.date(2024, 1, 5)] + [None] * 4


def test_haversine(spark):
    rows = [(40.7128, -74.0060, 51.5074, -0.1278), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ours = [r[0] for r in df.select(geo.haversine_km("a", "b", "c", "d")).collect()]
    assert 5500 < ours[0] < 5600
    assert ours[1] == 0
    assert math.isclose(ours[2], math.pi * 6371) and math.isclose(ours[3], math.pi * 6371)


def test_coordinates(spark):
    rows = [(90.0, 180.0), (-90.0, -180.0), (90.1, 0.0), (0.0, 180.1), (None, 0.0), (0.0, None), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    assert df.filter(geo.in_range()).count() == 2
