"""Classification rules as CASE expressions (first match wins).

Each rule takes column names and is parsed as one SQL expression, so a pipeline of
many rules stays cheap to build.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import constants as C


def literal(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else repr(value)


def case(branches: Iterable[tuple[str, object]], otherwise: object) -> str:
    """CASE text over (condition, value) pairs."""
    whens = " ".join(f"WHEN {condition} THEN {literal(value)}" for condition, value in branches)
    return f"CASE {whens} ELSE {literal(otherwise)} END"


def banded(column: str, test: str, bands: list[tuple], otherwise: str) -> str:
    """CASE text comparing a column with the edge of one band after the other."""
    return case(((f"{column} {test} {literal_double(edge)}", label) for edge, label in bands), otherwise)


def literal_double(value: float | int) -> str:
    """A floating literal (a plain ``7.5`` would be a decimal)."""
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def _unless(condition: str, label: str, otherwise: str) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN {literal(label)} ELSE {otherwise} END")


def risk_category(magnitude: str) -> Column:
    return F.expr(banded(magnitude, ">=", C.RISK_CATEGORY, C.RISK_CATEGORY_BELOW))


def magnitude_band(magnitude: str) -> Column:
    return F.expr(banded(magnitude, ">=", C.MAGNITUDE_BAND, C.MAGNITUDE_BAND_BELOW))


def distance_group(depth_km: str) -> Column:
    deep = f"{depth_km} > {literal_double(C.DEPTH_DEEP_ABOVE)}"
    intermediate = f"{depth_km} >= {literal_double(C.DEPTH_INTERMEDIATE_FROM)}"
    return F.expr(case([(deep, "Deep"), (intermediate, "Intermediate")], "Shallow"))


def depth_group(depth_km: str) -> Column:
    known = banded(depth_km, "<", C.DEPTH_GROUP, C.DEPTH_GROUP_ABOVE)
    return _unless(f"{depth_km} IS NULL", C.DEPTH_GROUP_UNKNOWN, known)


def heat_index(temperature: str, humidity: str) -> Column:
    t, rh = temperature, humidity
    terms = [
        "", f"*{t}", f"*{rh}", f"*{t}*{rh}", f"*{t}*{t}", f"*{rh}*{rh}", f"*{t}*{t}*{rh}",
        f"*{t}*{rh}*{rh}", f"*{t}*{t}*{rh}*{rh}",
    ]
    total = " + ".join(
        f"({literal_double(weight)}{term})" for weight, term in zip(C.HEAT_INDEX_COEFFICIENTS, terms)
    )
    hot = (
        f"{t} >= {literal_double(C.HEAT_INDEX_MIN_T)} AND {rh} >= {literal_double(C.HEAT_INDEX_MIN_RH)}"
    )
    return F.expr(f"CASE WHEN {hot} THEN round({total}, 2) ELSE {t} END")


def rain_severity(millimetres: str) -> Column:
    wet = banded(millimetres, "<", C.RAIN_SEVERITY, C.RAIN_SEVERITY_ABOVE)
    return _unless(f"{millimetres} IS NULL OR {millimetres} <= 0", C.RAIN_NONE, wet)


def wind_severity(kmh: str) -> Column:
    known = banded(kmh, "<", C.WIND_SEVERITY, C.WIND_SEVERITY_ABOVE)
    return _unless(f"{kmh} IS NULL", C.WIND_CALM, known)


def storm_severity(wind: str, rain: str, code: str) -> Column:
    def reached(wind_from: float, rain_from: float, codes: list[int]) -> str:
        test = f"{wind} >= {literal_double(wind_from)} OR {rain} >= {literal_double(rain_from)}"
        return f"{test} OR {code} IN ({', '.join(map(str, codes))})" if codes else test

    return F.expr(
        case(((reached(w, r, codes), label) for label, w, r, codes in C.STORM_SEVERITY), C.STORM_NONE)
    )


def aqi_category(aqi: str) -> Column:
    known = banded(aqi, "<=", C.AQI_CATEGORY, C.AQI_CATEGORY_ABOVE)
    return _unless(f"{aqi} IS NULL", C.AQI_CATEGORY_UNKNOWN, known)


def fire_severity(frp: str) -> Column:
    return F.expr(banded(frp, ">=", C.FIRE_SEVERITY, C.FIRE_SEVERITY_BELOW))


def detection_confidence(confidence: str) -> Column:
    words = [(f"lower({confidence}) = '{word}'", label) for word, label in C.CONFIDENCE_WORDS.items()]
    # A percentage is read as an integer: decimals are cut off, other notations and numbers that
    # do not fit are none.
    percent = f"try_cast(regexp_extract(trim({confidence}), '^([+-]?[0-9]+)([.][0-9]*)?$', 1) AS INT)"
    numbers = [(f"{percent} >= {edge}", label) for edge, label in C.CONFIDENCE_PERCENT]
    return F.expr(case(words + numbers, C.CONFIDENCE_BELOW))


def hotspot_tier(detections: str) -> Column:
    return F.expr(banded(detections, ">", C.HOTSPOT_TIER, C.HOTSPOT_TIER_BELOW))


def _equal_to(column: str, table: dict[str, object], otherwise: object) -> Column:
    return F.expr(case(((f"{column} = '{key}'", value) for key, value in table.items()), otherwise))


def air_quality_tier(category: str) -> Column:
    return _equal_to(category, C.AQ_HOTSPOT_TIER, C.AQ_HOTSPOT_TIER_ELSE)


def risk_level(score: str) -> Column:
    return F.expr(banded(score, ">=", C.RISK_LEVEL, C.RISK_LEVEL_BELOW))


def risk_weight(label: str, hazard: str) -> Column:
    table, unlisted = C.RISK_WEIGHTS[hazard]
    return _equal_to(label, table, unlisted).cast("double")
