"""Fixed values of the hazard model: thresholds, labels, weights and defaults.

They are stated once, as plain tables; the expressions that use them live in
``functions.rules`` and in the operators.
"""

# Monitored places (name, latitude, longitude).
MONITORED_LOCATIONS = [
    ("New York", 40.7128, -74.0060),
    ("London", 51.5074, -0.1278),
    ("Tokyo", 35.6762, 139.6503),
    ("Mumbai", 19.0760, 72.8777),
    ("São Paulo", -23.5505, -46.6333),
]

# Feed names, and the names under which ingestion logs record them.
SOURCES = ["earthquakes", "wildfires", "weather", "air_quality"]
INGESTION_SOURCES = [
    "usgs_earthquakes",
    "open_meteo_weather",
    "open_meteo_air_quality",
    "nasa_firms_wildfires",
]
INGESTION_NAME = {
    "earthquakes": "usgs_earthquakes",
    "weather": "open_meteo_weather",
    "air_quality": "open_meteo_air_quality",
    "wildfires": "nasa_firms_wildfires",
}

# Earthquake bands by magnitude, lower bounds inclusive.
RISK_CATEGORY = [(7.0, "Critical"), (5.0, "High"), (3.0, "Medium")]
RISK_CATEGORY_BELOW = "Low"
MAGNITUDE_BAND = [
    (8.0, "Great"),
    (7.0, "Major"),
    (6.0, "Strong"),
    (5.0, "Moderate"),
    (4.0, "Light"),
    (2.0, "Minor"),
]
MAGNITUDE_BAND_BELOW = "Micro"

# Depth of a stored quake (first strict, second inclusive), in km.
DEPTH_DEEP_ABOVE = 300.0
DEPTH_INTERMEDIATE_FROM = 70.0
# Depth groups of the dashboard, upper bounds exclusive.
DEPTH_GROUP = [(70.0, "Shallow"), (300.0, "Intermediate")]
DEPTH_GROUP_ABOVE = "Deep"
DEPTH_GROUP_UNKNOWN = "Unknown"

# Magnitude histogram bins, upper bounds exclusive.
MAGNITUDE_BINS = [("0-2", 2.0), ("2-4", 4.0), ("4-6", 6.0), ("6-8", 8.0), ("8+", None)]

# Heat index applies from this temperature (C) and humidity (%),
# and its coefficients for 1, T, RH, T*RH, T^2, RH^2, T^2*RH, T*RH^2, T^2*RH^2.
HEAT_INDEX_MIN_T = 27.0
HEAT_INDEX_MIN_RH = 40.0
HEAT_INDEX_COEFFICIENTS = [
    -8.78469475556,
    1.61139411,
    2.33854883889,
    -0.14611605,
    -0.012308094,
    -0.0164248277778,
    0.002211732,
    0.00072546,
    -0.000003582,
]

# Rain (mm) and wind (km/h) bands, upper bounds exclusive.
RAIN_NONE = "None"
RAIN_SEVERITY = [(2.5, "Light"), (7.5, "Moderate"), (50.0, "Heavy")]
RAIN_SEVERITY_ABOVE = "Extreme"
WIND_CALM = "Calm"
WIND_SEVERITY = [(20.0, "Calm"), (40.0, "Breezy"), (75.0, "Strong"), (120.0, "Gale")]
WIND_SEVERITY_ABOVE = "Hurricane"

# Storm severity (label, wind from, rain from, weather codes).
STORM_SEVERITY = [
    ("Extreme", 120.0, 50.0, [97, 99]),
    ("Severe", 75.0, 25.0, [95, 96]),
    ("Moderate", 40.0, 7.5, [65, 67, 75, 77, 82, 86]),
    ("Minor", 20.0, 2.5, []),
]
STORM_NONE = "None"

# Air quality index bands, upper bounds inclusive.
AQI_CATEGORY = [(50, "Good"), (100, "Moderate"), (150, "Poor"), (200, "Very Poor")]
AQI_CATEGORY_ABOVE = "Hazardous"
AQI_CATEGORY_UNKNOWN = "Unknown"

# Fire radiative power bands (MW), lower bounds inclusive.
FIRE_SEVERITY = [(200.0, "Extreme"), (50.0, "High"), (10.0, "Medium")]
FIRE_SEVERITY_BELOW = "Low"
# Detection confidence as words, or as a percentage (lower bounds).
CONFIDENCE_WORDS = {"high": "High", "nominal": "Nominal", "low": "Low"}
CONFIDENCE_PERCENT = [(80, "High"), (30, "Nominal")]
CONFIDENCE_BELOW = "Low"

# Hotspot tiers by number of detections in a cell (strict).
HOTSPOT_TIER = [(20, "High"), (10, "Moderate")]
HOTSPOT_TIER_BELOW = "Low"
# Tiers of air quality hotspots by category.
AQ_HOTSPOT_TIER = {"Hazardous": "Critical", "Very Poor": "High"}
AQ_HOTSPOT_TIER_ELSE = "Moderate"

# Risk weight per label and the weight of an unlisted label.
RISK_WEIGHTS = {
    "earthquakes": ({"Critical": 100, "High": 75, "Medium": 45, "Low": 15}, 10),
    "wildfires": ({"Extreme": 100, "High": 75, "Medium": 45, "Low": 15}, 10),
    "weather": (
        {"Extreme": 100, "Severe": 75, "Moderate": 45, "Minor": 20, "None": 5},
        5,
    ),
    "air_quality": (
        {
            "Hazardous": 100,
            "Very Poor": 80,
            "Poor": 55,
            "Moderate": 30,
            "Good": 10,
            "Unknown": 5,
        },
        5,
    ),
}
# Share of each hazard in the unified score.
RISK_SHARES = {
    "earthquake_score": 0.30,
    "wildfire_score": 0.25,
    "weather_score": 0.25,
    "air_quality_score": 0.20,
}
# Risk level by unified score, lower bounds inclusive.
RISK_LEVEL = [(75.0, "Critical"), (50.0, "High"), (25.0, "Moderate")]
RISK_LEVEL_BELOW = "Low"
RISK_LEVELS = ["Low", "Moderate", "High", "Critical"]
RISK_RADIUS_KM = 500.0
RISK_LOOKBACK_HOURS = 24
EARTH_RADIUS_KM = 6371.0

# Texts that stand for a missing value (exact and any-case forms).
NULL_TEXT_EXACT = ["", "NaN"]
NULL_TEXT_ANY_CASE = ["null", "none"]

# Forecast horizons (name, steps, step unit) and model settings. The 30d horizon has
# 720 daily steps; 30d_fixed has as many days as its name says.
FORECAST_HORIZONS = [("24h", 24, "hour"), ("7d", 168, "hour"), ("30d", 720, "day"), ("30d_fixed", 30, "day")]
FORECAST_MIN_POINTS = 10
FORECAST_WEEKLY_ABOVE_POINTS = 48
FORECAST_INTERVAL_Z = 1.28155

# Brightest fire detections kept per download, stream trigger.
FIRE_DOWNLOAD_LIMIT = 2000
STREAM_TRIGGER = "10 seconds"
JDBC_BATCH_SIZE = 1000
JDBC_ATTEMPTS = 3
JDBC_DELAY_SECONDS = 2
