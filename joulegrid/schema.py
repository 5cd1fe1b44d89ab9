"""Table schemas. Ids are long, measures decimal at rest, timestamps UTC."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: column names and types of the source files and of the stored tables
KWH = "decimal(12,4)"

METADATA_CSV = (
    "building_id string, site_id string, primaryspaceusage string, sub_primaryspaceusage string, "
    "sqm double, lat double, lng double, yearbuilt double, numberoffloors double, occupants double, "
    "industry string, subindustry string, heatingtype string, eui double, site_eui double, "
    "source_eui double, leed_level string, energystarscore double, electricity string, timezone string"
)
METADATA_COLUMNS = [part.strip().split(" ")[0] for part in METADATA_CSV.split(",")]

WEATHER_CSV = (
    "timestamp timestamp_ntz, site_id string, airTemperature double, cloudCoverage double, "
    "dewTemperature double, precipDepth1HR double, precipDepth6HR double, seaLvlPressure double, "
    "windDirection double, windSpeed double"
)

SITES = "site_id long, site_code string, timezone string"
BUILDINGS = (
    "building_id long, building_code string, site_id long, primary_use string, area_sqm decimal(10,2), "
    "sub_primary_use string, latitude decimal(9,6), longitude decimal(9,6), year_built int, "
    "number_of_floors int, occupants int, industry string, subindustry string, heating_type string, "
    "eui decimal(10,2), site_eui decimal(10,2), source_eui decimal(10,2), leed_level string, "
    "energy_star_rating int"
)
SENSORS = "sensor_id long, building_id long, meter_type string, unit string"
ENERGY = f"sensor_id long, ts timestamp, consumption_kwh {KWH}"
WEATHER_MEASURES = {
    "air_temp_c": "decimal(5,2)",
    "cloud_coverage": "decimal(4,2)",
    "dew_temp_c": "decimal(5,2)",
    "precip_1hr_mm": "decimal(6,2)",
    "precip_6hr_mm": "decimal(6,2)",
    "sea_lvl_pressure": "decimal(7,2)",
    "wind_direction": "decimal(5,1)",
    "wind_speed": "decimal(5,2)",
}
WEATHER = "site_id long, ts timestamp, " + ", ".join(f"{k} {v}" for k, v in WEATHER_MEASURES.items())
PREDICTIONS = (
    "sensor_id long, target_ts timestamp, model_name string, model_version string, "
    f"generated_at timestamp, horizon int, predicted_kwh {KWH}"
)
ALERTS = (
    "sensor_id long, ts timestamp, method string, detector_version string, anomaly_type string, "
    f"severity string, score decimal(10,4), expected_value {KWH}, actual_value {KWH}, "
    f"residual {KWH}, explanation string, resolved boolean"
)
TRUTH = (
    "sensor_id long, ts timestamp, seed int, anomaly_type string, "
    f"original_value {KWH}, injected_value {KWH}, split string"
)
MODEL_VERSIONS = (
    "model_name string, model_version string, feature_version string, train_start timestamp, "
    "train_end timestamp, validation_start timestamp, validation_end timestamp, test_start timestamp, "
    "test_end timestamp, hyperparameters string, random_seed int, metrics string, "
    "artifact_path string, notes string"
)
INGESTION_RUNS = (
    "source_file string, started_at timestamp, finished_at timestamp, rows_read long, "
    "rows_inserted long, rows_rejected long, status string, error_summary string"
)

ENERGY_KEY = ["sensor_id", "ts"]
WEATHER_KEY = ["site_id", "ts"]
PREDICTION_KEY = ["sensor_id", "target_ts", "model_name", "model_version"]
ALERT_KEY = ["sensor_id", "ts", "method", "detector_version"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
