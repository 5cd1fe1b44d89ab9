"""Exploratory report and chart data as result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joulegrid.anomalies import evaluation, inject
from joulegrid.operators import aggregates as ag, joins, lookups
from joulegrid.plans.inspection import quality_report

ATTRIBUTES = ["area_sqm", "number_of_floors", "occupants", "year_built"]
COUNT_ONLY = ["eui", "site_eui", "source_eui", "energy_star_rating"]


def explore(
    sites: DataFrame, buildings: DataFrame, sensors: DataFrame, readings: DataFrame, weather: DataFrame, measures: list[str], expected_hours: int
) -> dict[str, DataFrame]:
    """All tables of the exploratory report; each is lazy and independent."""
    resolved = lookups.electricity_sensors(buildings, sensors, sites)
    compared = ag.building_comparison(readings, sensors, buildings)
    days = ag.local_day_totals(readings, resolved)
    counted = [c for c in COUNT_ONLY if c in buildings.columns]
    return {
        "overview": ag.overview(sites, buildings, weather, readings),
        "comparison": compared,
        "attribute_correlations": ag.attribute_correlations(compared, buildings, ATTRIBUTES, counted),
        "mean_by_use": ag.mean_by_use(compared),
        "energy_intensity": ag.energy_intensity(readings, sensors, buildings),
        "day_totals": days,
        "month_totals": ag.month_totals(days),
        "hour_profile": ag.profile(readings, resolved, "hour", per_sensor=False),
        "weekday_profile": ag.profile(readings, resolved, "day_of_week", per_sensor=False),
        "weather_correlations": ag.weather_correlations(joins.site_weather(readings, resolved, weather), measures),
        "top_buildings": lookups.top_rows(compared, "mean_kwh", "building_id", 20),
        "peak_histogram": ag.histogram(compared, "peak_kwh", 15),
        "missing_ranking": ag.missing_ranking(readings, sensors, buildings, expected_hours),
        **quality_report(readings, weather, measures, expected_hours),
    }


def forecast_charts(metrics: DataFrame) -> dict[str, DataFrame]:
    """RMSE per model and split, and error by horizon, from the metrics table of a training run."""
    return {
        "model_rmse": metrics.where("breakdown = 'overall'").groupBy("model_name").pivot("split", ["validation", "test"]).agg(F.first("rmse")),
        "error_by_horizon": metrics.where("breakdown = 'horizon'").select(
            "model_name", "split", F.col("value").cast("int").alias("horizon"), "mae", "rmse"
        ),
    }


def detector_charts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sweep curves, detector metrics and recall by type from the evaluation job's tables."""
    kinds = [t[0] for t in inject.TYPES]
    return {
        "sweep_curves": tables["sweeps"].select("method", "threshold", "precision", "recall", "f1"),
        "detector_metrics": tables["detector_metrics"].select("split_name", "method", "precision", "recall", "f1", "false_positive_rate"),
        "recall_validation": evaluation.recall_matrix(tables["recall"].where("split_name = 'validation'"), kinds),
        "recall_test": evaluation.recall_matrix(tables["recall"].where("split_name = 'test'"), kinds),
    }
