"""Listing, look-up, filter and top-k operators."""

from __future__ import annotations

from datetime import date, datetime, time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.functions.zones import to_utc_argument
from joulegrid.operators.joins import bounded

MAX_TOP = 100


# --- pages and keys ---------------------------------------------------------------

def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page plus the ``total`` before paging."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def matching(rows: DataFrame, **equal_to) -> DataFrame:
    """Equality filters; a None argument is no filter."""
    given = [F.col(name) == value for name, value in equal_to.items() if value is not None]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def list_sites(sites: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(sites, ["site_id"], limit, offset)


def list_buildings(buildings: DataFrame, site_id=None, primary_use=None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(matching(buildings, site_id=site_id, primary_use=primary_use), ["building_id"], limit, offset)


def list_sensors(sensors: DataFrame, building_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(matching(sensors, building_id=building_id), ["sensor_id"], limit, offset)


def one_by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; an unknown key is an error."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"no row with {key} = {value!r}")
    return found


def by_keys(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of a set of keys held in a table (bulk form of the look-up)."""
    return rows.join(keys.select(*columns), list(columns), "left_semi")


def electricity_sensors(buildings: DataFrame, sensors: DataFrame, sites: DataFrame) -> DataFrame:
    """Every building with its electricity sensor and its site's zone."""
    return (
        sensors.where(F.col("meter_type") == "electricity")
        .join(buildings, "building_id")
        .join(sites, "site_id")
        .select("building_id", "sensor_id", "site_id", "timezone")
    )


# --- time ranges ------------------------------------------------------------------

def _bound(value, end: bool):
    if isinstance(value, str) and len(value) == 10:
        value = date.fromisoformat(value)
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime.combine(value, time(23, 59, 59) if end else time())
    return to_utc_argument(value)


def in_range(ts: Column, start=None, end=None) -> Column:
    """Both ends inclusive; naive means UTC; a bare date covers the whole day."""
    low = None if start is None else _bound(start, False)
    high = None if end is None else _bound(end, True)
    if low is not None and high is not None and low > high:
        raise ValueError("start must not be after end")
    parts = []
    if low is not None:
        parts.append(ts >= F.lit(low.isoformat(" ")).cast("timestamp"))
    if high is not None:
        parts.append(ts <= F.lit(high.isoformat(" ")).cast("timestamp"))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def in_period(ts: Column, start, end) -> Column:
    """Half-open period, as splits use it."""
    low, high = _bound(start, False), _bound(end, False)
    return (ts >= F.lit(low.isoformat(" ")).cast("timestamp")) & (ts < F.lit(high.isoformat(" ")).cast("timestamp"))


def first_per_key(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of every key (Spark cuts each partition before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def series(rows: DataFrame, key: str, ts: str, key_value=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Oldest rows first; ``limit`` gives the first rows of the one key, or of every key."""
    chosen = matching(rows, **{key: key_value}).where(in_range(F.col(ts), start, end))
    if key_value is None:
        return chosen if limit is None else first_per_key(chosen, [key], [ts], limit)
    return chosen.orderBy(ts) if limit is None else chosen.orderBy(ts).limit(limit)


# --- alerts -----------------------------------------------------------------------


def find_alerts(alerts: DataFrame, sensor_id=None, method=None, anomaly_type=None, severity=None, resolved=None, start=None, end=None) -> DataFrame:
    """Alerts under any of seven optional predicates."""
    chosen = matching(alerts, sensor_id=sensor_id, method=method, anomaly_type=anomaly_type, severity=severity, resolved=resolved)
    return chosen.where(in_range(F.col("ts"), start, end))


def alert_page(alerts: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; sensor and method break ties."""
    return page(alerts, [F.col("ts").desc(), "sensor_id", "method"], limit, offset)


def building_alerts(alerts: DataFrame, resolved_sensors: DataFrame) -> DataFrame:
    return alerts.join(bounded(resolved_sensors.select("sensor_id", "building_id")), "sensor_id")


def alert_context(alerts: DataFrame, readings: DataFrame, hours: int) -> DataFrame:
    """Readings within ``hours`` of each alert.

    Both sides are cut into buckets as long as the window, so the join key is
    (sensor, bucket) and a sensor with very many alerts spreads over many keys.
    """
    width = 2 * hours * 3600
    at = F.unix_timestamp("alert_ts")
    centres = alerts.select("sensor_id", F.col("ts").alias("alert_ts"), "method").withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor((at - hours * 3600) / width), F.floor((at + hours * 3600) / width))),
    )
    placed = readings.select("sensor_id", "ts", "consumption_kwh", F.floor(F.unix_timestamp("ts") / width).alias("_bucket"))
    near = F.abs(F.unix_timestamp("ts") - at) <= hours * 3600
    return centres.join(placed, ["sensor_id", "_bucket"]).where(near).drop("_bucket")


def highest_alert(alerts: DataFrame) -> DataFrame:
    """The highest-scoring alert of every type (earliest on a tie)."""
    order = F.struct("score", -F.unix_timestamp("ts"), -F.col("sensor_id"))
    best = F.max_by(F.struct("sensor_id", "ts", "score"), order)
    return alerts.groupBy("anomaly_type").agg(best.alias("_b")).select("anomaly_type", "_b.*")


# --- forecasts --------------------------------------------------------------------

def complete_forecast(predictions: DataFrame, horizons: int = 24) -> DataFrame:
    """The rows of the first (sensor, origin) that has every horizon."""
    first = (
        predictions.groupBy("sensor_id", "generated_at")
        .agg(F.countDistinct("horizon").alias("_n"))
        .where(F.col("_n") == horizons)
        .agg(F.min(F.struct("sensor_id", "generated_at")).alias("_k"))
        .select("_k.*")
    )
    return predictions.join(first, ["sensor_id", "generated_at"], "left_semi")


def local_midnight(rows: DataFrame, ts: str, tz: str) -> DataFrame:
    """Origins whose local hour is 0."""
    return rows.where(F.hour(cal.local(F.col(ts), F.col(tz))) == 0)


def latest_origin(rows: DataFrame, key: str = "sensor_id", origin: str = "origin_ts") -> DataFrame:
    """Rows of the latest origin of each sensor.

    The maximum is pre-aggregated and joined back, so no sensor's rows meet in one task.
    """
    latest = rows.groupBy(key).agg(F.max(origin).alias(origin))
    return rows.join(latest, [key, origin], "left_semi")


def split_periods(rows: DataFrame, origin: str, bounds: dict[str, tuple]) -> dict[str, DataFrame]:
    """Train / validation / test by origin, so one origin's horizons stay together."""
    return {name: rows.where(in_period(F.col(origin), *period)) for name, period in bounds.items()}


def complete_cases(rows: DataFrame, required: list[str]) -> DataFrame:
    return rows.dropna(subset=required)


# --- top-k ------------------------------------------------------------------------

def top_peaks(readings: DataFrame, n: int = 10) -> DataFrame:
    """The n largest readings of every sensor, NULLs left out, earliest first on a tie."""
    if not 1 <= n <= MAX_TOP:
        raise ValueError(f"n must lie between 1 and {MAX_TOP}")
    present = readings.where(F.col("consumption_kwh").isNotNull())
    w = Window.partitionBy("sensor_id").orderBy(F.col("consumption_kwh").desc(), "ts")
    return present.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_rows(rows: DataFrame, column: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.coalesce(F.col(column), F.lit(0.0)).desc(), key).limit(n)
