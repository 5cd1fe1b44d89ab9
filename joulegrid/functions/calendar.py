"""Calendar expressions on UTC timestamps (local conversion takes a zone column)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GRANULARITIES = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def local(ts: Column, tz: Column) -> Column:
    """UTC instant -> wall clock of the given zone."""
    return F.from_utc_timestamp(ts, tz)


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_timestamp(ts) / 3600).cast("long")


def from_hour_number(hour: Column) -> Column:
    return F.timestamp_seconds(hour * 3600)


def day_of_week(ts: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def is_weekend(dow: Column) -> Column:
    return dow.isin(0, 6)


def truncation_unit(granularity: str) -> str:
    try:
        return GRANULARITIES[granularity]
    except KeyError:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITIES)}, got {granularity!r}") from None


def bucket(ts: Column, granularity: str) -> Column:
    """Start of the UTC hour, day, week (Monday) or month."""
    return F.date_trunc(truncation_unit(granularity), ts)


def shift_hours(ts: Column, hours: Column | int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts) + F.lit(hours) * 3600)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * F.pi() / F.lit(float(period)))
    return F.sin(angle), F.cos(angle)


CALENDAR_COLUMNS = [
    "hour", "day_of_week", "day_of_month", "month", "is_weekend",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
]


def calendar_columns(local_ts: Column) -> list[Column]:
    """The eleven calendar features of a local timestamp."""
    hour, dow, month = F.hour(local_ts), day_of_week(local_ts), F.month(local_ts)
    hs, hc = cyclic(hour, 24)
    ds, dc = cyclic(dow, 7)
    ms, mc = cyclic(month - 1, 12)
    values = [hour, dow, F.dayofmonth(local_ts), month, is_weekend(dow), hs, hc, ds, dc, ms, mc]
    return [value.alias(name) for value, name in zip(values, CALENDAR_COLUMNS)]
