"""Checks and parsing of submitted text values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed pattern: a trailing Z or a numeric UTC offset
OFFSET_SUFFIX = r"(?:Z|[+-]\d{2}:?\d{2})$"


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value) == "")


def has_offset(value: Column) -> Column:
    return F.coalesce(value.rlike(OFFSET_SUFFIX), F.lit(False))


def to_wall_clock(value: Column) -> Column:
    """Text -> local timestamp, NULL when it cannot be read."""
    return F.try_to_timestamp(F.trim(value)).cast("timestamp_ntz")


def to_number(value: Column) -> Column:
    """Text -> finite-or-NULL double."""
    number = F.trim(value).try_cast("double")
    return F.when(~F.isnan(number), number)
