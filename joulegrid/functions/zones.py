"""Wall clock -> UTC with explicit daylight-saving rules.

Spark's ``to_utc_timestamp`` picks one instant for an ambiguous time and moves a
non-existent one by the full gap. Here an ambiguous time is NULL and a non-existent
one becomes the first valid instant, both from expressions on a zone *column*, so one
pass covers every zone in the data.
"""

from __future__ import annotations

import zoneinfo
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_DAY = 86_400


def _offset(seconds: Column, tz: Column) -> Column:
    """UTC offset of a zone, in seconds, at an instant given in epoch seconds."""
    return F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)) - seconds


def _transition_after(seconds: Column, old_offset: Column, tz: Column) -> Column:
    """First instant within two days of ``seconds`` whose offset differs from ``old_offset``."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("long")
        old = _offset(middle, tz) == old_offset
        return F.struct(
            F.when(old, middle).otherwise(span["lo"]).alias("lo"),
            F.when(old, span["hi"]).otherwise(middle).alias("hi"),
        )

    start = F.struct(seconds.cast("long").alias("lo"), (seconds + 2 * _DAY).cast("long").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, halve)["hi"]


def with_utc(df: DataFrame, local_col: str, tz_col: str, out: str = "ts") -> DataFrame:
    """Add ``out`` (UTC instant or NULL) and ``<out>_ambiguous`` to ``df``."""
    tz = F.col(tz_col)
    wall = F.unix_timestamp(F.col(local_col).cast("timestamp"))
    before, after = _offset(wall - _DAY, tz), _offset(wall + _DAY, tz)
    staged = df.withColumns({"_wall": wall, "_before": before, "_after": after})
    wall, before, after = F.col("_wall"), F.col("_before"), F.col("_after")
    early_ok = _offset(wall - before, tz) == before
    late_ok = _offset(wall - after, tz) == after
    steady = before == after
    ambiguous = F.coalesce(~steady & early_ok & late_ok, F.lit(False))
    instant = (
        F.when(steady, wall - before)
        .when(early_ok & late_ok, F.lit(None).cast("long"))
        .when(early_ok, wall - before)
        .when(late_ok, wall - after)
        .otherwise(_transition_after(wall - before - _DAY, before, tz))
    )
    return staged.withColumns({out: F.timestamp_seconds(instant), f"{out}_ambiguous": ambiguous}).drop(
        "_wall", "_before", "_after"
    )


def known_zones(spark: SparkSession) -> DataFrame:
    """The IANA zone names, a fixed list of a few hundred rows."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "timezone string")


def to_utc_argument(value: datetime | str) -> datetime:
    """A query argument as naive UTC: naive means UTC, an offset is converted."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value
    return value.astimezone(timezone.utc).replace(tzinfo=None)
