"""Ordered-series operators on hourly readings.

Every frame here is bounded, so a sensor is cut into time chunks and each chunk also
receives the few hours around it that its frames reach into. One exchange by
(sensor, chunk) then serves all lags, leads and rolling statistics, and a sensor with
a very long or very dense history is never one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.functions import calendar as cal

# with the widest halo a chunk stays below the 4,096 rows a window keeps in its fast buffer
CHUNK_HOURS = 3_648

LAGS = (1, 2, 3, 24, 48, 168)
HORIZONS = tuple(range(1, 25))
BASELINE_DAYS = 14
MAD_SCALE = 1.4826
MIN_SPREAD = 1e-6

CHUNK = ["sensor_id", "chunk"]
_UNITS = 10_000  # readings carry four decimals, so this makes them whole numbers


def _chunk_of(hour: Column, chunk_hours: int) -> Column:
    return F.floor(hour / chunk_hours).cast("long")


def _hours(readings: DataFrame) -> DataFrame:
    return readings.select(
        "sensor_id", cal.hour_number(F.col("ts")).alias("hour_no"), F.col("consumption_kwh")
    )


def _grid_rows(hours: DataFrame, chunk_hours: int, zones: DataFrame | None = None) -> DataFrame:
    """Every hour between a sensor's first and last row, generated chunk by chunk.

    With ``zones`` (sensor_id, tz) each hour also knows whether it is a local midnight. The zone
    joins one row per sensor here, never the readings.
    """
    spans = hours.groupBy("sensor_id").agg(F.min("hour_no").alias("_first"), F.max("hour_no").alias("_last"))
    carried = []
    if zones is not None:
        spans, carried = spans.join(zones.select("sensor_id", "tz"), "sensor_id"), ["tz"]
    chunks = spans.withColumn(
        "_c", F.explode(F.sequence(_chunk_of(F.col("_first"), chunk_hours), _chunk_of(F.col("_last"), chunk_hours)))
    )
    # a few bytes per chunk become thousands of rows: a fixed number of partitions keeps the
    # adaptive planner from merging them into a handful of tasks
    partitions = int(hours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(partitions, "sensor_id", "_c")
    start = F.greatest(F.col("_first"), F.col("_c") * chunk_hours)
    end = F.least(F.col("_last"), F.col("_c") * chunk_hours + (chunk_hours - 1))
    rows = chunks.select("sensor_id", *carried, F.explode(F.sequence(start, end)).alias("hour_no"))
    rows = rows.withColumn("consumption_kwh", F.lit(None).cast(hours.schema["consumption_kwh"].dataType))
    if zones is None:
        return rows
    midnight = F.hour(cal.local(cal.from_hour_number(F.col("hour_no")), F.col("tz"))) == 0
    return rows.withColumn("is_origin", midnight).drop("tz")


def chunked_grid(
    readings: DataFrame, before: int, after: int, chunk_hours: int = CHUNK_HOURS, zones: DataFrame | None = None
) -> DataFrame:
    """Gap-free hours in chunks, each with ``before`` / ``after`` hours of its neighbours.

    Rows that belong to the chunk have ``own`` = true; the others only feed frames. With
    ``zones`` the rows carry ``is_origin``, true at the sensor's local midnights.
    """
    hours = _hours(readings)
    grid = _grid_rows(hours, chunk_hours, zones)
    aggregates = [F.max("consumption_kwh").alias("consumption_kwh")]
    if zones is not None:
        hours = hours.withColumn("is_origin", F.lit(False))
        aggregates.append(F.max("is_origin").alias("is_origin"))
    home = _chunk_of(F.col("hour_no"), chunk_hours)
    reach = F.sequence(_chunk_of(F.col("hour_no") - after, chunk_hours), _chunk_of(F.col("hour_no") + before, chunk_hours))
    spread = hours.unionByName(grid).withColumn("chunk", F.explode(reach))
    return (
        spread.repartition(*CHUNK)
        .groupBy(*CHUNK, "hour_no")
        .agg(*aggregates)
        .withColumn("own", F.col("chunk") == home)
    )


def hourly_grid(readings: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """One row per sensor and hour between its first and last reading; gaps are NULL."""
    hours = _hours(readings)
    grid = _grid_rows(hours, chunk_hours)
    return (
        hours.unionByName(grid)
        .groupBy("sensor_id", "hour_no")
        .agg(F.max("consumption_kwh").alias("consumption_kwh"))
        .select("sensor_id", cal.from_hour_number(F.col("hour_no")).alias("ts"), "consumption_kwh")
    )


def in_chunk() -> "Window":
    return Window.partitionBy(*CHUNK).orderBy("hour_no")


def own_rows(chunked: DataFrame, *columns: str) -> DataFrame:
    return chunked.where("own").select(
        "sensor_id", cal.from_hour_number(F.col("hour_no")).alias("ts"), *columns
    )


def settle(rows: DataFrame, *columns: str) -> DataFrame:
    """Compute ``columns`` once, here.

    A later filter on a deeply nested column would be pushed down with the whole expression
    written out, array by array. Passing the values through a one-element generator keeps
    the filter above it; rows and values do not change.
    """
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns))))


def add_lags(chunked: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """lag_k is the value at T-k+1, so lag_1 is the origin's own value."""
    w, x = in_chunk(), F.col("consumption_kwh").cast("double")
    return chunked.withColumns({f"lag_{k}": F.lag(x, k - 1).over(w) if k > 1 else x for k in lags})


def add_targets(chunked: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    w, x = in_chunk(), F.col("consumption_kwh").cast("double")
    return chunked.withColumns({f"target_h{h}": F.lead(x, h).over(w) for h in horizons})


def add_rolling(chunked: DataFrame) -> DataFrame:
    """24 h mean and deviation and 168 h mean of strictly earlier hours, full windows only.

    The means are differences of running sums of whole units: exact, and constant work
    per row instead of one pass over 168 rows for each.
    """
    w = in_chunk()
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    units = F.round(F.col("consumption_kwh") * _UNITS).cast("long")
    staged = chunked.withColumn("_units", units).withColumns(
        {
            "_sum": F.coalesce(F.sum("_units").over(running), F.lit(0)),
            "_n": F.count("_units").over(running),
            "_std24": F.stddev_samp(F.col("consumption_kwh").cast("double")).over(w.rowsBetween(-24, -1)),
        }
    )
    staged = staged.withColumns(
        {f"_sum{n}": F.lag("_sum", n).over(w) for n in (24, 168)} | {f"_n{n}": F.lag("_n", n).over(w) for n in (24, 168)}
    )

    def full(n: int) -> Column:
        return F.col("_n") - F.col(f"_n{n}") == n

    def mean(n: int) -> Column:
        return F.when(full(n), (F.col("_sum") - F.col(f"_sum{n}")).cast("double") / F.lit(float(n * _UNITS)))

    return staged.withColumns(
        {
            "rolling_24h_mean": mean(24),
            "rolling_24h_std": F.when(full(24), F.col("_std24")),
            "rolling_168h_mean": mean(168),
        }
    ).drop("_units", "_sum", "_n", "_std24", "_sum24", "_sum168", "_n24", "_n168")


def add_baseline(chunked: DataFrame, days: int = BASELINE_DAYS) -> DataFrame:
    """Median and MAD of the previous ``days`` readings at the same UTC hour, and the robust z.

    On a gap-free grid those readings sit exactly 24, 48, .. rows back, so the ordering
    of the other features is reused and no second sort by hour is needed.
    """
    w, x = in_chunk(), F.col("consumption_kwh").cast("double")
    past = F.sort_array(F.array(*[F.lag(x, 24 * day).over(w) for day in range(1, days + 1)]))

    def middle(column: str) -> Column:
        return (F.get(column, F.lit((days - 1) // 2)) + F.get(column, F.lit(days // 2))) / 2

    # each step is its own column, so a sorted array is built once per row; NULLs sort first
    staged = chunked.withColumn("_past", past).withColumn(
        "baseline_median", F.when(F.get("_past", F.lit(0)).isNotNull(), middle("_past"))
    )
    spread = F.sort_array(F.array(*[F.abs(F.get("_past", F.lit(i)) - F.col("baseline_median")) for i in range(days)]))
    staged = staged.withColumn("_spread", spread).withColumn("baseline_mad", middle("_spread"))
    scale = F.col("baseline_mad") * MAD_SCALE
    staged = staged.withColumn("z_score", F.when(scale > MIN_SPREAD, (x - F.col("baseline_median")) / scale))
    return settle(staged.drop("_past", "_spread"), "baseline_median", "baseline_mad", "z_score")


class _Rows:
    """Rows in the order of chunk and hour, ``at`` being those asked for; a frame ends where their chunk does."""

    def __init__(self, table: pa.Table, asked: np.ndarray):
        n, starts = len(table), np.zeros(len(table), dtype=bool)
        for key in CHUNK:
            number = pc.fill_null(pc.index_in(table[key], pc.unique(table[key])), -1).to_numpy()
            starts[1:] |= number[1:] != number[:-1]
        self.table, self.at = table, asked
        self.begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))  # the first row of each row's chunk
        kwh = table["consumption_kwh"].combine_chunks()
        self.known, self.x = kwh.is_valid().to_numpy(zero_copy_only=False), kwh.fill_null(0.0).to_numpy()
        self._sums = np.concatenate([[0], np.cumsum(table["units"].fill_null(0).to_numpy())])
        self._seen = np.concatenate([[0], np.cumsum(self.known)])

    def value(self, hours: int) -> tuple[np.ndarray, np.ndarray]:
        """The reading so many hours later (earlier, if negative), and whether there is one."""
        there = self.at + hours
        place = np.clip(there, 0, len(self.x) - 1)
        return self.x[place], self.known[place] & (place == there) & (self.begin[place] == self.begin[self.at])

    def _full(self, hours: int) -> np.ndarray:
        first = np.maximum(self.at - hours, 0)
        return (self.at - hours >= self.begin[self.at]) & (self._seen[self.at] - self._seen[first] == hours)

    def rolling(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        day = self.x[np.maximum(self.at[:, None] - np.arange(1, 25), 0)]
        day = day - day[:, :1]  # equal readings deviate by exactly nothing
        out = {"rolling_24h_mean": None, "rolling_24h_std": (day.std(axis=1, ddof=1), self._full(24))}
        for hours in (24, 168):
            total = self._sums[self.at] - self._sums[np.maximum(self.at - hours, 0)]
            out[f"rolling_{hours}h_mean"] = (total / float(hours * _UNITS), self._full(hours))
        return out

    def baseline(self, days: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        back = self.at[:, None] - 24 * np.arange(1, days + 1)
        there = (back[:, -1] >= self.begin[self.at]) & self.known[np.maximum(back, 0)].all(axis=1)
        past, low, high = np.sort(self.x[np.maximum(back, 0)], axis=1), (days - 1) // 2, days // 2
        median = (past[:, low] + past[:, high]) / 2
        spread = np.sort(np.abs(past - median[:, None]), axis=1)
        mad = (spread[:, low] + spread[:, high]) / 2
        scale = mad * MAD_SCALE
        wide = scale > MIN_SPREAD
        z = (self.x[self.at] - median) / np.where(wide, scale, 1.0), wide & there & self.known[self.at]
        return {"baseline_median": (median, there), "baseline_mad": (mad, there), "z_score": z}


def _framed(chunked: DataFrame, wanted: str, before: int, after: int, columns: list[str], frames: Callable[[_Rows], dict]) -> DataFrame:
    """The rows with ``wanted``, and ``columns`` (doubles) that ``frames`` makes of the readings of their chunk.

    The same frames as windows, but in arrays over many chunks at once, for the rows asked for alone: some twenty
    window functions a row cost far more than the few sums and sorts behind them. The exchange of the chunks leaves
    each whole in one partition; a batch is read together with rows around it as far as a frame reaches.
    """
    x = F.col("consumption_kwh")
    units = F.round(x * _UNITS).cast("long").alias("units")
    rows = chunked.select(*CHUNK, "hour_no", F.expr(wanted).alias("asked"), x.cast("double").alias("consumption_kwh"), units)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = None, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                table = fresh if table is None else pa.concat_tables([table, fresh])
            elif table is None:
                return
            until = max(done, len(table) - (after if batch is not None else 0))
            asked = done + np.flatnonzero(table["asked"].fill_null(False).to_numpy()[done:until])
            if len(asked):
                found = frames(_Rows(table, asked))
                out = table.select(["sensor_id", "hour_no"]).take(asked)
                for name in columns:
                    out = out.append_column(name, pa.array(found[name][0], mask=~found[name][1]))
                yield from out.to_batches()
            first = max(0, until - before)
            table, done = table.slice(first), until - first

    schema = ", ".join([f"sensor_id {chunked.schema['sensor_id'].dataType.simpleString()}", "hour_no long", *[f"{c} double" for c in columns]])
    framed = rows.sortWithinPartitions(*CHUNK, "hour_no").mapInArrow(body, schema)
    return framed.select("sensor_id", cal.from_hour_number(F.col("hour_no")).alias("ts"), *columns)


def _own_in(hours: tuple[int, int] | None) -> str:
    """The rows asked for: a chunk's own, and only hours of a half-open range of hour numbers, if one is given."""
    return "own" if hours is None else f"own AND hour_no >= {hours[0]} AND hour_no < {hours[1]}"


def baseline_frames(chunked: DataFrame, hours: tuple[int, int] | None = None) -> DataFrame:
    """Own rows with reading, lag_2, the columns of :func:`add_rolling` and the z of :func:`add_baseline`."""

    def frames(rows: _Rows) -> dict:
        return {"consumption_kwh": rows.value(0), "lag_2": rows.value(-1), **rows.rolling(), **rows.baseline(BASELINE_DAYS)}

    columns = ["consumption_kwh", "lag_2", "rolling_24h_mean", "rolling_24h_std", "rolling_168h_mean", "z_score"]
    return _framed(chunked, _own_in(hours), 24 * BASELINE_DAYS, 0, columns, frames)


def deviation_frames(chunked: DataFrame, days: int = BASELINE_DAYS, hours: tuple[int, int] | None = None) -> DataFrame:
    """Own rows with reading and the columns of :func:`add_baseline`."""

    def frames(rows: _Rows) -> dict:
        return {"consumption_kwh": rows.value(0), **rows.baseline(days)}

    columns = ["consumption_kwh", "baseline_median", "baseline_mad", "z_score"]
    return _framed(chunked, _own_in(hours), 24 * days, 0, columns, frames)


def origin_frames(chunked: DataFrame, columns: list[str], lags: tuple[int, ...] = LAGS, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Own origins with the columns of :func:`add_lags`, :func:`add_targets` and :func:`add_rolling`."""

    def frames(rows: _Rows) -> dict:
        return {f"lag_{k}": rows.value(1 - k) for k in lags} | {f"target_h{h}": rows.value(h) for h in horizons} | rows.rolling()

    return _framed(chunked, "own AND is_origin", max(168, *lags), max(horizons), columns, frames)


def with_positions(rows: DataFrame, keys: list[str], ts: str, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Add ``position`` (1, 2, .. per key in time order) without one task per key.

    Rows are numbered inside time chunks; the chunk counts, a tiny table, give the offsets.
    """
    staged = rows.withColumn("_chunk", _chunk_of(cal.hour_number(F.col(ts)), chunk_hours))
    counts = staged.groupBy(*keys, "_chunk").agg(F.count("*").alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(ts))
    return (
        staged.withColumn("_local", local)
        .join(offsets, [*keys, "_chunk"])
        .withColumn("position", F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_local", "_offset")
    )


def in_position_chunks(positioned: DataFrame, before: int, chunk_rows: int = CHUNK_HOURS) -> DataFrame:
    """Chunks of consecutive positions, each preceded by the last ``before`` rows."""
    home = F.floor(F.col("position") / chunk_rows).cast("long")
    last = F.floor((F.col("position") + before) / chunk_rows).cast("long")
    return positioned.withColumn("chunk", F.explode(F.sequence(home, last))).withColumn("own", F.col("chunk") == home)


def equal_runs(chunked: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Add ``run_length``, ``run_start``, ``run_end`` of the maximal run of equal readings.

    ``chunked`` needs one hour of look-back. Runs are found inside chunks; only the first
    and last run of each chunk, two rows, are stitched across chunk borders.
    """
    w, x = in_chunk(), F.col("consumption_kwh")
    piece = Window.partitionBy(*CHUNK, "_run")
    starts = ~x.eqNullSafe(F.lag(x).over(w)) | F.lag("hour_no").over(w).isNull()
    marked = (
        chunked.withColumn("_starts", starts)
        .withColumn("_run", F.sum((F.col("own") & F.col("_starts")).cast("int")).over(w))
        .where("own")
    )
    # equal neighbours only matter for readings at or above zero
    usable = F.coalesce(x >= 0, F.lit(False))
    pieces = (
        marked.groupBy(*CHUNK, "_run")
        .agg(F.count("*").alias("_n"), F.min("hour_no").alias("_lo"), F.max("hour_no").alias("_hi"), F.max(usable).alias("_usable"))
        .where(
            (F.col("_lo") == F.col("chunk") * chunk_hours)
            | (F.col("_hi") == F.col("chunk") * chunk_hours + (chunk_hours - 1))
        )
    )
    over_time = Window.partitionBy("sensor_id").orderBy("chunk", "_run")
    stitched = pieces.withColumn("_joint", F.sum((F.col("_run") > 0).cast("int")).over(over_time))
    whole = Window.partitionBy("sensor_id", "_joint")
    totals = (
        stitched.withColumns(
            {"_total": F.sum("_n").over(whole), "_from": F.min("_lo").over(whole), "_to": F.max("_hi").over(whole)}
        )
        .where(F.col("_usable") & (F.col("_total") > F.col("_n")))
        # at most two entries per chunk; joining on the chunk alone keeps the rows where they are
        .groupBy(*CHUNK)
        .agg(F.collect_list(F.struct("_run", "_total", "_from", "_to")).alias("_longer"))
    )
    # a join's test for NULL keys on this side alone would keep both sides from sharing the chunks' exchange
    totals = settle(totals, *CHUNK)
    local = marked.withColumns(
        {"_n": F.count("*").over(piece), "_lo": F.min("hour_no").over(piece), "_hi": F.max("hour_no").over(piece)}
    )
    entry = F.get(F.filter("_longer", lambda e: e["_run"] == F.col("_run")), F.lit(0))
    joined = local.join(totals, CHUNK, "left").withColumn("_whole", F.when(F.col("_longer").isNotNull(), entry))
    return joined.select(
        *chunked.columns,
        F.coalesce("_whole._total", "_n").alias("run_length"),
        cal.from_hour_number(F.coalesce("_whole._from", "_lo")).alias("run_start"),
        cal.from_hour_number(F.coalesce("_whole._to", "_hi")).alias("run_end"),
    )


def unpivot_readings(wide: DataFrame, id_columns: list[str], codes: list[str], name: str = "building_code") -> DataFrame:
    """One column per building -> one row per building and timestamp; NULLs stay."""
    return wide.unpivot(id_columns, codes, name, "consumption_kwh")


def melt_horizons(origins: DataFrame, keep: list[str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per origin with target_h columns -> one row per (origin, horizon)."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_h{h}").alias("target_kwh")) for h in horizons])
    return origins.select(*keep, F.inline(pairs)).withColumn("target_ts", cal.shift_hours(F.col("origin_ts"), F.col("horizon")))
