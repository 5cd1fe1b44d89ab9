"""Day-ahead forecasts for submitted companies, many at once.

A company that breaks a rule goes to a rejection table with the first broken rule; the
others are forecast. Rules are grouped aggregates. The only ordered check works on
bounded time chunks, so no group is unbounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from joulegrid.forecasting import features as feat, models
from joulegrid.functions import text, zones
from joulegrid.session import written

MIN_ROWS = feat.LOOKBACK_HOURS
STEP_CHUNK_HOURS = 720
# fixed values: columns of a submission
FIELDS = ["building_code", "area_sqm", "number_of_floors", "occupants", "primary_use", "timezone"]
NUMBERS = ["area_sqm", "number_of_floors", "occupants"]
REJECTION = "building_code string, rule string, message string"


def _rule(name: str, broken: Column, message: Column) -> Column:
    return F.when(broken, F.struct(F.lit(name).alias("rule"), message.alias("message")))


def check_buildings(buildings: DataFrame) -> DataFrame:
    """One row per company with its fields and the first broken building rule."""
    code = F.trim("building_code")
    one = buildings.groupBy(code.alias("company")).agg(F.count("*").alias("_rows"), *[F.max(c).alias(c) for c in FIELDS])
    known = zones.known_zones(buildings.sparkSession).select(F.col("timezone").alias("_zone"), F.lit(True).alias("_known"))
    checked = one.join(known, F.trim("timezone") == F.col("_zone"), "left")
    blank = F.array_compact(F.array(*[F.when(text.is_blank(F.col(c)), F.lit(c)) for c in FIELDS]))
    numbers = {c: text.to_number(F.col(c)) for c in NUMBERS}
    bad = F.array_compact(F.array(*[F.when(n.isNull(), F.lit(c)) for c, n in numbers.items()]))
    small = F.array_compact(F.array(*[F.when(n <= 0, F.lit(c)) for c, n in numbers.items()]))
    broken = F.coalesce(
        _rule("one_building_row", F.col("_rows") != 1, F.format_string("expected exactly one building row, found %d", "_rows")),
        _rule("required_field", F.size(blank) > 0, F.concat(F.lit("missing required field(s): "), F.array_join(blank, ", "))),
        _rule("timezone", F.col("_known").isNull(), F.concat(F.lit("unknown time zone: "), F.col("timezone"))),
        _rule("numeric_field", F.size(bad) > 0, F.concat(F.lit("must be numeric: "), F.array_join(bad, ", "))),
        _rule("positive_field", F.size(small) > 0, F.concat(F.lit("must be positive: "), F.array_join(small, ", "))),
    )
    return checked.select(
        "company", *[n.alias(c) for c, n in numbers.items()],
        F.trim("primary_use").alias("primary_use"), F.trim("timezone").alias("tz"), broken.alias("_broken"),
    )


def parse_energy(energy: DataFrame) -> DataFrame:
    return energy.select(
        F.trim("building_code").alias("company"), F.col("timestamp").alias("_raw_ts"), F.col("energy_kwh").alias("_raw_kwh"),
        text.has_offset(F.col("timestamp")).alias("_offset"), text.to_wall_clock(F.col("timestamp")).alias("local_ts"),
        text.is_blank(F.col("energy_kwh")).alias("_blank"), text.to_number(F.col("energy_kwh")).alias("kwh"),
    )


def _counted_flags(rows: DataFrame, tests: dict[str, tuple[Column, Column]], *more: Column) -> DataFrame:
    """Per company how many rows each test flags, and its first example.

    The least of texts sorts its rows, so it is sought among flagged rows alone; sums need no sort.
    """
    counts = rows.groupBy("company").agg(*more, *[F.count_if(flag).alias(f"n_{name}") for name, (flag, _) in tests.items()])
    flagged = rows.where(reduce(lambda a, b: a | b, [F.coalesce(flag, F.lit(False)) for flag, _ in tests.values()]))
    examples = flagged.groupBy("company").agg(*[F.min(F.when(flag, example)).alias(f"eg_{name}") for name, (flag, example) in tests.items()])
    return counts.join(examples, "company", "left")


def _first_gap(stamps: DataFrame) -> DataFrame:
    """(company, _gap): the first two neighbouring stamps that are not one hour apart.

    Neighbours are found inside bounded time chunks; chunks meet by one row each.
    """
    chunk = F.floor(F.unix_timestamp(F.col("local_ts").cast("timestamp")) / (3600 * STEP_CHUNK_HOURS))
    placed = stamps.select("company", "local_ts", chunk.alias("_chunk"))
    inside = placed.withColumn("_previous", F.lag("local_ts").over(Window.partitionBy("company", "_chunk").orderBy("local_ts")))
    ends = placed.groupBy("company", "_chunk").agg(F.min("local_ts").alias("local_ts"), F.max("local_ts").alias("_last"))
    across = ends.withColumn("_previous", F.lag("_last").over(Window.partitionBy("company").orderBy("_chunk")))
    pairs = inside.select("company", "_previous", "local_ts").unionByName(across.select("company", "_previous", "local_ts"))
    step = F.unix_timestamp(F.col("local_ts").cast("timestamp")) - F.unix_timestamp(F.col("_previous").cast("timestamp"))
    return pairs.where(F.col("_previous").isNotNull() & (step != 3600)).groupBy("company").agg(F.min(F.struct("_previous", "local_ts")).alias("_gap"))


def check_energy(parsed: DataFrame, places: DataFrame, max_rows: int | None = None) -> DataFrame:
    """First broken energy rule per company, in the order the rules are documented.

    ``max_rows`` rejects longer submissions; without it any length is checked.
    """
    stamp = F.col("local_ts").cast("string")
    not_number = ~F.col("_blank") & F.col("kwh").isNull()
    tests = {
        "offset": (F.col("_offset"), F.col("_raw_ts")),
        "unparsed": (F.col("local_ts").isNull(), F.coalesce("_raw_ts", F.lit(""))),
        "blank": (F.col("_blank"), stamp),
        "text": (not_number, F.col("_raw_kwh")),
        "negative": (F.col("kwh") < 0, stamp),
    }
    basic = _counted_flags(parsed, tests, F.count("*").alias("_rows"))
    # rows, not repeated hours, are counted: three rows of one hour are two duplicates
    stamps = parsed.where(F.col("local_ts").isNotNull()).groupBy("company", "local_ts").agg(F.count("*").alias("_c"))
    repeated = stamps.where(F.col("_c") > 1).groupBy("company").agg(F.sum(F.col("_c") - 1).alias("n_duplicate"), F.min(stamp).alias("eg_duplicate"))
    steps = _first_gap(stamps)
    placed = zones.with_utc(
        stamps.join(places.select("company", "tz"), "company"), "local_ts", "tz", "ts"
    )
    utc = placed.groupBy("company", "ts").agg(F.count("*").alias("_c"), F.max("ts_ambiguous").alias("_ambiguous"), F.max("ts").alias("_ts"))
    shifted = utc.groupBy("company").agg(
        F.sum(F.when(F.col("_ambiguous"), F.col("_c")).otherwise(0)).alias("n_ambiguous"),
        F.count_if(F.col("_ts").isNotNull() & (F.col("_c") > 1)).alias("n_collision"),
    )
    joined = basic.join(repeated, "company", "left").join(steps, "company", "left").join(shifted, "company", "left")

    def counted(name: str, rule: str, words: str) -> Column:
        message = F.concat(F.col(f"n_{name}").cast("string"), F.lit(f" {words}, e.g. "), F.coalesce(f"eg_{name}", F.lit("")))
        return _rule(rule, F.col(f"n_{name}") > 0, message)

    broken = F.coalesce(
        *([_rule("too_many_rows", F.col("_rows") > max_rows, F.format_string(f"at most {max_rows} rows, got %d", "_rows"))] if max_rows else []),
        counted("offset", "naive_timestamp", "timestamp(s) carry a UTC offset"),
        counted("unparsed", "timestamp", "unreadable timestamp(s)"),
        counted("duplicate", "duplicate_timestamp", "duplicate timestamp(s)"),
        _rule("hourly_steps", F.col("_gap").isNotNull(), F.concat(
            F.lit("not hourly between "), F.col("_gap._previous").cast("string"), F.lit(" and "), F.col("_gap.local_ts").cast("string"))),
        counted("blank", "missing_kwh", "row(s) without energy_kwh"),
        counted("text", "numeric_kwh", "non-numeric energy_kwh value(s)"),
        counted("negative", "negative_kwh", "negative energy_kwh value(s)"),
        _rule("too_few_rows", F.col("_rows") < MIN_ROWS, F.format_string(f"at least {MIN_ROWS} rows, got %d", "_rows")),
        _rule("ambiguous_time", F.col("n_ambiguous") > 0, F.format_string("%d ambiguous local time(s)", "n_ambiguous")),
        _rule("utc_collision", F.col("n_collision") > 0, F.format_string("%d UTC hour(s) hit twice", "n_collision")),
    )
    return joined.select("company", "_rows", broken.alias("_broken"))


def validate(buildings: DataFrame, energy: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(static features, readings, rejections); ``sensor_id`` is the company code."""
    places = check_buildings(buildings)
    # every rule and the accepted readings read the same parsed rows, so they are written once
    parsed = written(parse_energy(energy))
    sound = places.where(F.col("_broken").isNull())
    facts = check_energy(parsed, sound, max_rows)
    verdict = places.select("company", F.col("_broken").alias("_place"), F.lit(True).alias("_has_place")).join(
        facts.select("company", F.col("_broken").alias("_energy"), F.lit(True).alias("_has_energy")), "company", "full_outer"
    )
    first = F.coalesce(
        "_place",
        _rule("one_building_row", F.col("_has_place").isNull(), F.lit("expected exactly one building row, found 0")),
        "_energy",
        _rule("too_few_rows", F.col("_has_energy").isNull(), F.lit(f"at least {MIN_ROWS} rows, got 0")),
    )
    # rejections, accepted companies and their readings all ask for the verdicts: one row per company, found once
    judged = written(verdict.select("company", first.alias("_r")))
    rejections = judged.where(F.col("_r").isNotNull()).select(F.col("company").alias("building_code"), "_r.rule", "_r.message")
    accepted = sound.join(judged.where(F.col("_r").isNull()), "company", "left_semi")
    static = accepted.select(
        F.col("company").alias("sensor_id"), F.col("company").alias("building_id"), F.col("company").alias("site_id"), "tz",
        "area_sqm", "primary_use", "number_of_floors", "occupants",
    )
    readings = zones.with_utc(parsed.join(accepted.select("company", "tz"), "company"), "local_ts", "tz", "ts").select(
        F.col("company").alias("sensor_id"), "ts", F.col("kwh").alias("consumption_kwh")
    )
    return static, readings, rejections


def use_warning(known: list[str]) -> Column:
    """Text for a use the model was not trained on; such a use is scored as all zeros."""
    message = F.concat(
        F.lit("primary_use '"), F.col("primary_use"), F.lit(f"' is not among the trained uses ({', '.join(sorted(known))}); treat this forecast as less certain")
    )
    return F.when(~F.col("primary_use").isin(known), message)


def forecast(
    buildings: DataFrame, energy: DataFrame, model: models.Model, model_name: str = "random_forest", version: str = "v1", max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecast rows, warnings, rejections). Only ``model.transform`` is called, nothing is fitted."""
    static, readings, rejections = validate(buildings, energy, max_rows)
    request = feat.latest_request(feat.origins(readings, static))
    # an unusable history shows as a company without any request row
    unusable = static.select(F.col("sensor_id").alias("building_code")).join(
        request.select(F.col("sensor_id").alias("building_code")).distinct(), "building_code", "left_anti"
    ).select("building_code", F.lit("forecast_origin").alias("rule"), F.lit(f"no local midnight with {MIN_ROWS} hours of history").alias("message"))
    rows = model.transform(request).select(
        F.col("sensor_id").alias("building_code"), "target_ts", "horizon", F.col(models.OUTPUT).alias("predicted_kwh"),
        F.lit(model_name).alias("model_name"), F.lit(version).alias("model_version"), F.col("origin_ts").alias("generated_at"),
    )
    warnings = static.select(F.col("sensor_id").alias("building_code"), use_warning(models.known_uses(model)).alias("warning")).where(F.col("warning").isNotNull())
    return rows, warnings, rejections.unionByName(unusable)
