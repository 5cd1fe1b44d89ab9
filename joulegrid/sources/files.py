"""Raw files: explicit schemas in, partitioned files out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from joulegrid import schema
from joulegrid.functions import text
from joulegrid.operators import joins
from joulegrid.sources import cleaning

# fixed values: columns of submitted and returned files
ENERGY_COLUMNS = ["timestamp", "energy_kwh"]
BUILDING_COLUMNS = ["building_code", "area_sqm", "number_of_floors", "occupants", "primary_use", "timezone"]
FORECAST_COLUMNS = ["building_code", "target_ts", "horizon", "predicted_kwh", "model_name", "model_version", "generated_at"]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line only."""
    return [name.strip().strip('"') for name in spark.read.text(path).first()[0].split(",")]


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV by column name under an explicit schema; columns outside the schema are not parsed."""
    wanted = {f.name: f for f in schema.struct(ddl).fields}
    present = header(spark, path)
    full = ", ".join(f"`{n}` {wanted[n].dataType.simpleString() if n in wanted else 'string'}" for n in present)
    rows = spark.read.schema(full).csv(path, header=True, nanValue="NaN")
    return rows.select(*[F.col(f"`{n}`") if n in present else F.lit(None).cast(f.dataType).alias(n) for n, f in wanted.items()])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.METADATA_CSV)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema.WEATHER_CSV)


def read_wide_readings(spark: SparkSession, path: str) -> DataFrame:
    """Timestamp plus one double column per building; the schema comes from the header line."""
    names = header(spark, path)
    ddl = ", ".join(f"`{n}` {'timestamp_ntz' if n == 'timestamp' else 'double'}" for n in names)
    return spark.read.schema(ddl).csv(path, header=True)


def wide_columns(spark: SparkSession, path: str) -> DataFrame:
    """The building columns of a wide file: ``place`` in a line and ``building_id``."""
    names = header(spark, path)
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("the wide file names a column twice")
    return spark.createDataFrame([(i, n) for i, n in enumerate(names) if n != "timestamp"], "place int, building_id string")


def read_long_readings(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame:
    """The given columns of a wide file as one row per line and building, in source order.

    Lines are split as text: a column of its own for every building would put as many expressions into the plan.
    """
    names = header(spark, path)
    line, stamp = F.col("value"), F.col("_stamp")
    quoted = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')  # looks ahead to the line's end: only where there are quotes
    cells = F.when(line.contains('"'), F.transform(quoted, lambda c: F.btrim(c, F.lit('"')))).otherwise(F.split(line, ","))
    short = F.greatest(F.lit(len(names)) - F.size("_cells"), F.lit(0))
    lines = cleaning.with_source_order(spark.read.text(path)).where(F.btrim("value") != "").select("ordinal", cells.alias("_cells"))
    stamped = lines.withColumn("_stamp", F.get("_cells", F.lit(names.index("timestamp")))).where(F.btrim("_stamp").eqNullSafe("timestamp") == F.lit(False))
    rows = stamped.select(
        F.when(~text.has_offset(stamp), stamp.try_cast("timestamp_ntz")).alias("local_ts"), "ordinal",
        F.posexplode(F.when(short > 0, F.concat("_cells", F.array_repeat(F.lit(None).cast("string"), short))).otherwise(F.col("_cells"))).alias("place", "_cell"),
    )
    return rows.join(joins.bounded(columns), "place").select("local_ts", "ordinal", "building_id", F.col("_cell").try_cast("double").alias("consumption_kwh"))


def write_wide_readings(long: DataFrame, path: str) -> None:
    """(timestamp, building_code, consumption_kwh) as a wide file: a line per timestamp, a column per building, every part with the header.

    A line is joined from its readings in the columns' order, with the commas of the columns between them.
    """
    spark = long.sparkSession
    codes = sorted(r[0] for r in long.select("building_code").distinct().collect())  # the header of the wide file
    head, last = ",".join(["timestamp", *codes]), len(codes)
    places = spark.createDataFrame([(i + 1, c) for i, c in enumerate(codes)], "place int, building_code string")
    cells = long.groupBy("timestamp", "building_code").agg(F.first("consumption_kwh").cast("string").alias("cell")).join(joins.bounded(places), "building_code")
    ordered = cells.groupBy("timestamp").agg(F.sort_array(F.collect_list(F.struct("place", "cell"))).alias("_cells"))

    def cell(entry, i):
        before = F.coalesce(F.get("_cells", i - 1)["place"], F.lit(0))
        return F.concat(F.repeat(F.lit(","), entry["place"] - before), F.coalesce(entry["cell"], F.lit("")))

    rest = F.repeat(F.lit(","), F.lit(last) - F.element_at("_cells", -1)["place"])
    lines = ordered.select("timestamp", F.concat(F.coalesce("timestamp", F.lit("")), F.array_join(F.transform("_cells", cell), ""), rest).alias("value"))

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": [head]})
        yield from batches

    lines.repartitionByRange("timestamp").sortWithinPartitions("timestamp").select("value").mapInArrow(headed, "value string").write.text(path)


def building_codes(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c != "timestamp"]


def _text_columns(spark: SparkSession, path: str, required: list[str], label: str) -> DataFrame:
    """All columns as text; a missing required column is an error that names it."""
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{label} lacks required column(s): {', '.join(missing)}; needed: {', '.join(required)}")
    return rows


def read_companies(spark: SparkSession, building_path: str, energy_path: str) -> tuple[DataFrame, DataFrame]:
    """Submissions of many companies; both files carry ``building_code``."""
    buildings = _text_columns(spark, building_path, BUILDING_COLUMNS, "building file").select(*BUILDING_COLUMNS)
    energy = _text_columns(spark, energy_path, ["building_code", *ENERGY_COLUMNS], "energy file")
    return buildings, energy.select("building_code", *ENERGY_COLUMNS)


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """One folder per company, rows ordered by horizon."""
    rows = forecasts.select(*FORECAST_COLUMNS)
    rows.repartition("building_code").sortWithinPartitions("building_code", "horizon").write.mode("overwrite").partitionBy(
        "building_code"
    ).option("header", True).csv(path)
