"""Keyed upserts on parquet tables.

A fact table is partitioned by month, so an upsert rewrites only the months it touches.
The merged months are written beside the table first and then replace those partitions:
no job reads and overwrites the same files, and a repeated run gives the same table.
One exchange brings the old and the new rows of a key together in the task that writes their file.

The folder beside the table is the upsert's journal. A run that was killed left one: marked ready, its merge was
whole and the replacement is done again from it; without the mark the table was not touched and the folder goes.
One writer at a time per table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from joulegrid.schema import INGESTION_RUNS, struct
from joulegrid.session import delete, written

MONTH = "month"
ROWS_PER_FILE = 4_000_000


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def require(spark: SparkSession, path: str, job: str) -> DataFrame:
    table = read_or_none(spark, path)
    if table is None:
        raise FileNotFoundError(f"no table at {path}; run {job} first")
    return table


def merged(
    current: DataFrame, incoming: DataFrame, keys: list[str], update: list[str] | None = None, defaults: dict | None = None
) -> DataFrame:
    """``current`` with ``incoming`` upserted.

    Existing keys take only the ``update`` columns (default: all but the protected ones).
    Columns in ``defaults`` are protected: kept on existing keys, the default on new ones.
    """
    defaults = defaults or {}
    columns = [c for c in current.columns if c not in keys]
    update = [c for c in columns if c not in defaults] if update is None else update
    old = current.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    fresh = [F.lit(defaults[c]).alias(f"_i_{c}") if c in defaults else F.col(c).alias(f"_i_{c}") for c in columns]
    new = incoming.select(*keys, F.lit(True).alias("_new"), *fresh)

    def result(name: str) -> Column:
        mine, theirs = F.col(f"_c_{name}"), F.col(f"_i_{name}")
        taken = F.col("_new").isNotNull() if name in update else F.col("_old").isNull()
        return F.when(taken, theirs).otherwise(mine).cast(current.schema[name].dataType).alias(name)

    joined = old.join(new, keys, "full_outer")
    return joined.select(*keys, *[result(c) for c in columns]).select(*current.columns)


def reject_duplicates(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One statement may not hold a key twice."""
    repeated = incoming.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate key in one upsert: {repeated[0].asDict()}")
    return incoming


def _aligned(incoming: DataFrame, schema: str, keys: list[str], defaults: dict) -> DataFrame:
    given = set(incoming.columns)
    return incoming.select(
        *[
            (F.col(f.name) if f.name in given else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in struct(schema).fields
        ]
    )


READY = "ready"


def _swap(spark: SparkSession, path: str, staging: str, layout: list[str]) -> None:
    """Put the staged partitions, or the staged table, in the place of the old ones; doing it again moves what is left."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if layout:
        # their number is bounded by the calendar and the names
        moves = []
        for entry in store.globStatus(place("/".join([f"{staging}/out", *["*=*"] * len(layout)]))) or []:
            folders, at = [], entry.getPath()
            for _ in layout:
                folders, at = [at.getName(), *folders], at.getParent()
            target = place(path)
            for folder in folders:
                target = place(target, folder)
            moves.append((entry.getPath(), target))
        store.mkdirs(place(path))
    else:
        moves = [(place(f"{staging}/out"), place(path))] if exists(spark, f"{staging}/out") else []
    for ready, target in moves:
        store.delete(target, True)
        store.mkdirs(target.getParent())
        if not store.rename(ready, target):
            raise OSError(f"could not move {ready.toString()} to {target.toString()}")


def recover(spark: SparkSession, path: str, schema: str, keys: list[str], layout: list[str]) -> dict[str, int]:
    """Finish or undo upserts that ended half-way; returns how many of each."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_staging")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = {"finished": 0, "undone": 0}
    for entry in store.listStatus(folder) if store.exists(folder) else []:
        left = entry.getPath().toString()
        if exists(spark, f"{left}/{READY}"):
            _swap(spark, path, left, layout)
            done["finished"] += 1
        else:
            done["undone"] += 1
        delete(spark, left)
    return done


def _mark(spark: SparkSession, staging: str) -> None:
    """From here on the merge is whole."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging}/{READY}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark).close()


def _counts(rows: DataFrame, layout: list[str]) -> dict[tuple, int]:
    return {tuple(r[c] for c in layout): r["count"] for r in rows.groupBy(*layout).count().collect()}


def _together(rows: DataFrame, counts: dict[tuple, int], keys: list[str], layout: list[str]) -> DataFrame:
    """Every key in one task (``_task``), which holds one partition of the table or a slice of it, by a hash of the key."""
    spark, tasks, start = rows.sparkSession, [], 0
    for place, n in sorted(counts.items(), key=str):
        slices = max(1, -(-n // ROWS_PER_FILE))
        tasks.append((*place, start, slices))
        start += slices
    fields = ", ".join([*[f"_l_{c} string" for c in layout], "_start int", "_slices int"])
    places = F.broadcast(spark.createDataFrame(tasks, fields))
    same = F.lit(True)
    for c in layout:
        same &= F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    at = (F.col("_start") + F.pmod(F.xxhash64(*keys[:2]), F.col("_slices"))).cast("int")
    return rows.join(places, same).withColumn("_task", at).select(*rows.columns, "_task").repartitionById(max(1, start), "_task")


def _merged_in_place(both: DataFrame, counts: dict[tuple, int], keys: list[str], layout: list[str], update: list[str], seen: Observation) -> DataFrame:
    """What :func:`merged` gives, from the old rows and the new ones (``_new``) in one table, sorted by key.

    ``seen`` takes the most new rows of one key. Keys with a NULL meet no other row, as in a join.
    """
    absent = F.lit(False)
    for k in keys:
        absent |= F.col(k).isNull()
    rows = _together(both.withColumn("_apart", absent & F.col("_new")), counts, keys, layout)
    of_key = Window.partitionBy(*layout, *[k for k in keys if k not in layout], "_apart", "_task")
    columns = [c for c in both.columns if c != "_new"]
    fresh = F.first(F.when(F.col("_new"), F.struct(*update)), ignorenulls=True).over(of_key) if update else F.lit(None)
    met = rows.withColumns({"_arrivals": F.count_if("_new").over(of_key), "_rows": F.count("*").over(of_key), "_fresh": fresh})
    met = met.observe(seen, F.max("_arrivals").alias("most"))
    # a key that was there keeps its row, with the new values
    kept = met.where(~F.col("_new") | (F.col("_arrivals") == F.col("_rows")))
    taken = F.col("_arrivals") > 0
    return kept.select(*[F.when(taken, F.col(f"_fresh.{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in columns])


def upsert(
    spark: SparkSession, path: str, incoming: DataFrame, schema: str, keys: list[str],
    month_of: str | None = None, update: list[str] | None = None, defaults: dict | None = None, parts: tuple[str, ...] = (),
) -> dict[str, int]:
    """Upsert ``incoming`` into the table at ``path``; returns rows read and written.

    The table is partitioned by the key columns ``parts`` and by the month of ``month_of``.
    """
    defaults = defaults or {}
    layout = [*parts, MONTH] if month_of else [*parts]
    recover(spark, path, schema, keys, layout)
    rows = _aligned(incoming, schema, keys, defaults)
    staging = f"{path.rstrip('/')}_staging/{uuid.uuid4().hex}"
    if month_of:
        rows = rows.withColumn(MONTH, F.date_format(month_of, "yyyy-MM"))
    # the input is evaluated once; the merge and the checks read the written copy
    rows.write.partitionBy(*layout).parquet(f"{staging}/in")
    rows = spark.read.schema(rows.schema).parquet(f"{staging}/in")
    if month_of and month_of not in keys:
        reject_duplicates(rows, keys)  # the merge only sees those of one month
    fields = struct(schema).fields
    columns = [*[f.name for f in fields], *([MONTH] if month_of else [])]
    new_counts = _counts(rows, layout)
    read = sum(new_counts.values())
    counts = dict(new_counts)
    both = rows.select(
        *[(F.lit(defaults[f.name]) if f.name in defaults else F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields],
        *([MONTH] if month_of else []), F.lit(True).alias("_new"),
    )
    current = read_or_none(spark, path)
    if current is not None:
        current = current.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], *([MONTH] if month_of else []))
        for i, part in enumerate(layout):
            # only touched partitions are read; their number is bounded by the calendar and the names
            touched = sorted({place[i] for place in new_counts if place[i] is not None})
            current = current.where(F.col(part).isin(touched) if touched else F.lit(False)).withColumn(part, F.col(part).cast("string"))
        for place, n in _counts(current, layout).items():
            counts[place] = counts.get(place, 0) + n
        both = current.select(*columns, F.lit(False).alias("_new")).unionByName(both)
    update = [c for c in columns if c not in keys and c != MONTH and c not in defaults] if update is None else update
    seen = Observation()
    result = _merged_in_place(both, counts, keys, layout, update, seen)
    result.write.partitionBy(*layout).parquet(f"{staging}/out")
    if read and seen.get["most"] > 1:
        reject_duplicates(rows, keys)
    _mark(spark, staging)
    _swap(spark, path, staging, layout)
    delete(spark, staging)
    return {"read": read, "written": read}


def assign_ids(current: DataFrame, incoming: DataFrame, code: str, key: str, update: list[str]) -> DataFrame:
    """Dimension upsert by natural code: known codes keep their id, new ones get the next ids.

    Ids follow code order. The sorted new codes are written once, so their partitions stay
    fixed; rows are numbered inside partitions and shifted by the counts before them.
    """
    top = F.coalesce(current.agg(F.max(key)).scalar(), F.lit(0))
    new_codes = incoming.select(code).distinct().join(current.select(code), code, "left_anti")
    ordered = written(new_codes.orderBy(code).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(code))
    numbered = ordered.withColumn("_place", place).join(offsets, "_part").select(
        code, (F.col("_place") + F.col("_offset") + top).cast("long").alias(key)
    )
    ids = current.select(code, key).unionByName(numbered.select(code, key))
    keyed = incoming.join(ids, code)
    return merged(current, keyed, [key, code], update)


def append_audit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, INGESTION_RUNS).coalesce(1).write.mode("append").parquet(path)
