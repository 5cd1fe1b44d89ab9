"""Helpers shared by the training-data operators: reading, shared intermediates, words, row maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"
# Rows of one Arrow batch: whole texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
# ids of eight bytes that may be broadcast: some tens of MB in each executor
BROADCAST_IDS = 2_000_000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; none of them changes a result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    A session on one machine (``local[...]``) may use the checkpoint folder set on its context instead;
    on a cluster without a shared folder this is an error, since executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared folder and read back: survives lost executors, cuts lineage."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def few_ids(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """A stored one-column table of ids, broadcast only if it has at most ``bound`` rows.

    Texts that meet few ids then stay where they are; beyond the bound Spark's sort join moves them.
    """
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        for file in frame.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(rows: DataFrame, schema: str | T.StructType, body: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` whose body yields dicts of column lists in the order of ``schema``."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in body(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow],
                schema=arrow,
            )

    return rows.mapInArrow(run, kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column; a NULL text counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def uniform(seed: int, *keys: Column) -> Column:
    """A repeatable number in (0, 1) from the keys; NULL keys count as a value of their own."""
    parts = [F.coalesce(k.cast("string"), F.lit("\u0001")) for k in keys]
    digest = F.md5(F.concat_ws("\u0002", F.lit(str(seed)), *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def sampled_labels(labels: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows, chosen by hash; every class as often as in ``labels``."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Documents with their labels for a fit; the broadcast side has at most ``bound`` rows of a few numbers."""
    return docs.join(F.broadcast(sampled_labels(labels, bound)), "doc_id")
