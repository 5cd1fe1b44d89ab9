"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every job assumes: UTC at rest, adaptive plans."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # an estimate counts the rows before an explode, so a side of millions of hours looks small enough to pass through
    # the driver: sides are broadcast by a hint on counted rows or by the measured size of their shuffle, never by estimate
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    # daily partitions are replaced one by one, never the whole table
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A temporary one stands in only on a single machine (``local[...]``); elsewhere executors could not
    read each other's files, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="joulegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the checkpoint folder: computed once, safe from lost executors."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store that this job wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            delete(table.sparkSession, file.rpartition("/")[0])


def local_session(cores: str = "*", app: str = "joulegrid", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
