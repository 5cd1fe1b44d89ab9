"""Detection job pieces shared by all detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

ALERT_COLUMNS = [
    "sensor_id", "ts", "method", "detector_version", "anomaly_type", "severity", "score",
    "expected_value", "actual_value", "residual", "explanation",
]


def union_alerts(*parts: DataFrame) -> DataFrame:
    """The detectors' outputs as one table; a detector without a residual gets NULL."""
    empty = F.lit(None).cast("double").alias("residual")
    padded = [p if "residual" in p.columns else p.select("*", empty) for p in parts]
    return reduce(DataFrame.unionByName, [p.select(*ALERT_COLUMNS) for p in padded])
