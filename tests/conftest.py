from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from joulegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """series(sensor, start, values): hourly readings; None is a NULL row, 'gap' no row."""

    def build(*parts):
        rows = []
        for sensor, start, values in parts:
            first = datetime.fromisoformat(start)
            for i, v in enumerate(values):
                if v != "gap":
                    rows.append((sensor, first + timedelta(hours=i), None if v is None else Decimal(str(round(v, 4)))))
        return spark.createDataFrame(rows, "sensor_id long, ts timestamp, consumption_kwh decimal(12,4)")

    return build


def column(rows, name, order="ts"):
    return [r[name] for r in rows.orderBy(order).collect()]
