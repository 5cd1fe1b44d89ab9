"""Mixes whose sources have documents of nearly equal size."""

from __future__ import annotations

import pytest

from joulegrid.llm import mixing


@pytest.mark.parametrize("share", [0.98, 0.985, 0.999, 1.985])
def test_nearly_equal_sizes_meet_a_target_near_the_whole(spark, share):
    rows = [(i, "a " * (100 + i % 8), "s") for i in range(800)] + [(1000 + i, "b " * (3 + i), "s") for i in range(3)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1.0,), share).toPandas()
    target = share * got["size"].sum()
    assert abs(got["target"].max() - target) < 1e-6 * target
    assert abs(got["taken"].sum() - target) <= 107
