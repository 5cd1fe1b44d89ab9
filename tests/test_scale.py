"""Plans that must hold when few input rows become very many."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from joulegrid.anomalies import rules
from joulegrid.catalog.jobs import _across_clock_changes
from joulegrid.catalog.standins import Tables
from joulegrid.forecasting import company
from joulegrid.operators import joins
from joulegrid.session import configure


def events(spark, path, users):
    rows = [(u, datetime(2024, 1, 1 + u % 20, u % 24, 30), "view" if u % 3 else "error", 1.5) for u in range(users)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return Tables(configure(spark), str(path))


def test_generated_hours_are_never_broadcast_by_an_estimate(spark, tmp_path):
    tables = events(spark, tmp_path, 20)
    plan = joins.with_actuals(tables.predictions(), tables.energy(), keep_missing=True)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hours_are_made_in_a_fixed_number_of_tasks_and_not_moved(spark, tmp_path):
    rows = events(spark, tmp_path, 40).dense()
    above, below = rows._jdf.queryExecution().executedPlan().toString().split("Union", 1)
    assert "Exchange" not in above and below.count("REPARTITION_BY_NUM") == 2  # which the adaptive planner leaves as it is
    assert rows.count() == 40 * 744 and rows.groupBy("sensor_id", "ts").count().where("count > 1").isEmpty()


def test_users_hours_and_values_may_be_null(spark, tmp_path):
    at = datetime(2024, 2, 3, 5, 10)
    rows = [(None, at, "view", 2.0), (1, None, "view", 3.0), (2, at, None, 4.0), (2, at, "view", None), (3, at, "error", 9.0), (3, at, "view", 1.25)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    base = Tables(configure(spark), str(tmp_path))._base()
    found = {(r.sensor_id, r.n, r.stamps) for r in base.groupBy("sensor_id").agg(F.count("*").alias("n"), F.count("ts").alias("stamps")).collect()}
    assert found == {(None, 29 * 24, 29 * 24), (1_000_001, 1, 0), (1_000_002, 29 * 24, 29 * 24), (1_000_003, 29 * 24, 29 * 24)}
    met = base.where("sensor_id = 1000003 AND ts = timestamp'2024-02-03 05:00:00'").first()
    assert met.error and met.other


def test_submitted_hours_are_dealt_before_they_are_made(spark, tmp_path):
    rows = [(k, f"c{k}", 0, 10.0, "BUILDING") for k in range(8)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    hours = _across_clock_changes(Tables(configure(spark), str(tmp_path)))
    above, below = hours._jdf.queryExecution().executedPlan().toString().split("Generate", 1)
    assert "Exchange" not in above and "REPARTITION_BY_NUM" in below
    assert hours.count() == 2 * (240 + 600 + 170 + 216)


def test_submitted_rows_are_parsed_once(spark):
    places = spark.createDataFrame([("a", "1", "2", "3", "use", "UTC")], ", ".join(f"{f} string" for f in company.FIELDS))
    energy = spark.createDataFrame([("a", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", str(h)) for h in range(240)], "building_code string, timestamp string, energy_kwh string")
    _, readings, rejections = company.validate(places, energy)
    # the submission is read from what was written after parsing
    assert readings.inputFiles() and rejections.inputFiles()
    assert readings.count() == 240 and rejections.isEmpty()


def test_runs_read_the_chunks_that_were_shuffled_once(spark, tmp_path):
    found = rules.detect(events(spark, tmp_path, 20).defects())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found.select("sensor_id", "ts", "score")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # hours of users twice, chunks, their hours and the neighbours' share: all of them once, not again for the border runs
    assert plan.count("Generate explode(sequence(") == 5 and "ReusedExchange" in plan


def test_companies_are_judged_once_and_examples_come_from_flagged_rows(spark):
    """Rejections read the written verdicts, not the submitted rows again; counts and examples as the rules say."""
    places = spark.createDataFrame([(c, "1", "2", "3", "use", "UTC") for c in ("twice", "text", "sound")], ", ".join(f"{f} string" for f in company.FIELDS))
    hours = [f"2024-01-{d:02d} {h:02d}:00:00" for d in range(1, 9) for h in range(24)]
    rows = [(c, s, "5") for c in ("twice", "sound") for s in hours] + [("twice", hours[9], "5")] * 2 + [("twice", hours[4], "6")]
    rows += [("text", s, {hours[5]: "x", hours[7]: "lots"}.get(s, "5")) for s in hours]
    energy = spark.createDataFrame(rows, "building_code string, timestamp string, energy_kwh string")
    _, readings, rejections = company.validate(places, energy)
    assert {r.building_code: (r.rule, r.message) for r in rejections.collect()} == {
        "twice": ("duplicate_timestamp", "3 duplicate timestamp(s), e.g. 2024-01-01 04:00:00"),
        "text": ("numeric_kwh", "2 non-numeric energy_kwh value(s), e.g. lots"),
    }
    assert readings.count() == len(hours)
    folders = {file.rpartition("/")[0] for file in rejections.inputFiles()}
    assert len(folders) == 1 and folders < {file.rpartition("/")[0] for file in readings.inputFiles()}
