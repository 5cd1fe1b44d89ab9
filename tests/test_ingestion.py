from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from joulegrid import schema
from joulegrid.functions.zones import to_utc_argument, with_utc
from joulegrid.operators import aggregates as ag, series as ser
from joulegrid.plans import ingestion, inspection
from joulegrid.sources import cleaning, files, tables


@pytest.mark.parametrize("local,zone,utc,ambiguous", [
    ("2016-06-01 12:00:00", "US/Eastern", "2016-06-01 16:00:00", False),
    ("2016-06-01 12:00:00", "Europe/London", "2016-06-01 11:00:00", False),
    ("2016-11-06 01:30:00", "US/Eastern", None, True),
    ("2016-11-06 00:59:59", "US/Eastern", "2016-11-06 04:59:59", False),
    ("2016-11-06 02:00:00", "US/Eastern", "2016-11-06 07:00:00", False),
    ("2016-03-13 02:30:00", "US/Eastern", "2016-03-13 07:00:00", False),
    ("2016-03-13 03:00:00", "US/Eastern", "2016-03-13 07:00:00", False),
    ("2016-10-02 02:15:00", "Australia/Lord_Howe", "2016-10-01 15:30:00", False),
    ("2016-04-03 01:45:00", "Australia/Lord_Howe", None, True),
    ("2016-01-15 12:00:00", "Asia/Kolkata", "2016-01-15 06:30:00", False),
])
def test_wall_clock_to_utc(spark, local, zone, utc, ambiguous):
    row = with_utc(spark.createDataFrame([(local, zone)], "s string, tz string").withColumn("l", F.col("s").cast("timestamp_ntz")), "l", "tz").first()
    assert (str(row.ts) if row.ts else None, row.ts_ambiguous) == (utc, ambiguous)


def test_arguments_are_utc():
    assert to_utc_argument("2016-01-01T00:00:00") == datetime(2016, 1, 1)
    assert to_utc_argument("2016-01-01T00:00:00-05:00") == datetime(2016, 1, 1, 5)


def long(spark, rows):
    return spark.createDataFrame([(c, datetime.fromisoformat(t), i, k) for c, t, i, k in rows], "building_code string, local_ts timestamp_ntz, ordinal long, consumption_kwh double")


def clean(spark, rows, zone="US/Eastern"):
    zones = spark.createDataFrame([("b1", zone), ("b2", zone)], "building_code string, timezone string")
    found, counters = cleaning.clean_readings(long(spark, rows), zones)
    return found, counters.first()


def test_negative_becomes_null(spark):
    found, counters = clean(spark, [("b1", "2016-06-01 00:00:00", 0, -5.0)])
    assert found.first().consumption_kwh is None and counters.negatives_rejected == 1


def test_first_of_duplicates_is_kept(spark):
    found, counters = clean(spark, [("b1", "2016-06-01 00:00:00", 0, 10.0), ("b1", "2016-06-01 00:00:00", 1, 99.0)])
    assert [float(r.consumption_kwh) for r in found.collect()] == [10.0] and counters.duplicates_dropped == 1


def test_ambiguous_is_dropped_and_counted(spark):
    found, counters = clean(spark, [("b1", "2016-11-06 01:30:00", 0, 1.0), ("b1", "2016-11-06 05:00:00", 1, 1.0)])
    assert found.count() == 1 and counters.ambiguous_dropped == 1 and counters.rows_in == 2


def test_counters_come_from_the_job_that_writes(spark, tmp_path):
    rows = [("b1", "2016-11-06 01:30:00", 0, 1.0), ("b1", "2016-11-06 05:00:00", 1, -1.0), ("b1", "2016-11-06 05:00:00", 2, 1.0), ("b2", "2016-11-06 05:00:00", 3, 4.0)]
    zones = spark.createDataFrame([("b1", "US/Eastern"), ("b2", "US/Eastern")], "building_code string, timezone string")
    found, counters = cleaning.observed_readings(long(spark, rows), zones)
    found.write.parquet(str(tmp_path / "out"))
    want = cleaning.clean_readings(long(spark, rows), zones)[1].first().asDict()
    assert counters() == want == {"rows_in": 4, "ambiguous_dropped": 1, "duplicates_dropped": 1, "negatives_rejected": 1, "rows_out": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_unpivot_keeps_null_rows(spark):
    wide = spark.createDataFrame([(datetime(2016, 1, 1), 10.0, 5.0, 1.0), (datetime(2016, 1, 1, 1), 12.0, None, 1.0)], "local_ts timestamp_ntz, b1 double, b2 double, other double")
    rows = ser.unpivot_readings(wide, ["local_ts"], ["b1", "b2"])
    assert rows.count() == 4 and rows.where("consumption_kwh IS NULL").count() == 1


def candidates(spark, sizes, rate=0.0):
    return spark.createDataFrame([(f"{s}{i}", s, rate + i / 1000) for s, n in sizes.items() for i in range(n)], "building_id string, site_id string, missing_rate double")


def test_selection_takes_smallest_sites(spark):
    chosen = ag.select_buildings(candidates(spark, {"A": 2, "B": 2, "C": 3, "D": 9}))
    assert {r.site_id for r in chosen.collect()} == {"A", "B", "C"} and chosen.count() == 7


def test_selection_cuts_the_last_site(spark):
    chosen = ag.select_buildings(candidates(spark, {"A": 4, "B": 9}), max_buildings=6).collect()
    assert sorted(r.building_id for r in chosen) == ["A0", "A1", "A2", "A3", "B0", "B1"]


def test_selection_minimum(spark):
    with pytest.raises(ValueError, match="below the minimum"):
        ag.require_minimum(ag.select_buildings(candidates(spark, {"A": 1})))


def test_candidates_need_flag_and_low_missing_rate(spark):
    metadata = spark.createDataFrame([("a", "S", "Yes"), ("b", "S", "No"), ("c", "S", None), ("d", "S", "Yes")], "building_id string, site_id string, electricity string")
    rates = spark.createDataFrame([("a", 0.01), ("b", 0.0), ("c", 0.0), ("d", 0.5)], "building_id string, missing_rate double")
    assert [r.building_id for r in ingestion.candidates(metadata, rates).collect()] == ["a"]


# --- upserts ----------------------------------------------------------------------------

def energy(spark, rows):
    return spark.createDataFrame([(s, datetime.fromisoformat(t), v) for s, t, v in rows], "sensor_id long, ts timestamp, consumption_kwh double")


def put(spark, path, rows):
    return tables.upsert(spark, path, energy(spark, rows), schema.ENERGY, schema.ENERGY_KEY, month_of="ts")


def test_upsert_replaces_and_keeps_other_months(spark, tmp_path):
    path = str(tmp_path / "energy")
    put(spark, path, [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-02-01 00:00:00", 2.0)])
    assert put(spark, path, [(1, "2016-02-01 00:00:00", 9.0), (2, "2016-02-01 00:00:00", 3.0)]) == {"read": 2, "written": 2}
    found = sorted((r.sensor_id, str(r.ts), float(r.consumption_kwh)) for r in spark.read.parquet(path).collect())
    assert found == [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-02-01 00:00:00", 9.0), (2, "2016-02-01 00:00:00", 3.0)]


def test_upsert_twice_is_the_same(spark, tmp_path):
    path = str(tmp_path / "energy")
    rows = [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-01-01 01:00:00", None)]
    put(spark, path, rows)
    put(spark, path, rows)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("step, kept", [("_mark", "undone"), ("_swap", "finished"), ("delete", "finished")])
def test_a_killed_upsert_is_finished_or_undone(spark, tmp_path, monkeypatch, step, kept):
    """The run dies before the mark, before the replacement or before the journal goes."""
    path = str(tmp_path / "energy")
    put(spark, path, [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-02-01 00:00:00", 2.0)])

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(tables, step, killed)
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, [(1, "2016-02-01 00:00:00", 9.0), (2, "2016-03-01 00:00:00", 3.0)])
    done = tables.recover(spark, path, schema.ENERGY, schema.ENERGY_KEY, [tables.MONTH])
    assert done[kept] == 1 and sum(done.values()) == 1
    february = 2.0 if kept == "undone" else 9.0
    want = [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-02-01 00:00:00", february)] + ([] if kept == "undone" else [(2, "2016-03-01 00:00:00", 3.0)])
    assert sorted((r.sensor_id, str(r.ts), float(r.consumption_kwh)) for r in spark.read.parquet(path).collect()) == want
    assert tables.recover(spark, path, schema.ENERGY, schema.ENERGY_KEY, [tables.MONTH]) == {"finished": 0, "undone": 0}


def test_the_next_upsert_recovers_first(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "energy")
    with monkeypatch.context() as broken:
        broken.setattr(tables, "_swap", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put(spark, path, [(1, "2016-01-01 00:00:00", 1.0), (2, "2016-01-01 00:00:00", 1.0)])
    put(spark, path, [(1, "2016-01-01 00:00:00", 5.0)])
    assert sorted((r.sensor_id, float(r.consumption_kwh)) for r in spark.read.parquet(path).collect()) == [(1, 5.0), (2, 1.0)]


def test_upsert_rejects_a_repeated_key(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate key"):
        put(spark, str(tmp_path / "energy"), [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-01-01 00:00:00", 2.0)])


def test_the_merge_writes_the_files_that_the_table_gets(spark, tmp_path, monkeypatch):
    """The staged files are moved into the table; they were read, dealt and written a second time."""
    path, staged = str(tmp_path / "energy"), []
    put(spark, path, [(1, "2016-01-01 00:00:00", 1.0), (1, "2016-02-01 00:00:00", 2.0)])
    mark = tables._mark

    def seen(session, staging):
        staged.extend(spark.read.parquet(f"{staging}/out").inputFiles())
        mark(session, staging)

    monkeypatch.setattr(tables, "_mark", seen)
    put(spark, path, [(1, "2016-02-01 00:00:00", 9.0), (2, "2016-02-01 00:00:00", 3.0), (2, "2016-03-01 00:00:00", 4.0)])
    now = {f.rsplit("/", 1)[1] for f in spark.read.parquet(path).inputFiles()}
    moved = {f.rsplit("/", 1)[1] for f in staged}
    assert moved and moved <= now


def test_merge_in_place_is_the_join(spark, monkeypatch):
    """Slices, repeated old keys, NULL keys and protected columns, beside the full outer join."""
    from pyspark.sql import Observation

    monkeypatch.setattr(tables, "ROWS_PER_FILE", 3)
    fields = "k long, m string, a int, b int"
    old = spark.createDataFrame([(1, "x", 1, 1), (1, "x", 2, 2), (2, "x", 3, 3), (None, "x", 4, 4), (None, "x", 5, 5), (3, "y", 6, 6)], fields)
    new = spark.createDataFrame([(1, "x", None, 70), (4, "x", 8, 80), (None, "x", 9, 90), (3, "x", 10, 100)], fields)
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    seen = Observation()
    got = tables._merged_in_place(both, {("x",): 9, ("y",): 1}, ["k"], ["m"], ["a"], seen)
    want = tables.merged(old, new, ["k", "m"], ["a"])
    assert sorted(map(str, got.select("k", "m", "a", "b").collect())) == sorted(map(str, want.select("k", "m", "a", "b").collect()))
    assert seen.get["most"] == 1


def test_resolved_survives_an_upsert(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alert = spark.createDataFrame([(1, datetime(2016, 1, 1), "m", "v1", "t", "high", 1.0, True)], "sensor_id long, ts timestamp, method string, detector_version string, anomaly_type string, severity string, score double, resolved boolean")
    tables.upsert(spark, path, alert, schema.ALERTS, schema.ALERT_KEY, month_of="ts")
    again = alert.drop("resolved").withColumn("score", F.lit(5.0))
    other = again.withColumn("method", F.lit("n"))
    tables.upsert(spark, path, again.unionByName(other), schema.ALERTS, schema.ALERT_KEY, month_of="ts", defaults={"resolved": False})
    found = {r.method: (float(r.score), r.resolved) for r in spark.read.parquet(path).collect()}
    assert found == {"m": (5.0, True), "n": (5.0, False)}


def test_ids_are_stable_and_follow_code_order(spark):
    current = spark.createDataFrame([(7, "b", "old")], "site_id long, site_code string, timezone string")
    incoming = spark.createDataFrame([("c", "z"), ("b", "new"), ("a", "z")], "site_code string, timezone string")
    found = tables.assign_ids(current, incoming, "site_code", "site_id", ["timezone"])
    assert {r.site_code: (r.site_id, r.timezone) for r in found.collect()} == {"b": (7, "new"), "a": (8, "z"), "c": (9, "z")}


# --- whole job --------------------------------------------------------------------------

@pytest.fixture()
def raw(tmp_path):
    start = datetime(2016, 3, 12)
    hours = [start + timedelta(hours=h) for h in range(48)]
    meta = ["building_id,site_id,timezone,primaryspaceusage,sqm,yearbuilt,electricity,extra"]
    meta += ["A1,A,US/Eastern,Office,100.5,1990.0,Yes,x", "A2,A,US/Eastern,,50,,Yes,x", "B1,B,Europe/London,Lodging,10,,Yes,x", "B2,B,Europe/London,Lodging,10,,No,x"]
    (tmp_path / "metadata.csv").write_text("\n".join(meta) + "\n")
    lines = ["timestamp,A1,A2,B1,B2,Z9"]
    for i, h in enumerate(hours):
        lines.append(f"{h},{i + 1},{'' if i == 3 else -1 if i == 4 else 2},{i},1,1")
    (tmp_path / "electricity.csv").write_text("\n".join(lines) + "\n")
    weather = ["timestamp,site_id,airTemperature,cloudCoverage,dewTemperature,precipDepth1HR,precipDepth6HR,seaLvlPressure,windDirection,windSpeed"]
    weather += [f"{h},{s},{i % 20}.5,,1,0,,1010.2,90,3.1" for s in "AB" for i, h in enumerate(hours)]
    weather.append(f"{hours[0]},A,99,,1,0,,1010.2,90,3.1")
    (tmp_path / "weather.csv").write_text("\n".join(weather) + "\n")
    return {k: str(tmp_path / f"{k}.csv") for k in ("metadata", "electricity", "weather")}


def load(spark, raw, out):
    return ingestion.run(spark, raw["metadata"], raw["electricity"], raw["weather"], out, min_buildings=2)


@pytest.fixture()
def relaxed(monkeypatch):
    monkeypatch.setattr(ingestion, "MAX_MISSING_RATE", 0.1)


def test_ingestion_end_to_end(spark, raw, tmp_path, relaxed):
    out = str(tmp_path / "db")
    first = load(spark, raw, out)
    stats = first["energy"]["stats"]
    # the spring gap maps 02:00 and 03:00 to one instant in the eastern zone only
    assert stats["negatives_rejected"] == 1 and stats["duplicates_dropped"] == 2 and stats["ambiguous_dropped"] == 0
    facts = spark.read.parquet(f"{out}/energy")
    assert facts.count() == 3 * 48 - 2 and facts.where("consumption_kwh IS NULL").count() == 2
    buildings = {r.building_code: r for r in spark.read.parquet(f"{out}/buildings").collect()}
    assert set(buildings) == {"A1", "A2", "B1"} and buildings["A1"].year_built == 1990 and buildings["A2"].year_built is None
    weather = spark.read.parquet(f"{out}/weather")
    assert weather.groupBy("site_id", "ts").count().where("count > 1").count() == 0
    before = rows(spark, out)
    load(spark, raw, out)
    assert rows(spark, out) == before
    runs = spark.read.parquet(f"{out}/ingestion_runs").collect()
    assert len(runs) == 6 and {r.status for r in runs} == {"success"}


def rows(spark, out):
    return {n: sorted(str(r) for r in spark.read.parquet(f"{out}/{n}").collect()) for n in ("sites", "buildings", "sensors", "energy", "weather")}


def test_failed_file_is_recorded_and_raised(spark, raw, tmp_path, relaxed):
    out = str(tmp_path / "db")
    with pytest.raises(Exception):
        ingestion.run(spark, raw["metadata"], raw["electricity"], str(tmp_path / "absent.csv"), out, min_buildings=2)
    runs = {r.source_file: r.status for r in spark.read.parquet(f"{out}/ingestion_runs").collect()}
    assert runs == {"metadata": "success", "readings": "success", "weather": "failed"}


def test_inspection(spark, raw):
    metadata = files.read_metadata(spark, raw["metadata"])
    wide = files.read_wide_readings(spark, raw["electricity"])
    profile = inspection.metadata_profile(metadata)
    assert profile["summary"].first().asDict() == {"rows": 4, "duplicate_ids": 0}
    assert {r.electricity: r.n for r in profile["electricity_flags"].collect()} == {"Yes": 3, "No": 1}
    assert inspection.readings_profile(wide)["missing_summary"].first().buildings == 5
    assert inspection.weather_profile(files.read_weather(spark, raw["weather"]))["summary"].first().duplicate_rows == 1
    codes = spark.createDataFrame([(c,) for c in files.building_codes(wide)], "building_id string")
    assert inspection.cross_check(metadata, codes).first().asDict() == {
        "metadata_ids": 4, "building_columns": 5, "in_both": 4, "metadata_only": 0, "columns_only": 1,
        "flagged": 3, "flagged_without_column": 0, "column_not_flagged": 2,
    }
    present = {r.column_name: r.present for r in inspection.column_presence(files.header(spark, raw["metadata"]), metadata).collect()}
    assert present["sqm"] and not present["lat"]


def test_a_wide_file_may_have_more_columns_than_a_plan_has_expressions(spark, tmp_path):
    codes = [f"b{i:05d}" for i in range(21_000)]
    path = str(tmp_path / "wide")
    gone = {("2016-01-01 00:00:00", "b00000"), ("2016-01-01 01:00:00", "b20999"), ("2016-01-01 01:00:00", "b00007")}
    stamps = spark.createDataFrame([("2016-01-01 00:00:00",), ("2016-01-01 01:00:00",)], "timestamp string")
    long = stamps.join(spark.range(len(codes)).select(F.format_string("b%05d", "id").alias("building_code"), F.col("id").cast("decimal(12,4)").alias("consumption_kwh")))
    files.write_wide_readings(long.where(~F.struct("timestamp", "building_code").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in gone])), path)
    assert files.header(spark, path) == ["timestamp", *codes]
    columns = files.wide_columns(spark, path)
    found = files.read_long_readings(spark, path, columns)
    assert found.count() == 2 * len(codes)
    assert {(str(r.local_ts), r.building_id) for r in found.where("consumption_kwh IS NULL").collect()} == gone
    assert found.where(F.col("consumption_kwh") != F.substring("building_id", 2, 5).cast("double")).isEmpty()
    rates = ingestion.missing_rates_of(found)
    assert sorted(tuple(r) for r in rates.where("missing_rate > 0").collect()) == [("b00000", 0.5), ("b00007", 0.5), ("b20999", 0.5)]


def test_long_readings_read_lines_as_the_wide_reader_does(spark, tmp_path):
    for name, lines in {
        "a": ['b1,"timestamp",b2', '1.5,2016-01-01 00:00:00,"2.5"', "", "NaN,2016-01-01 01:00:00,", "x,2016-01-01 02:00:00"],
        "b": ["b1,timestamp,b2", '"3",2016-01-01T03:00:00,1e2', "4,2016-01-01 04:00:00Z, 5", "6,bad,7", "8,,9"],
    }.items():
        (tmp_path / "wide").mkdir(exist_ok=True)
        (tmp_path / "wide" / f"{name}.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "wide")
    wide = cleaning.with_source_order(files.read_wide_readings(spark, path)).withColumnRenamed("timestamp", "local_ts")
    expected = ser.unpivot_readings(wide, ["local_ts", "ordinal"], ["b1", "b2"])
    found = files.read_long_readings(spark, path, files.wide_columns(spark, path))

    def plain(rows):
        file = F.element_at(F.split("ordinal.file", "/"), -1)
        return sorted(str(tuple(r)) for r in rows.select("local_ts", file, rows.columns[2], "consumption_kwh").collect())

    assert plain(found) == plain(expected) and len(plain(found)) == 14
    assert [r.consumption_kwh for r in found.where("building_id = 'b1' AND ordinal.file LIKE '%b.csv'").orderBy("ordinal").collect()] == [3.0, 4.0, 6.0, 8.0]
