"""Meter tables derived from the driver's tables, in Spark and as SQL text.

The driver's data has no meters, so each user of ``events`` is a sensor. A sensor's hourly
reading is a daily load shape plus the user's event values of that hour; ``error`` events
cut real gaps. Everything grows with the number of users and events.

    dense     every hour of the sensor's months
    energy    dense without hours that only saw errors; NULL where an error met other events
    defects   dense with planted faults on every sensor
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from joulegrid.functions import calendar as cal
from joulegrid.operators import joins, lookups

SENSOR_BASE = 1_000_000
# hours of the calendar months that the events span
EXPECTED_SQL = "(SELECT CAST(date_diff('hour', date_trunc('month', min(ts)), date_trunc('month', max(ts)) + INTERVAL 1 MONTH) AS BIGINT) FROM events)"
START, END = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
PERIODS = {
    "train": (START, "2024-01-20 00:00:00"),
    "validation": ("2024-01-20 00:00:00", "2024-01-25 00:00:00"),
    "test": ("2024-01-25 00:00:00", END),
}
# fixed values: the zone of each region
ZONES = {
    "AFRICA": "Africa/Johannesburg",
    "AMERICA": "US/Eastern",
    "ASIA": "Asia/Kolkata",
    "EUROPE": "Europe/Berlin",
    "MIDDLE EAST": "Asia/Dubai",
}


def _units(user: Column, hour_ts: Column) -> Column:
    """Load shape in hundredths of a kWh."""
    hour, day = F.hour(hour_ts), F.dayofmonth(hour_ts)
    wobble = (31 * user + 17 * day + 7 * hour + (user * day) % 11) % 23
    return 2000 + 100 * (user % 17) + 150 * F.abs(12 - hour) + 13 * wobble


class Tables:
    """The derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")

    def customers(self) -> DataFrame:
        return self.raw("customer")

    def expected_hours(self) -> int:
        """Hours of the calendar months that the events span: one row to the driver."""
        first, last = F.date_trunc("month", F.min("ts")), F.date_trunc("month", F.max("ts")) + F.expr("interval 1 month")
        return self.events().agg(((F.unix_timestamp(last) - F.unix_timestamp(first)) / 3600).cast("long")).first()[0] or 0

    # --- facts

    def _base(self) -> DataFrame:
        events = self.events()
        error = F.col("event_type") == "error"
        cents = F.when(~error, F.round(F.col("value") * 100).cast("long")).otherwise(0)
        hourly = events.select("user_id", F.date_trunc("hour", "ts").alias("ts"), cents.alias("cents"), error.alias("error"), (~error).alias("other"))
        cell = [F.sum("cents").alias("cents"), F.max("error").alias("error"), F.max("other").alias("other")]
        # a few bytes per user become hundreds of rows: a fixed number of partitions keeps the adaptive planner from making
        # them in one task, and as both sides of the union are dealt by user the hours are added up where they are made
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        seen = hourly.groupBy("user_id", "ts").agg(*cell).repartition(partitions, "user_id")
        spans = seen.groupBy("user_id").agg(
            F.date_trunc("month", F.min("ts")).alias("lo"),
            (F.date_trunc("month", F.max("ts")) + F.expr("interval 1 month") - F.expr("interval 1 hour")).alias("hi"),
        )
        grid = spans.select(
            "user_id",
            F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts"),
            F.lit(0).cast("long").alias("cents"), F.lit(False).alias("error"), F.lit(False).alias("other"),
        )
        cells = seen.unionByName(grid).groupBy("user_id", "ts").agg(*cell)
        units = _units(F.col("user_id"), F.col("ts")) + F.col("cents")
        kwh = (units.cast("decimal(14,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(12,4)")
        return cells.select((F.col("user_id") + SENSOR_BASE).alias("sensor_id"), "ts", kwh.alias("consumption_kwh"), "error", "other")

    def dense(self) -> DataFrame:
        return self._base().select("sensor_id", "ts", "consumption_kwh")

    def energy(self) -> DataFrame:
        return self._base().where(~F.col("error") | F.col("other")).select(
            "sensor_id", "ts", F.when(~F.col("error"), F.col("consumption_kwh")).alias("consumption_kwh")
        )

    def defects(self) -> DataFrame:
        day, hour, x = F.dayofmonth("ts"), F.hour("ts"), F.col("consumption_kwh")
        at = (day - 1) * 24 + hour
        planted = (
            F.when((at >= 96) & (at < 132), F.lit(12.345))
            .when((day == 10) & hour.between(2, 5), F.lit(0.0))
            .when((day == 12) & (hour == 10), x.cast("double") * 8)
            .when((day == 14) & (hour == 7), F.lit(None))
            .when((day == 15) & (hour == 8), F.lit(-5.0))
            .otherwise(x.cast("double"))
        )
        return self.dense().withColumn("consumption_kwh", planted.cast("decimal(12,4)"))

    # --- dimensions

    def sites(self) -> DataFrame:
        zone = F.lit(None).cast("string")
        for region, name in ZONES.items():
            zone = F.when(F.col("r_name") == region, name).otherwise(zone)
        regions = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.customers()
            .groupBy(F.floor(F.col("c_custkey") / 10).cast("long").alias("site_id"))
            .agg(F.min("c_nationkey").alias("n_nationkey"))
            .join(regions, "n_nationkey")
            .select("site_id", F.concat(F.lit("site_"), "site_id").alias("site_code"), zone.alias("timezone"))
        )

    def buildings(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customers().select(
            key.alias("building_id"),
            F.col("c_name").alias("building_code"),
            F.floor(key / 10).cast("long").alias("site_id"),
            F.when(key % 13 != 0, F.col("c_mktsegment")).alias("primary_use"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).cast("decimal(10,2)").alias("area_sqm"),
            F.when(key % 3 == 0, 1 + key % 20).cast("int").alias("number_of_floors"),
            F.when(key % 2 == 0, 10 + key % 300).cast("int").alias("occupants"),
            F.lit(None).cast("int").alias("year_built"),
        )

    def sensors(self) -> DataFrame:
        return self.customers().select(
            (F.col("c_custkey") + SENSOR_BASE).alias("sensor_id"),
            F.col("c_custkey").alias("building_id"),
            F.lit("electricity").alias("meter_type"),
            F.lit("kWh").alias("unit"),
        )

    def resolved(self) -> DataFrame:
        return lookups.electricity_sensors(self.buildings(), self.sensors(), self.sites())

    def weather(self) -> DataFrame:
        def of(kind: str, ddl: str) -> Column:
            return F.max(F.when(F.col("event_type") == kind, F.col("value"))).cast(ddl)

        return (
            self.events()
            .groupBy(F.floor(F.col("user_id") / 10).cast("long").alias("site_id"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(
                of("view", "decimal(5,2)").alias("air_temp_c"),
                F.lit(None).cast("decimal(4,2)").alias("cloud_coverage"),
                of("signup", "decimal(5,2)").alias("dew_temp_c"),
                of("click", "decimal(5,2)").alias("wind_speed"),
            )
        )

    # --- derived facts

    def predictions(self, season: int = 24) -> DataFrame:
        dense = self.dense()
        horizon = F.when(F.hour("target_ts") == 0, 24).otherwise(F.hour("target_ts"))
        requests = dense.select("sensor_id", F.col("ts").alias("target_ts"))
        return (
            joins.seasonal_naive(requests, dense, season)
            .where(F.col("predicted_kwh").isNotNull())
            .select(
                "sensor_id", "target_ts",
                F.lit(f"seasonal_naive_{season}h").alias("model_name"), F.lit("v1").alias("model_version"),
                cal.shift_hours(F.col("target_ts"), -horizon).alias("generated_at"),
                horizon.alias("horizon"), F.col("predicted_kwh").cast("decimal(12,4)").alias("predicted_kwh"),
            )
        )

    def alerts(self) -> DataFrame:
        from joulegrid.anomalies import behavioural, detect, rules

        return detect.union_alerts(rules.detect(self.defects()), behavioural.detect(self.dense(), 4.0)).withColumn(
            "resolved", F.dayofmonth("ts") % 5 == 0
        )

    def truth(self) -> DataFrame:
        hour = cal.hour_number(F.col("ts"))
        kinds = F.array(*[F.lit(k) for k in TRUTH_TYPES])
        return (
            self.dense()
            .where((hour + 7 * F.col("sensor_id")) % 97 == 0)
            .select(
                "sensor_id", "ts",
                F.get(kinds, (hour % 6).cast("int")).alias("anomaly_type"),
                F.col("consumption_kwh").alias("original_value"),
                (F.col("consumption_kwh") * 3).cast("decimal(12,4)").alias("injected_value"),
            )
        )

    def wide(self) -> DataFrame:
        """One row per user and hour, one column per event type."""
        return (
            self.events()
            .groupBy("user_id", F.date_trunc("hour", "ts").alias("ts"))
            .pivot("event_type", WIDE_COLUMNS)
            .agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100))
        )


class StoredTables(Tables):
    """The same tables read back from a store, as after ingestion; used to time operators alone."""

    FACTS = ("dense", "energy", "defects", "weather", "truth", "predictions", "alerts")
    DIMENSIONS = ("sites", "buildings", "sensors")

    def __init__(self, spark: SparkSession, sf_dir: str, store: str):
        super().__init__(spark, sf_dir)
        self.store = store

    @classmethod
    def write(cls, spark: SparkSession, sf_dir: str, store: str) -> "StoredTables":
        source = Tables(spark, sf_dir)
        for name in (*cls.FACTS, *cls.DIMENSIONS):
            getattr(source, name)().write.mode("overwrite").parquet(f"{store}/{name}")
        return cls(spark, sf_dir, store)

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store}/{name}")


    def predictions(self, season: int = 24) -> DataFrame:
        return self._stored("predictions") if season == 24 else super().predictions(season)


for _name in (*(f for f in StoredTables.FACTS if f != "predictions"), *StoredTables.DIMENSIONS):
    setattr(StoredTables, _name, lambda self, n=_name: self._stored(n))


# fixed values: the six injected anomaly types
TRUTH_TYPES = ["spike", "drop", "sustained_high", "sustained_low", "stuck_meter", "zero_consumption"]
WIDE_COLUMNS = ["click", "error", "purchase", "signup", "view"]


# --- the same tables as SQL common table expressions -------------------------------

_CASE_ZONE = "CASE r_name " + " ".join(f"WHEN '{r}' THEN '{z}'" for r, z in ZONES.items()) + " END"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": (
        (),
        f"""SELECT g.user_id + {SENSOR_BASE} AS sensor_id, g.h AS ts,
          CAST((2000 + 100 * (g.user_id % 17) + 150 * abs(12 - hour(g.h))
            + 13 * ((31 * g.user_id + 17 * day(g.h) + 7 * hour(g.h) + (g.user_id * day(g.h)) % 11) % 23)
            + coalesce(e.cents, 0)) * 0.01 AS DECIMAL(12,4)) AS consumption_kwh,
          coalesce(e.err, false) AS err, coalesce(e.other, false) AS other
        FROM (SELECT user_id, unnest(generate_series(date_trunc('month', min(ts)),
                date_trunc('month', max(ts)) + INTERVAL 1 MONTH - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h
              FROM events GROUP BY user_id) g
        LEFT JOIN (SELECT user_id, date_trunc('hour', ts) AS h,
                sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS cents,
                bool_or(event_type = 'error') AS err, bool_or(event_type <> 'error') AS other
              FROM events GROUP BY 1, 2) e ON e.user_id = g.user_id AND e.h = g.h""",
    ),
    "dense": (("base",), "SELECT sensor_id, ts, consumption_kwh FROM base"),
    "energy": (
        ("base",),
        "SELECT sensor_id, ts, CASE WHEN NOT err THEN consumption_kwh END AS consumption_kwh FROM base WHERE NOT err OR other",
    ),
    "defects": (
        ("dense",),
        """SELECT sensor_id, ts, CAST(CASE
            WHEN (day(ts) - 1) * 24 + hour(ts) >= 96 AND (day(ts) - 1) * 24 + hour(ts) < 132 THEN 12.345
            WHEN day(ts) = 10 AND hour(ts) BETWEEN 2 AND 5 THEN 0
            WHEN day(ts) = 12 AND hour(ts) = 10 THEN consumption_kwh * 8
            WHEN day(ts) = 14 AND hour(ts) = 7 THEN NULL
            WHEN day(ts) = 15 AND hour(ts) = 8 THEN -5
            ELSE consumption_kwh END AS DECIMAL(12,4)) AS consumption_kwh FROM dense""",
    ),
    "sites": (
        (),
        f"""SELECT s.site_id, 'site_' || s.site_id AS site_code, {_CASE_ZONE} AS timezone
        FROM (SELECT c_custkey // 10 AS site_id, min(c_nationkey) AS nk FROM customer GROUP BY 1) s
        JOIN nation n ON n.n_nationkey = s.nk JOIN region r ON r.r_regionkey = n.n_regionkey""",
    ),
    "buildings": (
        (),
        """SELECT c_custkey AS building_id, c_name AS building_code, c_custkey // 10 AS site_id,
          CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS primary_use,
          CAST(CASE WHEN c_acctbal > 0 THEN c_acctbal END AS DECIMAL(10,2)) AS area_sqm,
          CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 20 END AS INTEGER) AS number_of_floors,
          CAST(CASE WHEN c_custkey % 2 = 0 THEN 10 + c_custkey % 300 END AS INTEGER) AS occupants,
          CAST(NULL AS INTEGER) AS year_built FROM customer""",
    ),
    "sensors": (
        (),
        f"SELECT c_custkey + {SENSOR_BASE} AS sensor_id, c_custkey AS building_id, 'electricity' AS meter_type, 'kWh' AS unit FROM customer",
    ),
    "resolved": (
        ("sites", "buildings", "sensors"),
        """SELECT b.building_id, m.sensor_id, b.site_id, s.timezone FROM sensors m
        JOIN buildings b ON b.building_id = m.building_id JOIN sites s ON s.site_id = b.site_id""",
    ),
    "weather": (
        (),
        """SELECT user_id // 10 AS site_id, date_trunc('hour', ts) AS ts,
          CAST(max(CASE WHEN event_type = 'view' THEN value END) AS DECIMAL(5,2)) AS air_temp_c,
          CAST(NULL AS DECIMAL(4,2)) AS cloud_coverage,
          CAST(max(CASE WHEN event_type = 'signup' THEN value END) AS DECIMAL(5,2)) AS dew_temp_c,
          CAST(max(CASE WHEN event_type = 'click' THEN value END) AS DECIMAL(5,2)) AS wind_speed
        FROM events GROUP BY 1, 2""",
    ),
    "localised": (
        ("energy", "resolved"),
        """SELECT e.*, r.building_id, r.site_id, r.timezone,
          (e.ts AT TIME ZONE 'UTC') AT TIME ZONE r.timezone AS lts
        FROM energy e JOIN resolved r ON r.sensor_id = e.sensor_id""",
    ),
    "predictions": (
        ("dense",),
        """SELECT a.sensor_id, a.ts AS target_ts, 'seasonal_naive_24h' AS model_name, 'v1' AS model_version,
          a.ts - to_hours(CASE WHEN hour(a.ts) = 0 THEN 24 ELSE hour(a.ts) END) AS generated_at,
          CAST(CASE WHEN hour(a.ts) = 0 THEN 24 ELSE hour(a.ts) END AS INTEGER) AS horizon,
          b.consumption_kwh AS predicted_kwh
        FROM dense a JOIN dense b ON b.sensor_id = a.sensor_id AND b.ts = a.ts - INTERVAL 24 HOUR""",
    ),
    "truth": (
        ("dense",),
        """SELECT sensor_id, ts, list_extract(['spike','drop','sustained_high','sustained_low','stuck_meter','zero_consumption'],
            CAST(epoch(ts) // 3600 AS BIGINT) % 6 + 1) AS anomaly_type,
          consumption_kwh AS original_value, CAST(consumption_kwh * 3 AS DECIMAL(12,4)) AS injected_value
        FROM dense WHERE (CAST(epoch(ts) // 3600 AS BIGINT) + 7 * sensor_id) % 97 = 0""",
    ),
    "wide": (
        (),
        "SELECT user_id, date_trunc('hour', ts) AS ts, "
        + ", ".join(
            f"sum(CASE WHEN event_type = '{k}' THEN CAST(round(value * 100) AS BIGINT) END) / 100.0 AS \"{k}\"" for k in WIDE_COLUMNS
        )
        + " FROM events GROUP BY 1, 2",
    ),
}


def define(name: str, needs: tuple[str, ...], body: str) -> None:
    """Make a further common table expression available to the oracle texts."""
    _CTES[name] = (needs, body)


def with_tables(body: str, *names: str) -> str:
    """Prefix ``body`` with the named tables and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    kept = {"base"}  # most texts refer to it several times
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in kept else ''}(\n{_CTES[n][1]}\n)" for n in order) + "\n" + body
