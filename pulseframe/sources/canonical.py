"""Canonical telemetry tables from the driver's star-schema Parquet, and the same tables in DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import night_date, quantise
from ..store import kept, listing, utc_day

#: Fixed values of the fixture.
ZONES = ("UTC", "Asia/Kolkata", "Europe/Paris", "Asia/Kathmandu")
SOURCES = ("Apple Watch", "iPhone", "Scale", "Pod")
CUMULATIVE, CUTOVER = ("click", "view"), "2024-01-16 00:07:00"
FROM_DAY, TO_DAY = "2024-01-01", "2024-01-31"
SPORTS = ("Running", "Cycling", "Walking", "Hiking", "Rowing")
#: Regime and aggregation of each metric type of the fixture.
METRICS = {"click": ("cumulative", "sum"), "view": ("cumulative", "sum"), "purchase": ("raw", "average"), "signup": ("raw", "latest"), "error": ("category", "none")}


@dataclass
class Tables:
    """Canonical tables of one folder. Observations and minutes are derived once and kept by type and
    UTC day, and the dimensions as small tables, so that queries read the partitions that they ask for
    and dimensions are broadcast where their size allows; the others are lazy."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.read("events").select(
            "event_id", F.col("user_id").alias("subject_id"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").cast("decimal(18,2)").alias("v"), k.alias("k"), (k % 4).alias("source_id"), self.zone(F.col("user_id")).alias("tz"),
        )

    @staticmethod
    def zone(user):
        return F.element_at(F.array(*map(F.lit, ZONES)), (user % 4 + 1).cast("int"))

    def kept(self, name: str, df: DataFrame, *partitions: str) -> DataFrame:
        return kept(df, self.listing, name, partitions)

    @cached_property
    def listing(self) -> str:
        """What the folder's files are, so that tables derived from others are not taken for theirs."""
        return listing(self.spark, self.sf_dir)

    @cached_property
    def subjects(self) -> DataFrame:
        return self.kept("subjects", self.events.select("subject_id", "tz").distinct())

    @cached_property
    def observations(self) -> DataFrame:
        return self.kept("observations", self._observations().withColumn("utc_day", utc_day("start_ts")), "type", "utc_day")

    def _observations(self) -> DataFrame:
        e = self.events
        xml = (F.col("subject_id") % 2 == 1) | (F.col("ts") < F.lit(CUTOVER).cast("timestamp")) | (F.col("event_id") % 3 == 0)
        cumulative = F.col("type").isin(*CUMULATIVE)
        origin = F.when(cumulative, F.when(xml, "health_xml")).when(F.col("event_id") % 2 == 0, "hae").otherwise("health_xml")
        error = F.col("type") == "error"
        return e.withColumn("origin", origin).where("origin is not null").select(
            "event_id", "subject_id", "tz", "type", "source_id", F.col("ts").alias("start_ts"), F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("long") * 1_000_000).alias("end_ts"),
            F.when(~error, F.col("v")).alias("value"), F.when(~error, quantise(F.col("v").cast("double"), 1000)).alias("value_key"), F.when(error, F.col("k") % 2).alias("category_value"), "origin",
        )

    @cached_property
    def minutes(self) -> DataFrame:
        return self.kept("minutes", self._minutes().withColumn("utc_day", utc_day("minute_ts")), "type", "utc_day")

    def _minutes(self) -> DataFrame:
        e = self.events.where(F.col("type").isin(*CUMULATIVE) & (F.col("subject_id") % 2 == 0) & (F.col("ts") >= F.lit(CUTOVER).cast("timestamp")) & (F.col("event_id") % 3 != 0))
        top = F.max(F.struct("v", "source_id"))
        return e.groupBy("subject_id", "tz", "type", F.date_trunc("minute", "ts").alias("minute_ts")).agg(top.alias("t")).select("subject_id", "tz", "type", "minute_ts", F.col("t.v").alias("value"), F.col("t.source_id").alias("source_id"))

    @cached_property
    def cutovers(self) -> DataFrame:
        s = self.subjects.where("subject_id % 2 = 0").select("subject_id", F.explode(F.array(*map(F.lit, CUMULATIVE))).alias("type"))
        return self.kept("cutovers", s.withColumn("cutover_ts", F.lit(CUTOVER).cast("timestamp")))

    @cached_property
    def priorities(self) -> DataFrame:
        s = self.subjects.where("subject_id % 5 = 0").select("subject_id", F.explode(F.array(*map(F.lit, CUMULATIVE))).alias("type"))
        return self.kept("priorities", s.select("subject_id", "type", F.lit(1).alias("source_id"), F.lit(1).alias("rank")))

    @cached_property
    def sources(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(SOURCES)), "source_id int, name string")

    @cached_property
    def sleep_segments(self) -> DataFrame:
        return self.events.select(
            "subject_id", "tz", (F.col("event_id") % 2).cast("int").alias("source_id"), (F.col("k") % 6).alias("stage"), F.col("ts").alias("start_ts"),
            F.timestamp_micros(F.unix_micros("ts") + (F.col("k").cast("long") + 1) * 60_000_000).alias("end_ts"),
        )

    @cached_property
    def sleep_daily(self) -> DataFrame:
        e = self.events.where("subject_id % 3 = 0").withColumn("night", night_date(F.col("ts"), F.col("tz"))).where("night > date'2024-01-20'")
        s = lambda n: F.sum(F.col("k") * n)
        return e.groupBy("subject_id", "night").agg(
            F.lit(0).cast("long").alias("asleep_s"), s(60).alias("core_s"), s(30).alias("deep_s"), s(20).alias("rem_s"), s(5).alias("awake_s"), s(120).alias("in_bed_s"), F.min("ts").alias("sleep_start"), F.max("ts").alias("sleep_end"),
        )

    def _workouts(self, start) -> DataFrame:
        lines = self.read("lineitem").groupBy(F.col("l_orderkey").alias("workout_id")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
        n = self.subjects.agg(F.count("*").alias("n_users"))
        o = self.read("orders").crossJoin(F.broadcast(n)).select(
            F.col("o_orderkey").alias("workout_id"), (F.col("o_custkey") % F.col("n_users")).alias("subject_id"), start.alias("start_ts"), (F.lit(600) + F.col("o_orderkey") % 7200).cast("long").alias("duration_s"),
            F.element_at(F.array(*map(F.lit, SPORTS)), F.left("o_orderpriority", F.lit(1)).cast("int")).alias("activity"), "o_orderstatus", "o_totalprice",
        )
        o = o.join(lines, "workout_id", "left")
        return o.select(
            "workout_id", "subject_id", Tables.zone(F.col("subject_id")).alias("tz"), "activity", "start_ts", F.timestamp_seconds(F.unix_seconds("start_ts") + F.col("duration_s")).alias("end_ts"), "duration_s",
            F.when(F.col("o_orderstatus") != "P", F.col("q") * 100).cast("double").alias("distance_m"), (F.round(F.col("o_totalprice").cast("double"), 2) / 100).alias("energy_kj"),
            F.when(F.col("workout_id") % 3 == 0, F.col("q")).cast("double").alias("elevation_up_m"),
        )

    @cached_property
    def workouts(self) -> DataFrame:
        """January sessions, which overlap the events."""
        s = F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + (F.col("o_orderkey") % 30) * 86400 + (F.col("o_orderkey") * 7919) % 86400
        return self._workouts(F.timestamp_seconds(s))

    @cached_property
    def history(self) -> DataFrame:
        """The same sessions spread over years."""
        return self._workouts(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400))

    @cached_property
    def points(self) -> DataFrame:
        """Metres per minute of a session."""
        li = self.read("lineitem").select(F.col("l_orderkey").alias("workout_id"), F.col("l_linenumber").cast("int").alias("minute"), (F.col("l_quantity").cast("decimal(18,2)") * 20).alias("m"))
        return li.groupBy("workout_id", "minute").agg(F.sum("m").cast("double").alias("value"))

    @cached_property
    def batches(self) -> DataFrame:
        day = F.to_date("ts")
        b = self.events.groupBy("subject_id", day.alias("day")).agg(F.min("ts").alias("received_at"), (F.count("*") * 100).alias("body_bytes"), *[F.count_if(F.col("type") == t).alias(t) for t in ("click", "purchase")])
        status = F.element_at(F.array(*map(F.lit, ("received", "normalized", "rollups_ready", "rollups_ready", "failed"))), (F.dayofmonth("day") % 5 + 1).cast("int"))
        m = F.to_json(F.struct(F.struct(
            F.struct(F.col("click").alias("inserted"), (F.col("click") * 2).alias("minute_inserted"), F.lit(7).alias("skipped")).alias("click"),
            F.struct(F.col("purchase").alias("daily_upserted")).alias("purchase")).alias("metrics")))
        return b.withColumn("status", status).select("subject_id", "day", "received_at", "body_bytes", "status", F.when(F.col("status") != "received", m).alias("counts"))


#: The canonical tables as DuckDB common table expressions, written on their own from the fixture's text.
CANON = f"""
ev AS (SELECT event_id, user_id AS subject_id, event_type AS type, ts, CAST(value AS DECIMAL(18,2)) AS v,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS source_id,
  CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Kolkata' WHEN 2 THEN 'Europe/Paris' ELSE 'Asia/Kathmandu' END AS tz FROM events),
subj AS (SELECT DISTINCT subject_id, tz FROM ev),
obs0 AS (SELECT *, CASE WHEN type IN ('click', 'view') THEN CASE WHEN subject_id % 2 = 1 OR ts < TIMESTAMP '{CUTOVER}' OR event_id % 3 = 0 THEN 'health_xml' END
  WHEN event_id % 2 = 0 THEN 'hae' ELSE 'health_xml' END AS origin FROM ev),
obs AS (SELECT event_id, subject_id, tz, type, source_id, ts AS start_ts, ts + to_seconds(k) AS end_ts, CASE WHEN type <> 'error' THEN v END AS value,
  CASE WHEN type <> 'error' THEN CAST(floor(CAST(v AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS value_key,
  CASE WHEN type = 'error' THEN k % 2 END AS category_value, origin FROM obs0 WHERE origin IS NOT NULL),
mins AS (SELECT subject_id, tz, type, date_trunc('minute', ts) AS minute_ts, max(v) AS value, arg_max(source_id, (v, source_id)) AS source_id FROM ev
  WHERE type IN ('click', 'view') AND subject_id % 2 = 0 AND ts >= TIMESTAMP '{CUTOVER}' AND event_id % 3 <> 0 GROUP BY ALL),
cut AS (SELECT subject_id, t.type, TIMESTAMP '{CUTOVER}' AS cutover_ts FROM subj, (VALUES ('click'), ('view')) t(type) WHERE subject_id % 2 = 0),
prio AS (SELECT subject_id, t.type, 1 AS source_id, 1 AS rank FROM subj, (VALUES ('click'), ('view')) t(type) WHERE subject_id % 5 = 0),
src(source_id, name) AS (VALUES (0, 'Apple Watch'), (1, 'iPhone'), (2, 'Scale'), (3, 'Pod')),
seg AS (SELECT subject_id, tz, event_id % 2 AS source_id, k % 6 AS stage, ts AS start_ts, ts + to_seconds((k + 1) * 60) AS end_ts FROM ev),
sday AS (SELECT subject_id, CAST(timezone(tz, timezone('UTC', ts)) + INTERVAL 12 HOUR AS DATE) AS night, 0 AS asleep_s, sum(k * 60) AS core_s, sum(k * 30) AS deep_s, sum(k * 20) AS rem_s,
  sum(k * 5) AS awake_s, sum(k * 120) AS in_bed_s, min(ts) AS sleep_start, max(ts) AS sleep_end FROM ev WHERE subject_id % 3 = 0 GROUP BY 1, 2 HAVING night > DATE '2024-01-20'),
lq AS (SELECT l_orderkey AS workout_id, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY 1),
w0 AS (SELECT o_orderkey AS workout_id, o_custkey % (SELECT count(*) FROM subj) AS subject_id,
  TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER)) + to_seconds((o_orderkey * 7919) % 86400) AS jan,
  CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS hist, 600 + o_orderkey % 7200 AS duration_s,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'Running' WHEN '2' THEN 'Cycling' WHEN '3' THEN 'Walking' WHEN '4' THEN 'Hiking' WHEN '5' THEN 'Rowing' END AS activity,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(q * 100 AS DOUBLE) END AS distance_m, round(CAST(o_totalprice AS DOUBLE), 2) / 100 AS energy_kj,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(q AS DOUBLE) END AS elevation_up_m FROM orders LEFT JOIN lq ON workout_id = o_orderkey),
w1 AS (SELECT *, CASE subject_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Asia/Kolkata' WHEN 2 THEN 'Europe/Paris' ELSE 'Asia/Kathmandu' END AS tz FROM w0),
wk AS (SELECT *, jan AS start_ts, jan + to_seconds(duration_s) AS end_ts FROM w1),
wh AS (SELECT *, hist AS start_ts, hist + to_seconds(duration_s) AS end_ts FROM w1),
pts AS (SELECT l_orderkey AS workout_id, l_linenumber AS minute, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * 20) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
days AS (SELECT subject_id, tz, CAST(d AS DATE) AS day FROM subj, range(DATE '{FROM_DAY}', DATE '{TO_DAY}', INTERVAL 1 DAY) r(d))"""
