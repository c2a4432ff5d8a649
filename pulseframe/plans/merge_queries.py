"""Queries of ingestion: deduplication, matching, upserts, authority, identity and rollup upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units as U
from ..functions.timefns import iso_date, push_date
from ..operators import merge as M
from ..operators import series as S
from ..sources.canonical import CUMULATIVE, METRICS, Tables
from ..store import scratch_path
from ..streaming import authority
from .registry import query
from .series_queries import ROLLUP_SQL, built


@query("unit_conversion", """SELECT event_id, round(CAST(v AS DOUBLE) * 1.609344, 9) AS km, round(CAST(v AS DOUBLE) * 4.184, 9) AS kj, round((CAST(v AS DOUBLE) - 32) / 1.8, 9) AS celsius, CAST(NULL AS DOUBLE) AS nothing FROM ev""")
def unit_conversion(t: Tables):
    """H17."""
    c = lambda a, b: F.round(U.convert(F.col("v").cast("double"), F.lit(a), F.lit(b)), 9)
    return t.events.select("event_id", c("mi", "km").alias("km"), c("kcal", "kJ").alias("kj"), c("degF", "degC").alias("celsius"), c("kg", "km").alias("nothing"))


@query("batch_dedup", "SELECT subject_id, type, source_id, k, min(event_id) AS event_id FROM ev GROUP BY 1, 2, 3, 4")
def batch_dedup(t: Tables):
    """C11: the first row of each key in a batch."""
    return M.first_of_batch(t.events.select("subject_id", "type", "source_id", "k", "event_id"), ["subject_id", "type", "source_id", "k"], [F.col("event_id")])


@query("history_dedup", "SELECT event_id, subject_id, type FROM obs o WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM obs h WHERE h.event_id % 2 = 1 AND h.subject_id = o.subject_id AND h.type = o.type AND h.source_id = o.source_id AND h.category_value IS NOT DISTINCT FROM o.category_value)")
def history_dedup(t: Tables):
    """An anti-join on keys where null equals null."""
    o = t.observations
    return M.not_in_history(o.where("event_id % 2 = 0"), o.where("event_id % 2 = 1"), ["subject_id", "type", "source_id", "category_value"]).select("event_id", "subject_id", "type")


@query("interval_coverage", "h AS (SELECT subject_id, type, min(start_ts) AS a, max(start_ts) AS b FROM obs WHERE origin = 'health_xml' GROUP BY 1, 2) SELECT event_id, o.subject_id, o.type FROM obs o LEFT JOIN h USING (subject_id, type) WHERE origin = 'hae' AND (a IS NULL OR start_ts < a OR start_ts > b)")
def interval_coverage(t: Tables):
    """B10."""
    o = t.observations
    return M.outside_coverage(o.where("origin = 'hae'"), o.where("origin = 'health_xml'")).select("event_id", "subject_id", "type")


@query("minute_upsert", """i AS (SELECT subject_id, type, minute_ts, value + CASE WHEN epoch(minute_ts) % 120 = 0 THEN 1 ELSE 0 END AS value FROM mins), e AS (SELECT * FROM mins WHERE source_id <> 3)
SELECT i.subject_id, i.type, CASE WHEN e.value IS NULL THEN 'inserted' WHEN e.value <> i.value THEN 'updated' ELSE 'duplicate' END AS outcome, count(*) AS n FROM i LEFT JOIN e USING (subject_id, type, minute_ts) GROUP BY 1, 2, 3""")
def minute_upsert(t: Tables):
    """A10: outcomes of a minute batch against what is there."""
    i = t.minutes.withColumn("id", F.unix_seconds("minute_ts")).withColumn("value", F.col("value") + F.when(F.unix_seconds("minute_ts") % 120 == 0, 1).otherwise(0))
    return M.upsert_minutes(i, t.minutes.where("source_id <> 3")).groupBy("subject_id", "type", "outcome").agg(F.count("*").alias("n"))


@query("cutover_bootstrap", "SELECT subject_id, type, strftime(min(minute_ts), '%Y-%m-%d %H:%M:%S') AS cutover_ts, arg_min(source_id, (minute_ts, source_id)) AS device_id FROM mins GROUP BY 1, 2")
def cutover_bootstrap(t: Tables):
    """D35."""
    m = t.minutes.withColumn("device_id", F.col("source_id"))
    return M.bootstrap_cutovers(m, t.spark.createDataFrame([], "subject_id long, type string, cutover_ts timestamp, device_id int"))


@query("device_authority", """c AS (SELECT subject_id, type, min(minute_ts) + INTERVAL 1 DAY AS cutover_ts, arg_min(source_id, (minute_ts, source_id)) AS authority FROM mins GROUP BY 1, 2), e AS (SELECT * FROM mins WHERE epoch(minute_ts) % 120 = 0)
SELECT m.subject_id, m.type, CASE WHEN m.minute_ts < cutover_ts THEN 'before_cutover' WHEN m.source_id = authority THEN 'write' WHEN e.value = m.value THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n FROM mins m JOIN c USING (subject_id, type) LEFT JOIN e ON e.subject_id = m.subject_id AND e.type = m.type AND e.minute_ts = m.minute_ts GROUP BY 1, 2, 3""")
def device_authority(t: Tables):
    """One authoritative device; others' minutes are duplicates or quarantined conflicts."""
    m = t.minutes.withColumn("device_id", F.col("source_id"))
    state = M.bootstrap_cutovers(m, t.spark.createDataFrame([], "subject_id long, type string, cutover_ts timestamp, device_id int")).withColumn("cutover_ts", F.col("cutover_ts") + F.expr("INTERVAL 1 DAY"))
    out = M.judge_minutes(m, state, t.minutes.where(F.unix_seconds("minute_ts") % 120 == 0))
    return out.groupBy("subject_id", "type", "outcome").agg(F.count("*").alias("n"))


@query("rollup_drain", ROLLUP_SQL + """ SELECT subject_id, type, strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS hour_utc, n, CAST(sum AS DOUBLE) AS sum, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max FROM q4""")
def rollup_drain(t: Tables):
    """A rollup built before the last tenth of the rows came, brought up to date by ranges; only the
    rows of their hours are read into the rebuild."""
    ranges = t.kept("drain_queue", M.dirty_ranges(t.observations.where("event_id % 10 = 9"), ["error"]))
    old = t.kept("rollup_before", built(t, t.observations.where("event_id % 10 <> 9")), "type")
    hours = M.hours_of(ranges)
    obs, minutes = M.of_hours(t.observations, hours, "start_ts"), M.of_hours(t.minutes, hours, "minute_ts")
    rebuilt = S.build_rollup(obs, minutes, t.cutovers, t.priorities, t.sources, list(CUMULATIVE), ["purchase", "signup"])
    return M.apply_rollup(old, rebuilt, hours)


def matchable(t: Tables):
    """Incoming and existing samples whose values are coarse, so that many share one."""
    o = t.observations.where("type in ('purchase', 'signup')").withColumn("id", F.col("event_id")).withColumn("value_key", F.floor(F.col("value_key") / 100_000))
    far = o.withColumn("start_ts", F.date_trunc("minute", "start_ts"))
    return o.where("origin = 'hae'"), far.where("event_id % 3 <> 0")


@query("channel_match")
def channel_match(t: Tables):
    """One-to-one closest matches across channels; compared with a plain version in the tests."""
    incoming, existing = matchable(t)
    return M.match_across(incoming, existing, "existing")


@query("authority_stream", """base AS (SELECT subject_id, type, minute_ts, CAST(value AS DOUBLE) AS value, source_id % 2 AS device, CAST(epoch(minute_ts) AS BIGINT) // 60 % 3 AS b FROM mins),
r AS (SELECT * FROM base UNION ALL SELECT subject_id, type, minute_ts, value + CASE WHEN CAST(epoch(minute_ts) AS BIGINT) % 120 = 0 THEN 1 ELSE 0 END, 9, b + 1 FROM base),
f AS (SELECT subject_id, type, arg_min(device, (b, device)) AS owner, min((b, device)) AS first FROM r GROUP BY 1, 2),
c AS (SELECT f.subject_id, f.type, owner, min(minute_ts) AS cutover FROM f JOIN r ON r.subject_id = f.subject_id AND r.type = f.type AND (r.b, r.device) = f.first GROUP BY 1, 2, 3),
h AS (SELECT r.subject_id, r.type, r.minute_ts, r.value FROM r JOIN c ON r.subject_id = c.subject_id AND r.type = c.type WHERE device = owner AND minute_ts >= cutover)
SELECT r.subject_id, r.type, CASE WHEN device = owner THEN CASE WHEN r.minute_ts < cutover THEN 'before_cutover' ELSE 'inserted' END WHEN h.value = r.value THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n
FROM r JOIN c ON r.subject_id = c.subject_id AND r.type = c.type LEFT JOIN h ON h.subject_id = r.subject_id AND h.type = r.type AND h.minute_ts = r.minute_ts GROUP BY 1, 2, 3""")
def authority_stream(t: Tables):
    """Device authority as state of a stream that takes four batches, late minutes among them; a ninth device sends each
    minute again a batch later, every second one with another value."""
    device, at = (F.col("source_id") % 2).cast("long"), F.unix_seconds("minute_ts")
    base = t.minutes.select("subject_id", "type", "minute_ts", F.col("value").cast("double").alias("value"), device.alias("device_id"), F.floor(at / 60).cast("long").alias("m"))
    echo = base.withColumns({"value": F.col("value") + F.when(at % 120 == 0, 1).otherwise(0), "device_id": F.lit(9).cast("long")})
    rows = base.withColumn("b", F.col("m") % 3).unionByName(echo.withColumn("b", F.col("m") % 3 + 1))
    rows = rows.withColumn("batch", F.concat_ws("-", "b", "device_id")).withColumn("place", F.lit(0)).drop("m")
    root = scratch_path(t.spark, "authority")
    for b in range(4):
        rows.where(F.col("b") == b).drop("b").write.mode("append").parquet(f"{root}/landed")
        authority.run(t.spark.readStream.schema(rows.drop("b").schema).parquet(f"{root}/landed"), f"{root}/judged", f"{root}/checkpoint")
    out = t.spark.read.schema(f"{authority.JUDGED}, minute_ts timestamp").parquet(f"{root}/judged")
    return out.groupBy("subject_id", "type", "outcome").agg(F.count("*").alias("n"))


@query("workout_identity", """k AS (SELECT workout_id, subject_id FROM wk WHERE workout_id % 4 = 0),
f AS (SELECT subject_id, activity, start_ts, end_ts, count(*) AS n, min(workout_id) AS fit FROM wk WHERE workout_id % 4 <> 0 GROUP BY 1, 2, 3, 4)
SELECT wk.workout_id AS external_id, CASE WHEN k.workout_id IS NOT NULL THEN 'known' WHEN n = 1 AND wk.workout_id % 4 <> 3 THEN 'adopted' ELSE 'created' END AS outcome
FROM wk LEFT JOIN k ON k.workout_id = wk.workout_id LEFT JOIN f ON f.subject_id = wk.subject_id AND f.activity = wk.activity AND f.start_ts = wk.start_ts AND f.end_ts = wk.end_ts""")
def workout_identity(t: Tables):
    """C14: known by id, adopted by a unique fingerprint, or created."""
    w = t.workouts.select("workout_id", "subject_id", "activity", "start_ts", "end_ts", F.lit(None).cast("int").alias("source_id"))
    known = w.where("workout_id % 4 = 0").select(F.lit("push").alias("namespace"), F.col("workout_id").alias("external_id"), "workout_id", "subject_id")
    moved = F.when(F.col("workout_id") % 4 == 3, F.expr("INTERVAL 5 SECONDS")).otherwise(F.expr("INTERVAL 0 SECONDS"))
    i = w.select(F.lit("push").alias("namespace"), F.col("workout_id").alias("external_id"), "subject_id", "activity", (F.col("start_ts") + moved).alias("start_ts"), "end_ts", "source_id")
    return M.resolve_workouts(i, known, w).select("external_id", "outcome")


@query("date_parsing", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS push_s, 330 AS push_offset, CAST(floor(epoch(ts)) AS BIGINT) AS iso_s, 330 AS iso_offset, CAST(NULL AS BIGINT) AS bad FROM ev")
def date_parsing(t: Tables):
    """Wire dates to instants and offsets."""
    local = F.from_utc_timestamp("ts", "Asia/Kolkata")
    a, b = F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0530")), F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    (p, po), (i, io), bad = push_date(a), iso_date(b), iso_date(F.lit("2024-01-01 10:00"))[0]
    return t.events.select("event_id", F.unix_seconds(p).alias("push_s"), po.cast("long").alias("push_offset"), F.unix_seconds(i).alias("iso_s"), io.cast("long").alias("iso_offset"), F.unix_seconds(bad).alias("bad"))


@query("cutover_ranges", """c AS (SELECT * FROM cut), x AS (SELECT subject_id, type, max(start_ts) AS last FROM obs WHERE origin = 'health_xml' GROUP BY 1, 2)
SELECT subject_id, type, strftime(date_trunc('hour', cutover_ts), '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(date_trunc('hour', last) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS to_ts FROM c JOIN x USING (subject_id, type) WHERE last >= cutover_ts""")
def cutover_ranges(t: Tables):
    """What new cutovers invalidate."""
    return M.cutover_ranges(t.cutovers, t.observations.where("origin = 'health_xml'"))


@query("sleep_daily_upsert", """i AS (SELECT subject_id, night, asleep_s + core_s AS asleep_s, core_s FROM sday WHERE core_s % 2 = 0)
SELECT subject_id, strftime(s.night, '%Y-%m-%d') AS night, coalesce(i.asleep_s, s.asleep_s) AS asleep_s FROM sday s LEFT JOIN i USING (subject_id, night)""")
def sleep_daily_upsert(t: Tables):
    """Nights that come again replace those that are there; of two in a batch the last counts."""
    old = t.sleep_daily.select("subject_id", "night", F.lit("hae").alias("channel"), "asleep_s")
    again = t.sleep_daily.where("core_s % 2 = 0").select("subject_id", "night", F.lit("hae").alias("channel"), (F.col("asleep_s") + F.col("core_s")).alias("asleep_s"))
    batch = again.withColumn("id", F.lit(2)).unionByName(again.withColumn("asleep_s", F.lit(-1).cast("long")).withColumn("id", F.lit(1)))
    return M.upsert_daily_sleep(batch, old).select("subject_id", "night", "asleep_s")


@query("sleep_merge", """h AS (SELECT *, row_number() OVER (PARTITION BY subject_id, source_id, stage, start_ts, end_ts ORDER BY start_ts) AS rn FROM seg WHERE CAST(floor(epoch(start_ts)) AS BIGINT) % 2 = 0)
SELECT DISTINCT subject_id, source_id, stage, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts FROM seg s WHERE CAST(floor(epoch(start_ts)) AS BIGINT) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.subject_id = s.subject_id AND h.source_id = s.source_id AND h.stage = s.stage AND h.start_ts = s.start_ts AND h.end_ts = s.end_ts)""")
def sleep_merge(t: Tables):
    """Segments that come again under a new uuid or the old one are not inserted."""
    s = t.sleep_segments.withColumn("at", F.floor(F.unix_seconds("start_ts")))
    uuid = F.concat_ws("-", "subject_id", "source_id", "stage", F.unix_micros("start_ts").cast("string"), F.unix_micros("end_ts").cast("string"))
    history = s.where("at % 2 = 0").withColumn("uuid", F.when(F.col("at") % 4 == 0, uuid))
    batch = s.where("at % 3 <> 0").withColumn("uuid", uuid).withColumn("id", F.col("at"))
    return M.merge_sleep(batch, history).select("subject_id", "source_id", "stage", "start_ts")


@query("new_dimension_rows", """n AS (SELECT DISTINCT 'k' || k AS name FROM ev) SELECT name, CASE WHEN CAST(substr(name, 2) AS INTEGER) < 50 THEN 'known' ELSE 'new' END AS state FROM n""")
def new_dimension_rows(t: Tables):
    """Names that the dimension lacks get a row, once."""
    names = t.events.select(F.concat(F.lit("k"), F.col("k")).alias("name"))
    known = names.where("cast(substr(name, 2) as int) < 50").distinct().select(F.col("name"), F.substring("name", 2, 9).cast("long").alias("id"))
    out = M.dimension(names, M.dimension(names, known))
    return out.select("name", F.when(F.col("id") == F.xxhash64("name"), "new").otherwise("known").alias("state"))


@query("types_to_import", "SELECT type FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('weight')) v(type) WHERE type NOT IN (SELECT type FROM obs WHERE origin = 'health_xml' AND type <> 'signup')")
def types_to_import(t: Tables):
    """Types without an exported row yet."""
    types = t.spark.createDataFrame([(x,) for x in (*METRICS, "weight")], "type string")
    return M.types_to_import(types, t.observations.where("origin = 'health_xml' and type <> 'signup'"))


@query("device_pushes", "d AS (SELECT * FROM (VALUES (0), (1), (2), (9)) v(device_id)), b AS (SELECT subject_id % 3 AS device_id, CAST(ts AS DATE) AS day, subject_id, min(ts) AS r FROM ev GROUP BY 1, 2, 3) SELECT d.device_id, count(b.device_id) AS pushes, strftime(max(r), '%Y-%m-%d %H:%M:%S') AS last_push FROM d LEFT JOIN b USING (device_id) GROUP BY 1")
def device_pushes(t: Tables):
    """Batches of each device."""
    devices = t.spark.createDataFrame([(i,) for i in (0, 1, 2, 9)], "device_id long")
    return M.device_pushes(devices, t.batches.withColumn("device_id", F.col("subject_id") % 3))


@query("batch_retries", """b AS (SELECT subject_id, CAST(ts AS DATE) AS day, min(ts) AS r, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT *, n % 6 + 1 AS attempt, n % 4 = 0 AS permanent, n % 3 <> 0 AS bad FROM b),
x AS (SELECT *, CASE WHEN NOT bad THEN 'done' WHEN permanent OR attempt >= 5 THEN 'failed' ELSE 'retry' END AS state FROM s)
SELECT subject_id, strftime(day, '%Y-%m-%d') AS day, state, CASE WHEN state = 'retry' THEN strftime(TIMESTAMP '2024-02-01' + to_seconds(CAST(least(30 * pow(2, attempt - 1), 1800) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS retry_at FROM x""")
def batch_retries(t: Tables):
    """Permanent failures and retries that back off."""
    n = F.col("body_bytes") / 100
    b = t.batches.select("subject_id", "day", (n % 6 + 1).cast("int").alias("attempt"), (n % 4 == 0).alias("permanent"), F.when(n % 3 != 0, F.lit("broken")).alias("error"))
    return M.settle(b, F.lit("2024-02-01").cast("timestamp")).select("subject_id", "day", "state", "retry_at")


@query("first_channel_wins", """o AS (SELECT * FROM obs WHERE type IN ('purchase', 'signup')), s AS (SELECT subject_id, type, greatest(min(start_ts) FILTER (WHERE origin = 'hae'), min(start_ts) FILTER (WHERE origin = 'health_xml')) - INTERVAL 1 SECOND AS lo,
 least(max(start_ts) FILTER (WHERE origin = 'hae'), max(start_ts) FILTER (WHERE origin = 'health_xml')) + INTERVAL 1 SECOND AS hi, CASE WHEN subject_id % 2 = 0 THEN 'health_xml' ELSE 'hae' END AS later FROM o GROUP BY 1, 2 HAVING count(DISTINCT origin) = 2)
SELECT o.subject_id, o.type, o.origin, count(*) AS rows_replaced FROM o JOIN s ON s.subject_id = o.subject_id AND s.type = o.type AND s.later = o.origin WHERE start_ts BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def first_channel_wins(t: Tables):
    """Rows of the later channel that a repair replaces."""
    first = F.when(F.col("subject_id") % 2 == 0, "hae").otherwise("health_xml")
    since = F.when(F.col("origin") == first, F.lit("2024-02-01")).otherwise("2024-02-02").cast("timestamp")
    return M.first_channel_wins(t.observations.where("type in ('purchase', 'signup')").withColumn("ingested_at", since))


@query("taxonomy_seed", """SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 3 = 0 THEN 'old ' || n_name END AS name, n_regionkey AS type FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0""")
def taxonomy_seed(t: Tables):
    """Rows of a checked contract replace those there are, others stay, and a second run changes nothing."""
    rows = t.read("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("type"))
    known = rows.where("code % 3 = 0").withColumn("name", F.concat(F.lit("old "), "name"))
    contract = M.checked_contract(rows.where("code % 2 = 0"), t.read("region").select(F.col("r_regionkey").alias("type")), ["code"])
    return M.seed_taxonomy(M.seed_taxonomy(known, contract, ["code"]), contract, ["code"])
