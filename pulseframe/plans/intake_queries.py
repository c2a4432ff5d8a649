"""Queries of the store that payload files are taken into: three micro-batches of payloads made from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.canonical import Tables
from ..store import scratch_path
from ..streaming import intake
from .ingest_queries import iso, wired
from .registry import query

STEPS, HEART, STAND = (f"HK{x}" for x in ("QuantityTypeIdentifierStepCount", "QuantityTypeIdentifierHeartRate", "CategoryTypeIdentifierAppleStandHour"))
TYPES = [(STEPS, "quantity", "cumulative", "count", 1000, False, False), (HEART, "quantity", "raw", "count/min", 1000, False, False), (STAND, "category", "category", None, 1000, False, False)]
#: Stores by application and state of the source folder.
_STORES: dict[tuple[str, str], str] = {}


def contract(t: Tables) -> tuple[DataFrame, DataFrame]:
    types = t.spark.createDataFrame(TYPES, "type string, kind string, regime string, unit string, scale int, opted_out boolean, reaggregated boolean")
    return types, t.spark.createDataFrame([(STAND, 0), (STAND, 1)], "type string, category int")


def files(payloads: DataFrame, kind: str, device: int, name: str) -> DataFrame:
    """Payloads (subject_id, body) as files of a landing folder."""
    path = F.concat(F.lit(f"landing/{kind}/subject="), "subject_id", F.lit(f"/device={device}/{name}.json"))
    return payloads.select(path.alias("path"), F.lit("2024-02-01").cast("timestamp").alias("modificationTime"), F.col("body").cast("binary").alias("content"))


def push_payloads(t: Tables, some: str) -> DataFrame:
    """Steps and heart rates of some events, in their order; every tenth heart rate is an average, every tenth date is bad."""
    value, heart, digit = F.col("v").cast("double"), F.col("type") == "purchase", F.col("k") % 10
    point = F.struct(
        F.when(digit == 7, F.lit("never")).otherwise(wired(F.col("ts"))).alias("date"), F.when(~heart, value).alias("qty"), F.when(heart, F.when(digit == 0, value - 1).otherwise(value)).alias("Min"),
        F.when(heart, value).alias("Avg"), F.when(heart, value).alias("Max"), F.lit("W ").alias("source"),
    )
    e = t.events.where("type in ('click', 'purchase')").where(some)
    g = e.groupBy("subject_id", "type").agg(F.array_sort(F.collect_list(F.struct("event_id", point.alias("p")))).alias("x"))
    metric = F.struct(F.when(heart, "heart_rate").otherwise("step_count").alias("name"), F.when(heart, "bpm").otherwise("steps").alias("units"), F.col("x.p").alias("data"))
    g = g.groupBy("subject_id").agg(F.collect_list(metric).alias("metrics"))
    return g.select("subject_id", F.to_json(F.struct(F.struct("metrics").alias("data"))).alias("body"))


def native_payloads(t: Tables, some: str) -> DataFrame:
    """Heart rates and stand hours of some events, with uuids; of four categories two are in the contract."""
    heart = F.col("type") == "purchase"
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lower(F.lpad(F.hex("event_id"), 12, "0")))
    sample = F.struct(
        uuid.alias("uuid"), F.when(heart, HEART).otherwise(STAND).alias("type"), iso(F.col("ts")).alias("start"), F.when(heart, F.col("v").cast("double")).alias("value"), F.when(heart, "count/min").alias("unit"),
        F.when(~heart, F.col("k") % 4).alias("category"), F.lit("W").alias("source"),
    )
    g = t.events.where("type in ('error', 'purchase')").where(some).groupBy("subject_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return g.select("subject_id", F.to_json(F.struct(F.lit("pulse-native/1").alias("format"), "samples")).alias("body"))


def stored(t: Tables) -> intake.Intake:
    """A store after three micro-batches, of which the second brings another device's payloads and native ones, and the third
    payloads that came before and broken ones; its rollup is brought up to date after the first and the last."""
    key = (t.spark.sparkContext.applicationId, t.listing)
    root = _STORES.get(key) or scratch_path(t.spark, "intake")
    took = intake.Intake(intake.lake(t.spark, root), *contract(t))
    if key in _STORES:
        return took
    first = files(push_payloads(t, "event_id % 3 = 0"), "push", 1, "a")
    other = files(push_payloads(t, "event_id % 3 = 1 or event_id % 6 = 0"), "push", 2, "b")
    native = files(native_payloads(t, "event_id % 3 <> 0"), "native", 3, "c")
    broken = files(t.subjects.select("subject_id", F.lit("{not json").alias("body")), "push", 1, "d")
    again = first.withColumn("path", F.replace("path", F.lit("a.json"), F.lit("again.json")))
    took.ingest(first, 0)
    took.drain()
    took.ingest(other.unionByName(native), 1)
    took.ingest(again.unionByName(broken), 2)
    took.drain()
    _STORES[key] = root
    return took


#: Payload A is the first device's, B the second's, N the native one.
STORED = f"""e AS (SELECT event_id, subject_id, type, date_trunc('second', ts) AS ts, date_trunc('minute', ts) AS minute_ts, CAST(v AS DOUBLE) AS v, k, k % 10 AS digit FROM ev),
a AS (SELECT *, 'a' AS file FROM e WHERE event_id % 3 = 0 AND type IN ('click', 'purchase')), b AS (SELECT *, 'b' AS file FROM e WHERE (event_id % 3 = 1 OR event_id % 6 = 0) AND type IN ('click', 'purchase')),
n AS (SELECT *, 'c' AS file FROM e WHERE event_id % 3 <> 0 AND type IN ('error', 'purchase')),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
heart AS (SELECT DISTINCT subject_id, ts, v FROM ab WHERE type = 'purchase' AND digit NOT IN (0, 7)),
more AS (SELECT subject_id, ts, v FROM n WHERE type = 'purchase' AND NOT EXISTS (SELECT 1 FROM heart h WHERE h.subject_id = n.subject_id AND h.ts = n.ts AND h.v = n.v)),
o AS (SELECT subject_id, '{HEART}' AS type, ts, v, NULL AS category, FALSE AS named FROM heart UNION ALL SELECT subject_id, '{HEART}', ts, v, NULL, TRUE FROM more
 UNION ALL SELECT subject_id, '{STAND}', ts, NULL, k % 4, TRUE FROM n WHERE type = 'error' AND k % 4 < 2),
am AS (SELECT subject_id, minute_ts, arg_max(v, event_id) AS v FROM a WHERE type = 'click' AND digit <> 7 GROUP BY 1, 2),
bm AS (SELECT subject_id, minute_ts, arg_max(v, event_id) AS v FROM b WHERE type = 'click' AND digit <> 7 GROUP BY 1, 2),
late AS (SELECT * FROM bm WHERE subject_id NOT IN (SELECT subject_id FROM am)),
m AS (SELECT *, 1 AS device_id FROM am UNION ALL SELECT *, 2 FROM late),
c AS (SELECT bm.* FROM bm LEFT JOIN am USING (subject_id, minute_ts) WHERE subject_id IN (SELECT subject_id FROM am) AND am.v IS DISTINCT FROM bm.v)"""


@query("intake_observations", STORED + " SELECT subject_id, type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_ts, v AS value, CAST(floor(v * 1000 + 0.5) AS BIGINT) AS value_key, category AS category_value, named FROM o")
def intake_observations(t: Tables):
    """L: payloads to observations, by content and by uuid once each."""
    o = stored(t).observations()
    return o.select("subject_id", "type", "start_ts", "value", "value_key", "category_value", F.col("uuid").isNotNull().alias("named"))


@query("intake_minutes", STORED + " SELECT subject_id, strftime(minute_ts, '%Y-%m-%d %H:%M:%S') AS minute_ts, v AS value, device_id, 'minute' AS kind FROM m UNION ALL SELECT subject_id, strftime(minute_ts, '%Y-%m-%d %H:%M:%S'), v, 2, 'conflict' FROM c")
def intake_minutes(t: Tables):
    """L, A10, A12, J05: minutes of each subject's first device, and the quarantined ones of others."""
    s = stored(t)
    cols = ["subject_id", "minute_ts", "value", "device_id"]
    return s.minutes().select(*cols, F.lit("minute").alias("kind")).unionByName(s.store.read("conflicts").select(*cols, F.lit("conflict").alias("kind")))


@query("intake_ledger", STORED + """, x AS (SELECT subject_id, file, event_id, digit, type FROM ab UNION ALL SELECT subject_id, file, event_id, digit, type FROM n),
p AS (SELECT DISTINCT subject_id, file FROM x), bad AS (SELECT subject_id, file, count(*) AS skipped FROM x WHERE digit = 7 AND file <> 'c' GROUP BY 1, 2)
SELECT subject_id, file, 'rollups_ready' AS state, NULL AS error, skipped FROM p LEFT JOIN bad USING (subject_id, file)
UNION ALL SELECT subject_id, 'again', 'duplicate', NULL, NULL FROM p WHERE file = 'a' UNION ALL SELECT subject_id, 'd', 'failed', 'json_invalid', NULL FROM subj""")
def intake_ledger(t: Tables):
    """Payloads with their states, and how many of their points had no date."""
    skipped = [F.coalesce(F.get_json_object("counts", f"$.{m}.skipped_bad_point").cast("long"), F.lit(0)) for m in ("step_count", "heart_rate")]
    file = F.regexp_extract("path", r"(\w+)\.json$", 1)
    return stored(t).ledger().select("subject_id", file.alias("file"), "state", "error", F.nullif(skipped[0] + skipped[1], F.lit(0)).alias("skipped"))


@query("intake_rollup", STORED + f""", r AS (SELECT subject_id, type, date_trunc('hour', ts) AS h, v FROM o WHERE v IS NOT NULL UNION ALL SELECT subject_id, '{STEPS}', date_trunc('hour', minute_ts), v FROM m)
SELECT subject_id, type, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_utc, count(*) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max FROM r GROUP BY ALL""")
def intake_rollup(t: Tables):
    """The stored rollup after two drains of what the batches made dirty."""
    r = stored(t).store.read("rollup")
    return r.select("subject_id", "type", "hour_utc", "n", F.round("sum", 6).alias("sum"), "min", "max")


@query("intake_inventory", STORED + " SELECT subject_id, type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM o GROUP BY 1, 2")
def intake_inventory(t: Tables):
    """Counts and coverage of the stored observations, from summaries that the commits keep."""
    return stored(t).inventory()


@query("intake_newest", STORED + ", q AS (SELECT *, row_number() OVER (PARTITION BY subject_id, type ORDER BY ts DESC, v DESC NULLS LAST, category DESC NULLS LAST) AS rn FROM o) SELECT subject_id, type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start_ts, v AS value FROM q WHERE rn <= 5")
def intake_newest(t: Tables):
    """the five newest observations of each subject and type, read from the newest month back."""
    return stored(t).newest(5).select("subject_id", "type", "start_ts", "value")
