"""Queries of metric pages, inventories, the dashboard and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import freshness, local_day, percent_delta
from ..operators import catalogue as C
from ..operators import series as S
from ..operators.sessions import identical_sessions
from ..sources.canonical import FROM_DAY, TO_DAY, Tables
from .registry import query
from .series_queries import DAY, RAW, raw_daily
from .session_queries import WDAY

D, TSF = "strftime({0}, '%Y-%m-%d')", "strftime({0}, '%Y-%m-%d %H:%M:%S')"
SLUG = "CASE category_value WHEN 0 THEN 'idle' WHEN 1 THEN 'stood' END"


def slugs(t: Tables):
    return t.spark.createDataFrame(list(C.SLUGS.items()), "category_value int, slug string")


@query("category_breakdown", f"""SELECT subject_id, type, {SLUG} AS slug, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY subject_id, type), 6) AS share FROM obs WHERE type = 'error' GROUP BY 1, 2, 3""")
def category_breakdown(t: Tables):
    """D13."""
    return C.category_breakdown(t.observations.where("type = 'error'"), slugs(t))


@query("metric_sources", f"""q1 AS (SELECT subject_id, type, source_id, start_ts AS ts, FALSE AS live FROM obs UNION ALL SELECT subject_id, type, source_id, minute_ts, TRUE FROM mins),
q2 AS (SELECT subject_id, type, source_id, count(*) AS n, min(ts) AS a, max(ts) AS b, bool_or(live) AS live FROM q1 GROUP BY 1, 2, 3)
SELECT subject_id, type, name, n, {TSF.format('a')} AS first_ts, {TSF.format('b')} AS last_ts, live, round(100 * n / sum(n) OVER (PARTITION BY subject_id, type), 6) AS share FROM q2 LEFT JOIN src USING (source_id)""")
def metric_sources(t: Tables):
    """D14, G01."""
    return C.source_shares(t.observations, t.minutes, t.sources)


@query("recent_samples", f"""q1 AS (SELECT subject_id, type, start_ts AS ts, value, source_id, 'sample' AS channel FROM obs WHERE value IS NOT NULL UNION ALL SELECT subject_id, type, minute_ts, value, source_id, 'minute' FROM mins),
q2 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, type ORDER BY ts DESC, value DESC, source_id, channel) AS place FROM q1)
SELECT subject_id, type, {TSF.format('ts')} AS ts, CAST(value AS DOUBLE) AS value, source_id, channel, place FROM q2 WHERE place <= 40""")
def recent_samples(t: Tables):
    """F01."""
    return C.recent_samples(t.observations, t.minutes)


@query("recent_occurrences", f"""q1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_ts DESC, event_id) AS place FROM obs WHERE type = 'error')
SELECT subject_id, event_id, {SLUG} AS slug, round((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 6) AS seconds, place FROM q1 WHERE place <= 60""")
def recent_occurrences(t: Tables):
    """F02, H06."""
    return C.recent_occurrences(t.observations.where("type = 'error'"), slugs(t))


@query("extreme_sample", f"""q1 AS (SELECT subject_id, max(value) AS value, arg_max(start_ts, (value, -epoch_us(start_ts))) AS ts FROM obs WHERE type = 'purchase' AND value IS NOT NULL AND {DAY} = DATE '2024-01-10' GROUP BY 1),
q2 AS (SELECT q1.subject_id, min(workout_id) AS workout_id FROM q1 JOIN wk ON wk.subject_id = q1.subject_id AND wk.start_ts <= ts AND ts < wk.end_ts GROUP BY 1)
SELECT q1.subject_id, CAST(value AS DOUBLE) AS value, {TSF.format('ts')} AS ts, workout_id FROM q1 LEFT JOIN q2 USING (subject_id)""")
def extreme_sample(t: Tables):
    """F06, C06."""
    return C.extreme_sample(t.observations.where("type = 'purchase'"), t.workouts, "2024-01-10")


COV = f"""q1 AS (SELECT subject_id, type, {DAY} AS d FROM obs UNION ALL SELECT subject_id, type, {DAY.replace('start_ts', 'minute_ts')} FROM mins),
q2 AS (SELECT subject_id, type, min(d) AS first_day, max(d) AS last_day, count(*) AS measures FROM q1 GROUP BY 1, 2)"""


@query("metric_inventory", COV + f""" SELECT subject_id, type, {D.format('first_day')} AS first_day, {D.format('last_day')} AS last_day, measures FROM q2""")
def metric_inventory(t: Tables):
    """Bounds of each type from one aggregate for each table."""
    return C.coverage(t.observations, t.minutes)


@query("inventory_summary", COV + f""" SELECT subject_id, count(*) AS types, sum(measures) AS measures, {D.format('min(first_day)')} AS first_day, {D.format('max(last_day)')} AS last_day, count(*) FILTER (WHERE DATE '2024-03-29' - last_day > 60) AS dormant FROM q2 GROUP BY 1""")
def inventory_summary(t: Tables):
    """D33."""
    return C.inventory_summary(C.coverage(t.observations, t.minutes), "2024-03-29")


@query("top_types", COV + """, q3 AS (SELECT subject_id, type, measures, round(100 * measures / sum(measures) OVER (PARTITION BY subject_id), 6) AS share, row_number() OVER (PARTITION BY subject_id ORDER BY measures DESC, type) AS place FROM q2) SELECT * FROM q3 WHERE place <= 8""")
def top_types(t: Tables):
    """D24, F04."""
    return C.top_types(C.coverage(t.observations, t.minutes), 8)


@query("subject_catalog", "SELECT DISTINCT subject_id, type FROM obs WHERE type <> 'error' AND value IS NOT NULL UNION SELECT DISTINCT subject_id, 'derived:training_time' FROM wk UNION SELECT DISTINCT subject_id, 'derived:sleep_asleep' FROM seg")
def subject_catalog(t: Tables):
    """Chartable types with rows, and derived series."""
    own = t.observations.where("type <> 'error' and value is not null").select("subject_id", "type")
    train = t.workouts.join(t.subjects, "subject_id", "left_semi").select("subject_id", F.lit("derived:training_time").alias("type"))
    return own.unionByName(train).unionByName(t.sleep_segments.select("subject_id", F.lit("derived:sleep_asleep").alias("type"))).distinct()


BATCH = f"""b1 AS (SELECT subject_id, CAST(ts AS DATE) AS day, min(ts) AS received_at, count(*) * 100 AS body_bytes, count(*) FILTER (WHERE type = 'click') AS click, count(*) FILTER (WHERE type = 'purchase') AS purchase FROM ev GROUP BY 1, 2),
b2 AS (SELECT *, CASE dayofmonth(day) % 5 WHEN 0 THEN 'received' WHEN 1 THEN 'normalized' WHEN 4 THEN 'failed' ELSE 'rollups_ready' END AS status FROM b1),
b AS (SELECT *, CASE WHEN status <> 'received' THEN click * 3 + purchase END AS points FROM b2)"""


@query("recent_batches", BATCH + f""", q1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY received_at DESC) AS place FROM b) SELECT subject_id, {TSF.format('received_at')} AS received_at, status, body_bytes, points, place FROM q1 WHERE place <= 20""")
def recent_batches(t: Tables):
    """Points summed over a map of counters."""
    w = Window.partitionBy("subject_id").orderBy(F.col("received_at").desc())
    b = t.batches.withColumn("place", F.row_number().over(w)).where("place <= 20")
    return b.select("subject_id", "received_at", "status", "body_bytes", C.points_of("counts").alias("points"), "place")


@query("ingest_volumes_by_day", BATCH + f""", q1 AS (SELECT subject_id, day, count(*) AS batches, sum(body_bytes) AS bytes, sum(points) AS points FROM b GROUP BY 1, 2)
SELECT days.subject_id, {D.format('days.day')} AS day, coalesce(batches, 0) AS batches, coalesce(bytes, 0) AS bytes, points FROM days LEFT JOIN q1 ON q1.subject_id = days.subject_id AND q1.day = days.day""")
def ingest_volumes_by_day(t: Tables):
    """D22, C01, INV1's exceptions."""
    return C.ingest_by_day(t.batches, FROM_DAY, TO_DAY, t.subjects)


@query("sync_overview", BATCH + f""", q1 AS (SELECT subject_id, count(*) FILTER (WHERE status = 'received') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, max(received_at) FILTER (WHERE status IN ('normalized', 'rollups_ready')) AS lv FROM b GROUP BY 1)
SELECT subject_id, pending, failed, {TSF.format('lv')} AS last_visible, CASE WHEN failed > 0 THEN 'error' WHEN pending > 0 THEN 'syncing' WHEN lv IS NULL THEN 'never' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(lv) < 26 * 3600 THEN 'fresh' ELSE 'stale' END AS state FROM q1""")
def sync_overview(t: Tables):
    """D16, H32."""
    o = C.sync_overview(t.batches)
    return o.withColumn("state", freshness(F.col("last_visible"), F.lit("2024-01-31").cast("timestamp"), F.col("failed"), F.col("pending")))


@query("ingest_comparison", BATCH + """, q AS (SELECT subject_id, sum(points) FILTER (WHERE day >= DATE '2024-01-16') AS now, sum(points) FILTER (WHERE day < DATE '2024-01-16') AS before FROM b GROUP BY 1),
y AS (SELECT subject_id, CAST(round((max(CAST(start_ts AS DATE)) - min(CAST(start_ts AS DATE))) / 365.25) AS BIGINT) AS covered_years FROM wh GROUP BY 1)
SELECT q.subject_id, now, before, round((now - before) * 100.0 / nullif(before, 0), 6) AS delta, covered_years FROM q LEFT JOIN y USING (subject_id)""")
def ingest_comparison(t: Tables):
    """Null-preserving sums of two windows with their change, and the years that a subject's sessions cover."""
    b, late = t.batches.withColumn("points", C.points_of("counts")), F.col("day") >= "2024-01-16"
    out = b.groupBy("subject_id").agg(F.sum(F.when(late, F.col("points"))).alias("now"), F.sum(F.when(~late, F.col("points"))).alias("before"))
    day = F.to_date("start_ts")
    years = t.history.groupBy("subject_id").agg(F.round(F.datediff(F.max(day), F.min(day)) / 365.25).cast("long").alias("covered_years"))
    delta = percent_delta(F.col("now"), F.col("before"))
    return out.withColumn("delta", F.round(delta, 6)).join(years, "subject_id", "left")


@query("data_totals", f"""n(kind, subject_id, n) AS (SELECT 'observations', subject_id, count(*) FROM obs GROUP BY 2 UNION ALL SELECT 'minutes', subject_id, count(*) FROM mins GROUP BY 2 UNION ALL SELECT 'segments', subject_id, count(*) FROM seg GROUP BY 2 UNION ALL SELECT 'workouts', subject_id, count(*) FROM wk GROUP BY 2),
c AS (SELECT subject_id, count(DISTINCT type) AS types, max({DAY}) - min({DAY}) + 1 AS coverage_days FROM obs GROUP BY 1)
SELECT subj.subject_id, {", ".join(f"coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0) AS {k}" for k in ("observations", "minutes", "segments", "workouts"))}, coalesce(any_value(types), 0) AS types, any_value(coverage_days) AS coverage_days
FROM subj LEFT JOIN n USING (subject_id) LEFT JOIN c USING (subject_id) GROUP BY 1""")
def data_totals(t: Tables):
    """Rows of four tables, types with data and days covered."""
    tables = {"observations": t.observations, "minutes": t.minutes, "segments": t.sleep_segments, "workouts": t.workouts}
    return C.totals(tables, t.observations, t.subjects)


CATALOGUE = [("purchase", "HKQuantityTypeIdentifierHeartRate", "count/min", "average"), ("signup", "HKQuantityTypeIdentifierActiveEnergyBurned", "kJ", "latest")]
LAST = "CAST(arg_max(value, (start_ts, event_id)) AS DOUBLE)"
FIXED = "printf(CASE WHEN abs({0}) >= 100 THEN '%.0f' WHEN abs({0}) >= 10 THEN '%.1f' ELSE '%.2f' END, {0})"


@query("catalogue_rows", f"""dv AS (SELECT subject_id, type, {DAY} AS day, CASE type WHEN 'purchase' THEN CAST(sum(value) AS DOUBLE) / count(value) ELSE {LAST} / 4.184 END AS value FROM obs WHERE type IN ('purchase', 'signup') GROUP BY 1, 2, 3),
cv AS (SELECT subject_id, type, min({DAY}) AS a, max({DAY}) AS b, count(*) AS measures FROM obs WHERE type IN ('purchase', 'signup') GROUP BY 1, 2),
sp AS (SELECT cv.*, (SELECT arg_max(value, day) FROM dv WHERE dv.subject_id = cv.subject_id AND dv.type = cv.type) AS v, (SELECT count(*) FROM dv WHERE dv.subject_id = cv.subject_id AND dv.type = cv.type AND dv.day > cv.b - 30) AS points FROM cv)
SELECT subject_id, type, CASE type WHEN 'purchase' THEN 'Heart rate' ELSE 'Active energy burned' END AS label, CASE type WHEN 'purchase' THEN 'heart' ELSE 'activity' END AS "group", CASE type WHEN 'purchase' THEN '/min' ELSE 'kcal' END AS unit, measures,
 CASE WHEN strftime(a, '%b %Y') = strftime(b, '%b %Y') THEN strftime(a, '%b %Y') ELSE strftime(a, '%b %Y') || ' - ' || strftime(b, '%b %Y') END AS coverage, {D.format('b')} AS last_value_day, round(v, 9) AS last_shown, points, 30 AS slots, DATE '2024-03-29' - b > 60 AS dormant,
 CASE type WHEN 'purchase' THEN 'heart rate hkquantitytypeidentifierheartrate heart-rate /min heart' ELSE 'active energy burned hkquantitytypeidentifieractiveenergyburned active-energy-burned kcal activity' END AS haystack FROM sp""")
def catalogue_rows(t: Tables):
    """Rows of the metric catalogue."""
    types = t.spark.createDataFrame(CATALOGUE, "type string, identifier string, unit string, aggregation string")
    obs = t.observations.where("type in ('purchase', 'signup')").withColumn("day", local_day(F.col("start_ts"), F.col("tz")))
    value = F.when(F.col("type") == "purchase", S.value_of("average")).otherwise(S.value_of("latest"))
    daily = obs.groupBy("subject_id", "type", "day").agg(value.alias("value"))
    rows = C.catalogue_rows(C.coverage(obs, t.minutes.limit(0)), daily, types, "2024-03-29")
    points = F.size(F.filter("spark", lambda v: v.isNotNull()))
    return rows.withColumns({"last_shown": F.round(F.element_at("spark", -1), 9), "points": points, "slots": F.size("spark")}).drop("spark", "last_value")


@query("overlay_scales", RAW + f""", s AS (SELECT subject_id, 'a' AS key, day, value FROM q0 UNION ALL SELECT subject_id, 'b', day, value * 2 + 1 FROM q0 UNION ALL SELECT subject_id, 'c', day, CASE WHEN day > DATE '2024-01-10' THEN value END FROM q0 WHERE subject_id % 2 = 0)
SELECT subject_id, key, {D.format('day')} AS day, CASE WHEN subject_id % 2 = 0 THEN 'normalized' ELSE 'absolute' END AS mode, CASE WHEN subject_id % 2 = 1 AND key = 'b' THEN 1 ELSE 0 END AS axis,
 round(CASE WHEN value IS NOT NULL THEN coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.5) END, 9) AS scaled FROM s WINDOW w AS (PARTITION BY subject_id, key)""")
def overlay_scales(t: Tables):
    """Two series have an axis each, three of unlike units are normalised."""
    r = raw_daily(t)
    one = lambda key, v, rows=r: rows.select("subject_id", F.lit(key).alias("key"), "day", v.alias("value"))
    s = one("a", F.col("value")).unionByName(one("b", F.col("value") * 2 + 1)).unionByName(one("c", F.when(F.col("day") > "2024-01-10", F.col("value")), r.where("subject_id % 2 = 0")))
    units = t.spark.createDataFrame([("a", "bpm"), ("b", "m"), ("c", None)], "key string, unit string")
    scaled = S.normalised(s).join(S.scale_plan(s, units), ["subject_id", "key"])
    return scaled.select("subject_id", "key", "day", "mode", "axis", F.round("scaled", 9).alias("scaled"))


ALIKE = ["subject_id", "activity", "start_ts", "end_ts", "duration_s", "distance_m", "energy_kj", "elevation_up_m"]


@query("duplicate_workouts", f"""c1 AS (SELECT * FROM wk UNION ALL SELECT * REPLACE (workout_id + 10000000 AS workout_id) FROM wk WHERE workout_id % 50 = 0 UNION ALL SELECT * REPLACE (workout_id + 20000000 AS workout_id) FROM wk WHERE workout_id % 100 = 0),
c2 AS (SELECT workout_id FROM pts WHERE workout_id % 7 <> 0 UNION SELECT workout_id + 10000000 FROM pts WHERE workout_id % 150 = 0),
c3 AS (SELECT {", ".join(f"c1.{c}" for c in ALIKE)}, list(CAST(c1.workout_id AS VARCHAR) ORDER BY CAST(c1.workout_id AS VARCHAR)) AS ids, count(c2.workout_id) AS kids, max(CAST(c2.workout_id AS VARCHAR)) AS kid FROM c1 LEFT JOIN c2 USING (workout_id) GROUP BY ALL HAVING count(*) > 1)
SELECT subject_id, activity, {TSF.format("start_ts")} AS start_ts, array_to_string(ids, ',') AS ids, CASE kids WHEN 1 THEN kid WHEN 0 THEN ids[1] END AS keep FROM c3""")
def duplicate_workouts(t: Tables):
    """Groups of sessions alike in all business columns, and the one to keep. A fiftieth of the sessions
    is doubled, some with rows of their own."""
    w, p = t.workouts, t.points.select("workout_id")
    for n, every in ((10_000_000, 50), (20_000_000, 100)):
        w = w.unionByName(t.workouts.where(F.col("workout_id") % every == 0).withColumn("workout_id", F.col("workout_id") + n))
    kids = p.where("workout_id % 7 <> 0").union(p.where("workout_id % 150 = 0").select(F.col("workout_id") + 10_000_000))
    found = identical_sessions(w, kids, ALIKE)
    return found.select("subject_id", "activity", "start_ts", F.array_join("ids", ",").alias("ids"), "keep")


@query("dual_origin_types", f"""q1 AS (SELECT subject_id, type, count(*) FILTER (WHERE origin = 'hae') AS hae, count(*) FILTER (WHERE origin = 'health_xml') AS xml, min(start_ts) FILTER (WHERE origin = 'hae') AS a1, max(start_ts) FILTER (WHERE origin = 'hae') AS b1, min(start_ts) FILTER (WHERE origin = 'health_xml') AS a2, max(start_ts) FILTER (WHERE origin = 'health_xml') AS b2 FROM obs GROUP BY 1, 2)
SELECT subject_id, type, hae, xml, {TSF.format("greatest(a1, a2) - INTERVAL 1 SECOND")} AS from_ts, {TSF.format("least(b1, b2) + INTERVAL 1 SECOND")} AS to_ts FROM q1 WHERE hae > 0 AND xml > 0""")
def dual_origin_types(t: Tables):
    """Types that came by both channels, and where they overlap."""
    x, h = F.col("origin") == "health_xml", F.col("origin") == "hae"
    of = lambda f, c: f(F.when(c, F.col("start_ts")))
    g = t.observations.groupBy("subject_id", "type").agg(F.count_if(h).alias("hae"), F.count_if(x).alias("xml"), F.greatest(of(F.min, h), of(F.min, x)).alias("a"), F.least(of(F.max, h), of(F.max, x)).alias("b")).where("hae > 0 and xml > 0")
    return g.select("subject_id", "type", "hae", "xml", (F.col("a") - F.expr("INTERVAL 1 SECOND")).alias("from_ts"), (F.col("b") + F.expr("INTERVAL 1 SECOND")).alias("to_ts"))


@query("heatmap", f"""q1 AS (SELECT subject_id, {WDAY} AS day, sum(duration_s) / 60.0 AS m FROM wk GROUP BY 1, 2), q2 AS (SELECT DISTINCT subject_id, {DAY} AS day FROM obs WHERE type = 'click'),
g AS (SELECT subject_id, CAST(d AS DATE) AS day FROM subj, range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) r(d))
SELECT g.subject_id, {D.format('g.day')} AS day, CASE WHEN g.day <= DATE '2024-01-30' THEN round(coalesce(m, CASE WHEN q2.day IS NOT NULL THEN 0 END), 9) END AS cell, isodow(g.day) - 1 AS weekday, g.day <= DATE '2024-01-30' AS inside
FROM g LEFT JOIN q1 ON q1.subject_id = g.subject_id AND q1.day = g.day LEFT JOIN q2 ON q2.subject_id = g.subject_id AND q2.day = g.day""")
def heatmap(t: Tables):
    """Minutes of training, 0 on days with steps only, else null; whole weeks, with empty cells around."""
    m = t.workouts.groupBy("subject_id", local_day(F.col("start_ts"), F.col("tz")).alias("day")).agg((F.sum("duration_s") / 60).alias("m"))
    steps = t.observations.where("type = 'click'").select("subject_id", local_day(F.col("start_ts"), F.col("tz")).alias("day"), F.lit(True).alias("steps")).distinct()
    first, last = F.trunc(F.lit(FROM_DAY).cast("date"), "week"), F.date_add(F.trunc(F.date_sub(F.lit(TO_DAY).cast("date"), 1), "week"), 6)
    out = t.subjects.select("subject_id", F.explode(F.sequence(first, last)).alias("day")).join(m, ["subject_id", "day"], "left").join(steps, ["subject_id", "day"], "left")
    inside = (F.col("day") >= FROM_DAY) & (F.col("day") < TO_DAY)
    cell = F.round(F.coalesce("m", F.when(F.col("steps"), F.lit(0.0))), 9)
    return out.select("subject_id", "day", F.when(inside, cell).alias("cell"), F.weekday("day").alias("weekday"), inside.alias("inside"))


@query("metric_card", RAW + """ SELECT subject_id, round(avg(value), 9) AS headline, arg_max(value, day) FILTER (WHERE value IS NOT NULL) AS last_value, strftime(max(day) FILTER (WHERE value IS NOT NULL), '%Y-%m-%d') AS last_day, round(least(greatest(arg_max(value, day) FILTER (WHERE value IS NOT NULL) / avg(value), 0), 1), 9) AS gauge FROM q0 GROUP BY 1""")
def metric_card(t: Tables):
    """Mean of measured days, the last value with its day, and a clamped ratio."""
    last = F.expr("max_by(value, day) FILTER (WHERE value IS NOT NULL)")
    g = raw_daily(t).groupBy("subject_id").agg(F.avg("value").alias("headline"), last.alias("last_value"), F.max(F.when(F.col("value").isNotNull(), F.col("day"))).alias("last_day"))
    return g.select("subject_id", F.round("headline", 9).alias("headline"), "last_value", "last_day", F.round(F.least(F.greatest(F.col("last_value") / F.col("headline"), F.lit(0.0)), F.lit(1.0)), 9).alias("gauge"))
