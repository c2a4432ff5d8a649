"""Queries of nights, workouts, records and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import local_day
from ..operators import sessions as X
from ..sources.canonical import Tables
from .registry import query
from .windows import Range, parse_day, timeline_window

FROM, TO, NOW = "2024-01-01", "2024-01-31", "2001-08-01"
WDAY = "CAST(timezone(tz, timezone('UTC', start_ts)) AS DATE)"


def nights(t: Tables):
    return X.sleep_nights(t.sleep_segments, t.sleep_daily, t.sources, FROM, TO)


def st(*codes: int) -> str:
    return f"CAST(round(sum(sec) FILTER (WHERE stage IN ({', '.join(map(str, codes))}))) AS BIGINT)"


NIGHTS = f"""q1 AS (SELECT *, CAST(timezone(tz, timezone('UTC', start_ts)) + INTERVAL 12 HOUR AS DATE) AS night, epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6 AS sec FROM seg),
q2 AS (SELECT subject_id, night, source_id, {st(1, 3, 4, 5)} AS asleep_s, {st(3)} AS core_s, {st(4)} AS deep_s, {st(5)} AS rem_s, {st(2)} AS awake_s, {st(0)} AS in_bed_s,
 min(start_ts) FILTER (WHERE stage IN (1, 3, 4, 5)) AS sleep_start, max(end_ts) FILTER (WHERE stage IN (1, 3, 4, 5)) AS sleep_end FROM q1 WHERE night >= DATE '{FROM}' AND night < DATE '{TO}' GROUP BY 1, 2, 3),
q3 AS (SELECT q2.*, row_number() OVER (PARTITION BY subject_id, night ORDER BY regexp_matches(name, '(?i)watch') DESC NULLS LAST, asleep_s DESC NULLS LAST, source_id) AS rn FROM q2 LEFT JOIN src USING (source_id)),
q4 AS (SELECT subject_id, night, CASE WHEN asleep_s > 0 THEN asleep_s ELSE core_s + deep_s + rem_s END AS asleep_s, core_s, deep_s, rem_s, awake_s, in_bed_s, sleep_start, sleep_end, 'reported' AS channel FROM sday WHERE night < DATE '{TO}'),
nights AS (SELECT * FROM q4 UNION ALL SELECT subject_id, night, asleep_s, core_s, deep_s, rem_s, awake_s, in_bed_s, sleep_start, sleep_end, 'derived' FROM q3 WHERE rn = 1 AND (subject_id, night) NOT IN (SELECT subject_id, night FROM q4))"""


@query("sleep_nights", NIGHTS + """
SELECT subject_id, strftime(night, '%Y-%m-%d') AS night, asleep_s, core_s, deep_s, rem_s, awake_s, in_bed_s, strftime(sleep_start, '%Y-%m-%d %H:%M:%S') AS sleep_start, strftime(sleep_end, '%Y-%m-%d %H:%M:%S') AS sleep_end, channel FROM nights""")
def sleep_nights(t: Tables):
    """D15, E05, E06, H07, H08."""
    return nights(t)


SHARE = "round(100 * sum({0}) / nullif(sum(coalesce(core_s, 0) + coalesce(deep_s, 0) + coalesce(rem_s, 0) + coalesce(awake_s, 0)), 0), 6)"


@query("sleep_summary", NIGHTS + f""", q6 AS (SELECT nights.*, CAST((hour(l) * 60 + minute(l) - 720 + 1440) % 1440 AS DOUBLE) AS bed FROM (SELECT nights.*, timezone(tz, timezone('UTC', sleep_start)) AS l FROM nights JOIN subj USING (subject_id)) nights),
q7 AS (SELECT *, avg(bed) OVER (PARTITION BY subject_id) AS mean_bed FROM q6)
SELECT subject_id, count(*) AS nights, round(avg(asleep_s / 3600), 9) AS hours, round(avg(deep_s / 3600), 9) AS deep_hours, round(avg(bed), 6) AS bedtime, CASE WHEN count(bed) >= 2 THEN round(avg(abs(bed - mean_bed)), 6) END AS bedtime_mad,
 {SHARE.format('core_s')} AS core_share, {SHARE.format('deep_s')} AS deep_share, {SHARE.format('rem_s')} AS rem_share, {SHARE.format('awake_s')} AS awake_share FROM q7 GROUP BY 1""")
def sleep_summary(t: Tables):
    """D31, D32, H14."""
    return X.sleep_summary(nights(t), t.subjects)


HR = """q1 AS (SELECT wk.*, o.value FROM wk LEFT JOIN obs o ON o.subject_id = wk.subject_id AND o.type = 'purchase' AND o.start_ts >= wk.start_ts AND o.start_ts < wk.end_ts),
q2 AS (SELECT workout_id, subject_id, tz, activity, start_ts, duration_s, distance_m, energy_kj, round(CAST(sum(value) AS DOUBLE) / nullif(count(value), 0), 9) AS avg_hr, count(value) AS samples FROM q1 GROUP BY ALL)"""


def with_hr(t: Tables):
    return X.interval_rate(t.workouts, t.observations.where("type = 'purchase'")).withColumn("avg_hr", F.round("avg_hr", 9))


@query("workouts_in_range", HR + """
SELECT workout_id, subject_id, activity, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, duration_s, distance_m, avg_hr, samples FROM q2""")
def workouts_in_range(t: Tables):
    """Every session with its mean rate, kept with null where nothing was sampled."""
    return with_hr(t).select("workout_id", "subject_id", "activity", "start_ts", "duration_s", "distance_m", "avg_hr", F.coalesce("samples", F.lit(0)).alias("samples"))


@query("workout_summary", HR + """
SELECT subject_id, count(*) AS sessions, sum(duration_s) AS duration_s, sum(distance_m) AS distance_m, round(sum(energy_kj), 6) AS energy_kj, round(avg(avg_hr), 6) AS avg_hr FROM q2 GROUP BY 1""")
def workout_summary(t: Tables):
    """The mean of sessions' means, not of samples."""
    return with_hr(t).groupBy("subject_id").agg(F.count("*").alias("sessions"), F.sum("duration_s").alias("duration_s"), F.sum("distance_m").alias("distance_m"), F.round(F.sum("energy_kj"), 6).alias("energy_kj"), F.round(F.avg("avg_hr"), 6).alias("avg_hr"))


@query("workout_rate_by_source", """q1 AS (SELECT wk.workout_id, o.source_id, CAST(sum(o.value) AS DOUBLE) / count(*) AS avg_hr, count(*) AS samples, CAST(max(o.value) AS DOUBLE) AS max_value FROM wk JOIN obs o ON o.subject_id = wk.subject_id AND o.type = 'purchase' AND o.start_ts >= wk.start_ts AND o.start_ts < wk.end_ts GROUP BY 1, 2)
SELECT workout_id, source_id, round(avg_hr, 9) AS avg_hr, samples, max_value, row_number() OVER (PARTITION BY workout_id ORDER BY samples DESC, source_id) AS place FROM q1""")
def workout_rate_by_source(t: Tables):
    """Samples of each source within a session, the largest first."""
    g = X.interval_rate(t.workouts, t.observations.where("type = 'purchase'"), by=["source_id"])
    w = Window.partitionBy("workout_id").orderBy(F.col("samples").desc(), "source_id")
    return g.withColumn("place", F.row_number().over(w)).withColumn("avg_hr", F.round("avg_hr", 9))


@query("workouts_by_activity", """SELECT subject_id, activity, count(*) AS sessions, row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, activity) AS place FROM wk GROUP BY 1, 2""")
def workouts_by_activity(t: Tables):
    """D18."""
    g = t.workouts.groupBy("subject_id", "activity").agg(F.count("*").alias("sessions"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.col("sessions").desc(), "activity")))


@query("weekly_volume", f"""q1 AS (SELECT subject_id, date_trunc('week', {WDAY}) AS week, count(*) AS sessions, sum(distance_m) AS distance_m, sum(duration_s) AS duration_s FROM wk WHERE {WDAY} >= DATE '{FROM}' AND {WDAY} < DATE '{TO}' GROUP BY 1, 2)
SELECT subj.subject_id, strftime(w, '%Y-%m-%d') AS week, coalesce(sessions, 0) AS sessions, distance_m, coalesce(duration_s, 0) AS duration_s FROM subj CROSS JOIN range(date_trunc('week', DATE '{FROM}'), DATE '{TO}', INTERVAL 7 DAY) r(w) LEFT JOIN q1 ON q1.subject_id = subj.subject_id AND q1.week = w""")
def weekly_volume(t: Tables):
    """D19, H04."""
    return X.weekly_volume(t.workouts, t.subjects, FROM, TO)


@query("workout_minutes_per_day", f"SELECT subject_id, strftime({WDAY}, '%Y-%m-%d') AS day, round(sum(duration_s) / 60.0, 9) AS minutes FROM wk GROUP BY 1, 2")
def workout_minutes_per_day(t: Tables):
    """D20."""
    return t.workouts.groupBy("subject_id", local_day(F.col("start_ts"), F.col("tz")).alias("day")).agg(F.round(F.sum("duration_s") / 60, 9).alias("minutes"))


@query("monthly_silhouette", """q1 AS (SELECT subject_id, date_trunc('month', CAST(timezone(tz, timezone('UTC', start_ts)) AS DATE)) AS m, sum(duration_s) / 60.0 AS minutes FROM wh GROUP BY 1, 2),
q2 AS (SELECT subject_id, unnest(range(CAST(min(m) AS TIMESTAMP), CAST(max(m) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM q1 GROUP BY 1)
SELECT q2.subject_id, strftime(q2.m, '%Y-%m') AS month, round(coalesce(minutes, 0), 9) AS minutes FROM q2 LEFT JOIN q1 ON q1.subject_id = q2.subject_id AND q1.m = q2.m""")
def monthly_silhouette(t: Tables):
    """D21, H09."""
    return X.monthly_silhouette(t.history)


def records_sql(rows: str) -> str:
    """Record candidates of sessions, by the rules of the five kinds."""
    return f"""q1 AS (SELECT subject_id, tz, activity, workout_id, start_ts, kind, place, value, CASE WHEN kind = 'best_pace' THEN -value ELSE value END AS score FROM (
 SELECT *, 'longest_distance' AS kind, 0 AS place, CASE WHEN distance_m > 0 THEN distance_m END AS value FROM {rows}
 UNION ALL SELECT *, 'longest_duration', 1, CASE WHEN duration_s > 0 THEN CAST(duration_s AS DOUBLE) END FROM {rows}
 UNION ALL SELECT *, 'best_speed', 2, CASE WHEN activity = 'Cycling' AND distance_m >= 20000 AND duration_s > 0 THEN distance_m / 1000 / (duration_s / 3600) END FROM {rows}
 UNION ALL SELECT *, 'best_pace', 3, CASE WHEN activity <> 'Cycling' AND distance_m >= 5000 AND duration_s > 0 THEN duration_s / (distance_m / 1000) END FROM {rows}
 UNION ALL SELECT *, 'biggest_climb', 4, CASE WHEN elevation_up_m > 0 THEN elevation_up_m END FROM {rows}) WHERE value IS NOT NULL),
ev1 AS (SELECT *, max(score) OVER (PARTITION BY subject_id, activity, kind ORDER BY start_ts, workout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM q1)"""


RECORDS = records_sql("wh")


@query("record_events", RECORDS + """
SELECT subject_id, activity, kind, workout_id, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, round(value, 9) AS value, round(abs(best), 9) AS previous FROM ev1 WHERE score > best""")
def record_events(t: Tables):
    """Replay of the running best, in five kinds."""
    return X.record_events(t.history).drop("tz", "place").withColumns({"value": F.round("value", 9), "previous": F.round("previous", 9)})


AGES = f"q2 AS (SELECT *, epoch(TIMESTAMP '{NOW}') - epoch(start_ts) AS age FROM q1)"
BEST = "(score, -epoch(start_ts), -workout_id)"
SPORT_RECORDS = RECORDS + f""", {AGES}, q3 AS (SELECT subject_id, activity, kind, arg_max(value, {BEST}) AS best, arg_max(workout_id, {BEST}) AS workout_id, abs(max(score) FILTER (WHERE age < 365 * 86400)) AS ly,
 abs(max(score) FILTER (WHERE age >= 365 * 86400 AND age < 730 * 86400)) AS lb, count(*) AS sessions, arg_max(age, {BEST}) < 90 * 86400 AS recent FROM q2 GROUP BY 1, 2, 3)"""


@query("sport_records", SPORT_RECORDS + """
SELECT subject_id, activity, kind, round(best, 9) AS best, workout_id, round((ly - lb) / nullif(abs(lb), 0) * 100, 6) AS delta, sessions, recent FROM q3""")
def sport_records(t: Tables):
    """The best of each sport and kind."""
    return X.sport_records(t.history, NOW).withColumns({"best": F.round("best", 9), "delta": F.round("delta", 6)})


@query("emblematic_records", SPORT_RECORDS + """, q4 AS (SELECT *, CASE WHEN (activity, kind) IN (('Running', 'best_pace'), ('Cycling', 'best_speed')) THEN 0 WHEN kind = 'longest_distance' THEN 1 WHEN kind = 'longest_duration' THEN 2 END AS rank FROM q3)
SELECT subject_id, activity, arg_min(kind, rank) AS kind, round(arg_min(best, rank), 9) AS best FROM q4 WHERE rank IS NOT NULL GROUP BY 1, 2""")
def emblematic_records(t: Tables):
    """One record for each sport."""
    return X.emblematic(X.sport_records(t.history, NOW)).select("subject_id", "activity", "kind", F.round("best", 9).alias("best"))


PROGRESSION = f"""y2 AS (SELECT subject_id, activity, kind, year(start_ts) AS year, abs(max(score)) AS value FROM q1 GROUP BY 1, 2, 3, 4),
y3 AS (SELECT subject_id, activity, kind, unnest(range(min(year), {NOW[:4]} + 1)) AS year FROM y2 GROUP BY 1, 2, 3),
yp AS (SELECT subject_id, activity, kind, year, value FROM y3 LEFT JOIN y2 USING (subject_id, activity, kind, year))"""


@query("yearly_progression", RECORDS + f""", {PROGRESSION}
SELECT subject_id, activity, kind, year, round(value, 9) AS value FROM yp""")
def yearly_progression(t: Tables):
    """Dense years with gaps."""
    return X.yearly_progression(t.history, NOW).withColumn("value", F.round("value", 9))


PLACE = "list_position(['longest_distance', 'longest_duration', 'best_speed', 'best_pace', 'biggest_climb'], kind)"


@query("featured_records", RECORDS + f""", {PROGRESSION}, f1 AS (SELECT subject_id, activity, kind, count(value) AS measured FROM yp GROUP BY 1, 2, 3),
f2 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, activity ORDER BY measured DESC, {PLACE}) AS rn FROM f1), f3 AS (SELECT subject_id, activity, max(n) AS sessions FROM (SELECT subject_id, activity, kind, count(*) AS n FROM q1 GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(n) >= 5),
f4 AS (SELECT f2.subject_id, f2.activity, kind, measured, sessions, row_number() OVER (PARTITION BY f2.subject_id ORDER BY sessions DESC, f2.activity) AS place FROM f2 JOIN f3 USING (subject_id, activity) WHERE rn = 1)
SELECT * FROM f4 WHERE place <= 6""")
def featured_records(t: Tables):
    """Sports with five sessions or more, each by its densest progression."""
    return X.featured(X.yearly_progression(t.history, NOW), X.sport_records(t.history, NOW))


def page_sql(rows: str, size: int, page: int) -> str:
    return f"""p1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_ts DESC, workout_id) AS place, CAST(ceil(count(*) OVER (PARTITION BY subject_id) / {size}.0) AS BIGINT) AS pages FROM {rows})
SELECT subject_id, workout_id, activity, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, place, pages FROM p1 WHERE place > (least({page}, pages) - 1) * {size} AND place <= least({page}, pages) * {size}"""


PAGE = ("subject_id", "workout_id", "activity", "start_ts", "place", "pages")


@query("recent_workouts", page_sql("wk", 5, 1))
def recent_workouts(t: Tables):
    """the newest five sessions."""
    return X.session_list(t.workouts, size=5).select(*PAGE)


@query("workout_page", page_sql("(SELECT * FROM wk WHERE activity = 'Running')", 2, 3))
def workout_page(t: Tables):
    """A page of one sport; pages past the end are the last."""
    return X.session_list(t.workouts, "Running", page=3, size=2).select(*PAGE)


@query("kilometre_splits", """q1 AS (SELECT *, sum(value) OVER w AS s, row_number() OVER w AS i FROM pts WINDOW w AS (PARTITION BY workout_id ORDER BY minute)),
q2 AS (SELECT workout_id, i, s - value AS b, value, unnest(range(CAST(floor((s - value) / 1000) AS BIGINT) + 1, CAST(floor(s / 1000) AS BIGINT) + 1)) AS km FROM q1),
q3 AS (SELECT workout_id, km, (i - 1) * 60 + 60 * (km * 1000 - b) / value AS met FROM q2)
SELECT workout_id, km, CAST(floor(met - coalesce(lag(met) OVER (PARTITION BY workout_id ORDER BY km), 0) + 0.5) AS BIGINT) AS seconds FROM q3""")
def kilometre_splits(t: Tables):
    """E15."""
    return X.kilometre_splits(t.points)


#: A period that reaches past today, so that the window is cut: 30 days that end with today.
TODAY = "2024-01-25"
SPAN = timeline_window(Range(parse_day(FROM), parse_day(TO)), parse_day(TODAY))
BOUNDS = f"BETWEEN DATE '{SPAN.start}' AND DATE '{SPAN.end}' - 1"
ALL_SESSIONS = "wa AS (SELECT * FROM wh WHERE workout_id % 2 = 0 UNION ALL SELECT * FROM wk WHERE workout_id % 2 = 1)"


def all_sessions(t: Tables):
    """Half of the sessions in January and half in the years before, so that some January ones are records."""
    return t.history.where("workout_id % 2 = 0").unionByName(t.workouts.where("workout_id % 2 = 1"))


TIMELINE = NIGHTS.replace(f"night >= DATE '{FROM}' AND night < DATE '{TO}'", f"night {BOUNDS}").replace(f"WHERE night < DATE '{TO}'", f"WHERE night {BOUNDS}").replace("q1 AS", "n1 AS").replace("FROM q1", "FROM n1") + f""", {ALL_SESSIONS}, {records_sql("wa")},
s1 AS (SELECT subject_id, 'workout' AS kind, {WDAY} AS day, CAST(epoch(start_ts) AS BIGINT) AS ts, workout_id AS ref, CAST(NULL AS VARCHAR) AS what, 0 AS tie FROM wa),
s2 AS (SELECT subject_id, 'night' AS kind, night AS day, CAST(floor(epoch(coalesce(sleep_end, CAST(night AS TIMESTAMP)))) AS BIGINT) AS ts, 0 AS ref, CAST(NULL AS VARCHAR) AS what, 0 AS tie FROM nights),
s3 AS (SELECT subject_id, 'record' AS kind, {WDAY} AS day, CAST(epoch(start_ts) AS BIGINT) AS ts, workout_id AS ref, kind AS what, place AS tie FROM ev1 WHERE score > best),
s4 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, kind ORDER BY day DESC, ts DESC, ref, tie) AS rn FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) WHERE day {BOUNDS}),
s5 AS (SELECT * FROM s4 WHERE rn <= CASE kind WHEN 'workout' THEN 10 WHEN 'night' THEN 5 ELSE 4 END),
s6 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY kind <> 'record', day DESC, ts DESC, CASE kind WHEN 'workout' THEN 0 WHEN 'night' THEN 1 ELSE 2 END, ref, tie) AS slot,
 greatest(10, count(*) FILTER (WHERE kind = 'record') OVER (PARTITION BY subject_id)) AS budget, count(*) OVER (PARTITION BY subject_id) AS total FROM s5)"""


def entries(t: Tables):
    night = X.sleep_nights(t.sleep_segments, t.sleep_daily, t.sources, str(SPAN.start), str(SPAN.end))
    every = all_sessions(t)
    return X.timeline(every, night, X.record_events(every), str(SPAN.start), str(SPAN.end))


@query("activity_timeline", TIMELINE + """
SELECT subject_id, kind, strftime(day, '%Y-%m-%d') AS day, ts, ref, what, total > budget AS truncated FROM s6 WHERE slot <= budget""")
def activity_timeline(t: Tables):
    """A budgeted merge of sessions, nights and records."""
    return entries(t)


@query("timeline_days", TIMELINE + """
SELECT subject_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS entries, max(ts) AS newest, string_agg(kind || ':' || ref, ',' ORDER BY ts DESC, kind, ref, what) AS stream FROM s6 WHERE slot <= budget GROUP BY 1, 2""")
def timeline_days(t: Tables):
    """The stream by day."""
    line = F.array_join(F.transform("entries", lambda e: F.concat(e["kind"], F.lit(":"), e["ref"].cast("string"))), ",")
    return X.by_day(entries(t)).select("subject_id", "day", F.size("entries").alias("entries"), F.element_at("entries", 1)["ts"].alias("newest"), line.alias("stream"))


@query("timeline_sessions", f"""{ALL_SESSIONS}, h1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_ts DESC, workout_id) AS place FROM wa WHERE {WDAY} {BOUNDS}),
h2 AS (SELECT h1.subject_id, h1.workout_id, place, CAST(sum(o.value) AS DOUBLE) / nullif(count(o.value), 0) AS avg_hr FROM h1 LEFT JOIN obs o ON o.subject_id = h1.subject_id AND o.type = 'purchase' AND o.start_ts >= h1.start_ts AND o.start_ts < h1.end_ts WHERE place <= 10 GROUP BY 1, 2, 3)
SELECT subject_id, workout_id, place, round(avg_hr, 9) AS avg_hr FROM h2""")
def timeline_sessions(t: Tables):
    """The window's newest ten sessions with their mean rate."""
    day = local_day(F.col("start_ts"), F.col("tz"))
    inside = all_sessions(t).where((day >= str(SPAN.start)) & (day < str(SPAN.end)))
    newest = X.session_list(inside, size=10)
    rated = X.interval_rate(newest, t.observations.where("type = 'purchase'"))
    return rated.select("subject_id", "workout_id", "place", F.round("avg_hr", 9).alias("avg_hr"))


@query("session_detail", HR + f""", q3 AS (SELECT *, {WDAY} AS day FROM q2)
SELECT a.workout_id, round(avg(b.avg_hr), 6) AS usual_hr, CASE WHEN any_value(a.distance_m) > 0 THEN round(any_value(a.duration_s) / (any_value(a.distance_m) / 1000), 6) END AS pace, CASE WHEN any_value(a.distance_m) > 0 THEN round(any_value(a.distance_m) / any_value(a.duration_s) * 3.6, 6) END AS speed
FROM q3 a LEFT JOIN q3 b ON a.subject_id = b.subject_id AND a.activity = b.activity AND b.day < a.day AND b.day >= a.day - 90 AND b.avg_hr IS NOT NULL GROUP BY a.workout_id""")
def session_detail(t: Tables):
    """Mean rate of the sport's sessions in the 90 days before a session's day; pace and speed.

    A range window over days instead of a self-join: each session reads its sport's running sums."""
    w = with_hr(t).withColumn("n", F.datediff(local_day(F.col("start_ts"), F.col("tz")), F.lit("1970-01-01")))
    span = Window.partitionBy("subject_id", "activity").orderBy("n").rangeBetween(-90, -1)
    fine = F.col("distance_m") > 0
    return w.select("workout_id", F.round(F.avg("avg_hr").over(span), 6).alias("usual_hr"), F.when(fine, F.round(F.col("duration_s") / (F.col("distance_m") / 1000), 6)).alias("pace"), F.when(fine, F.round(F.col("distance_m") / F.col("duration_s") * 3.6, 6)).alias("speed"))


@query("night_views", NIGHTS + """
SELECT n.subject_id, strftime(night, '%Y-%m-%d') AS night, round(coalesce(deep_s, 0) / 3600.0, 9) AS deep_h, round(coalesce(core_s, 0) / 3600.0, 9) AS core_h, round(coalesce(rem_s, 0) / 3600.0, 9) AS rem_h, round(coalesce(awake_s, 0) / 3600.0, 9) AS awake_h, round(asleep_s / 3600.0, 9) AS asleep_h,
 strftime(timezone(tz, timezone('UTC', sleep_start)), '%H:%M') AS bedtime FROM nights n JOIN subj USING (subject_id) WHERE asleep_s IS NOT NULL""")
def night_views(t: Tables):
    """Hours by phase and the bedtime."""
    return X.night_view(nights(t), t.subjects)


@query("missing_nights", NIGHTS + " SELECT subj.subject_id, count(asleep_s) AS measured, 25 - count(asleep_s) AS missing FROM subj LEFT JOIN nights USING (subject_id) GROUP BY 1")
def missing_nights(t: Tables):
    """Of a window of 30 days, 25 have passed."""
    return X.missing_nights(nights(t), t.subjects, 30, 25)


@query("sport_tiles", HR + f""", w2 AS (SELECT *, CASE WHEN {WDAY} >= DATE '2024-01-16' AND {WDAY} < DATE '2024-01-31' THEN 'now' WHEN {WDAY} >= DATE '2024-01-01' AND {WDAY} < DATE '2024-01-16' THEN 'before' END AS part FROM q2),
s2 AS (SELECT subject_id, part, count(*) AS sessions, sum(duration_s) AS duration_s, sum(distance_m) AS distance_m, sum(energy_kj) AS energy_kj, avg(avg_hr) AS avg_hr FROM w2 WHERE part IS NOT NULL GROUP BY 1, 2),
t2(subject_id, part, tile, v) AS ({" UNION ALL ".join(f"SELECT subject_id, part, '{c}', CAST({c} AS DOUBLE) FROM s2" for c in ("sessions", "duration_s", "distance_m", "energy_kj", "avg_hr"))}),
b2 AS (SELECT subj.subject_id, k.tile, CASE WHEN k.tile IN ('sessions', 'duration_s') THEN coalesce(max(v) FILTER (WHERE part = 'now'), 0) ELSE max(v) FILTER (WHERE part = 'now') END AS now, CASE WHEN k.tile IN ('sessions', 'duration_s') THEN coalesce(max(v) FILTER (WHERE part = 'before'), 0) ELSE max(v) FILTER (WHERE part = 'before') END AS before
 FROM subj CROSS JOIN (VALUES ('sessions'), ('duration_s'), ('distance_m'), ('energy_kj'), ('avg_hr')) k(tile) LEFT JOIN t2 ON t2.subject_id = subj.subject_id AND t2.tile = k.tile GROUP BY 1, 2)
SELECT subject_id, tile, round(now, 6) AS value, round((now - before) / nullif(abs(before), 0) * 100, 6) AS delta FROM b2""")
def sport_tiles(t: Tables):
    """Five figures of two adjacent windows."""
    tiles = X.sport_tiles(with_hr(t), t.subjects, ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-16"))
    return tiles.withColumns({"value": F.round("value", 6), "delta": F.round("delta", 6)})


@query("sessions_with_points", "SELECT workout_id, EXISTS (SELECT 1 FROM pts WHERE pts.workout_id = wk.workout_id AND minute >= 5) AS has_points FROM wk")
def sessions_with_points(t: Tables):
    """Whether a session has rows of its own, without counting them."""
    some = t.points.where("minute >= 5").select("workout_id").distinct().withColumn("has_points", F.lit(True))
    return t.workouts.select("workout_id").join(some, "workout_id", "left").na.fill(False)
