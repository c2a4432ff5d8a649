"""Series queries: daily, bucketed, rolled up, reduced and compared."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.timefns import iso_week, local_day, local_midnight, percent_delta
from ..lake import Lake
from ..operators import sessions as X
from ..operators import series as S
from ..sources.canonical import CUMULATIVE, FROM_DAY, METRICS, TO_DAY, Tables
from ..store import scratch_path
from .registry import query
from .windows import Range, comparison, granularity, months, parse_day, source_plan

TODAY = "2024-01-30"
WINDOW = Range(parse_day(FROM_DAY), parse_day(TO_DAY))
L = "CAST(timezone(tz, timezone('UTC', {0})) AS DATE)"
DAY = L.format("start_ts")
IN = f"BETWEEN DATE '{FROM_DAY}' AND DATE '{TO_DAY}' - 1"
FMT = "strftime({0}, '%Y-%m-%d') AS {0}"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def axis(t: Tables):
    return S.day_axis(t.subjects, FROM_DAY, TO_DAY)


def parts(t: Tables, grain: str = "hour"):
    return S.cumulative_parts(t.observations, t.minutes, t.cutovers, t.priorities, t.sources, list(CUMULATIVE), FROM_DAY, TO_DAY, grain)


def built(t: Tables, obs=None):
    return S.build_rollup(t.observations if obs is None else obs, t.minutes, t.cutovers, t.priorities, t.sources, list(CUMULATIVE), ["purchase", "signup"])


def rollup(t: Tables):
    """The kept hourly rollup, by type."""
    return t.kept("rollup_hourly", built(t), "type")


def edges(t: Tables):
    """The kept pieces of hours that local midnights cut, by type."""
    made = S.build_edges(t.observations, t.minutes, t.cutovers, t.priorities, t.sources, t.subjects, list(CUMULATIVE), ["purchase", "signup"])
    return t.kept("rollup_edges", made, "type")


def daily_series(t: Tables, type_: str, window: Range, today: str, source: str | None = None):
    """(subject_id, day, value, n) of one metric for any window: the plan reads the kept rollup for long
    windows of sums and averages, and raw rows else, or as ``source`` says. Both give the same numbers."""
    regime, aggregation = METRICS[type_]
    a, b = window.start.isoformat(), window.end.isoformat()
    rows = t.observations.where(F.col("type") == type_)
    if regime == "category":
        return S.occurrence_days(rows, S.day_axis(t.subjects, a, b), type_, "count", a, b).withColumn("n", F.col("value").cast("long"))
    pieces = lambda first: S.cumulative_parts(t.observations, t.minutes, t.cutovers, t.priorities, t.sources, [type_], first, b)
    if source_plan(window, aggregation, source) == "rollup":
        first = min(max(a, today), b)
        tail = pieces(first) if regime == "cumulative" else S.in_window(rows.where("value is not null"), "start_ts", first, b).withColumn("v", F.col("value"))
        of = lambda kept: kept.where(F.col("type") == type_)
        out = S.daily_hybrid(of(rollup(t)), of(edges(t)), tail.select("subject_id", "day", "v"), t.subjects, aggregation, a, b, today)
    elif regime == "cumulative":
        out = S.daily_cumulative(pieces(a), S.day_axis(t.subjects, a, b), type_)
    else:
        out = S.daily_discrete(rows, S.day_axis(t.subjects, a, b), type_, aggregation, a, b)
    return out.select("subject_id", "day", "value", *[c for c in ("min", "max") if c in out.columns], "n")


def discrete_sql(type_: str, value: str, rows: str = "obs") -> str:
    return f"""q AS (SELECT subject_id, {DAY} AS day, {value} AS value, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max, count(value) AS n
 FROM {rows} WHERE type = '{type_}' AND {DAY} {IN} GROUP BY 1, 2)
SELECT days.subject_id, {FMT.format('day')}, value, min, max, n FROM days LEFT JOIN q USING (subject_id, day)"""


@query("daily_average", discrete_sql("purchase", "CAST(sum(value) AS DOUBLE) / count(value)"))
def daily_average(t: Tables):
    """Mean per local day on a dense axis; days without samples are null."""
    return S.daily_discrete(t.observations, axis(t), "purchase", "average", FROM_DAY, TO_DAY)


HOLES = "(SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM obs)"


@query("daily_latest", discrete_sql("signup", "CAST((array_agg(value ORDER BY start_ts DESC, event_id DESC))[1] AS DOUBLE)", HOLES))
def daily_latest(t: Tables):
    """The day's newest row, also where it was not measured: a seventh of the values is taken out."""
    rows = t.observations.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return S.daily_discrete(rows, axis(t), "signup", "latest", FROM_DAY, TO_DAY)


def parts_sql(grain: str) -> str:
    return f"""q1 AS (SELECT o.subject_id, o.type, {DAY} AS day, date_trunc('{grain}', start_ts) AS ts, source_id, sum(value) AS v
 FROM obs o LEFT JOIN cut USING (subject_id, type) WHERE type IN ('click', 'view') AND origin = 'health_xml' AND value IS NOT NULL
 AND start_ts < coalesce(cutover_ts, TIMESTAMP '9999-12-31') AND {DAY} {IN} GROUP BY ALL),
q2 AS (SELECT q1.*, row_number() OVER (PARTITION BY subject_id, type, day, ts ORDER BY rank ASC NULLS LAST, regexp_matches(name, '(?i)watch') DESC, v DESC, source_id) AS rn
 FROM q1 LEFT JOIN prio USING (subject_id, type, source_id) LEFT JOIN src USING (source_id)),
q3 AS (SELECT subject_id, type, day, ts, v FROM q2 WHERE rn = 1 UNION ALL
 SELECT m.subject_id, m.type, {L.format('minute_ts')}, minute_ts, value FROM mins m JOIN cut USING (subject_id, type) WHERE minute_ts >= cutover_ts AND {L.format('minute_ts')} {IN})"""


@query("daily_cumulative", parts_sql("hour") + f""",
q4 AS (SELECT subject_id, day, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM q3 WHERE type = 'click' GROUP BY 1, 2)
SELECT days.subject_id, {FMT.format('day')}, value, n FROM days LEFT JOIN q4 USING (subject_id, day)""")
def daily_cumulative(t: Tables):
    """One winning source per hour before the cutover, minutes after it."""
    return S.daily_cumulative(parts(t), axis(t), "click")


ROLLUP_SQL = """q1 AS (SELECT o.subject_id, o.type, date_trunc('hour', start_ts) AS hour_utc, source_id, sum(value) AS v
 FROM obs o LEFT JOIN cut USING (subject_id, type) WHERE type IN ('click', 'view') AND origin = 'health_xml' AND start_ts < coalesce(cutover_ts, TIMESTAMP '9999-12-31') GROUP BY ALL),
q2 AS (SELECT q1.*, row_number() OVER (PARTITION BY subject_id, type, hour_utc ORDER BY rank ASC NULLS LAST, regexp_matches(name, '(?i)watch') DESC, v DESC, source_id) AS rn
 FROM q1 LEFT JOIN prio USING (subject_id, type, source_id) LEFT JOIN src USING (source_id)),
q3 AS (SELECT subject_id, type, hour_utc, v FROM q2 WHERE rn = 1 UNION ALL SELECT m.subject_id, m.type, date_trunc('hour', minute_ts), value FROM mins m
 UNION ALL SELECT subject_id, type, date_trunc('hour', start_ts), value FROM obs WHERE type IN ('purchase', 'signup')),
q4 AS (SELECT subject_id, type, hour_utc, count(*) AS n, sum(v) AS sum, min(v) AS min, max(v) AS max FROM q3 GROUP BY 1, 2, 3)"""


@query("rollup_hourly", ROLLUP_SQL + f"""
SELECT subject_id, type, {TS.format('hour_utc')}, n, CAST(sum AS DOUBLE) AS sum, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max FROM q4""")
def rollup_hourly(t: Tables):
    """Hourly states of all types."""
    return rollup(t)


@query("hybrid_daily_average", discrete_sql("purchase", "CAST(sum(value) AS DOUBLE) / count(value)"))
def hybrid_daily_average(t: Tables):
    """The same numbers as the raw series, from the rollup and its edges."""
    return daily_series(t, "purchase", WINDOW, TODAY, "rollup")


@query("hybrid_daily_sum", parts_sql("hour") + f""",
q4 AS (SELECT subject_id, day, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM q3 WHERE type = 'view' GROUP BY 1, 2)
SELECT days.subject_id, {FMT.format('day')}, value, n FROM days LEFT JOIN q4 USING (subject_id, day)""")
def hybrid_daily_sum(t: Tables):
    """The cumulative series from the rollup and its edges."""
    return daily_series(t, "view", WINDOW, TODAY, "rollup")


LONG = Range(parse_day("2023-12-20"), parse_day("2024-02-03"))
LONG_DAYS = "ld AS (SELECT subject_id, CAST(d AS DATE) AS day FROM subj, range(DATE '2023-12-20', DATE '2024-02-03', INTERVAL 1 DAY) r(d))"
LONG_IN = "BETWEEN DATE '2023-12-20' AND DATE '2024-02-02'"
RAW_DAY = f"SELECT subject_id, type, {DAY} AS day, {{0}} AS value, count(value) AS n FROM obs WHERE type = '{{1}}' AND {DAY} {LONG_IN} GROUP BY 1, 2, 3"


@query("daily_series_planned", parts_sql("hour").replace(IN, LONG_IN) + f""",
{LONG_DAYS}, s AS (SELECT subject_id, type, day, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM q3 GROUP BY 1, 2, 3 UNION ALL {RAW_DAY.format("CAST(sum(value) AS DOUBLE) / count(value)", "purchase")}
 UNION ALL {RAW_DAY.format("CAST(arg_max(value, (start_ts, event_id)) AS DOUBLE)", "signup")} UNION ALL {RAW_DAY.format("CAST(count(*) AS DOUBLE)", "error").replace("count(value)", "count(*)")}),
kinds(type, plan) AS (VALUES ('click', 'rollup'), ('view', 'rollup'), ('purchase', 'rollup'), ('signup', 'raw'), ('error', 'raw'))
SELECT k.type, plan, ld.subject_id, strftime(ld.day, '%Y-%m-%d') AS day, round(value, 9) AS value, n FROM ld CROSS JOIN kinds k LEFT JOIN s ON s.subject_id = ld.subject_id AND s.day = ld.day AND s.type = k.type""")
def daily_series_planned(t: Tables):
    """Every metric over 45 days, each by the plan that its window and aggregation choose."""
    out = None
    for type_, (_, aggregation) in METRICS.items():
        plan = F.lit(source_plan(LONG, aggregation)).alias("plan")
        one = daily_series(t, type_, LONG, TODAY).select(F.lit(type_).alias("type"), plan, "subject_id", "day", F.round("value", 9).alias("value"), "n")
        out = one if out is None else out.unionByName(one)
    return out


NIGHT = "CAST(timezone(tz, timezone('UTC', start_ts)) + INTERVAL 12 HOUR AS DATE)"


@query("derived_daily", f"""wd AS (SELECT subject_id, {DAY} AS day, sum(duration_s) / 60.0 AS value FROM wk GROUP BY 1, 2),
n1 AS (SELECT *, {NIGHT} AS night, epoch_us(end_ts) / 1e6 - epoch_us(start_ts) / 1e6 AS sec FROM seg),
n2 AS (SELECT subject_id, night, source_id, CAST(round(sum(sec) FILTER (WHERE stage IN (1, 3, 4, 5))) AS BIGINT) AS asleep_s FROM n1 WHERE night {IN} GROUP BY 1, 2, 3),
n3 AS (SELECT n2.*, row_number() OVER (PARTITION BY subject_id, night ORDER BY regexp_matches(name, '(?i)watch') DESC NULLS LAST, asleep_s DESC NULLS LAST, source_id) AS rn FROM n2 LEFT JOIN src USING (source_id)),
n4 AS (SELECT subject_id, night, CASE WHEN asleep_s > 0 THEN asleep_s ELSE core_s + deep_s + rem_s END AS asleep_s FROM sday WHERE night {IN}),
nn AS (SELECT * FROM n4 UNION ALL SELECT subject_id, night, asleep_s FROM n3 WHERE rn = 1 AND (subject_id, night) NOT IN (SELECT subject_id, night FROM n4))
SELECT 'derived:training_time' AS type, days.subject_id, strftime(days.day, '%Y-%m-%d') AS day, round(value, 9) AS value FROM days LEFT JOIN wd ON wd.subject_id = days.subject_id AND wd.day = days.day
UNION ALL SELECT 'derived:sleep_asleep', days.subject_id, strftime(days.day, '%Y-%m-%d'), round(asleep_s / 3600.0, 9) FROM days LEFT JOIN nn ON nn.subject_id = days.subject_id AND night = days.day""")
def derived_daily(t: Tables):
    """Minutes of training by local day and hours asleep by the day of waking; days without are null."""
    day = local_day(F.col("start_ts"), F.col("tz"))
    train = t.workouts.groupBy("subject_id", day.alias("day")).agg((F.sum("duration_s") / 60).alias("value"))
    nights = X.sleep_nights(t.sleep_segments, t.sleep_daily, t.sources, FROM_DAY, TO_DAY)
    asleep = nights.select("subject_id", F.col("night").alias("day"), (F.col("asleep_s") / 3600).alias("value"))
    days = axis(t).select("subject_id", "day")
    of = lambda name, rows: days.join(rows, ["subject_id", "day"], "left").select(F.lit(name).alias("type"), "subject_id", "day", F.round("value", 9).alias("value"))
    return of("derived:training_time", train).unionByName(of("derived:sleep_asleep", asleep))


def bucket_sql(from_day: str, to_day: str, width: int, rows: str) -> str:
    t0 = f"timezone('UTC', timezone(tz, TIMESTAMP '{from_day}'))"
    t1 = f"timezone('UTC', timezone(tz, TIMESTAMP '{to_day}'))"
    return f"""qa AS (SELECT subject_id, tz, b AS bucket FROM subj, range({t0}, {t1}, INTERVAL {width} SECOND) r(b)),
{rows}
SELECT qa.subject_id, {TS.format('bucket').replace('strftime(bucket', 'strftime(qa.bucket')}, value, n FROM qa LEFT JOIN qb ON qa.subject_id = qb.subject_id AND qa.bucket = qb.bucket"""


def bin_sql(ts: str, from_day: str, width: int) -> str:
    return f"time_bucket(INTERVAL {width} SECOND, {ts}, timezone('UTC', timezone(tz, TIMESTAMP '{from_day}')))"


@query("bucket_hour_average", bucket_sql("2024-01-05", "2024-01-12", 3600, f"""qb AS (SELECT subject_id, {bin_sql('start_ts', '2024-01-05', 3600)} AS bucket, CAST(sum(value) AS DOUBLE) / count(value) AS value, count(value) AS n
 FROM obs WHERE type = 'purchase' AND {DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1, 2)"""))
def bucket_hour_average(t: Tables):
    """Hours from local midnight, also in zones off by half an hour."""
    rows = t.observations.where("type = 'purchase'")
    return S.bucket_series(rows, t.subjects, "2024-01-05", "2024-01-12", 3600, "start_ts", S.value_of("average"), [F.count("value").alias("n")])


@query("bucket_minute_sum", parts_sql("minute").replace(IN, "BETWEEN DATE '2024-01-16' AND DATE '2024-01-16'") + ",\n" + bucket_sql("2024-01-16", "2024-01-17", 60, f"""qb AS (SELECT q3.subject_id, {bin_sql('ts', '2024-01-16', 60)} AS bucket, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM q3 JOIN subj USING (subject_id) WHERE type = 'click' GROUP BY 1, 2)"""))
def bucket_minute_sum(t: Tables):
    """Winner per minute on the day of the cutover."""
    p = S.cumulative_parts(t.observations, t.minutes, t.cutovers, t.priorities, t.sources, list(CUMULATIVE), "2024-01-16", "2024-01-17", "minute")
    rows = p.where("type = 'click'").join(t.subjects, "subject_id")
    return S.bucket_series(rows, t.subjects, "2024-01-16", "2024-01-17", 60, "ts", F.sum("v").cast("double"), [F.count("*").alias("n")])


def occurrence_sql(value: str) -> str:
    return f"""q AS (SELECT subject_id, {DAY} AS day, {value} AS value FROM obs WHERE type = 'error' AND {DAY} {IN} GROUP BY 1, 2)
SELECT days.subject_id, {FMT.format('day')}, value FROM days LEFT JOIN q USING (subject_id, day)"""


@query("occurrences_per_day", occurrence_sql("CAST(count(*) AS DOUBLE)"))
def occurrences_per_day(t: Tables):
    """D12 counted."""
    return S.occurrence_days(t.observations, axis(t), "error", "count", FROM_DAY, TO_DAY)


@query("occurrence_seconds_per_day", occurrence_sql("CAST(sum(epoch(end_ts) - epoch(start_ts)) AS DOUBLE)"))
def occurrence_seconds_per_day(t: Tables):
    """D12 as durations."""
    return S.occurrence_days(t.observations, axis(t), "error", "duration", FROM_DAY, TO_DAY)


RAW = f"""q AS (SELECT subject_id, {DAY} AS day, CAST(sum(value) AS DOUBLE) / count(value) AS value FROM obs WHERE type = 'purchase' AND {DAY} {IN} GROUP BY 1, 2),
q0 AS (SELECT days.subject_id, days.day, value FROM days LEFT JOIN q USING (subject_id, day))"""


def raw_daily(t: Tables):
    return daily_average(t).select("subject_id", "day", "value")


@query("window_reduction", RAW + """
SELECT subject_id, round(avg(value), 9) AS mean, arg_max(value, day) FILTER (WHERE value IS NOT NULL) AS latest, round(sum(value), 9) AS total, min(value) AS low, max(value) AS high, count(value) AS measured FROM q0 GROUP BY 1""")
def window_reduction(t: Tables):
    """One value of a window by aggregation, extremes and coverage."""
    s = raw_daily(t)
    out = S.reduce_window(s, "average").withColumn("mean", F.round("value", 9)).drop("value")
    for name, agg in (("latest", "latest"), ("total", "sum")):
        v = F.col("value") if agg == "latest" else F.round("value", 9)
        out = out.join(S.reduce_window(s, agg).select("subject_id", v.alias(name)), "subject_id")
    return out


@query("period_trend", RAW + """
SELECT subject_id, round(avg(value) FILTER (WHERE day >= DATE '2024-01-16'), 9) AS now, round(avg(value) FILTER (WHERE day < DATE '2024-01-16'), 9) AS before,
 round((avg(value) FILTER (WHERE day >= DATE '2024-01-16') - avg(value) FILTER (WHERE day < DATE '2024-01-16')) / nullif(abs(avg(value) FILTER (WHERE day < DATE '2024-01-16')), 0) * 100, 6) AS delta FROM q0 GROUP BY 1""")
def period_trend(t: Tables):
    """Two adjacent windows from one read, and the change in per cent."""
    late = F.col("day") >= "2024-01-16"
    s = raw_daily(t).groupBy("subject_id").agg(F.avg(F.when(late, F.col("value"))).alias("now"), F.avg(F.when(~late, F.col("value"))).alias("before"))
    return s.select("subject_id", F.round("now", 9).alias("now"), F.round("before", 9).alias("before"), F.round(percent_delta(F.col("now"), F.col("before")), 6).alias("delta"))


@query("day_extremes", RAW + """
SELECT subject_id, strftime(arg_min(day, (value, day)) FILTER (WHERE value IS NOT NULL), '%Y-%m-%d') AS low_day, strftime(arg_max(day, (value, -epoch(day))) FILTER (WHERE value IS NOT NULL), '%Y-%m-%d') AS high_day FROM q0 GROUP BY 1""")
def day_extremes(t: Tables):
    """The first day of the lowest and of the highest value."""
    s = raw_daily(t).where("value is not null")
    out = s.groupBy("subject_id").agg(F.min(F.struct("value", "day")).alias("lo"), F.max(F.struct("value", (-F.datediff("day", F.lit("1970-01-01"))).alias("neg"), "day")).alias("hi"))
    return t.subjects.select("subject_id").join(out, "subject_id", "left").select("subject_id", F.col("lo.day").alias("low_day"), F.col("hi.day").alias("high_day"))


@query("rolling_mean", RAW + f"""
SELECT subject_id, {FMT.format('day')}, value, round(CASE WHEN value IS NOT NULL THEN avg(value) OVER (PARTITION BY subject_id ORDER BY q0.day ROWS 6 PRECEDING) END, 9) AS rolling FROM q0""")
def rolling_mean(t: Tables):
    """E09."""
    return S.rolling_mean(raw_daily(t), 7).withColumn("rolling", F.round("rolling", 9))


@query("downsample", RAW + """, q1 AS (SELECT *, (row_number() OVER (PARTITION BY subject_id ORDER BY day) - 1) // CAST(ceil(count(*) OVER (PARTITION BY subject_id) / 12.0) AS BIGINT) AS bucket FROM q0)
SELECT subject_id, bucket, round(avg(value), 9) AS value, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM q1 GROUP BY 1, 2""")
def downsample(t: Tables):
    """E10, E11."""
    return S.downsample(raw_daily(t), 12).withColumn("value", F.round("value", 9))


@query("measured_segments", RAW + """, q1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS i FROM q0),
q2 AS (SELECT *, i - row_number() OVER (PARTITION BY subject_id ORDER BY day) AS island FROM q1 WHERE value IS NOT NULL)
SELECT subject_id, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS points FROM q2 GROUP BY subject_id, island""")
def measured_segments(t: Tables):
    """Gaps and islands."""
    return S.segments(raw_daily(t))


@query("dirty_hour_runs", """q1 AS (SELECT DISTINCT subject_id, type, date_trunc('hour', start_ts) AS h FROM obs WHERE type <> 'error'),
q2 AS (SELECT *, epoch(h) / 3600 - row_number() OVER (PARTITION BY subject_id, type ORDER BY h) AS island FROM q1)
SELECT subject_id, type, strftime(min(h), '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(max(h) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS to_ts, count(*) AS hours FROM q2 GROUP BY subject_id, type, island""")
def dirty_hour_runs(t: Tables):
    """Changed hours as minimal ranges; categories have no rollup."""
    h = t.observations.where("type <> 'error'").select("subject_id", "type", F.date_trunc("hour", "start_ts").alias("hour_utc"))
    return S.hour_runs(h, ["subject_id", "type"])


WIDTHS = {"minute": 60, "hour": 3600}


def explore_chart(t: Tables, type_: str, window: Range, today: str):
    """(subject_id, bucket, value, n): a metric at the grain that suits the window, minutes up to two days, hours
    up to three weeks, else local days, on a dense axis; a bucket is named by the instant it begins at."""
    regime, aggregation = METRICS[type_]
    grain, a, b = granularity(window), window.start.isoformat(), window.end.isoformat()
    if grain == "day":
        s = daily_series(t, type_, window, today).join(t.subjects, "subject_id")
        return s.select("subject_id", local_midnight(F.col("day"), F.col("tz")).alias("bucket"), "value", "n")
    if regime == "cumulative":
        rows = S.cumulative_parts(t.observations, t.minutes, t.cutovers, t.priorities, t.sources, [type_], a, b, grain).join(t.subjects, "subject_id")
        return S.bucket_series(rows, t.subjects, a, b, WIDTHS[grain], "ts", F.sum("v").cast("double"), [F.count("*").alias("n")])
    rows = t.observations.where(F.col("type") == type_)
    return S.bucket_series(rows, t.subjects, a, b, WIDTHS[grain], "start_ts", S.value_of(aggregation), [F.count("value").alias("n")])


def days(a: str, b: str) -> Range:
    return Range(parse_day(a), parse_day(b))


@query("explore_hours", parts_sql("hour").replace(IN, "BETWEEN DATE '2024-01-12' AND DATE '2024-01-18'") + ",\n" + bucket_sql("2024-01-12", "2024-01-19", 3600, f"""qb AS (SELECT q3.subject_id, {bin_sql('ts', '2024-01-12', 3600)} AS bucket, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM q3 JOIN subj USING (subject_id) WHERE type = 'view' GROUP BY 1, 2)"""))
def explore_hours(t: Tables):
    """L: a week of a cumulative metric, by hours."""
    return explore_chart(t, "view", days("2024-01-12", "2024-01-19"), TODAY)


@query("explore_minutes", bucket_sql("2024-01-10", "2024-01-12", 60, f"""qb AS (SELECT subject_id, {bin_sql('start_ts', '2024-01-10', 60)} AS bucket, CAST(arg_max(value, (start_ts, event_id)) AS DOUBLE) AS value, count(value) AS n
 FROM obs WHERE type = 'signup' AND {DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-01-11' GROUP BY 1, 2)"""))
def explore_minutes(t: Tables):
    """L: two days of a state, by minutes."""
    return explore_chart(t, "signup", days("2024-01-10", "2024-01-12"), TODAY)


PAIR = days("2024-01-16", TO_DAY)


@query("metric_window_stats", RAW + """, n AS (SELECT * FROM q0 WHERE day >= DATE '2024-01-16'), b AS (SELECT subject_id, avg(value) AS before FROM q0 WHERE day < DATE '2024-01-16' GROUP BY 1),
s AS (SELECT n.subject_id, avg(value) AS value, any_value(before) AS before, min(value) AS low, arg_min(n.day, (value, n.day)) FILTER (WHERE value IS NOT NULL) AS ld, max(value) AS high, arg_max(n.day, (value, -epoch(n.day))) FILTER (WHERE value IS NOT NULL) AS hd, count(value) AS measured FROM n JOIN b USING (subject_id) GROUP BY 1),
d AS (SELECT *, (value - before) / nullif(abs(before), 0) * 100 AS delta FROM s)
SELECT subject_id, round(value, 9) AS value, round(before, 9) AS before, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'off' WHEN abs(delta) < 0.5 THEN 'flat' WHEN delta < 0 THEN 'good' ELSE 'bad' END AS quality, low, strftime(ld, '%Y-%m-%d') AS low_day, high, strftime(hd, '%Y-%m-%d') AS high_day, measured FROM d""")
def metric_window_stats(t: Tables):
    """L, D28-D30, H31: the figures over a chart, from one read of both windows."""
    before = comparison(PAIR, PAIR.end)
    both = daily_series(t, "purchase", Range(before.start, PAIR.end), TODAY)
    text = lambda r: (r.start.isoformat(), r.end.isoformat())
    out = S.window_stats(both, "average", text(PAIR), text(before), True)
    return out.withColumns({"value": F.round("value", 9), "before": F.round("before", 9), "delta": F.round("delta", 6)})


@query("rollup_by_month", ROLLUP_SQL + f"""
SELECT subject_id, type, {TS.format('hour_utc')}, n, CAST(sum AS DOUBLE) AS sum, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max FROM q4""")
def rollup_by_month(t: Tables):
    """The whole rollup rebuilt month by month, of all months that there are rows of, each committed when it is done."""
    path = scratch_path(t.spark, "by-month")
    lake = Lake(t.spark, path, {"rollup": "subject_id long, hour_utc timestamp, n long, sum double, min double, max double, type string, month string"}, {"rollup": ("month", "type")})
    days = t.observations.select("utc_day").unionByName(t.minutes.select("utc_day"))
    first, last = days.agg(F.min("utc_day"), F.max("utc_day")).first()
    if first is not None:
        for r in months(Range(first, last + timedelta(days=1))):
            a, b = r.start.isoformat(), r.end.isoformat()
            part = S.build_rollup(S.within(t.observations, "start_ts", a, b), S.within(t.minutes, "minute_ts", a, b), t.cutovers, t.priorities, t.sources, list(CUMULATIVE), ["purchase", "signup"])
            lake.commit({}, {"rollup": part.withColumn("month", F.date_format("hour_utc", "yyyy-MM"))})
    return lake.read("rollup").drop("month")


@query("granted_daily", "g AS (SELECT subject_id FROM subj WHERE subject_id % 3 = 1), " + discrete_sql("purchase", "CAST(sum(value) AS DOUBLE) / count(value)") + " WHERE subject_id IN (SELECT subject_id FROM g)")
def granted_daily(t: Tables):
    """A viewer sees the subjects that were granted."""
    grants = t.subjects.select((F.col("subject_id") % 3).alias("viewer_id"), "subject_id")
    rows, axis_ = S.scoped(t.observations, grants, 1), S.scoped(axis(t), grants, 1)
    return S.daily_discrete(rows, axis_, "purchase", "average", FROM_DAY, TO_DAY)


@query("viewer_context", """s AS (SELECT subject_id, min(tz) AS tz, min(ts) AS created FROM ev GROUP BY 1), g AS (SELECT DISTINCT k AS viewer_id, subject_id FROM ev),
o AS (SELECT viewer_id, s.*, row_number() OVER (PARTITION BY viewer_id ORDER BY created, subject_id) AS rn FROM g JOIN s USING (subject_id) WHERE subject_id % 4 <> 3 AND viewer_id % 5 <> 0)
SELECT viewer_id, subject_id, tz FROM o WHERE rn = 1""")
def viewer_context(t: Tables):
    """Each enabled viewer's oldest live subject."""
    e = t.events
    state = F.when(F.col("subject_id") % 4 == 3, "purged").otherwise("live")
    subjects = e.groupBy("subject_id").agg(F.min("tz").alias("tz"), F.min("ts").alias("created_at")).withColumn("purge_state", state)
    grants = e.select(F.col("k").alias("viewer_id"), "subject_id").distinct()
    users = e.select(F.col("k").alias("viewer_id")).distinct().withColumn("disabled_at", F.when(F.col("viewer_id") % 5 == 0, F.lit("2024-01-01")))
    return S.viewer_subjects(users, grants, subjects)


@query("iso_weeks", f"SELECT DISTINCT strftime({DAY}, '%Y-%m-%d') AS day, strftime({DAY}, '%G-W%V') AS week FROM obs UNION SELECT '2024-12-30', '2025-W01' UNION SELECT '2023-01-01', '2022-W52'")
def iso_weeks(t: Tables):
    """H13."""
    day = t.observations.select(local_day(F.col("start_ts"), F.col("tz")).alias("day")).distinct()
    edge = t.spark.createDataFrame([("2024-12-30",), ("2023-01-01",)], "day string").select(F.col("day").cast("date").alias("day"))
    return day.unionByName(edge).select("day", iso_week(F.col("day")).alias("week"))
