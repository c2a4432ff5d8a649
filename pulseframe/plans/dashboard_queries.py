"""The dashboard in one request, and the figures of metrics that are counted rather than averaged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import series as S
from ..sources.canonical import Tables
from .catalogue_queries import heatmap
from .registry import ORACLES, query
from .series_queries import DAY, PAIR, daily_average, daily_cumulative, metric_window_stats
from .session_queries import sleep_summary, weekly_volume
from .windows import comparison

NOW = "2024-01-30"


def part(df: DataFrame, name: str, key: Column, value: str, before: Column | None = None) -> DataFrame:
    """A part of the dashboard as (subject_id, part, key, value, before)."""
    old = F.lit(None) if before is None else before
    return df.select("subject_id", F.lit(name).alias("part"), key.alias("key"), F.col(value).cast("double").alias("value"), old.cast("double").alias("before"))


def today(daily: DataFrame, day: str) -> DataFrame:
    """(subject_id, value, usual): a day's value and the mean of the measured days before it."""
    now, then = F.when(F.col("day") == day, F.col("value")), F.when(F.col("day") < day, F.col("value"))
    return daily.groupBy("subject_id").agg(F.max(now).alias("value"), F.round(F.avg(then), 9).alias("usual"))


def sql_part(name: str, of: str, key: str, value: str, before: str = "NULL") -> str:
    return f"SELECT subject_id, '{name}' AS part, {key} AS key, CAST({value} AS DOUBLE) AS value, CAST({before} AS DOUBLE) AS before FROM ({ORACLES[of]}) x"


DASHBOARD = " UNION ALL ".join([
    sql_part("card", "metric_window_stats", "'purchase'", "value", "before"), sql_part("chart", "daily_average", "day", "round(value, 9)"), sql_part("sleep", "sleep_summary", "'hours'", "hours"),
    sql_part("volume", "weekly_volume", "week", "distance_m"), sql_part("heat", "heatmap", "day", "cell"),
    f"SELECT subject_id, 'today', 'click', max(value) FILTER (WHERE day = '{NOW}'), round(avg(value) FILTER (WHERE day < '{NOW}'), 9) FROM ({ORACLES['daily_cumulative']}) x GROUP BY subject_id",
])


@query("dashboard", DASHBOARD)
def dashboard(t: Tables):
    """L: a metric card with its comparison, the chart's days, the sleep card, today against the days before, weekly volume and the
    heatmap, for all subjects at once."""
    day = F.date_format("day", "yyyy-MM-dd")
    parts = [
        part(metric_window_stats(t), "card", F.lit("purchase"), "value", F.col("before")), part(daily_average(t).withColumn("value", F.round("value", 9)), "chart", day, "value"), part(sleep_summary(t), "sleep", F.lit("hours"), "hours"),
        part(weekly_volume(t), "volume", F.date_format("week", "yyyy-MM-dd"), "distance_m"), part(heatmap(t), "heat", day, "cell"), part(today(daily_cumulative(t), NOW), "today", F.lit("click"), "value", F.col("usual")),
    ]
    return reduce(DataFrame.unionByName, parts)


BEFORE = comparison(PAIR, PAIR.end)
A, B, C = BEFORE.start.isoformat(), PAIR.start.isoformat(), PAIR.end.isoformat()
#: Days of the window that have gone by.
ELAPSED = 5


@query("occurrence_stats", f"""d AS (SELECT subject_id, CAST(r AS DATE) AS day FROM subj, range(DATE '{A}', DATE '{C}', INTERVAL 1 DAY) x(r)),
c AS (SELECT subject_id, {DAY} AS day, count(*) AS n FROM obs WHERE type = 'error' GROUP BY 1, 2), x AS (SELECT d.*, n FROM d LEFT JOIN c USING (subject_id, day)),
s AS (SELECT subject_id, coalesce(sum(n) FILTER (WHERE day >= DATE '{B}' AND day < DATE '{B}' + {ELAPSED}), 0) AS total, coalesce(sum(n) FILTER (WHERE day < DATE '{B}'), 0) AS previous,
 count(n) FILTER (WHERE day >= DATE '{B}') AS measured, count(*) FILTER (WHERE day >= DATE '{B}') AS days FROM x GROUP BY 1)
SELECT subject_id, CAST(total AS DOUBLE) AS total, CAST(previous AS DOUBLE) AS previous, round((total - previous) * 100.0 / nullif(previous, 0), 6) AS delta, measured, days FROM s""")
def occurrence_stats(t: Tables):
    """L: how often a category came in the days of a window that have gone by, against the window before."""
    days = S.day_axis(t.subjects, A, C)
    out = S.occurrence_stats(S.occurrence_days(t.observations, days, "error", "count", A, C), (B, C), (A, B), ELAPSED)
    return out.withColumn("delta", F.round("delta", 6))

