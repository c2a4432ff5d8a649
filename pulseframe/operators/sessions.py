"""Sleep nights, workouts, records, splits and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import clock_since_noon
from ..functions.timefns import local_day, night_date, percent_delta, seconds, since_noon

#: Codes of sleep stages.
IN_BED, ASLEEP, AWAKE, CORE, DEEP, REM = range(6)
HOUR_US = 3_600_000_000


def stage_seconds(*stages: int) -> Column:
    """Whole seconds in some stages; null where a night has none of them."""
    return F.round(F.sum(F.when(F.col("stage").isin(*stages), F.col("sec")))).cast("long")


def sleep_nights(segments: DataFrame, daily: DataFrame, sources: DataFrame, from_night: str, to_night: str) -> DataFrame:
    """One row for each subject and night: the reported night if there is one, else the night derived
    from the winning source's segments (watches first, then the longest asleep)."""
    seg = segments.withColumn("night", night_date(F.col("start_ts"), F.col("tz"))).where((F.col("night") >= from_night) & (F.col("night") < to_night)).withColumn("sec", seconds(F.col("start_ts"), F.col("end_ts")))
    asleep = F.col("stage").isin(ASLEEP, CORE, DEEP, REM)
    per = seg.groupBy("subject_id", "night", "source_id").agg(
        stage_seconds(ASLEEP, CORE, DEEP, REM).alias("asleep_s"), stage_seconds(CORE).alias("core_s"), stage_seconds(DEEP).alias("deep_s"), stage_seconds(REM).alias("rem_s"), stage_seconds(AWAKE).alias("awake_s"), stage_seconds(IN_BED).alias("in_bed_s"),
        F.min(F.when(asleep, F.col("start_ts"))).alias("sleep_start"), F.max(F.when(asleep, F.col("end_ts"))).alias("sleep_end"),
    )
    w = Window.partitionBy("subject_id", "night").orderBy(F.col("name").rlike("(?i)watch").desc_nulls_last(), F.col("asleep_s").desc_nulls_last(), "source_id")
    derived = per.join(sources, "source_id", "left").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    cols = ["subject_id", "night", "asleep_s", "core_s", "deep_s", "rem_s", "awake_s", "in_bed_s", "sleep_start", "sleep_end"]
    parts = [F.col("core_s"), F.col("deep_s"), F.col("rem_s")]
    stages = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))
    reported = daily.where((F.col("night") >= from_night) & (F.col("night") < to_night)).withColumn("asleep_s", F.when(F.col("asleep_s") > 0, F.col("asleep_s")).otherwise(stages))
    both = reported.select(*cols, F.lit("reported").alias("channel")).unionByName(derived.select(*cols, F.lit("derived").alias("channel")))
    first = Window.partitionBy("subject_id", "night").orderBy(F.col("channel").desc())
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def sleep_summary(nights: DataFrame, subjects: DataFrame) -> DataFrame:
    """Means over nights: hours asleep and deep, bedtime in minutes since noon and its mean absolute
    deviation (null for fewer than two nights), and each phase's share of the phases' time."""
    n = nights.join(subjects, "subject_id").withColumn("bed", since_noon(F.col("sleep_start"), F.col("tz")).cast("double"))
    n = n.withColumn("mean_bed", F.avg("bed").over(Window.partitionBy("subject_id")))
    total = F.sum(F.coalesce("core_s", F.lit(0)) + F.coalesce("deep_s", F.lit(0)) + F.coalesce("rem_s", F.lit(0)) + F.coalesce("awake_s", F.lit(0)))
    share = lambda c: F.round(100 * F.sum(c) / F.nullif(total, F.lit(0)), 6).alias(f"{c[:-2]}_share")
    return n.groupBy("subject_id").agg(
        F.count("*").alias("nights"), F.round(F.avg(F.col("asleep_s") / 3600), 9).alias("hours"), F.round(F.avg(F.col("deep_s") / 3600), 9).alias("deep_hours"), F.round(F.avg("bed"), 6).alias("bedtime"),
        F.when(F.count("bed") >= 2, F.round(F.avg(F.abs(F.col("bed") - F.col("mean_bed"))), 6)).alias("bedtime_mad"), *map(share, ("core_s", "deep_s", "rem_s", "awake_s")),
    )


def interval_rate(workouts: DataFrame, samples: DataFrame, out: str = "avg_hr", by: list[str] | None = None) -> DataFrame:
    """workouts with the mean of the samples in [start_ts, end_ts), null where there are none.

    A session is cut into the hours it touches, so the range join is an equi-join on (subject, hour) with
    the exact bounds as a residual; the samples are shuffled once and a long session costs its hours."""
    h = lambda c: F.floor(F.unix_micros(c) / F.lit(HOUR_US)).cast("long")
    w = workouts.select("workout_id", "subject_id", "start_ts", "end_ts").withColumn("hour", F.explode(F.sequence(h(F.col("start_ts")), h(F.timestamp_micros(F.unix_micros("end_ts") - 1)))))
    s = samples.select(F.col("subject_id"), F.col("start_ts").alias("at"), "value", *(by or [])).withColumn("hour", h(F.col("at")))
    hit = w.join(s, ["subject_id", "hour"]).where("at >= start_ts and at < end_ts")
    agg = hit.groupBy("workout_id", *(by or [])).agg((F.sum("value").cast("double") / F.count("value")).alias(out), F.count("value").alias("samples"), F.max("value").cast("double").alias("max_value"))
    return agg if by else workouts.join(agg.drop("max_value"), "workout_id", "left")


def weekly_volume(workouts: DataFrame, subjects: DataFrame, from_day: str, to_day: str) -> DataFrame:
    """Dense ISO weeks: sessions and seconds are 0 and distance null where a week has none."""
    w = workouts.withColumn("day", local_day(F.col("start_ts"), F.col("tz"))).where((F.col("day") >= from_day) & (F.col("day") < to_day))
    agg = w.groupBy("subject_id", F.trunc("day", "week").alias("week")).agg(F.count("*").alias("sessions"), F.sum("distance_m").alias("distance_m"), F.sum("duration_s").alias("duration_s"))
    weeks = F.sequence(F.trunc(F.lit(from_day).cast("date"), "week"), F.date_sub(F.lit(to_day).cast("date"), 1), F.expr("INTERVAL 7 DAYS"))
    out = subjects.select("subject_id", F.explode(weeks).alias("week")).join(agg, ["subject_id", "week"], "left")
    return out.select("subject_id", "week", F.coalesce("sessions", F.lit(0)).alias("sessions"), "distance_m", F.coalesce("duration_s", F.lit(0)).alias("duration_s"))


def monthly_silhouette(workouts: DataFrame) -> DataFrame:
    """Minutes for each local month from a subject's first to its last, 0 where there are none."""
    m = workouts.groupBy("subject_id", F.trunc(local_day(F.col("start_ts"), F.col("tz")), "month").alias("month")).agg((F.sum("duration_s") / 60).alias("minutes"))
    axis = m.groupBy("subject_id").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("subject_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return axis.join(m, ["subject_id", "month"], "left").select("subject_id", F.date_format("month", "yyyy-MM").alias("month"), F.round(F.coalesce("minutes", F.lit(0.0)), 9).alias("minutes"))


#: Least metres for records of pace and speed, the sport that is judged by speed, and the
#: kinds of record in their order.
PACE_M, SPEED_M, WHEELED = 5_000, 20_000, "Cycling"
KINDS = ("longest_distance", "longest_duration", "best_speed", "best_pace", "biggest_climb")


def record_values(workouts: DataFrame) -> DataFrame:
    """(… , kind, place, value, score): what a session can hold records of. Pace counts on foot from 5 km and
    speed on wheels from 20 km, so that short sprints set none; score grows with what is better."""
    far, long, wheeled = F.col("distance_m"), F.col("duration_s").cast("double"), F.col("activity") == WHEELED
    value = {
        "longest_distance": F.when(far > 0, far),
        "longest_duration": F.when(long > 0, long),
        "best_speed": F.when(wheeled & (far >= SPEED_M) & (long > 0), far / 1000 / (long / 3600)),
        "best_pace": F.when(~wheeled & (far >= PACE_M) & (long > 0), long / (far / 1000)),
        "biggest_climb": F.when(F.col("elevation_up_m") > 0, F.col("elevation_up_m")),
    }
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("place"), value[k].alias("value")) for i, k in enumerate(KINDS)]
    own = ["subject_id", "tz", "activity", "workout_id", "start_ts"]
    out = workouts.select(*own, F.explode(F.array(*rows)).alias("x")).where("x.value is not null").select(*own, "x.*")
    return out.withColumn("score", F.when(F.col("kind") == "best_pace", -F.col("value")).otherwise(F.col("value")))


def record_events(workouts: DataFrame) -> DataFrame:
    """Sessions that beat all earlier ones of their sport, with the value beaten. A first session and
    an equal one are no event."""
    w = Window.partitionBy("subject_id", "activity", "kind").orderBy("start_ts", "workout_id").rowsBetween(Window.unboundedPreceding, -1)
    v = record_values(workouts).withColumn("best", F.max("score").over(w))
    return v.where("score > best").select("subject_id", "tz", "activity", "kind", "place", "workout_id", "start_ts", "value", F.abs("best").alias("previous"))


def sport_records(workouts: DataFrame, now: str) -> DataFrame:
    """For each sport and kind: the best value and the first session with it, the change in per cent from
    the best of the 365 days before last to that of the last 365 days, and whether the best is under 90
    days old, all counted back from an instant."""
    v = record_values(workouts).withColumn("age", F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("start_ts"))
    first = F.max(F.struct("score", (-F.unix_seconds("start_ts")).alias("o"), (-F.col("workout_id")).alias("i"), "value", "age"))
    year = 365 * 86_400
    last, before = F.max(F.when(F.col("age") < year, F.col("score"))), F.max(F.when((F.col("age") >= year) & (F.col("age") < 2 * year), F.col("score")))
    out = v.groupBy("subject_id", "activity", "kind").agg(first.alias("b"), F.abs(last).alias("last_year"), F.abs(before).alias("year_before"), F.count("*").alias("sessions"))
    delta = percent_delta(F.col("last_year"), F.col("year_before"))
    return out.select("subject_id", "activity", "kind", F.col("b.value").alias("best"), (-F.col("b.i")).alias("workout_id"), delta.alias("delta"), "sessions", (F.col("b.age") < 90 * 86_400).alias("recent"))


def yearly_progression(workouts: DataFrame, now: str) -> DataFrame:
    """(… , year, value): the best of each UTC year from the first to that of ``now``, null in years without
    a session."""
    v = record_values(workouts).withColumn("year", F.year("start_ts"))
    key = ["subject_id", "activity", "kind"]
    best = v.groupBy(*key, "year").agg(F.abs(F.max("score")).alias("value"))
    axis = best.groupBy(*key).agg(F.min("year").alias("a")).select(*key, F.explode(F.sequence(F.col("a"), F.year(F.lit(now).cast("timestamp")))).alias("year"))
    return axis.join(best, [*key, "year"], "left")


def featured(progression: DataFrame, records: DataFrame, least: int = 5, most: int = 6) -> DataFrame:
    """(subject_id, activity, kind, measured, place): of each sport with at least ``least`` sessions the
    kind whose progression has the most measured years, in the kinds' order on ties; at most ``most`` sports,
    those with the most sessions first."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    sports = records.groupBy("subject_id", "activity").agg(F.max("sessions").alias("sessions")).where(F.col("sessions") >= least)
    dense = progression.groupBy("subject_id", "activity", "kind").agg(F.count("value").alias("measured"))
    pick = Window.partitionBy("subject_id", "activity").orderBy(F.col("measured").desc(), order)
    one = dense.withColumn("rn", F.row_number().over(pick)).where("rn = 1").drop("rn").join(sports, ["subject_id", "activity"])
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy(F.col("sessions").desc(), "activity"))
    return one.withColumn("place", place).where(F.col("place") <= most).select("subject_id", "activity", "kind", "measured", "sessions", "place")


def emblematic(records: DataFrame) -> DataFrame:
    """One record for each sport: pace for running and speed for cycling where there are such, else
    distance, else duration."""
    own = F.when((F.col("activity") == "Running") & (F.col("kind") == "best_pace"), 0).when((F.col("activity") == WHEELED) & (F.col("kind") == "best_speed"), 0)
    rank = F.coalesce(own, F.when(F.col("kind") == "longest_distance", 1), F.when(F.col("kind") == "longest_duration", 2))
    w = Window.partitionBy("subject_id", "activity").orderBy("rank")
    return records.withColumn("rank", rank).where("rank is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "rank")


def session_list(workouts: DataFrame, activity: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of each subject's sessions, newest first, of one sport or all. A page past the end is the
    last one. (place, pages) tell where a row stands."""
    some = workouts if activity is None else workouts.where(F.col("activity") == activity)
    own = Window.partitionBy("subject_id")
    out = some.withColumn("place", F.row_number().over(own.orderBy(F.col("start_ts").desc(), "workout_id"))).withColumn("pages", F.ceil(F.count("*").over(own) / size))
    at = F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages"))
    return out.where((F.col("place") > (at - 1) * size) & (F.col("place") <= at * size))


def identical_sessions(workouts: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, ids, keep): groups of sessions alike in all their business columns, null equal to null. The
    keeper is the one with child rows, or the first id as text where none has; groups in which several have
    some are not redundant and have no keeper."""
    rows = workouts.join(children.select("workout_id").distinct().withColumn("__kids", F.lit(1)), "workout_id", "left")
    text = F.col("workout_id").cast("string")
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(text)).alias("ids"), F.count("__kids").alias("with_kids"), F.max(F.when(F.col("__kids") == 1, text)).alias("kid"))
    keep = F.when(F.col("with_kids") == 1, F.col("kid")).when(F.col("with_kids") == 0, F.element_at("ids", 1))
    return g.where(F.size("ids") > 1).withColumn("keep", keep).drop("with_kids", "kid")


def kilometre_splits(points: DataFrame) -> DataFrame:
    """(workout_id, km, seconds): time of each full kilometre; crossings are interpolated within their
    minute, and rounded to whole seconds. points: metres for each minute of a session."""
    w = Window.partitionBy("workout_id").orderBy("minute")
    p = points.withColumn("sum", F.sum("value").over(w)).withColumn("i", F.row_number().over(w))
    p = p.withColumn("before", F.col("sum") - F.col("value"))
    lo, hi = F.floor(F.col("before") / 1000) + 1, F.floor(F.col("sum") / 1000)
    c = p.where(hi >= lo).select("workout_id", "i", "before", "value", F.explode(F.sequence(lo, hi)).alias("km"))
    c = c.withColumn("at", (F.col("i") - 1) * 60 + 60 * (F.col("km") * 1000 - F.col("before")) / F.col("value"))
    each = F.col("at") - F.coalesce(F.lag("at").over(Window.partitionBy("workout_id").orderBy("km")), F.lit(0.0))
    return c.select("workout_id", "km", F.floor(each + 0.5).cast("long").alias("seconds"))


def timeline(workouts: DataFrame, nights: DataFrame, events: DataFrame, from_day: str, to_day: str, most: int = 10, most_nights: int = 5, most_records: int = 4) -> DataFrame:
    """Per subject the window's newest sessions, nights and records in one stream, newest first.

    Each kind is cut to its own number before they meet; the stream to ``most``, where records always stay.
    A session can hold several records, each an entry. truncated: the merged entries were more. Days are
    local; a night without an end stands at the start of its day in UTC. events: record events of the
    whole history."""
    day = local_day(F.col("start_ts"), F.col("tz"))
    inside = (F.col("day") >= from_day) & (F.col("day") < to_day)
    cols = ["subject_id", "kind", "day", "ts", "ref", "what", "tie"]
    none = F.lit(None).cast("string")
    s = workouts.select("subject_id", F.lit("workout").alias("kind"), day.alias("day"), F.unix_seconds("start_ts").alias("ts"), F.col("workout_id").alias("ref"), none.alias("what"), F.lit(0).alias("tie"))
    woke = F.coalesce(F.unix_seconds("sleep_end"), F.unix_seconds(F.col("night").cast("timestamp")))
    n = nights.select("subject_id", F.lit("night").alias("kind"), F.col("night").alias("day"), woke.alias("ts"), F.lit(0).cast("long").alias("ref"), none.alias("what"), F.lit(0).alias("tie"))
    r = events.select("subject_id", F.lit("record").alias("kind"), day.alias("day"), F.unix_seconds("start_ts").alias("ts"), F.col("workout_id").alias("ref"), F.col("kind").alias("what"), F.col("place").alias("tie"))
    newest = [F.col("day").desc(), F.col("ts").desc()]
    order = F.when(F.col("kind") == "workout", 0).when(F.col("kind") == "night", 1).otherwise(2)

    def cut(df: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("subject_id").orderBy(*newest, "ref", "tie")
        return df.where(inside).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(*cols)

    merged = cut(s, most).unionByName(cut(n, most_nights)).unionByName(cut(r, most_records))
    all_ = Window.partitionBy("subject_id")
    first = F.when(F.col("kind") == "record", 0).otherwise(1)
    t = merged.withColumn("slot", F.row_number().over(all_.orderBy(first, *newest, order, "ref", "tie"))).withColumn("records", F.count_if(F.col("kind") == "record").over(all_)).withColumn("total", F.count("*").over(all_))
    budget = F.greatest(F.lit(most), F.col("records"))
    return t.where(F.col("slot") <= budget).select("subject_id", "kind", "day", "ts", "ref", "what", (F.col("total") > budget).alias("truncated"))


def by_day(entries: DataFrame) -> DataFrame:
    """(subject_id, day, entries): a stream's entries of each day, newest first."""
    newest = F.array_sort(F.collect_list(F.struct((-F.col("ts")).alias("before"), "kind", "ref", "what")))
    return entries.groupBy("subject_id", "day").agg(F.transform(newest, lambda e: F.struct((-e["before"]).alias("ts"), e["kind"].alias("kind"), e["ref"].alias("ref"), e["what"].alias("what"))).alias("entries"))


def night_view(nights: DataFrame, subjects: DataFrame) -> DataFrame:
    """Nights with time asleep as hours by phase, a phase that is not given as none, and the bedtime as text."""
    hours = lambda c: F.round(F.coalesce(c, F.lit(0)) / 3600, 9).alias(f"{c[:-2]}_h")
    bed = clock_since_noon(since_noon(F.col("sleep_start"), F.col("tz")))
    some = nights.where("asleep_s is not null").join(subjects, "subject_id")
    return some.select("subject_id", "night", *map(hours, ("deep_s", "core_s", "rem_s", "awake_s", "asleep_s")), F.when(F.col("sleep_start").isNotNull(), bed).alias("bedtime"))


def missing_nights(nights: DataFrame, subjects: DataFrame, days: int, elapsed: int) -> DataFrame:
    """Nights of a window's days so far that were not measured."""
    measured = nights.where("asleep_s is not null").groupBy("subject_id").agg(F.count("*").alias("measured"))
    out = subjects.select("subject_id").join(measured, "subject_id", "left")
    return out.select("subject_id", F.coalesce("measured", F.lit(0)).alias("measured"), (F.lit(min(days, elapsed)) - F.coalesce("measured", F.lit(0))).alias("missing"))


def session_summary(workouts: DataFrame, by: list[str]) -> DataFrame:
    """Sessions, seconds, metres, energy and the mean of sessions' mean rates."""
    return workouts.groupBy(*by).agg(F.count("*").alias("sessions"), F.sum("duration_s").alias("duration_s"), F.sum("distance_m").alias("distance_m"), F.sum("energy_kj").alias("energy_kj"), F.avg("avg_hr").alias("avg_hr"))


def sport_tiles(workouts: DataFrame, subjects: DataFrame, window: tuple[str, str], before: tuple[str, str]) -> DataFrame:
    """(subject_id, tile, value, delta): five figures of a window's sessions, each with its change in per cent
    from the window before. workouts: with avg_hr. Both windows come from one pass."""
    day = local_day(F.col("start_ts"), F.col("tz"))
    of = lambda w: (day >= w[0]) & (day < w[1])
    part = F.when(of(window), "now").when(of(before), "before")
    g = session_summary(workouts.withColumn("part", part).where("part is not null"), ["subject_id", "part"])
    names = ("sessions", "duration_s", "distance_m", "energy_kj", "avg_hr")
    rows = g.select("subject_id", "part", F.explode(F.array(*[F.struct(F.lit(n).alias("tile"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("subject_id", "part", "x.*")
    both = rows.groupBy("subject_id", "tile").agg(*[F.max(F.when(F.col("part") == p, F.col("v"))).alias(p) for p in ("now", "before")])
    all_ = subjects.select("subject_id", F.explode(F.array(*map(F.lit, names))).alias("tile")).join(both, ["subject_id", "tile"], "left")
    zero = F.col("tile").isin("sessions", "duration_s")
    now, then = (F.when(zero, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in ("now", "before"))
    return all_.select("subject_id", "tile", now.alias("value"), percent_delta(now, then).alias("delta"))
