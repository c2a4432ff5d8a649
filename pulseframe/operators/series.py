"""Time series over local days and buckets: gap-preserving axes, one winning source, hourly rollups.

Every function takes all subjects at once: the subject is a grouping key, so work spreads over the
cluster and one pass serves any number of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import bin_start, local_day, local_midnight, percent_delta, seconds, trend_quality

FAR = "9999-12-31"


def day_axis(subjects: DataFrame, from_day: str, to_day: str) -> DataFrame:
    """One row for each subject and local day of [from_day, to_day)."""
    days = F.sequence(F.lit(from_day).cast("date"), F.date_sub(F.lit(to_day).cast("date"), 1))
    return subjects.select("subject_id", "tz", F.explode(days).alias("day"))


def in_window(df: DataFrame, ts: str, from_day: str, to_day: str) -> DataFrame:
    """Rows whose local day is in [from_day, to_day), with that day. Coarse bounds in UTC reach the scan,
    and the partitions where rows are kept by UTC day; the exact test follows in each subject's zone."""
    lo, hi = F.lit(from_day).cast("timestamp"), F.lit(to_day).cast("timestamp")
    coarse = (F.col(ts) >= lo - F.expr("INTERVAL 15 HOURS")) & (F.col(ts) < hi + F.expr("INTERVAL 15 HOURS"))
    if "utc_day" in df.columns:
        coarse = coarse & F.col("utc_day").between(F.date_sub(F.lit(from_day), 1), F.lit(to_day).cast("date"))
    day = local_day(F.col(ts), F.col("tz"))
    return df.where(coarse).withColumn("day", day).where((F.col("day") >= from_day) & (F.col("day") < to_day))


def value_of(aggregation: str) -> Column:
    """The day's value by the type's aggregation."""
    if aggregation == "sum":
        return F.sum("value").cast("double")
    if aggregation == "average":
        return F.sum("value").cast("double") / F.nullif(F.count("value"), F.lit(0))
    if aggregation == "latest":
        return F.max_by("value", F.struct("start_ts", "event_id")).cast("double")
    if aggregation == "duration":
        return F.sum(F.coalesce(seconds(F.col("start_ts"), F.col("end_ts")), F.lit(0.0)))
    raise ValueError(f"{aggregation!r} gives no series")


def daily_discrete(obs: DataFrame, axis: DataFrame, type_: str, aggregation: str, from_day: str, to_day: str) -> DataFrame:
    """(subject_id, day, value, min, max, n) for each day of the axis; days without values are null. n
    counts measured rows; latest takes the newest row, measured or not, of equal instants the largest
    event_id."""
    rows = in_window(obs.where(F.col("type") == type_), "start_ts", from_day, to_day)
    agg = rows.groupBy("subject_id", "day").agg(value_of(aggregation).alias("value"), F.min("value").cast("double").alias("min"), F.max("value").cast("double").alias("max"), F.count("value").alias("n"))
    return axis.select("subject_id", "day").join(agg, ["subject_id", "day"], "left")


def with_cutover(df: DataFrame, cutovers: DataFrame) -> DataFrame:
    return df.join(cutovers, ["subject_id", "type"], "left").withColumn("cutover_ts", F.coalesce("cutover_ts", F.lit(FAR).cast("timestamp")))


def winners(partials: DataFrame, grain: list[str], priorities: DataFrame, sources: DataFrame) -> DataFrame:
    """The winning source of each grain: configured rank first, then watches, then the larger value.

    partials: (subject_id, type, *grain, source_id, v), one row for each source."""
    key = ["subject_id", "type", "source_id"]
    ranked = partials.join(priorities.select(*key, "rank"), key, "left").join(sources, "source_id", "left")
    order = [F.col("rank").asc_nulls_last(), F.coalesce(F.col("name").rlike("(?i)watch"), F.lit(False)).desc(), F.col("v").desc_nulls_last(), F.col("source_id").asc_nulls_last()]
    w = Window.partitionBy("subject_id", "type", *grain).orderBy(*order)
    return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "rank", "name")


def cumulative_parts(obs: DataFrame, minutes: DataFrame, cutovers: DataFrame, priorities: DataFrame, sources: DataFrame, types: list[str], from_day: str, to_day: str, grain: str = "hour") -> DataFrame:
    """(subject_id, type, day, ts, v): the winner of each UTC hour (or minute) and local day from
    exported rows before the cutover, and minute rows from the cutover on. A gap after the cutover is
    never filled from exports."""
    xml = in_window(with_cutover(obs.where(F.col("type").isin(*types) & (F.col("origin") == "health_xml") & F.col("value").isNotNull()), cutovers), "start_ts", from_day, to_day)
    by = ["subject_id", "type", "day", "ts"]
    partial = xml.where("start_ts < cutover_ts").groupBy("subject_id", "type", "day", F.date_trunc(grain, "start_ts").alias("ts"), "source_id").agg(F.sum("value").alias("v"))
    won = winners(partial, ["day", "ts"], priorities, sources)
    live = in_window(with_cutover(minutes.where(F.col("type").isin(*types)), cutovers), "minute_ts", from_day, to_day).where("minute_ts >= cutover_ts")
    return won.select(*by, "v").unionByName(live.select("subject_id", "type", "day", F.col("minute_ts").alias("ts"), F.col("value").alias("v")))


def daily_cumulative(parts: DataFrame, axis: DataFrame, type_: str) -> DataFrame:
    """(subject_id, day, value, n): n counts winning hours and minutes."""
    agg = parts.where(F.col("type") == type_).groupBy("subject_id", "day").agg(F.sum("v").cast("double").alias("value"), F.count("*").alias("n"))
    return axis.select("subject_id", "day").join(agg, ["subject_id", "day"], "left")


def build_rollup(obs: DataFrame, minutes: DataFrame, cutovers: DataFrame, priorities: DataFrame, sources: DataFrame, cumulative: list[str], discrete: list[str]) -> DataFrame:
    """rollup_hourly (subject_id, type, hour_utc, n, sum, min, max).

    Discrete types: samples of each UTC hour. Cumulative types: the hour's winner as one value, and
    minute rows. Category types have none."""
    d = obs.where(F.col("type").isin(*discrete) & F.col("value").isNotNull()).select("subject_id", "type", F.date_trunc("hour", "start_ts").alias("hour_utc"), F.col("value").alias("v"))
    xml = with_cutover(obs.where(F.col("type").isin(*cumulative) & (F.col("origin") == "health_xml") & F.col("value").isNotNull()), cutovers).where("start_ts < cutover_ts")
    partial = xml.groupBy("subject_id", "type", F.date_trunc("hour", "start_ts").alias("hour_utc"), "source_id").agg(F.sum("value").alias("v"))
    won = winners(partial, ["hour_utc"], priorities, sources).select("subject_id", "type", "hour_utc", "v")
    live = with_cutover(minutes.where(F.col("type").isin(*cumulative)), cutovers).where("minute_ts >= cutover_ts").select("subject_id", "type", F.date_trunc("hour", "minute_ts").alias("hour_utc"), F.col("value").alias("v"))
    return d.unionByName(won).unionByName(live).groupBy("subject_id", "type", "hour_utc").agg(*state())


def build_edges(obs: DataFrame, minutes: DataFrame, cutovers: DataFrame, priorities: DataFrame, sources: DataFrame, subjects: DataFrame, cumulative: list[str], discrete: list[str]) -> DataFrame:
    """rollup_edges (subject_id, type, hour_utc, day, n, sum, min, max): the pieces of the hours that a local
    midnight cuts, one for each of its two days, as the rollup holds whole hours. Each piece of a
    cumulative type has a winner of its own."""
    cut = lambda df, ts: df.withColumn("hour_utc", F.date_trunc("hour", ts)).where(split_hours(df, F.date_trunc("hour", ts)))
    day = lambda ts: local_day(F.col(ts), F.col("tz")).alias("day")
    cols = ["subject_id", "type", "hour_utc"]
    d = cut(obs.where(F.col("type").isin(*discrete) & F.col("value").isNotNull()), "start_ts").select(*cols, day("start_ts"), F.col("value").alias("v"))
    xml = with_cutover(cut(obs.where(F.col("type").isin(*cumulative) & (F.col("origin") == "health_xml") & F.col("value").isNotNull()), "start_ts"), cutovers)
    partial = xml.where("start_ts < cutover_ts").groupBy(*cols, day("start_ts"), "source_id").agg(F.sum("value").alias("v"))
    won = winners(partial, ["hour_utc", "day"], priorities, sources).select(*cols, "day", "v")
    live = with_cutover(cut(minutes.where(F.col("type").isin(*cumulative)), "minute_ts"), cutovers).where("minute_ts >= cutover_ts").select(*cols, day("minute_ts"), F.col("value").alias("v"))
    return d.unionByName(won).unionByName(live).groupBy(*cols, "day").agg(*state())


def state() -> list[Column]:
    """What a rollup keeps of values v."""
    return [F.count("*").alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")]


def split_hours(df: DataFrame, hour: str | Column) -> Column:
    """True for UTC hours that a local midnight cuts, as in zones that are not whole hours off UTC."""
    h = F.col(hour) if isinstance(hour, str) else hour
    return local_day(h, F.col("tz")) != local_day(h + F.expr("INTERVAL 3599 SECONDS"), F.col("tz"))


def daily_hybrid(rollup: DataFrame, edges: DataFrame, tail: DataFrame, subjects: DataFrame, aggregation: str, from_day: str, to_day: str, today: str) -> DataFrame:
    """Daily values of one type from the kept rollup's whole hours and the pieces of hours that a local
    midnight cuts, with raw rows (subject_id, day, v) for the days from ``today`` on. Averages are sums
    over counts, never means of means."""
    last, cols = min(to_day, today), ["subject_id", "day", "sum", "n", "min", "max"]
    hours = rollup.join(subjects, "subject_id")
    whole = in_window(hours.where(~split_hours(hours, "hour_utc")), "hour_utc", from_day, last).select(*cols)
    pieces = edges.where((F.col("day") >= from_day) & (F.col("day") < last)).select(*cols)
    live = tail.groupBy("subject_id", "day").agg(*state()).select(*cols)
    total, n = F.sum("sum").cast("double"), F.sum("n")
    value = total if aggregation == "sum" else total / F.nullif(n, F.lit(0))
    out = [value.alias("value")] + ([] if aggregation == "sum" else [F.min("min").cast("double").alias("min"), F.max("max").cast("double").alias("max")]) + [n.alias("n")]
    days = whole.unionByName(pieces).unionByName(live).groupBy("subject_id", "day").agg(*out)
    return day_axis(subjects, from_day, to_day).select("subject_id", "day").join(days, ["subject_id", "day"], "left")


def bucket_axis(subjects: DataFrame, from_day: str, to_day: str, width_s: int) -> DataFrame:
    """Buckets of width_s seconds from local midnight of from_day, per subject."""
    t0, t1 = local_midnight(F.lit(from_day).cast("date"), F.col("tz")), local_midnight(F.lit(to_day).cast("date"), F.col("tz"))
    last = F.timestamp_micros(F.unix_micros(t1) - 1)
    return subjects.select("subject_id", F.explode(F.sequence(t0, last, F.expr(f"INTERVAL {width_s} SECONDS"))).alias("bucket"))


def bucket_series(rows: DataFrame, subjects: DataFrame, from_day: str, to_day: str, width_s: int, ts: str, value: Column, extras: list[Column] | None = None) -> DataFrame:
    """Values per bucket on a dense axis anchored at local midnight. subjects: one row for each.

    Only measured buckets and a row for each subject are shuffled. Each of them yields the empty buckets up to the
    next one of its subject, so that the dense axis is made where it is read and is neither dealt nor joined."""
    t0, t1 = local_midnight(F.lit(from_day).cast("date"), F.col("tz")), local_midnight(F.lit(to_day).cast("date"), F.col("tz"))
    binned = in_window(rows, ts, from_day, to_day).withColumn("bucket", bin_start(F.col(ts), t0, width_s))
    inside = binned.where((F.col("bucket") >= t0) & (F.col("bucket") < t1) & F.col("subject_id").isNotNull())
    agg = inside.groupBy("subject_id", "bucket").agg(value.alias("value"), *(extras or []))
    names = [c for c in agg.columns if c not in ("subject_id", "bucket")]
    begins = subjects.select("subject_id", t0.alias("bucket"), t1.alias("stop"), F.lit(0).alias("measured"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A number given keeps small shuffles from being read by one task, which would make the whole axis.
    both = agg.withColumn("measured", F.lit(1)).unionByName(begins, allowMissingColumns=True).repartition(parts, "subject_id")
    w = Window.partitionBy("subject_id").orderBy("bucket", "measured")
    runs = both.withColumns({"stop": F.first("stop").over(w), "next": F.lead("bucket").over(w)}).where("stop is not null")
    runs = runs.withColumn("end", F.coalesce("next", "stop")).where("bucket < end")
    axis = F.explode(F.sequence("bucket", F.timestamp_micros(F.unix_micros("end") - 1), F.expr(f"INTERVAL {width_s} SECONDS")))
    dense = runs.select("subject_id", F.col("bucket").alias("begin"), axis.alias("bucket"), *names)
    return dense.select("subject_id", "bucket", *[F.when(F.col("bucket") == F.col("begin"), F.col(c)).alias(c) for c in names])


def occurrence_days(obs: DataFrame, axis: DataFrame, type_: str, mode: str, from_day: str, to_day: str) -> DataFrame:
    """Occurrences per local day, counted or as seconds; days without any are null."""
    rows = in_window(obs.where(F.col("type") == type_), "start_ts", from_day, to_day)
    v = F.count("*").cast("double") if mode == "count" else value_of("duration")
    return axis.select("subject_id", "day").join(rows.groupBy("subject_id", "day").agg(v.alias("value")), ["subject_id", "day"], "left")


def reduced(aggregation: str, value: Column) -> Column:
    """One value of a series: the last measured for states, the sum for sums and durations, else the mean of measured
    days; null where nothing was measured."""
    if aggregation == "latest":
        return F.max_by(value, F.when(value.isNotNull(), F.col("day")))
    return F.sum(value) if aggregation in ("sum", "duration") else F.avg(value)


def reduce_window(series: DataFrame, aggregation: str) -> DataFrame:
    """One value of a window for each subject, with the lowest and highest and the number of measured days."""
    v = F.col("value")
    return series.groupBy("subject_id").agg(reduced(aggregation, v).alias("value"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("measured"))


def rolling_mean(series: DataFrame, k: int) -> DataFrame:
    """Trailing mean of k points; gaps are skipped and stay gaps."""
    w = Window.partitionBy("subject_id").orderBy("day").rowsBetween(-(k - 1), 0)
    return series.withColumn("rolling", F.when(F.col("value").isNotNull(), F.avg("value").over(w)))


def downsample(series: DataFrame, target: int) -> DataFrame:
    """At most target points: means of runs of ceil(n / target) days, with each run's first and last day."""
    all_ = Window.partitionBy("subject_id")
    size = F.ceil(F.count("*").over(all_) / target)
    at = F.floor((F.row_number().over(all_.orderBy("day")) - 1) / size)
    return series.withColumn("bucket", at).groupBy("subject_id", "bucket").agg(F.avg("value").alias("value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def segments(series: DataFrame) -> DataFrame:
    """Runs of consecutive measured points."""
    w = Window.partitionBy("subject_id").orderBy("day")
    s = series.withColumn("i", F.row_number().over(w)).where("value is not null")
    s = s.withColumn("island", F.col("i") - F.row_number().over(w))
    return s.groupBy("subject_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("points")).drop("island")


def hour_runs(hours: DataFrame, keys: list[str], hour: str = "hour_utc") -> DataFrame:
    """Hours coalesced into minimal half-open ranges [from_ts, to_ts)."""
    w = Window.partitionBy(*keys).orderBy(hour)
    x = hours.select(*keys, hour).distinct().withColumn("island", F.unix_seconds(hour) / 3600 - F.row_number().over(w))
    out = x.groupBy(*keys, "island").agg(F.min(hour).alias("from_ts"), F.max(hour).alias("last"), F.count("*").alias("hours"))
    return out.withColumn("to_ts", F.col("last") + F.expr("INTERVAL 1 HOUR")).drop("island", "last")


def scale_plan(series: DataFrame, units: DataFrame) -> DataFrame:
    """(subject_id, key, mode, axis): series of one unit share an axis, two series have one each, more of unlike
    units are normalised on one. series: (subject_id, key, …); units: (key, unit)."""
    keys = series.select("subject_id", "key").distinct().join(units, "key", "left")
    own = Window.partitionBy("subject_id")
    kinds, n = F.size(F.collect_set(F.coalesce("unit", F.lit(""))).over(own)), F.count("*").over(own)
    place = F.row_number().over(own.orderBy("key")) - 1
    plan = keys.withColumns({"kinds": kinds, "series": n, "place": place})
    mode = F.when((F.col("kinds") == 1) | (F.col("series") == 2), "absolute").otherwise("normalized")
    axis = F.when((F.col("kinds") > 1) & (F.col("series") == 2), F.col("place")).otherwise(0)
    return plan.select("subject_id", "key", mode.alias("mode"), axis.alias("axis"))


def normalised(series: DataFrame) -> DataFrame:
    """series with ``scaled``: values between the series' own least and largest as 0 to 1; 0.5 where all are
    equal, null where nothing was measured."""
    own = Window.partitionBy("subject_id", "key")
    low, high = F.min("value").over(own), F.max("value").over(own)
    scaled = F.when(F.col("value").isNotNull(), F.when(high > low, (F.col("value") - low) / (high - low)).otherwise(0.5))
    return series.withColumn("scaled", scaled)


def scoped(rows: DataFrame, grants: DataFrame, viewer: int) -> DataFrame:
    """The rows of the subjects that a viewer may see; grants: (viewer_id, subject_id)."""
    return rows.join(grants.where(F.col("viewer_id") == viewer).select("subject_id"), "subject_id", "left_semi")


def within(rows: DataFrame, ts: str, from_day: str, to_day: str) -> DataFrame:
    """Rows of UTC days, by partition where rows are kept by day."""
    lo, hi = F.lit(from_day).cast("timestamp"), F.lit(to_day).cast("timestamp")
    some = rows.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    return some.where((F.col("utc_day") >= from_day) & (F.col("utc_day") < to_day)) if "utc_day" in rows.columns else some


def window_stats(series: DataFrame, aggregation: str, window: tuple[str, str], before: tuple[str, str], lower_is_better: bool | None) -> DataFrame:
    """One row for each subject with days in the window: its value by its aggregation with the one of the window before, the
    change in per cent and whether it is good, the first days of the lowest and highest value, and the
    measured days. series: (subject_id, day, value) over both windows, read once."""
    in_ = lambda w: (F.col("day") >= w[0]) & (F.col("day") < w[1])
    now, then = F.when(in_(window), F.col("value")), F.when(in_(before), F.col("value"))
    first = F.when(now.isNotNull(), F.struct(now.alias("value"), "day"))
    top = F.when(now.isNotNull(), F.struct(now.alias("value"), (-F.datediff("day", F.lit("1970-01-01"))).alias("early"), "day"))
    out = series.groupBy("subject_id").agg(
        F.count_if(in_(window)).alias("days"), reduced(aggregation, now).alias("value"), reduced(aggregation, then).alias("before"), F.min(first).alias("lo"), F.max(top).alias("hi"), F.count(now).alias("measured"),
    ).where("days > 0")
    delta = percent_delta(F.col("value"), F.col("before"))
    return out.select("subject_id", "value", "before", delta.alias("delta"), trend_quality(delta, lower_is_better).alias("quality"), F.col("lo.value").alias("low"), F.col("lo.day").alias("low_day"), F.col("hi.value").alias("high"), F.col("hi.day").alias("high_day"), "measured")


def occurrence_stats(days: DataFrame, window: tuple[str, str], before: tuple[str, str], elapsed: int) -> DataFrame:
    """(subject_id, total, previous, delta, measured, days): occurrences of the first ``elapsed`` days of a window and of the window
    before, the change in per cent (null without earlier ones), and the window's days with some and in all. days:
    (subject_id, day, value) on a dense axis over both windows."""
    inside = (F.col("day") >= window[0]) & (F.col("day") < window[1])
    gone = inside & (F.col("day") < F.date_add(F.lit(window[0]).cast("date"), elapsed))
    earlier = (F.col("day") >= before[0]) & (F.col("day") < before[1])
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0))
    out = days.groupBy("subject_id").agg(total(gone).alias("total"), total(earlier).alias("previous"), F.count(F.when(inside, F.col("value"))).alias("measured"), F.count_if(inside).alias("days"))
    return out.select("subject_id", "total", "previous", percent_delta(F.col("total"), F.col("previous")).alias("delta"), "measured", "days")


def viewer_subjects(users: DataFrame, grants: DataFrame, subjects: DataFrame) -> DataFrame:
    """(viewer_id, subject_id, tz): the subject that each viewer sees: of those granted to a user who isn't disabled the
    oldest that is live, of equal ages the smallest id. users: (viewer_id, disabled_at); grants: (viewer_id, subject_id);
    subjects: (subject_id, tz, purge_state, created_at). Viewers without one have no row."""
    live = subjects.where("purge_state = 'live'").select("subject_id", "tz", "created_at")
    own = grants.join(users.where("disabled_at is null").select("viewer_id"), "viewer_id", "left_semi").join(live, "subject_id")
    oldest = own.groupBy("viewer_id").agg(F.min(F.struct("created_at", "subject_id", "tz")).alias("s"))
    return oldest.select("viewer_id", "s.subject_id", "s.tz")
