"""Inventories, counts, shares, recent rows and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import metric_value, shown_unit, shown_value
from ..functions.names import label, metric_group, slug
from ..functions.timefns import local_day, seconds

#: Fixed value: the labels of the category contract.
SLUGS = {0: "idle", 1: "stood"}


def category_breakdown(obs: DataFrame, slugs: DataFrame) -> DataFrame:
    """Rows and share in per cent for each slug of a category type; unknown codes are a null slug."""
    rows = obs.where("category_value is not null or type = 'error'").join(slugs, "category_value", "left")
    g = rows.groupBy("subject_id", "type", "slug").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("subject_id", "type")), 6))


def source_shares(obs: DataFrame, minutes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of both channels for each type and source: share in per cent, first and last instant, and
    whether any came by the minute channel."""
    both = obs.select("subject_id", "type", "source_id", F.col("start_ts").alias("ts"), F.lit(False).alias("live")).unionByName(minutes.select("subject_id", "type", "source_id", F.col("minute_ts").alias("ts"), F.lit(True).alias("live")))
    g = both.groupBy("subject_id", "type", "source_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or("live").alias("live"))
    return g.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("subject_id", "type")), 6)).join(sources, "source_id", "left").drop("source_id")


def recent_samples(obs: DataFrame, minutes: DataFrame, k: int = 40) -> DataFrame:
    """The newest k samples of each subject and type over both channels. Each channel is cut to its
    own k before they meet, so little is ranked twice."""
    w = Window.partitionBy("subject_id", "type").orderBy(F.col("ts").desc(), F.col("value").desc(), "source_id", "channel")
    top = lambda df: df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    a = obs.where("value is not null").select("subject_id", "type", F.col("start_ts").alias("ts"), "value", "source_id", F.lit("sample").alias("channel"))
    b = minutes.select("subject_id", "type", F.col("minute_ts").alias("ts"), "value", "source_id", F.lit("minute").alias("channel"))
    return top(top(a).drop("place").unionByName(top(b).drop("place")))


def recent_occurrences(obs: DataFrame, slugs: DataFrame, k: int = 60) -> DataFrame:
    """The newest k occurrences; the duration is null without an end."""
    w = Window.partitionBy("subject_id").orderBy(F.col("start_ts").desc(), "event_id")
    rows = obs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(slugs, "category_value", "left")
    return rows.select("subject_id", "event_id", "slug", F.round(seconds(F.col("start_ts"), F.col("end_ts")), 6).alias("seconds"), "place")


def extreme_sample(obs: DataFrame, workouts: DataFrame, day: str) -> DataFrame:
    """The highest sample of each subject on a local day, and the session that covers its instant (of
    several the smallest id; null if none)."""
    rows = obs.where("value is not null").where(local_day(F.col("start_ts"), F.col("tz")) == day)
    top = rows.groupBy("subject_id").agg(F.max(F.struct("value", (-F.unix_micros("start_ts")).alias("o"), "start_ts")).alias("t")).select("subject_id", F.col("t.value").alias("value"), F.col("t.start_ts").alias("ts"))
    w = workouts.select("subject_id", "workout_id", "start_ts", "end_ts")
    hit = top.join(w, "subject_id").where("start_ts <= ts and ts < end_ts").groupBy("subject_id").agg(F.min("workout_id").alias("workout_id"))
    return top.join(hit, "subject_id", "left")


def coverage(obs: DataFrame, minutes: DataFrame) -> DataFrame:
    """First and last local day and row counts of each type over both channels."""
    def of(df, ts):
        d = local_day(F.col(ts), F.col("tz"))
        return df.groupBy("subject_id", "type").agg(F.min(d).alias("a"), F.max(d).alias("b"), F.count("*").alias("n"))

    both = of(obs, "start_ts").unionByName(of(minutes, "minute_ts"))
    return both.groupBy("subject_id", "type").agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.sum("n").alias("measures"))


def inventory_summary(cov: DataFrame, today: str) -> DataFrame:
    """Types, measures, first and last day, and types silent for more than 60 days."""
    silent = F.datediff(F.lit(today).cast("date"), "last_day") > 60
    return cov.groupBy("subject_id").agg(F.count("*").alias("types"), F.sum("measures").alias("measures"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.count_if(silent).alias("dormant"))


def top_types(cov: DataFrame, k: int = 8) -> DataFrame:
    """The k largest types with their share of all types, not only of those listed."""
    w = Window.partitionBy("subject_id")
    t = cov.withColumn("share", F.round(100 * F.col("measures") / F.sum("measures").over(w), 6)).withColumn("place", F.row_number().over(w.orderBy(F.col("measures").desc(), "type")))
    return t.where(F.col("place") <= k).select("subject_id", "type", "measures", "share", "place")


def points_of(counts: str):
    """Points of a batch: the sum of what its metrics inserted; null where the map is absent."""
    m = F.from_json(F.get_json_object(counts, "$.metrics"), "map<string,map<string,bigint>>")
    each = lambda x: sum((F.coalesce(F.element_at(x, F.lit(k)), F.lit(0)) for k in ("inserted", "minute_inserted", "daily_upserted")), F.lit(0))
    return F.when(m.isNotNull(), F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + each(x)))


def ingest_by_day(batches: DataFrame, from_day: str, to_day: str, subjects: DataFrame) -> DataFrame:
    """Batches, bytes and points of each day; days without batches have 0 batches and bytes, null points."""
    days = F.sequence(F.lit(from_day).cast("date"), F.date_sub(F.lit(to_day).cast("date"), 1))
    g = batches.withColumn("points", points_of("counts")).groupBy("subject_id", "day").agg(F.count("*").alias("batches"), F.sum("body_bytes").alias("bytes"), F.sum("points").alias("points"))
    out = subjects.select("subject_id", F.explode(days).alias("day")).join(g, ["subject_id", "day"], "left")
    return out.select("subject_id", "day", F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "points")


def sync_overview(batches: DataFrame) -> DataFrame:
    visible = F.col("status").isin("normalized", "rollups_ready")
    return batches.groupBy("subject_id").agg(F.count_if(F.col("status") == "received").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.when(visible, F.col("received_at"))).alias("last_visible"))


def totals(tables: dict[str, DataFrame], obs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows of each table, types with data, and days from the first to the last observation, by subject: one
    union of aggregates. Subjects without rows have zeros, and no days."""
    parts = [df.groupBy("subject_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    agg = rows.groupBy("subject_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in tables])
    day = local_day(F.col("start_ts"), F.col("tz"))
    span = obs.groupBy("subject_id", "type").agg(F.min(day).alias("a"), F.max(day).alias("b")).groupBy("subject_id").agg(F.count("*").alias("types"), (F.datediff(F.max("b"), F.min("a")) + 1).alias("coverage_days"))
    out = subjects.select("subject_id").join(agg, "subject_id", "left").join(span, "subject_id", "left")
    return out.na.fill(0, [*tables, "types"])


def catalogue_rows(cov: DataFrame, daily: DataFrame, types: DataFrame, today: str, spark_days: int = 30, dormant_days: int = 60) -> DataFrame:
    """A row of the catalogue for each subject and type: labels, coverage as text, the value of the last
    measured day, the values of the days up to the type's own last day as a list with gaps, a flag for types
    that have been silent, and the text that a search looks in.

    cov: ``coverage``; daily: (subject_id, type, day, value); types: (type, identifier, unit, aggregation)."""
    i = F.col("identifier")
    rows = cov.join(types.withColumnRenamed("unit", "canonical"), "type")
    back = rows.select("subject_id", "type", "last_day", F.explode(F.sequence(F.date_sub("last_day", spark_days - 1), F.col("last_day"))).alias("day"))
    shown = back.join(daily.select("subject_id", "type", "day", "value"), ["subject_id", "type", "day"], "left")
    listed = F.array_sort(F.collect_list(F.struct("day", "value")))
    spark = shown.groupBy("subject_id", "type").agg(F.transform(listed, lambda x: x["value"]).alias("spark"), F.max(F.when(F.col("value").isNotNull(), F.struct("day", "value"))).alias("last"))
    month = lambda c: F.date_format(c, "MMM yyyy")
    covered = F.when(month("first_day") == month("last_day"), month("first_day")).otherwise(F.concat(month("first_day"), F.lit(" - "), month("last_day")))
    unit, group = shown_unit(F.col("canonical")), metric_group(i)
    text = F.lower(F.concat_ws(" ", label(i), i, slug(i), unit, group))
    value = metric_value(F.col("last.value"), F.col("aggregation"), F.col("canonical"), F.col("last.value"))
    out = rows.join(spark, ["subject_id", "type"])
    return out.select(
        "subject_id", "type", label(i).alias("label"), group.alias("group"), unit.alias("unit"), "measures", covered.alias("coverage"), value.alias("last_value"), F.col("last.day").alias("last_value_day"),
        F.transform("spark", lambda v: shown_value(v, F.col("canonical"))).alias("spark"), (F.datediff(F.lit(today).cast("date"), "last_day") > dormant_days).alias("dormant"), text.alias("haystack"),
    )
