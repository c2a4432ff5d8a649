"""Ingestion as anti-joins: deduplication, matching across channels, upserts, authority and identity.

Nothing is dropped silently: what a step refuses it counts or quarantines. Every step is keyed, so a
replay of the same rows inserts nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import kept_table
from .series import hour_runs

KEY = ["subject_id", "type", "source_id", "start_ts", "end_ts"]
#: Seconds within which samples are close, and seconds that a channel may cut off.
NEAR_S, TRUNCATED_S = 1.0, 60.0


def first_of_batch(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the batch's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def not_in_history(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, null equal to null, the history does not hold."""
    h = history.select(*[F.col(k).alias(f"__h_{k}") for k in keys]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    return rows.join(h, on, "left_anti")


def outside_coverage(rows: DataFrame, other: DataFrame) -> DataFrame:
    """For re-aggregated types: rows outside the closed time range of the other channel."""
    span = other.groupBy("subject_id", "type").agg(F.min("start_ts").alias("__a"), F.max("start_ts").alias("__b"))
    out = rows.join(span, ["subject_id", "type"], "left")
    return out.where(F.col("__a").isNull() | (F.col("start_ts") < F.col("__a")) | (F.col("start_ts") > F.col("__b"))).drop("__a", "__b")


def candidate_pairs(incoming: DataFrame, existing: DataFrame, truncated_side: str = "existing") -> DataFrame:
    """(subject_id, type, source_id, value_key, in_id, ex_id, dt): pairs of equal keys that are close within
    a second, or where one side's channel cuts seconds off: its instant is at :00 and the other's lies
    within that minute. An equi-join on the key and a bucket of time; samples without a value never match."""
    key = ["subject_id", "type", "source_id", "value_key"]
    us, minute_us = F.unix_micros, 60_000_000
    minute = lambda c, d=0: F.floor((us(c) + d) / F.lit(minute_us)).cast("long")
    i = incoming.where("value_key is not null").select(*key, F.col("id").alias("in_id"), F.col("start_ts").alias("it")).withColumn("b", minute(F.col("it")))
    e = existing.where("value_key is not null").select(*key, F.col("id").alias("ex_id"), F.col("start_ts").alias("et"))
    buckets = F.array(*[minute(F.col("et"), d) for d in (0, -int(NEAR_S * 1e6), int(NEAR_S * 1e6))])
    e = e.withColumn("b", F.explode(F.array_distinct(buckets)))
    cut, full = ("et", "it") if truncated_side == "existing" else ("it", "et")
    near = F.abs(us("it") - us("et")) <= int(NEAR_S * 1e6)
    at_zero = (us(cut) % minute_us == 0) & (us(full) >= us(cut)) & (us(full) < us(cut) + int(TRUNCATED_S * 1e6))
    return i.join(e, [*key, "b"]).where(near | at_zero).select(*key, "in_id", "ex_id", F.abs(us("it") - us("et")).alias("dt")).distinct()


def _settled(pairs: DataFrame) -> DataFrame:
    """pairs with (in_settles, ex_settles, outcome): which ends are settled by the distances as they stand.

    Of an end only its least distance counts. That is certain once the other ends of the pairs at it have no
    closer pair themselves; an end with several such pairs is ambiguous then, one with a single pair waits
    until the other end is certain too."""
    ends = {"in": Window.partitionBy("in_id"), "ex": Window.partitionBy("ex_id")}
    for e, w in ends.items():
        pairs = pairs.withColumn(f"{e}_least", F.min("dt").over(w))
    pairs = pairs.withColumn("ready", (F.col("dt") == F.col("in_least")) & (F.col("dt") == F.col("ex_least")))
    for e, w in ends.items():
        at = F.col("dt") == F.col(f"{e}_least")
        pairs = pairs.withColumns({f"{e}_n": F.count_if(at).over(w), f"{e}_sure": F.bool_and(F.col("ready") | ~at).over(w)})
    for (e, w), other in zip(ends.items(), ("ex", "in"), strict=True):
        met = F.bool_or(F.col("ready") & (F.col(f"{other}_sure") | F.col(f"{other}_done"))).over(w)
        pairs = pairs.withColumn(f"{e}_settles", F.col(f"{e}_sure") & ((F.col(f"{e}_n") > 1) | met))
    # An end that is settled while the other is not had several pairs at that distance.
    single = (F.col("in_n") == 1) & (F.col("ex_n") == 1) & ~F.col("in_done") & ~F.col("ex_done")
    return pairs.withColumn("outcome", F.when(single, "matched").otherwise("ambiguous"))


def match_across(incoming: DataFrame, existing: DataFrame, truncated_side: str = "existing") -> DataFrame:
    """(in_id, outcome): incoming samples that an existing one of the same type, source and value
    accounts for (matched), or that cannot be told apart (ambiguous); others have no row.

    Pairs are one to one, closest first; where equally close pairs share an end, all that touch are
    ambiguous. Each round settles every end whose least distance can't change any more, and drops its
    farther pairs: the result is that of one pass from the closest to the farthest pair. Pairs at the same
    distance stay until both ends are settled, as they count for both. Windows are over an end's pairs, whose
    number the rules of closeness bound, so a constant value that fills a whole history is no group of
    its own."""
    left = candidate_pairs(incoming, existing, truncated_side).select("in_id", "ex_id", "dt")
    left, done = left.withColumns({"in_done": F.lit(False), "ex_done": F.lit(False)}), None
    while True:
        now = kept_table(_settled(left), "pairs")
        if not now.limit(1).count():
            break
        part = now.where("in_settles and not in_done and dt = in_least").select("in_id", "outcome").distinct()
        done = part if done is None else done.unionByName(part)
        now = now.withColumns({f"{e}_done": F.col(f"{e}_done") | F.col(f"{e}_settles") for e in ("in", "ex")})
        farther = (F.col("in_done") & (F.col("dt") > F.col("in_least"))) | (F.col("ex_done") & (F.col("dt") > F.col("ex_least")))
        left = now.where(~farther & ~(F.col("in_done") & F.col("ex_done"))).select("in_id", "ex_id", "dt", "in_done", "ex_done")
    return incoming.sparkSession.createDataFrame([], "in_id long, outcome string") if done is None else done


def merge_raw(incoming: DataFrame, history: DataFrame, other: DataFrame, reaggregated: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counters) for samples of the raw regime: first of the batch, not in the own
    channel's history, outside the other channel's range for re-aggregated types, and else not
    accounted for by one of its samples."""
    keys = [*KEY, "value_key"]
    batch = first_of_batch(incoming, keys, [F.col("id")])
    fresh = not_in_history(batch, history, keys)
    re = F.col("type").isin(*reaggregated) if reaggregated else F.lit(False)
    apart = outside_coverage(fresh.where(re), other)
    rest = fresh.where(~re)
    found = match_across(rest, other.where(~re))
    kept = rest.join(found, rest["id"] == found["in_id"], "left_anti").unionByName(apart)
    steps = [("received", incoming), ("batch_distinct", batch), ("not_in_history", fresh), ("inserted", kept)]
    counts = reduce(DataFrame.unionByName, [df.groupBy("subject_id", "type").agg(F.count("*").alias("n")).withColumn("step", F.lit(s)) for s, df in steps])
    return kept, counts


def upsert_minutes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming minutes with an outcome: inserted, updated (another value) or duplicate; within the
    batch the last row of a minute counts."""
    key = ["subject_id", "type", "minute_ts"]
    last = first_of_batch(incoming, key, [F.col("id").desc()])
    old = existing.select(*key, F.col("value").alias("__old"))
    out = last.join(old, key, "left")
    return out.withColumn("outcome", F.when(F.col("__old").isNull(), "inserted").when(F.col("__old") != F.col("value"), "updated").otherwise("duplicate")).withColumnRenamed("__old", "old_value")


def bootstrap_cutovers(minutes: DataFrame, state: DataFrame) -> DataFrame:
    """State with a row for each new (subject, type): its first device and minute. Rows never move."""
    first = minutes.groupBy("subject_id", "type").agg(F.min(F.struct("minute_ts", "device_id")).alias("f")).select("subject_id", "type", F.col("f.minute_ts").alias("cutover_ts"), F.col("f.device_id").alias("device_id"))
    return state.select("subject_id", "type", "cutover_ts", "device_id").unionByName(first.join(state, ["subject_id", "type"], "left_anti"))


def judge_minutes(minutes: DataFrame, cutovers: DataFrame, existing: DataFrame) -> DataFrame:
    """minutes with an outcome: write (the authoritative device at or after the cutover),
    before_cutover, or for other devices duplicate (equal value) or conflict (quarantined)."""
    m = minutes.join(cutovers.select("subject_id", "type", "cutover_ts", F.col("device_id").alias("authority")), ["subject_id", "type"], "left")
    m = m.join(existing.select("subject_id", "type", "minute_ts", F.col("value").alias("held")), ["subject_id", "type", "minute_ts"], "left")
    own = F.col("device_id") == F.col("authority")
    out = F.when(F.col("minute_ts") < F.col("cutover_ts"), "before_cutover").when(own, "write").when(F.col("held") == F.col("value"), "duplicate").otherwise("conflict")
    return m.withColumn("outcome", out).drop("authority", "held", "cutover_ts")


def resolve_workouts(incoming: DataFrame, known_ids: DataFrame, workouts: DataFrame, tolerance_s: int | None = None) -> DataFrame:
    """incoming with workout_id and an outcome: known (external id in the subject), adopted (exactly one
    session with the fingerprint and without an id of the namespace), foreign (id of another subject)
    or created. Fingerprint: activity, start, end and source; with a tolerance: activity and a start
    within so many seconds."""
    i = incoming.join(known_ids.select("namespace", "external_id", F.col("workout_id").alias("__known"), F.col("subject_id").alias("__owner")), ["namespace", "external_id"], "left")
    free = workouts.select(F.col("workout_id").alias("__fit"), "subject_id", "activity", F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"), F.col("source_id").alias("__src"))
    us = F.unix_micros
    if tolerance_s is None:
        same = (F.col("start_ts") == F.col("__s")) & (F.col("end_ts") == F.col("__e")) & F.col("source_id").eqNullSafe(F.col("__src"))
        hits = i.where("__known is null").join(free, ["subject_id", "activity"]).where(same)
    else:
        width = max(1, 2 * tolerance_s) * 1_000_000
        b = lambda c, d=0: F.floor((us(F.col(c)) + F.lit(d * tolerance_s * 1_000_000)) / F.lit(width)).cast("long")
        near = free.withColumn("__b", F.explode(F.array_distinct(F.array(b("__s", -1), b("__s"), b("__s", 1)))))
        hits = i.where("__known is null").withColumn("__b", b("start_ts")).join(near, ["subject_id", "activity", "__b"]).where(F.abs(us("start_ts") - us("__s")) <= tolerance_s * 1_000_000)
    taken = known_ids.select(F.col("workout_id").alias("__fit"), "namespace").distinct()
    one = hits.join(taken, ["__fit", "namespace"], "left_anti").groupBy("namespace", "external_id").agg(F.countDistinct("__fit").alias("__n"), F.min("__fit").alias("__fit")).where("__n = 1")
    out = i.join(one.select("namespace", "external_id", "__fit"), ["namespace", "external_id"], "left")
    own = F.col("__owner") == F.col("subject_id")
    outcome = F.when(F.col("__known").isNotNull() & own, "known").when(F.col("__known").isNotNull(), "foreign").when(F.col("__fit").isNotNull(), "adopted").otherwise("created")
    made = F.xxhash64("namespace", "external_id")
    return out.withColumn("outcome", outcome).withColumn("workout_id", F.when(F.col("outcome") == "known", F.col("__known")).when(F.col("outcome") == "adopted", F.col("__fit")).when(F.col("outcome") == "created", made)).drop("__known", "__owner", "__fit")


def later_channel_rows(obs: DataFrame) -> DataFrame:
    """For types with both channels, the rows of the later channel within the overlap of one second more at both ends,
    which the earlier channel (by its first ingestion) replaces."""
    g = obs.groupBy("subject_id", "type", "origin").agg(F.min("ingested_at").alias("since"), F.min("start_ts").alias("a"), F.max("start_ts").alias("b"))
    w = Window.partitionBy("subject_id", "type")
    both = g.withColumn("k", F.count("*").over(w)).where("k = 2").withColumn("place", F.row_number().over(w.orderBy("since", "origin")))
    span = both.groupBy("subject_id", "type").agg((F.max("a") - F.expr("INTERVAL 1 SECOND")).alias("lo"), (F.min("b") + F.expr("INTERVAL 1 SECOND")).alias("hi"), F.max(F.when(F.col("place") == 2, F.col("origin"))).alias("origin"))
    return obs.join(span, ["subject_id", "type", "origin"]).where("start_ts between lo and hi").drop("lo", "hi")


def first_channel_wins(obs: DataFrame) -> DataFrame:
    """Report of a repair: how many rows of the later channel go."""
    return later_channel_rows(obs).groupBy("subject_id", "type", "origin").agg(F.count("*").alias("rows_replaced"))


def dirty_ranges(changed: DataFrame, category_types: list[str], ts: str = "start_ts") -> DataFrame:
    """Hours of really changed rows as minimal ranges; categories have no rollup."""
    h = changed.where(~F.col("type").isin(*category_types)) if category_types else changed
    return hour_runs(h.select("subject_id", "type", F.date_trunc("hour", ts).alias("hour_utc")), ["subject_id", "type"])


def hours_of(ranges: DataFrame) -> DataFrame:
    """(subject_id, type, hour_utc): the hours of half-open ranges, each once."""
    hours = F.sequence("from_ts", F.col("to_ts") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return ranges.select("subject_id", "type", F.explode(hours).alias("hour_utc")).distinct()


def of_hours(rows: DataFrame, hours: DataFrame, ts: str) -> DataFrame:
    """Source rows of some hours."""
    return rows.withColumn("hour_utc", F.date_trunc("hour", ts)).join(hours, ["subject_id", "type", "hour_utc"], "left_semi").drop("hour_utc")


def pass_of(queue: DataFrame, most: int = 100, batch: int | None = None) -> DataFrame:
    """The ranges that one pass over the queue takes: the first ``most`` by their order of arrival, of one
    batch or all."""
    some = queue if batch is None else queue.where(F.col("batch") == batch)
    return some.orderBy("id").limit(most)


def apply_rollup(old: DataFrame, rebuilt: DataFrame, hours: DataFrame) -> DataFrame:
    """The rollup with some hours replaced by their rebuilt states; hours without rows vanish."""
    return old.join(hours, ["subject_id", "type", "hour_utc"], "left_anti").unionByName(rebuilt)


def cutover_ranges(new_cutovers: DataFrame, exported: DataFrame) -> DataFrame:
    """(subject_id, type, from_ts, to_ts): what a new cutover invalidates, from its hour to an hour after the
    last exported row, since those rows no longer count; nothing where no exported row follows."""
    last = exported.groupBy("subject_id", "type").agg(F.max("start_ts").alias("last"))
    hour = F.date_trunc("hour", "cutover_ts").alias("from_ts")
    to = (F.date_trunc("hour", "last") + F.expr("INTERVAL 1 HOUR")).alias("to_ts")
    return new_cutovers.join(last, ["subject_id", "type"]).where("last >= cutover_ts").select("subject_id", "type", hour, to)


def upsert_daily_sleep(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The nights after a batch: of a subject, night and channel the last one written counts."""
    key = ["subject_id", "night", "channel"]
    last = first_of_batch(incoming, key, [F.col("id").desc()])
    return existing.join(last.select(*key), key, "left_anti").unionByName(last.select(existing.columns))


def merge_sleep(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Segments to insert: the last of each uuid in the batch that the history knows neither by uuid nor as an
    equal segment."""
    batch = first_of_batch(incoming, ["subject_id", "uuid"], [F.col("id").desc()])
    fresh = not_in_history(batch, history.where("uuid is not null"), ["subject_id", "uuid"])
    exact = ["subject_id", "source_id", "stage", "start_ts", "end_ts"]
    return not_in_history(first_of_batch(fresh, exact, [F.col("id").desc()]), history, exact)


def dimension(names: DataFrame, known: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """The dimension with a row for each name that it lacked. Keys are hashes of names, so that no counter
    is shared and a batch that comes again makes none."""
    new = names.where(F.col(name).isNotNull()).select(name).distinct().join(known, name, "left_anti")
    return known.select(key, name).unionByName(new.select(F.xxhash64(name).alias(key), name))


def seed_taxonomy(known: DataFrame, contract: DataFrame, keys: list[str]) -> DataFrame:
    """A taxonomy after an idempotent upsert of its contract: rows of the contract replace those of their
    keys, others stay."""
    return known.join(contract.select(*keys), keys, "left_anti").unionByName(contract)


def checked_contract(contract: DataFrame, types: DataFrame, keys: list[str], key: str = "type") -> DataFrame:
    """The contract, if each of its rows has its keys, once each, and a type that there is; else an error that names
    some of those at fault."""
    blank = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    faults = [
        ("without a key", contract.where(blank)), ("twice", contract.groupBy(*keys).count().where("count > 1")),
        ("of unknown types", contract.join(types.select(key), key, "left_anti")),
    ]
    for what, rows in faults:
        if some := rows.select(*keys).limit(5).collect():
            raise ValueError(f"rows of the contract {what}: {', '.join(str(tuple(r)) for r in some)}")
    return contract


def types_to_import(types: DataFrame, exported: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The types of an import: those asked for, or those without an exported row yet."""
    return types.where(F.col("type").isin(*only)) if only is not None else types.join(exported.select("type").distinct(), "type", "left_anti")


def device_pushes(devices: DataFrame, batches: DataFrame) -> DataFrame:
    """devices with the number of batches they pushed and the last one's instant."""
    g = batches.groupBy("device_id").agg(F.count("*").alias("pushes"), F.max("received_at").alias("last_push"))
    return devices.join(g, "device_id", "left").withColumn("pushes", F.coalesce("pushes", F.lit(0)))


def settle(attempts: DataFrame, now, most: int = 5) -> DataFrame:
    """Batches (…, error, permanent, attempt) with a state: done, failed for good where the error is one of
    validation or the attempts are used up, else retry with the instant of the next attempt, after 30 s that
    double up to half an hour."""
    wait = F.least(F.lit(30) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(1800.0))
    state = F.when(F.col("error").isNull(), "done").when(F.col("permanent") | (F.col("attempt") >= most), "failed").otherwise("retry")
    out = attempts.withColumn("state", state)
    return out.withColumn("retry_at", F.when(F.col("state") == "retry", F.timestamp_seconds(F.unix_seconds(now) + wait)))
