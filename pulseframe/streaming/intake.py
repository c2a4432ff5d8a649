"""Payload files to canonical tables: each micro-batch is validated, normalised, merged with what is stored and committed
with its ledger and dirty hours in one step; then the rollup takes the dirty hours in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import iso_date
from ..lake import Lake
from ..operators import merge as M
from ..operators import series as S
from ..operators import sessions as X
from ..sources import normalise as N
from ..sources import wire
from ..store import kept_table

PHASES = ", ".join(f"{k} long" for k in N.PHASES)
#: The tables of a store, and the columns that their folders are split by.
SCHEMAS = {
    "observations": "subject_id long, source_id long, start_ts timestamp, end_ts timestamp, tz_offset_min int, value double, value_key long, "
    "category_value int, origin string, uuid string, batch string, type string, month string",
    "minutes": "subject_id long, minute_ts timestamp, value double, source_id long, device_id long, type string, month string",
    "cutovers": "subject_id long, type string, cutover_ts timestamp, device_id long",
    "conflicts": "subject_id long, type string, minute_ts timestamp, device_id long, value double, month string",
    "nights": f"subject_id long, night date, channel string, {PHASES}, sleep_start timestamp, sleep_end timestamp",
    "segments": "subject_id long, uuid string, source_id long, stage int, start_ts timestamp, end_ts timestamp, month string",
    "sessions": "workout_id long, subject_id long, activity string, source_id long, start_ts timestamp, end_ts timestamp, tz_offset_min int, "
    "indoor boolean, duration_s double, distance_m double, energy_kj double, elevation_up_m double, stats map<string,string>",
    "session_ids": "namespace string, external_id string, workout_id long, subject_id long",
    "session_points": "workout_id long, series string, ts timestamp, value double, month string",
    "session_routes": "workout_id long, ts timestamp, lat double, lon double, altitude_m double, speed_ms double, course_deg double, "
    "h_acc_m double, month string",
    "sources": "source_id long, name string",
    "dirty": "subject_id long, type string, from_ts timestamp, to_ts timestamp",
    "ledger": "path string, sha256 string, subject_id long, device_id long, format string, state string, error string, counts string, "
    "first_ts timestamp, last_ts timestamp, batch string",
    "summaries": "subject_id long, n long, first_ts timestamp, last_ts timestamp, type string",
    "rollup": "subject_id long, hour_utc timestamp, n long, sum double, min double, max double, type string, month string",
}
BY = {t: ("type", "month") for t in ("observations", "minutes", "rollup")} | {t: ("month",) for t in ("conflicts", "segments", "session_points", "session_routes")}
BY["summaries"] = ("type",)
#: Formats by the first part of a payload's path, which names the subject and the device too.
FORMATS = {"push": "push", "native": "native"}
PATH = r"(push|native)/subject=(\d+)/device=(\d+)/"
#: A checksum that a file's name may hold.
NAMED = r"\.([0-9a-f]{64})\.json"
OBSERVED = ["subject_id", "type", "source_id", "start_ts", "value_key"]


def lake(spark: SparkSession, root: str) -> Lake:
    return Lake(spark, root, SCHEMAS, BY)


def month(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM").alias("month")


def source_id(name: str = "source") -> Column:
    return F.xxhash64(F.coalesce(name, F.lit(""))).alias("source_id")


def summary(observations: DataFrame) -> DataFrame:
    """(subject_id, type, n, first_ts, last_ts) of some observations; those of parts of them add up."""
    return observations.groupBy("subject_id", "type").agg(F.count("*").alias("n"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last committed row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "commit")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "commit").alias("r")).select(*keys, "r.*")


@contextmanager
def dealt(spark: SparkSession) -> Iterator[None]:
    """Joins are dealt by key meanwhile, none by sending a side whole through the driver because its files look small: packed
    tables of payloads, subjects and minutes take many times their size there, and an intake has dozens of such joins.
    Tables with a row for each type are still sent, as they ask for it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def joins_dealt(step: Callable) -> Callable:
    """A method of Intake that plans and runs its joins so."""

    @wraps(step)
    def run(self, *args, **kwargs):
        with dealt(self.store.spark):
            return step(self, *args, **kwargs)

    return run


@dataclass
class Past:
    """What was stored before a batch, as of one state of the store."""

    store: Lake
    state: dict
    kinds: set[str]
    months: list[str]
    types: list[str]
    subjects: list[int] | None

    def has(self, kind: str) -> bool:
        """Whether the batch has rows of a staged kind."""
        return kind in self.kinds

    def all(self, table: str) -> DataFrame:
        return self.store.read(table, self.state)

    def near(self, table: str, numbered: bool = False) -> DataFrame:
        """A table's rows in the months, types and, if they are few, subjects of the batch."""
        out = self.store.read(table, self.state, numbered).where(F.col("month").isin(*self.months))
        if "type" in out.columns:
            out = out.where(F.col("type").isin(*self.types))
        return out.where(F.col("subject_id").isin(*self.subjects)) if "subject_id" in out.columns and self.subjects is not None else out


@dataclass
class Intake:
    """A store and the contract that payloads are read by.

    types: (type, kind, regime, unit, scale, opted_out, reaggregated), a row for each type: kind quantity or category, regime raw,
    cumulative or sleep. categories: (type, category). The payloads of a micro-batch count as one after the other, by time
    of arrival and path, push payloads before native ones. Payloads that can't be read go to the ledger as failed,
    with the reason, and are kept where they lie; those whose content the subject sent before are marked duplicate.

    History is read in the types and months of the batch, and where it has few subjects, in their files alone. A batch that
    failed midway is run again as a whole; one that was committed is not."""

    store: Lake
    types: DataFrame
    categories: DataFrame

    def done(self, batch: int) -> bool:
        return self.store.state()["marks"].get("batch", -1) >= batch

    def run(self, landing: str, checkpoint: str, files: int = 1000):
        """Takes the payload files that have landed, each once; returns when done."""
        spark = self.store.spark
        schema = "path string, modificationTime timestamp, length long, content binary"
        stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(landing)
        out = stream.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint)
        return out.trigger(availableNow=True).start()

    def received(self, files: DataFrame) -> DataFrame:
        """(path, subject_id, device_id, format, batch, sha256, body, error): payloads in the order of ``batch``."""
        arrived = F.concat_ws("|", F.date_format("modificationTime", "yyyyMMddHHmmssSSSSSS"), "path")
        at = lambda i: F.regexp_extract("path", PATH, i)
        order = F.concat_ws("|", F.when(at(1) == "native", "1").otherwise("0"), arrived)
        rows = wire.unpacked_files(files.withColumn("batch", order), kept=("batch",))
        named = F.regexp_extract("path", NAMED, 1)
        error = F.coalesce(F.when(at(1) == "", "path_invalid"), F.when((named != "") & (named != F.col("sha256")), "sha256_mismatch"), "error")
        return rows.select("path", at(2).try_cast("long").alias("subject_id"), at(3).try_cast("long").alias("device_id"), at(1).alias("format"), "batch", "sha256", "body", error.alias("error"))

    def judged(self, files: DataFrame, state: dict) -> DataFrame:
        """The payloads with the state that they start with: validated, failed or duplicate."""
        rows = kept_table(self.received(files), "received")
        rows = rows.withColumn("__text", F.col("body"))
        push = wire.parsed(rows.where("format = 'push'"), wire.PUSH, F.col("doc.data").isNotNull()).drop("doc")
        native = wire.parsed(rows.where("format = 'native'"), wire.NATIVE, F.col("doc.format").endswith("native/1")).drop("doc")
        rest = rows.where("format not in ('push', 'native')").drop("body")
        found = push.unionByName(native).unionByName(rest).withColumnRenamed("__text", "body")
        stored = self.store.read("ledger", state).where("state = 'normalized'").select("subject_id", "sha256", F.lit(True).alias("__stored")).distinct()
        first = Window.partitionBy("subject_id", "sha256", F.col("error").isNull()).orderBy("batch")
        found = found.withColumn("__n", F.row_number().over(first)).join(stored, ["subject_id", "sha256"], "left")
        start = F.when(F.col("error").isNotNull(), "failed").when(F.col("__stored") | (F.col("__n") > 1), "duplicate").otherwise("validated")
        return found.withColumn("state", start).drop("__n", "__stored")

    @joins_dealt
    def ingest(self, files: DataFrame, batch: int, between: Callable[[str], None] = lambda step: None) -> None:
        """foreachBatch over files (path, modificationTime, content). between: called after each step, for tests that stop there."""
        if self.done(batch):
            return
        state = self.store.state()
        bodies = kept_table(self.judged(files, state), "bodies")
        between("judged")
        good = bodies.where("state = 'validated'").select("subject_id", "device_id", "batch", "body", F.lit(None).cast("string").alias("error"), "format")
        # Kept as columns, so that each reader takes the fields that it needs and none parses again.
        push = kept_table(wire.push_documents(good.where("format = 'push'")), "push")
        native = kept_table(wire.native_documents(good.where("format = 'native'")), "native")
        fine = lambda rows: rows.where("skip_reason is null")
        points = kept_table(N.push_metrics(push, self.types), "points")
        samples = kept_table(self._samples(native), "samples")
        minutes = kept_table(self._minute_points(points, native, bodies), "minute-points")
        sessions = kept_table(self._sessions(push, native), "sessions")
        nights = kept_table(N.push_nights(push), "nights")
        series, routes = kept_table(fine(N.push_series(push)), "series"), kept_table(fine(N.push_routes(push)), "routes")
        between("normalised")
        past = self._history(state, {"points": (points, "ts"), "samples": (samples, "start_ts"), "minutes": (minutes, "minute_ts"), "series": (series, "ts"), "routes": (routes, "ts")})
        fresh = kept_table(self._observations(points, samples, past), "fresh")
        none = lambda fields: self.store.spark.createDataFrame([], fields)
        cutovers, judged = none(SCHEMAS["cutovers"]), none("subject_id long, type string, minute_ts timestamp, batch string, name string, outcome string")
        adds = {"observations": fresh, "summaries": summary(fresh)}
        if past.has("minutes"):
            cutovers, judged = self._minutes(minutes, past)
            cutovers, judged = kept_table(cutovers, "cutovers"), kept_table(judged, "judged")
            adds["cutovers"] = cutovers
            adds["minutes"] = judged.where("outcome in ('inserted', 'updated')").withColumn("month", month("minute_ts"))
            adds["conflicts"] = judged.where("outcome = 'conflict'").withColumn("month", month("minute_ts"))
        between("merged")
        adds["nights"] = M.first_of_batch(fine(nights), ["subject_id", "night", "channel"], [F.col("id").desc()])
        if past.has("samples"):
            adds["segments"] = self._segments(samples, past)
        if not sessions.isEmpty():
            adds |= self._stored_sessions(self._resolved(sessions, past), series, routes, past)
        adds["sources"] = self._sources(past, points, samples, sessions)
        adds["dirty"] = self._dirty(fresh, judged, cutovers, past)
        adds["ledger"] = self._ledger(bodies, points, samples, minutes, sessions, nights, fresh, judged)
        self.store.commit(adds, marks={"batch": batch})
        between("committed")

    # Staging

    def _samples(self, native: DataFrame) -> DataFrame:
        """Native samples as observations, refused ones with their reason."""
        known = self.types.select("type", "regime", "unit", "scale", "opted_out", "kind")
        s = native.select("subject_id", "batch", F.posexplode("doc.samples").alias("place", "s")).select("subject_id", "batch", "place", "s.*")
        s = s.join(F.broadcast(known.withColumnRenamed("unit", "to")), "type", "left")  # a row for each type
        s = s.join(F.broadcast(self.categories.select("type", "category", F.lit(True).alias("known"))), ["type", "category"], "left")  # rows of the contract
        (start, offset), (end, _) = iso_date(F.col("start")), iso_date(F.col("end"))
        cat, sleep = F.col("kind") == "category", F.col("regime") == "sleep"
        reason = (
            F.when(F.col("kind").isNull(), "skipped_unknown_type").when(F.col("opted_out"), "skipped_opt_out")
            .when(~F.coalesce(F.col("uuid").rlike(N.UUID), F.lit(False)), "skipped_bad_uuid").when(start.isNull(), "skipped_bad_point")
            .when(cat & F.col("category").isNull(), "skipped_bad_point").when(sleep & ~F.coalesce(end > start, F.lit(False)), "skipped_bad_point")
            .when(cat & F.col("known").isNull(), "category_without_contract").when(~cat & (F.col("regime") == "cumulative"), "skipped_minute_type")
            .when(~cat & ~N.finite(F.col("value")), "skipped_bad_point")
            .when(~cat & F.col("to").isNotNull() & ~F.col("unit").eqNullSafe(F.col("to")), "unit_mismatch")
        )
        value = F.when(~cat, F.col("value"))
        return s.select(
            "subject_id", "batch", "place", "type", "regime", F.lower("uuid").alias("uuid"), N.source_name(F.col("source")).alias("source"), start.alias("start_ts"),
            F.when(end >= start, end).alias("end_ts"), offset.alias("tz_offset_min"), value.alias("value"), N.quantise(value, F.col("scale").cast("double")).alias("value_key"),
            F.when(cat, F.col("category")).alias("category_value"), reason.alias("skip_reason"),
        )

    def _minute_points(self, points: DataFrame, native: DataFrame, bodies: DataFrame) -> DataFrame:
        """(subject_id, device_id, batch, place, name, type, minute_ts, value, source): accepted minutes of both formats, and refused
        ones of native payloads."""
        push = points.where("skip_reason is null and regime = 'cumulative'").select(
            "subject_id", "batch", "place", "name", "type", F.date_trunc("minute", "ts").alias("minute_ts"), "value", "source", "skip_reason"
        )
        own = N.native_minute_points(native, self.types).select(
            "subject_id", "batch", "place", F.col("type").alias("name"), "type", "minute_ts", "value", F.lit("HealthKit").alias("source"), "skip_reason"
        )
        return push.unionByName(own).join(bodies.select("batch", "device_id"), "batch")

    def _sessions(self, push: DataFrame, native: DataFrame) -> DataFrame:
        named = lambda df, space: df.withColumn("namespace", F.lit(space))
        return named(N.push_sessions(push), "push").unionByName(named(N.native_sessions(native), "native"))

    # Merging

    def _history(self, state: dict, staged: dict[str, tuple[DataFrame, str]]) -> Past:
        """What is stored around the staged rows (rows, instant): their months, a minute more at the ends, and their types.
        What comes to the driver is as many names as there are types and months, and 64 subjects at most."""
        near = [month(F.col("at") + F.expr(f"INTERVAL {s} SECONDS")) for s in (-60, 60)]
        kinds = [
            df.select(F.lit(k).alias("kind"), F.col(ts).alias("at"), "subject_id", (F.col("type") if "type" in df.columns else F.lit(None).cast("string")).alias("type"))
            for k, (df, ts) in staged.items()
        ]
        rows = reduce(DataFrame.unionByName, kinds).where("at is not null")
        found = rows.groupBy("kind").agg(*[F.collect_set(m).alias(f"m{i}") for i, m in enumerate(near)], F.collect_set("type").alias("types")).collect()
        subjects = [r[0] for r in rows.select("subject_id").distinct().limit(65).collect()]
        return Past(
            self.store, state, {r["kind"] for r in found}, sorted({m for r in found for m in (*r["m0"], *r["m1"])}), sorted({t for r in found for t in r["types"]}),
            subjects if len(subjects) <= 64 else None,
        )

    def _observations(self, points: DataFrame, samples: DataFrame, past: Past) -> DataFrame:
        """The observations that are new: push points by content, against the other channel by coverage or closest match;
        native samples by uuid, and by content against rows without one."""
        push = points.where("skip_reason is null and regime = 'raw'").select(
            "subject_id", "type", source_id(), F.col("ts").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"), "tz_offset_min", "value", "value_key",
            F.lit(None).cast("int").alias("category_value"), F.lit("hae").alias("origin"), F.lit(None).cast("string").alias("uuid"), "batch", "name", "place",
        )
        native = samples.where("skip_reason is null and regime <> 'sleep'").select(
            "subject_id", "type", source_id(), "start_ts", "end_ts", "tz_offset_min", "value", "value_key", "category_value", F.lit("hae").alias("origin"),
            "uuid", "batch", F.col("type").alias("name"), "place",
        )
        order = [F.col("batch"), F.col("place")]
        held = past.near("observations")
        rows = M.not_in_history(M.first_of_batch(push, OBSERVED, order), held.where("origin = 'hae'"), OBSERVED)
        again = [r[0] for r in self.types.where("reaggregated").select("type").collect()]
        whole = past.all("observations").where(F.col("type").isin(*again) & (F.col("origin") == "health_xml"))
        apart = M.outside_coverage(rows.where(F.col("type").isin(*again)), whole)
        rest = kept_table(rows.where(~F.col("type").isin(*again)).withColumn("id", F.xxhash64(*OBSERVED)), "matchable")
        exported = held.where("origin = 'health_xml'").withColumn("id", F.xxhash64(*OBSERVED, "end_ts", "batch"))
        found = M.match_across(rest, exported)
        rest = rest.join(found, rest["id"] == found["in_id"], "left_anti").drop("id")
        pushed = apart.unionByName(rest)
        exact = [*OBSERVED, "category_value"]
        own = M.not_in_history(M.first_of_batch(native, ["subject_id", "uuid"], order), held.where("uuid is not null"), ["subject_id", "uuid"])
        own = M.not_in_history(own, held.where("uuid is null").select(*exact).unionByName(pushed.select(*exact)), exact)
        return pushed.unionByName(own).drop("place").withColumn("month", month("start_ts"))

    def _segments(self, samples: DataFrame, past: Past) -> DataFrame:
        rows = samples.where("skip_reason is null and regime = 'sleep'").select(
            "subject_id", "uuid", source_id(), F.col("category_value").alias("stage"), "start_ts", "end_ts", F.struct("batch", "place").alias("id"), "batch"
        )
        fresh = M.merge_sleep(rows, past.near("segments"))
        return fresh.withColumn("month", month("start_ts"))

    def _minutes(self, rows: DataFrame, past: Past) -> tuple[DataFrame, DataFrame]:
        """(new cutovers, minutes with an outcome). The first payload's device of a subject and type becomes its authority, from that
        payload's first minute on. Its later minutes are inserted, updated or duplicate; those of other devices
        duplicate or, once for each minute and device, conflict."""
        key = ["subject_id", "type"]
        fine = M.first_of_batch(rows.where("skip_reason is null"), ["batch", *key, "minute_ts"], [F.col("place").desc()]).withColumn("source_id", source_id())
        known = past.all("cutovers")
        per = fine.groupBy(*key, "batch", "device_id").agg(F.min("minute_ts").alias("cutover_ts"))
        first = per.groupBy(*key).agg(F.min_by(F.struct("cutover_ts", "device_id"), "batch").alias("c")).select(*key, "c.cutover_ts", "c.device_id")
        new = first.join(known, key, "left_anti")
        authority = known.unionByName(new.select(*known.columns)).withColumnRenamed("device_id", "authority")
        stored = current(past.near("minutes", numbered=True), [*key, "minute_ts"])
        fine = fine.join(authority, key)
        own = fine.where("device_id = authority and minute_ts >= cutover_ts")
        last = M.first_of_batch(own, [*key, "minute_ts"], [F.col("batch").desc()])
        held = stored.select(*key, "minute_ts", F.col("value").alias("held"))
        last = last.join(held, [*key, "minute_ts"], "left")
        outcome = F.when(F.col("held").isNull(), "inserted").when(F.col("held") != F.col("value"), "updated").otherwise("duplicate")
        last = last.withColumn("outcome", outcome).drop("held")
        early = fine.where("device_id = authority and minute_ts < cutover_ts").withColumn("outcome", F.lit("before_cutover"))
        after = held.join(last.select(*key, "minute_ts"), [*key, "minute_ts"], "left_anti").unionByName(last.select(*key, "minute_ts", F.col("value").alias("held")))
        others = fine.where("device_id <> authority").join(after, [*key, "minute_ts"], "left")
        same = others.where("held = value").withColumn("outcome", F.lit("duplicate"))
        unlike = M.first_of_batch(others.where("held is null or held <> value"), [*key, "minute_ts", "device_id"], [F.col("batch")])
        quarantined = past.near("conflicts").select(*key, "minute_ts", "device_id", F.lit(True).alias("__there"))
        unlike = unlike.join(quarantined, [*key, "minute_ts", "device_id"], "left")
        unlike = unlike.withColumn("outcome", F.when(F.col("__there"), "conflict_duplicate").otherwise("conflict")).drop("__there")
        parts = [last, early, same.drop("held"), unlike.drop("held")]
        return new, reduce(DataFrame.unionByName, [p.drop("authority", "cutover_ts") for p in parts])

    def _resolved(self, sessions: DataFrame, past: Past) -> DataFrame:
        """Sessions with workout_id and outcome: push sessions by their fingerprint, then native ones by a start within a second,
        also against those that the batch makes. A session whose id another subject holds is one of its own."""
        ids, stored = past.all("session_ids"), past.all("sessions").select("workout_id", "subject_id", "activity", "start_ts", "end_ts", "source_id")
        fine = sessions.where("skip_reason is null").withColumn("source_id", source_id())
        made = F.xxhash64("namespace", "external_id", "subject_id")
        out = []
        for space, tolerance in (("push", None), ("native", 1)):
            own = M.first_of_batch(fine.where(F.col("namespace") == space), ["subject_id", "external_id"], [F.col("batch")])
            new = M.resolve_workouts(own, ids, stored, tolerance)
            new = kept_table(new.withColumn("workout_id", F.when(F.col("outcome").isin("created", "foreign"), made).otherwise(F.col("workout_id"))), "resolved")
            ids = ids.unionByName(new.where("outcome in ('created', 'adopted')").select(*ids.columns))
            stored = stored.unionByName(new.where("outcome in ('created', 'foreign')").select(*stored.columns))
            out.append(new)
        return out[0].unionByName(out[1])

    def _stored_sessions(self, placed: DataFrame, series: DataFrame, routes: DataFrame, past: Past) -> dict[str, DataFrame]:
        """New sessions and ids, and the points and positions that the sessions don't hold yet."""
        new = placed.where("outcome in ('created', 'foreign')")
        new = M.first_of_batch(new, ["workout_id"], [F.col("batch")]).join(past.all("sessions").select("workout_id"), "workout_id", "left_anti")
        ids = placed.where("outcome in ('created', 'adopted')").select("namespace", "external_id", "workout_id", "subject_id")
        where = placed.where("namespace = 'push'").select("subject_id", "external_id", "workout_id").distinct()
        out = {"sessions": new, "session_ids": ids}
        for table, kind, rows, keys in (("session_points", "series", series, ["workout_id", "series", "ts"]), ("session_routes", "routes", routes, ["workout_id", "ts"])):
            if past.has(kind):
                rows = M.first_of_batch(rows.join(where, ["subject_id", "external_id"]), keys, [F.col("external_id")])
                out[table] = M.not_in_history(rows, past.near(table), keys).withColumn("month", month("ts"))
        return out

    def _sources(self, past: Past, *rows: DataFrame) -> DataFrame:
        """The sources whose names are new."""
        names = reduce(DataFrame.unionByName, [r.select(F.coalesce("source", F.lit("")).alias("name")) for r in rows]).distinct()
        names = names.unionByName(names.sparkSession.createDataFrame([("HealthKit",)], "name string")).distinct()
        return names.join(past.all("sources"), "name", "left_anti").withColumn("source_id", source_id("name"))

    def _dirty(self, fresh: DataFrame, judged: DataFrame, cutovers: DataFrame, past: Past) -> DataFrame:
        """Ranges of the hours that really changed, and of exported rows that a new cutover puts out of force."""
        changed = fresh.where("value is not null").select("subject_id", "type", "start_ts")
        changed = changed.unionByName(judged.where("outcome in ('inserted', 'updated')").select("subject_id", "type", F.col("minute_ts").alias("start_ts")))
        ranges = M.dirty_ranges(changed, []).select("subject_id", "type", "from_ts", "to_ts")
        types = [r[0] for r in cutovers.select("type").distinct().collect()]
        if not types:
            return ranges
        exported = past.all("observations").where(F.col("type").isin(*types) & (F.col("origin") == "health_xml"))
        return ranges.unionByName(M.cutover_ranges(cutovers, exported.select("subject_id", "type", "start_ts")))

    def _ledger(self, bodies: DataFrame, points: DataFrame, samples: DataFrame, minutes: DataFrame, sessions: DataFrame, nights: DataFrame, fresh: DataFrame, judged: DataFrame) -> DataFrame:
        """A row for each payload: its state, what became of its points by metric, and the range that they cover."""
        tell = lambda df, name, what: df.select("batch", name.alias("name"), what.alias("what"))
        told = [
            tell(points, F.col("name"), F.coalesce("skip_reason", F.lit("accepted"))), tell(samples, F.coalesce("type", F.lit("unknown")), F.coalesce("skip_reason", F.lit("accepted"))),
            tell(minutes.where("skip_reason is not null"), F.coalesce("name", F.lit("unknown")), F.col("skip_reason")), tell(sessions, F.lit("workouts"), F.coalesce("skip_reason", F.lit("accepted"))),
            tell(nights, F.lit("sleep_analysis"), F.coalesce("skip_reason", F.lit("daily_upserted"))), tell(fresh, F.col("name"), F.lit("inserted")), tell(judged, F.col("name"), F.concat(F.lit("minute_"), "outcome")),
        ]
        n = reduce(DataFrame.unionByName, told).groupBy("batch", "name", "what").agg(F.count("*").alias("n"))
        n = n.groupBy("batch", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("what", "n")))).alias("m"))
        n = n.groupBy("batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "m")))).alias("counts"))
        seen = [points.select("batch", "ts"), *[df.select("batch", F.col(c).alias("ts")) for df, c in ((samples, "start_ts"), (minutes, "minute_ts"), (sessions, "start_ts"))]]
        span = reduce(DataFrame.unionByName, seen).groupBy("batch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        state = F.when(F.col("state") == "validated", "normalized").otherwise(F.col("state")).alias("state")
        return bodies.join(n, "batch", "left").join(span, "batch", "left").select("path", "sha256", "subject_id", "device_id", "format", state, "error", "counts", "first_ts", "last_ts", "batch")

    # What readers see

    def observations(self) -> DataFrame:
        return self.store.read("observations")

    def minutes(self) -> DataFrame:
        return current(self.store.read("minutes", numbered=True), ["subject_id", "type", "minute_ts"])

    def nights(self) -> DataFrame:
        return current(self.store.read("nights", numbered=True), ["subject_id", "night", "channel"])

    def ledger(self) -> DataFrame:
        """Payloads with their states; those whose hours the rollup has are rollups_ready."""
        state = self.store.state()
        ready = (F.col("state") == "normalized") & (F.col("commit") <= state["marks"].get("drained", 0))
        rows = self.store.read("ledger", state, numbered=True)
        return rows.withColumn("state", F.when(ready, "rollups_ready").otherwise(F.col("state"))).drop("commit")

    def inventory(self) -> DataFrame:
        """(subject_id, type, n, first_ts, last_ts) of all observations, from the summaries that commits keep: no
        observation is read."""
        rows = self.store.read("summaries").groupBy("subject_id", "type")
        return rows.agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    @joins_dealt
    def newest(self, k: int) -> DataFrame:
        """The newest k observations of each subject and type, of equal instants those with the largest value, source and uuid.

        Months are read from the newest back, each only for the subjects and types that lack rows still and have some that
        early, until all have theirs: where all push daily that is the last month, however long the history."""
        state, key = self.store.state(), ["subject_id", "type"]
        rows = self.store.read("observations", state)
        order = [F.col(c).desc_nulls_last() for c in ("start_ts", "value", "source_id", "uuid", "category_value")]
        place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        lack = kept_table(self.inventory().select(*key, F.least("n", F.lit(k)).alias("lack"), month("first_ts").alias("first")), "lack")
        found = []
        for m in sorted({p.rpartition("month=")[2] for p in state["tables"].get("observations", {})}, reverse=True):
            some = rows.where(F.col("month") == m).join(lack.where(F.col("first") <= m), key)
            part = kept_table(some.withColumn("place", place).where("place <= lack").drop("place", "lack", "first"), "newest")
            found.append(part)
            got = part.groupBy(*key).agg(F.count("*").alias("got"))
            lack = kept_table(lack.join(got, key, "left").withColumn("lack", F.col("lack") - F.coalesce("got", F.lit(0))).where("lack > 0").drop("got"), "lack")
            if lack.isEmpty():
                break
        return reduce(DataFrame.unionByName, found) if found else rows.limit(0)

    @joins_dealt
    def repair_channels(self, regimes: tuple[str, ...] = ("raw",)) -> DataFrame | None:
        """Deletes the observations of a later channel where the earlier one has the range too, in one commit that writes the touched
        partitions anew and makes their hours dirty. The number of rows by (subject_id, type, origin); None where none goes,
        as in a second run."""
        state = self.store.state()
        some = [r["type"] for r in self.types.select("type", "regime").collect() if r["regime"] in regimes]
        obs = self.store.read("observations", state, numbered=True).where(F.col("type").isin(*some)).withColumnRenamed("commit", "ingested_at")
        gone = kept_table(M.later_channel_rows(obs), "gone")
        parts = [tuple(r) for r in gone.select("type", "month").distinct().collect()]
        if not parts:
            return None
        at = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("month") == m) for t, m in parts])
        # A channel's rows of a range go together, so the same join finds them in the partitions.
        keys = ["subject_id", "type", "origin", "start_ts", "batch", "uuid", "source_id", "value_key", "category_value"]
        left = kept_table(M.not_in_history(self.store.read("observations", state).where(at), gone, keys), "left")
        dirty = M.dirty_ranges(gone.where("value is not null"), []).select("subject_id", "type", "from_ts", "to_ts")
        drops = [f"type={t}/month={m}" for t, m in parts]
        # First and last instants can't be taken back, so the summaries of the types are made anew.
        types = sorted({t for t, _ in parts})
        rest = self.store.read("observations", state).where(F.col("type").isin(*types) & ~at).select("subject_id", "type", "start_ts")
        summaries = summary(rest.unionByName(left.select("subject_id", "type", "start_ts")))
        drops = {"observations": drops, "summaries": [f"type={t}" for t in types]}
        self.store.commit({"dirty": dirty}, {"observations": left, "summaries": summaries}, drops=drops)
        return gone.groupBy("subject_id", "type", "origin").agg(F.count("*").alias("rows_deleted"))

    @joins_dealt
    def merge_sessions(self) -> DataFrame | None:
        """Deletes sessions that are alike in all their business columns but for the one that stays, and points its ids, series and
        positions to that. Groups of which several have such rows are left as they are. (workout_id, keep) of those deleted;
        None where none is."""
        state = self.store.state()
        stored = {t: self.store.read(t, state) for t in ("sessions", "session_ids", "session_points", "session_routes")}
        children = reduce(DataFrame.unionByName, [stored[t].select("workout_id") for t in stored if t != "sessions"])
        alike = [c for c in stored["sessions"].columns if c not in ("workout_id", "stats")]
        rows = stored["sessions"].withColumn("stats_text", F.to_json(F.array_sort(F.map_entries("stats"))))
        groups = X.identical_sessions(rows, children, [*alike, "stats_text"]).where("keep is not null")
        ids = groups.select(F.explode("ids").alias("id"), "keep").where("id <> keep")
        gone = kept_table(ids.select(F.col("id").cast("long").alias("workout_id"), F.col("keep").cast("long").alias("keep")), "merged")
        if gone.isEmpty():
            return None
        replaced, drops = {}, {}
        for table, df in stored.items():
            moved = df.join(gone, "workout_id", "left")
            moved = moved.where("keep is null").drop("keep") if table == "sessions" else moved.withColumn("workout_id", F.coalesce("keep", "workout_id")).drop("keep")
            if table != "sessions" and df.join(gone, "workout_id", "left_semi").isEmpty():
                continue
            replaced[table] = kept_table(moved.select(*df.columns), table)
            drops[table] = list(state["tables"].get(table, {}))
        self.store.commit({}, replaced, drops=drops)
        return gone

    @joins_dealt
    def drain(self, priorities: DataFrame | None = None) -> int | None:
        """Brings the rollup up to date with all commits so far, and marks them, in one commit: only partitions of
        type and month that hold dirty hours are read and replaced, and only those hours rebuilt. The commit's number; None
        where nothing was dirty."""
        state = self.store.state()
        queue = self.store.read("dirty", state, numbered=True).where(F.col("commit") > state["marks"].get("drained", 0)).drop("commit")
        hours = kept_table(M.hours_of(queue).withColumn("month", month("hour_utc")), "hours")
        touched = [tuple(r) for r in hours.select("type", "month").distinct().collect()]
        if not touched:
            return None
        at = reduce(lambda a, b: a | b, [(F.col("type") == t) & (F.col("month") == m) for t, m in touched])
        types = {r["type"]: r["regime"] for r in self.types.select("type", "regime").collect()}
        some = lambda df, ts: M.of_hours(df.where(at), hours, ts)
        minutes = current(some(self.store.read("minutes", state, numbered=True), "minute_ts"), ["subject_id", "type", "minute_ts"])
        ranks = priorities if priorities is not None else queue.sparkSession.createDataFrame([], "subject_id long, type string, source_id long, rank int")
        cumulative = [t for t, r in types.items() if r == "cumulative"]
        rebuilt = S.build_rollup(
            some(self.store.read("observations", state), "start_ts"), minutes, self.store.read("cutovers", state).drop("device_id"), ranks,
            self.store.read("sources", state), cumulative, [t for t in types if t not in cumulative],
        ).withColumn("month", month("hour_utc"))
        old = self.store.read("rollup", state).where(at)
        rows = kept_table(M.apply_rollup(old, rebuilt.select(*old.columns), hours), "rollup")
        gone = [f"type={t}/month={m}" for t, m in touched]
        held = [p for p in gone if p in state["tables"].get("rollup", {})]
        return self.store.commit({}, {"rollup": rows}, marks={"drained": state["commit"]}, drops={"rollup": held})
