"""Payload files to stored tables: crashes, replays, versions and the rollup's upkeep."""

import gzip
import hashlib
import json
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseframe import lake as lakes
from pulseframe.streaming import intake

HEART, STEPS, SLEEP = "HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierStepCount", "HKCategoryTypeIdentifierSleepAnalysis"
TYPES = [(HEART, "quantity", "raw", "count/min", 10, False, False), (STEPS, "quantity", "cumulative", "count", 1, False, False), (SLEEP, "category", "sleep", None, 1, False, False)]
FILE = "path string, modificationTime timestamp, content binary"
FROM = datetime(2024, 1, 30, 22, 0, tzinfo=timezone.utc)


def contract(spark):
    types = spark.createDataFrame(TYPES, "type string, kind string, regime string, unit string, scale int, opted_out boolean, reaggregated boolean")
    return types, spark.createDataFrame([(SLEEP, 1), (SLEEP, 3)], "type string, category int")


def date(minute):
    return (FROM + timedelta(minutes=minute)).strftime("%Y-%m-%d %H:%M:%S +0000")


def uuid(n):
    return f"00000000-0000-0000-0000-{n:012x}"


def push(heart=(), steps=(), workouts=()):
    metrics = [
        {"name": "heart_rate", "units": "bpm", "data": [{"date": date(m), "Min": v, "Avg": v, "Max": v, "source": "Watch"} for m, v in heart]},
        {"name": "step_count", "units": "steps", "data": [{"date": date(m), "qty": v, "source": "Watch"} for m, v in steps]},
        {"name": "sleep_analysis", "units": "hr", "data": [{"date": date(0), "deep": 1.5, "sleepStart": date(0)}]},
    ]
    run = [{"id": i, "name": "Outdoor Run", "start": date(a), "end": date(a + 30), "duration": 1800.0, "stepCount": [{"date": date(a), "qty": 9.0, "units": "count", "source": "Watch"}]} for i, a in workouts]
    return {"data": {"metrics": metrics, "workouts": run}}


def native(samples=(), sleep=(), workouts=()):
    iso = lambda m: date(m).replace(" +0000", "Z").replace(" ", "T")
    rows = [{"uuid": uuid(n), "type": HEART, "start": iso(m), "value": v, "unit": "count/min", "source": "Watch"} for n, m, v in samples]
    rows += [{"uuid": uuid(n), "type": SLEEP, "start": iso(m), "end": iso(m + 60), "category": c, "source": "Watch"} for n, m, c in sleep]
    runs = [{"uuid": uuid(n), "activity": "HKWorkoutActivityTypeRunning", "start": iso(a), "end": iso(a + 30)} for n, a in workouts]
    return {"format": "pulse-native/1", "samples": rows, "workouts": runs}


def file(spark, *payloads):
    """payloads: (kind, device, name, content)."""
    rows = [(f"/land/{kind}/subject=1/device={device}/{name}.json", FROM, json.dumps(p).encode() if not isinstance(p, bytes) else p) for kind, device, name, p in payloads]
    return spark.createDataFrame(rows, FILE)


def first(spark):
    return file(spark, ("push", 1, "a", push([(0, 60), (1, 61), (130, 70)], [(0, 5), (0, 6), (150, 7)], [("w1", 10)])), ("native", 1, "b", native([(1, 1, 61), (2, 5, 62)], [(7, 0, 1), (8, 0, 2)], [(9, 10), (10, 300)])))


def second(spark):
    return file(spark, ("push", 2, "c", push([(0, 60), (9, 99)], [(0, 6), (150, 8), (151, 1)])), ("push", 1, "d", push([], [(150, 9), (-5, 3)], [("w1", 10)])), ("push", 1, "e", b"{broken"))


def content(took):
    out = {}
    for table in intake.SCHEMAS:
        df = took.store.read(table)
        out[table] = sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())
    return out


@pytest.fixture(scope="module")
def begun(spark, tmp_path_factory):
    """Makes copies of a store that has taken the first batch."""
    root = tmp_path_factory.mktemp("begun") / "store"
    intake.Intake(intake.lake(spark, str(root)), *contract(spark)).ingest(first(spark), 0)

    def copy(where):
        shutil.copytree(root, where)
        return intake.Intake(intake.lake(spark, str(where)), *contract(spark))

    return copy


@pytest.fixture(scope="module")
def whole(spark, begun, tmp_path_factory):
    took = begun(tmp_path_factory.mktemp("whole") / "store")
    took.ingest(second(spark), 1)
    return took, content(took)


def test_what_is_stored(whole):
    took, held = whole
    heart = sorted((r.start_ts.strftime("%H:%M"), r.value, r.uuid) for r in took.observations().collect())
    # The sample that a push payload holds too comes in once, as the push's.
    assert heart == [("00:10", 70.0, None), ("22:00", 60.0, None), ("22:01", 61.0, None), ("22:05", 62.0, uuid(2)), ("22:09", 99.0, None)]
    minutes = sorted((r.minute_ts.strftime("%d %H:%M"), r.value, r.device_id) for r in took.minutes().collect())
    assert minutes == [("30 22:00", 6.0, 1), ("31 00:30", 9.0, 1)]
    conflicts = sorted((r.minute_ts.strftime("%d %H:%M"), r.value) for r in took.store.read("conflicts").collect())
    assert conflicts == [("31 00:30", 8.0), ("31 00:31", 1.0)]
    assert [(r.stage, r.uuid) for r in took.store.read("segments").collect()] == [(1, uuid(7))]
    assert len(held["sessions"]) == 2 and len(held["session_ids"]) == 3  # the first native run is the push's
    assert len(held["session_points"]) == 1 and len(held["nights"]) == 2 and took.nights().count() == 1
    states = {r.path.rsplit("/", 1)[1]: (r.state, r.error) for r in took.ledger().collect()}
    assert states == {"a.json": ("normalized", None), "b.json": ("normalized", None), "c.json": ("normalized", None), "d.json": ("normalized", None), "e.json": ("failed", "json_invalid")}
    counts = {r.path.rsplit("/", 1)[1]: json.loads(r.counts or "{}") for r in took.ledger().collect()}
    assert counts["b.json"][SLEEP] == {"accepted": 1, "category_without_contract": 1}
    assert counts["c.json"]["step_count"] == {"accepted": 3, "minute_conflict": 2, "minute_duplicate": 1}
    assert counts["d.json"]["step_count"] == {"accepted": 2, "minute_before_cutover": 1, "minute_updated": 1}


@pytest.mark.parametrize("step", ["merged", "written"])
def test_a_batch_that_dies_and_runs_again_gives_the_same_store(spark, tmp_path, begun, whole, monkeypatch, step):
    took = begun(tmp_path / "store")
    before = content(took)

    def die(at):
        if at == step:
            raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="killed"):
        if step == "written":
            m.setattr(lakes.Lake, "_show", lambda self, name, what: die("written"))
        took.ingest(second(spark), 1, die)
    assert content(took) == before
    took.ingest(second(spark), 1)
    assert content(took) == whole[1]
    took.ingest(second(spark), 1)
    assert content(took) == whole[1]


def test_replays_change_nothing(spark, tmp_path, whole):
    took, held = whole
    again = intake.Intake(took.store, took.types, took.categories)
    again.ingest(first(spark).withColumn("path", F.replace("path", F.lit(".json"), F.lit("2.json"))), 2)
    now = content(again)
    assert {t for t in held if now[t] != held[t]} == {"ledger"}
    assert [r.state for r in again.ledger().where("path like '%2.json'").collect()] == ["duplicate"] * 2


def test_the_rollup_is_brought_up_to_date_by_partition(spark, tmp_path, begun):
    root = str(tmp_path / "store")
    took = begun(root)
    took.drain()
    assert took.ledger().where("state = 'rollups_ready'").count() == 2 and took.drain() is None
    version = took.store.version()
    old = {r.hour_utc.strftime("%H"): (r.n, r.sum) for r in version.read("rollup").where(F.col("type") == HEART).collect()}
    assert old == {"22": (3, 183.0), "00": (1, 70.0)}
    folders = took.store.folders("rollup")
    took.ingest(file(spark, ("push", 1, "z", push([(3, 65), (60 * 24 * 3, 50)]))), 1)
    took.drain()
    now = took.store.folders("rollup")
    # January's heart rates are written anew and February's added; steps stay as they were.
    assert {p for p in now if now[p] != folders.get(p)} == {f"type={HEART}/month=2024-01", f"type={HEART}/month=2024-02"}
    assert {r.hour_utc.strftime("%H"): (r.n, r.sum) for r in version.read("rollup").where(F.col("type") == HEART).collect()} == old
    later = intake.lake(spark, root)  # as another application opens it
    assert {r.hour_utc.strftime("%d %H"): (r.n, r.sum) for r in later.read("rollup").where(F.col("type") == HEART).collect()} == {"30 22": (4, 248.0), "31 00": (1, 70.0), "02 22": (1, 50.0)}


def test_the_later_channel_is_repaired(spark, tmp_path):
    took = intake.Intake(intake.lake(spark, str(tmp_path / "store")), *contract(spark))
    month = F.lit("2024-01")
    rows = lambda origin, minutes, value: spark.range(1).select(
        F.explode(F.lit(minutes)).alias("minute"), F.lit(origin).alias("origin"), F.lit(value).alias("value")
    ).select(
        F.lit(1).alias("subject_id"), F.lit(1).alias("source_id"), (F.lit("2024-01-10 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("minute"))).alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"),
        F.lit(0).alias("tz_offset_min"), "value", F.lit(1).alias("value_key"), F.lit(None).cast("int").alias("category_value"), "origin", F.lit(None).cast("string").alias("uuid"), F.lit("b").alias("batch"), F.lit(HEART).alias("type"), month.alias("month"),
    )
    took.store.commit({"observations": rows("health_xml", [0, 60, 120, 180], 1.0)})
    took.store.commit({"observations": rows("hae", [90, 91, 175, 185, 400], 2.0)})
    took.store.commit({"observations": rows("hae", [500], 3.0).withColumn("subject_id", F.lit(2))})
    took.store.commit({"summaries": intake.summary(took.observations())})
    assert [tuple(r) for r in took.repair_channels().collect()] == [(1, HEART, "hae", 3)]
    assert sorted((r.subject_id, r.n) for r in took.inventory().collect()) == [(1, 6), (2, 1)]
    left = sorted((r.subject_id, r.origin, r.value) for r in took.observations().collect())
    assert left == [(1, "hae", 2.0)] * 2 + [(1, "health_xml", 1.0)] * 4 + [(2, "hae", 3.0)]
    assert took.repair_channels() is None
    took.drain()
    assert {r.hour_utc.hour: (r.n, r.sum) for r in took.store.read("rollup").where("subject_id = 1").collect()} == {1: (1, 1.0), 2: (1, 1.0)}  # the hours that lost rows


def test_newest_rows_and_inventory(spark, tmp_path):
    took = intake.Intake(intake.lake(spark, str(tmp_path / "store")), *contract(spark))
    far = 60 * 24 * 40
    took.ingest(file(spark, ("push", 1, "a", push([(0, 60), (-far, 50), (-far - 1, 51), (-3 * far, 40), (5, 61)]))), 0)
    took.ingest(file(spark, ("push", 1, "b", push([(5, 62), (-2 * far, 45)]))), 1)
    newest = lambda k: sorted(r.value for r in took.newest(k).collect())
    assert newest(1) == [62.0] and newest(2) == [61.0, 62.0] and newest(5) == [50.0, 51.0, 60.0, 61.0, 62.0] and len(newest(99)) == 7
    (r,) = took.inventory().collect()
    assert (r.n, r.first_ts.date(), r.last_ts.minute) == (7, (FROM - timedelta(minutes=3 * far)).date(), 5)
    assert "observations" not in took.inventory()._jdf.queryExecution().toString()


def test_one_subject_reads_the_files_that_hold_it(spark, tmp_path):
    """Folders are sorted by subject, so that a file's statistics keep readers of one subject from others."""
    lake = intake.lake(spark, str(tmp_path / "l"))
    rows = spark.range(40_000).select((F.col("id") % 400).alias("subject_id"), F.lit(HEART).alias("type"), F.lit("2024-01").alias("month"), F.timestamp_seconds("id").alias("start_ts"), F.lit(1.0).alias("value"))
    rest = [c for c in intake.SCHEMAS["observations"].split(", ") if c.split()[0] not in rows.columns]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small rows would go to one file
    try:
        lake.commit({"observations": rows.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in rest])})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounds = [(r.a, r.b, r.n) for r in lake.read("observations").groupBy(F.input_file_name().alias("f")).agg(F.min("subject_id").alias("a"), F.max("subject_id").alias("b"), F.count("*").alias("n")).collect()]
    assert len(bounds) > 1 and sum(a <= 123 <= b for a, b, _ in bounds) == 1


def test_sessions_that_are_alike_become_one(spark, tmp_path):
    took = intake.Intake(intake.lake(spark, str(tmp_path / "store")), *contract(spark))
    session = lambda i, activity, stats=None: (i, 1, activity, 5, FROM, FROM + timedelta(minutes=30), 0, None, 60.0, None, 1.5, None, stats or {"a": "1", "b": "2"})
    rows = [session(10, "Run"), session(11, "Run"), session(12, "Run"), session(20, "Row"), session(21, "Row"), session(30, "Walk"), session(31, "Walk", {"a": "2"}), session(40, "Swim"), session(41, "Swim")]
    took.store.commit({
        "sessions": spark.createDataFrame(rows, intake.SCHEMAS["sessions"]), "session_ids": spark.createDataFrame([("push", "x", 11, 1), ("push", "y", 40, 1), ("push", "z", 41, 1)], intake.SCHEMAS["session_ids"]),
        "session_points": spark.createDataFrame([(11, "s", FROM, 1.0, "2024-01")], intake.SCHEMAS["session_points"]),
    })
    assert sorted(tuple(r) for r in took.merge_sessions().collect()) == [(10, 11), (12, 11), (21, 20)]
    assert sorted(r.workout_id for r in took.store.read("sessions").collect()) == [11, 20, 30, 31, 40, 41]
    assert [r.workout_id for r in took.store.read("session_points").collect()] == [11]
    assert took.merge_sessions() is None


def test_files_that_land_are_taken_once(spark, tmp_path):
    land = tmp_path / "land" / "push" / "subject=4" / "device=1"
    land.mkdir(parents=True)
    took = intake.Intake(intake.lake(spark, str(tmp_path / "store")), *contract(spark))
    body = gzip.compress(json.dumps(push([(0, 60)])).encode())
    (land / f"a.{hashlib.sha256(body).hexdigest()}.json.gz").write_bytes(body)
    (land / f"b.{'0' * 64}.json.gz").write_bytes(body)
    for _ in range(2):
        took.run(str(tmp_path / "land"), str(tmp_path / "checkpoint")).awaitTermination(300)
    assert [(r.subject_id, r.value) for r in took.observations().collect()] == [(4, 60.0)]
    assert sorted((r.state, r.error or "") for r in took.ledger().collect()) == [("failed", "sha256_mismatch"), ("normalized", "")]


def test_commits_sum_up_and_compact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lakes, "SUMMED", 3)
    lake = lakes.Lake(spark, str(tmp_path / "l"), {"t": "k long, type string", "u": "x long"}, {"t": ("type",)})
    rows = lambda *r: spark.createDataFrame(list(r), "k long, type string")
    for n in range(4):
        lake.commit({"t": rows((n, "a"), (n, "b")), "u": spark.range(n).withColumnRenamed("id", "x")}, marks={"last": n})
    at = lake.version()
    lake.commit({}, {"t": rows((9, "b"))}, drops={"t": ["type=a"]})
    assert sorted(tuple(r) for r in lake.read("t").collect()) == [(9, "b")]
    assert at.read("t").count() == 8 and lake.read("u").count() == 6 and lake.state()["marks"] == {"last": 3}
    for n in range(3):
        lake.commit({"t": rows((n, "b"))})
    lake.compact("t", 2)
    assert len(lake.folders("t")["type=b"]) == 1 and sorted(r.k for r in lake.read("t").collect()) == [0, 1, 2, 9]
    with pytest.raises(ValueError, match="not both"):
        lake.commit({"t": rows((1, "b"))}, {"t": rows((1, "b"))})
