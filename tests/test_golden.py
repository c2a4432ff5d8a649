"""Small hand-written cases."""

import gzip
import json
from datetime import datetime as D
from datetime import timezone

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import names as N
from pulseframe.functions import timefns as T
from pulseframe.functions import units as U
from pulseframe.operators import merge as M
from pulseframe.operators import series as S
from pulseframe.operators import sessions as X

SAMPLE = "id long, subject_id long, type string, source_id int, value_key long, start_ts timestamp"


def at(s):
    return D.fromisoformat(f"2024-01-10T{s}").replace(tzinfo=timezone.utc)


def samples(spark, times, key=7):
    return spark.createDataFrame([(i, 1, "hr", 0, key, at(t)) for i, t in enumerate(times)], SAMPLE)


@pytest.mark.parametrize(
    ("incoming", "existing", "want"),
    [
        (["10:00:05"], ["10:00:06"], {0: "matched"}),
        (["10:00:05"], ["10:00:07"], {}),
        (["10:00:59.900"], ["10:00:00"], {0: "matched"}),
        (["10:01:00"], ["10:00:00"], {}),
        (["10:00:05"], ["10:00:04", "10:00:06"], {0: "ambiguous"}),
        (["10:00:05", "10:00:05"], ["10:00:05"], {0: "ambiguous", 1: "ambiguous"}),
        (["10:00:05", "10:00:05.500"], ["10:00:05"], {0: "matched"}),
    ],
)
def test_match(spark, incoming, existing, want):
    got = M.match_across(samples(spark, incoming), samples(spark, existing)).collect()
    assert {r.in_id: r.outcome for r in got} == want


def test_null_value_never_matches(spark):
    assert M.match_across(samples(spark, ["10:00:05"], None), samples(spark, ["10:00:05"], None)).count() == 0


def test_half_hour_zone_and_dst(spark):
    df = spark.createDataFrame([(at("18:15:00"),), (at("18:45:00"),)], "ts timestamp")
    days = [r[0].isoformat() for r in df.select(T.local_day(F.col("ts"), F.lit("Asia/Kolkata"))).collect()]
    assert days == ["2024-01-10", "2024-01-11"]
    axis = spark.createDataFrame([(1, "Europe/Paris")], "subject_id long, tz string")
    hours = S.bucket_axis(axis, "2026-03-29", "2026-03-30", 3600).count(), S.bucket_axis(axis, "2026-10-25", "2026-10-26", 3600).count()
    assert hours == (23, 25)


def test_scalars(spark):
    r = spark.range(1).select(
        T.quantise(F.lit(-2.5), 1).alias("q"), T.percent_delta(F.lit(3.0), F.lit(0.0)).alias("d"), U.convert(F.lit(1.0), F.lit("km"), F.lit("kg")).alias("u"), N.label(F.lit("HKQuantityTypeIdentifierHeartRate")).alias("l"),
        N.metric_group(F.lit("HKQuantityTypeIdentifierRestingHeartRate")).alias("g"), U.elevation_m(F.lit("1710 cm")).alias("e"), U.source_name(F.lit(" My Watch\t")).alias("s"), T.trend_quality(F.lit(3.0), True).alias("t"),
    ).first()
    assert (r.q, r.d, r.u, r.l, r.g, round(r.e, 6), r.s, r.t) == (-2, None, None, "Heart rate", "heart", 17.1, "My Watch", "bad")


def test_splits(spark):
    pts = spark.createDataFrame([(1, i, v) for i, v in enumerate([600.0, 600.0, 900.0])], "workout_id long, minute int, value double")
    assert [r.seconds for r in X.kilometre_splits(pts).orderBy("km").collect()] == [100, 73]


def test_winner_and_cutover(spark):
    obs = spark.createDataFrame(
        [(1, 1, "UTC", "steps", s, at(t), at(t), v, "health_xml") for s, t, v in ((0, "10:10:00", 5.0), (1, "10:20:00", 9.0), (1, "11:40:00", 7.0))],
        "event_id long, subject_id long, tz string, type string, source_id int, start_ts timestamp, end_ts timestamp, value double, origin string",
    )
    mins = spark.createDataFrame([(1, "UTC", "steps", at("11:45:00"), 2.0, 0)], "subject_id long, tz string, type string, minute_ts timestamp, value double, source_id int")
    cut = spark.createDataFrame([(1, "steps", at("11:30:00"))], "subject_id long, type string, cutover_ts timestamp")
    src = spark.createDataFrame([(0, "Apple Watch"), (1, "iPhone")], "source_id int, name string")

    def total(prio):
        p = S.cumulative_parts(obs, mins, cut, spark.createDataFrame(prio, "subject_id long, type string, source_id int, rank int"), src, ["steps"], "2024-01-10", "2024-01-11")
        return S.daily_cumulative(p, spark.createDataFrame([(1, D(2024, 1, 10).date())], "subject_id long, day date"), "steps").first()

    assert (total([]).value, total([]).n) == (7.0, 2)
    assert total([(1, "steps", 1, 1)]).value == 11.0


def test_replay_inserts_nothing(spark):
    df = samples(spark, ["10:00:05", "10:00:09"]).withColumn("end_ts", F.col("start_ts"))
    kept, counts = M.merge_raw(df, df, df.limit(0), [])
    assert kept.count() == 0
    assert {r.step: r.n for r in counts.collect()} == {"received": 2, "batch_distinct": 2}


def test_wire_and_spool(spark, tmp_path):
    from pulseframe.sources import normalise, wire
    from pulseframe.streaming.spool import Spool

    point = lambda minute, lo, mid, hi: {"date": f"2024-01-10 10:0{minute}:00 +0530", "Min": lo, "Avg": mid, "Max": hi}
    good = {"data": {"metrics": [
        {"name": "heart_rate", "units": "bpm", "data": [point(0, 60, 60, 60), point(1, 60, 61, 62), {"date": "x", "qty": 1}]},
        {"name": "blood_pressure", "units": "mmHg", "data": [{"date": "2024-01-10 10:00:00 +0530", "systolic": 120, "diastolic": 80}]},
    ]}}
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a b.json").write_text(json.dumps(good))
    (folder / "b.json").write_text("{not json")
    (folder / "c.json.gz").write_bytes(gzip.compress(json.dumps(good).encode()))
    (folder / "d.json.gz").write_bytes(gzip.compress(b"{}")[:-9])
    (folder / "e.json").write_text('{"data": null}')
    b = wire.read_batches(spark, str(folder)).withColumns({"subject_id": F.lit(1), "batch": F.lit(0)})
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in wire.parsed(b, wire.PUSH, F.col("doc.data").isNotNull()).collect()}
    assert errors == {"a%20b.json": None, "b.json": "json_invalid", "c.json.gz": None, "d.json.gz": "gunzip_failed", "e.json": "shape_invalid"} or errors == {"a b.json": None, "b.json": "json_invalid", "c.json.gz": None, "d.json.gz": "gunzip_failed", "e.json": "shape_invalid"}
    assert {r.error for r in wire.read_batches(spark, str(folder), most=20).collect()} == {None, "too_large", "gunzip_failed"}
    types = spark.createDataFrame([("HKQuantityTypeIdentifierHeartRate", "raw", "count/min", False)] + [(f"HKQuantityTypeIdentifierBloodPressure{s}", "raw", "mmHg", False) for s in ("Systolic", "Diastolic")], "type string, regime string, unit string, opted_out boolean")
    pts = normalise.push_metrics(wire.push_documents(b.where("path like '%b.json'")), types)
    assert {r["name"]: r["counts"] for r in normalise.counters(pts, "name").collect()} == {"heart_rate": {"accepted": 1, "skipped_aggregated": 1, "skipped_bad_point": 1}, "blood_pressure": {"accepted": 2}}
    assert wire.read_batches(spark, str(folder), spark.createDataFrame([("gone", "0")], "path string, sha256 string")).where("error = 'raw_file_missing'").count() == 1

    land = tmp_path / "land"
    land.mkdir()
    row = {"uuid": "u1", "subject_id": 1, "type": "hr", "source_id": 0, "start_ts": "2024-01-10T10:00:00Z", "end_ts": None, "value": 60.0, "category_value": None}
    (land / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row))
    spool = Spool(spark, str(tmp_path / "store"))
    spool.run(str(land), str(tmp_path / "cp")).awaitTermination(60)
    (land / "2.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"uuid": "u2", "value": 61.0}))
    spool.run(str(land), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.uuid for r in spool.observations.collect()) == ["u1", "u2"]
    (land / "3.json").write_text((land / "1.json").read_text())
    spool.run(str(land), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.batch, r.received, r.valid, r.inserted, r.status) for r in spool.ledger.orderBy("batch").collect()] == [(0, 2, 2, 1, "normalized"), (1, 2, 2, 1, "normalized"), (2, 2, 0, 0, "duplicate")]
    spool.drained(1)
    assert {r.batch: r.status for r in spool.ledger.collect()} == {0: "normalized", 1: "rollups_ready", 2: "duplicate"}


def test_batches_of_repeated_rows_are_not_taken_for_each_other(spark, tmp_path):
    from pulseframe.streaming.spool import SAMPLE, Spool

    spool = Spool(spark, str(tmp_path / "store"))
    row = lambda u: (u, 1, "hr", 0, at("10:00:00"), None, float(u[1:]), None)
    for n, ids in enumerate((["u1", "u1", "u2", "u2"], ["u3", "u3", "u4", "u4"], ["u4", "u3", "u4", "u3"])):
        spool.ingest(spark.createDataFrame([row(u) for u in ids], SAMPLE), n)
    assert sorted(r.uuid for r in spool.observations.collect()) == ["u1", "u2", "u3", "u4"]
    assert [r.status for r in spool.ledger.orderBy("batch").collect()] == ["normalized", "normalized", "duplicate"]


def test_gzip_members_are_read_whole(spark, tmp_path):
    from pulseframe.sources import wire

    z, body = gzip.compress, b'{"data":{"metrics":[]}}'
    cases = {"one": z(body), "two": z(body[:9]) + z(body[9:]), "padded": z(body) + b"\0" * 20, "cut": z(body[:9]) + z(body[9:])[:-5], "rest": z(body) + b"more", "huge": z(body[:9]) + z(b" " * 99)}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.body, r.error) for r in wire.read_batches(spark, str(tmp_path), most=50).collect()}
    fine, bad = (body.decode(), None), (None, "gunzip_failed")
    assert got == {"one": fine, "two": fine, "padded": fine, "cut": bad, "rest": bad, "huge": (None, "too_large")}


def test_points_count_by_the_rules_of_their_metric(spark):
    from pulseframe.sources import normalise, wire

    at_ = "2024-01-10 10:00:00 +0000"
    points = {
        "heart_rate": ("bpm", [{"Avg": 70}, {"qty": 71}, {"Min": 72, "Avg": 72, "Max": 72}, {"Min": 1, "Avg": 2, "Max": 3, "qty": 73}]),
        "body_temperature": ("degC", [{"qty": 37, "Avg": 36, "Min": 35}, {"Avg": 36}]),
        "blood_pressure": ("mmHg", [{"systolic": 120}, {"systolic": 120, "diastolic": 80}]),
    }
    doc = {"data": {"metrics": [{"name": n, "units": u, "data": [{"date": at_, **p} for p in ps]} for n, (u, ps) in points.items()]}}
    batches = spark.createDataFrame([(1, 0, json.dumps(doc), None)], "subject_id long, batch int, body string, error string")
    names = ["HeartRate", "BodyTemperature", "BloodPressureSystolic", "BloodPressureDiastolic"]
    types = [(f"HKQuantityTypeIdentifier{n}", "raw", u, False, s) for n, u, s in zip(names, ("count/min", "degC", "mmHg", "mmHg"), (10, 100, 1, 1), strict=True)]
    p = normalise.push_metrics(wire.push_documents(batches), spark.createDataFrame(types, "type string, regime string, unit string, opted_out boolean, scale int"))
    got = sorted((r["name"], r.value_key, r.skip_reason) for r in p.collect() if r.skip_reason is None)
    assert got == [("blood_pressure", 80, None), ("blood_pressure", 120, None), ("body_temperature", 3700, None), ("heart_rate", 720, None)]
    refused = {r["name"]: r["counts"] for r in normalise.counters(p.where("skip_reason is not null"), "name").collect()}
    assert refused == {"heart_rate": {"skipped_bad_point": 2, "skipped_aggregated": 1}, "body_temperature": {"skipped_bad_point": 1}, "blood_pressure": {"skipped_bad_point": 1}}


def test_minute_counters_take_late_and_repeated_events_once(spark, tmp_path):
    from pulseframe.streaming import spool

    store, event = str(tmp_path / "minutes"), "event_id long, subject_id long, type string, ts timestamp, value double"
    batches = [[(1, at("10:00:05"), 2.0), (2, at("10:00:50"), 3.0)], [(3, at("12:00:00"), 1.0), (2, at("10:00:50"), 3.0)], [(4, at("10:00:59"), 5.0)]]
    for n, rows in [*enumerate(batches), (2, batches[2])]:
        spool.minute_counters(spark, store, spark.createDataFrame([(i, 1, "steps", t, v) for i, t, v in rows], event), n)
    assert {(r.minute_ts.strftime("%H:%M"), r.value, r.n) for r in spool.minutes(spark, store).collect()} == {("10:00", 10.0, 3), ("12:00", 1.0, 1)}


def test_export(spark, tmp_path):
    from pulseframe.sources import export, wire

    rec = '<Record type="HR" sourceName="W" unit="count/min" value="{}" startDate="2024-01-10 10:0{}:00 +0000" endDate="2024-01-10 10:00:00 +0000"/>'
    (tmp_path / "export.xml").write_text(
        "<HealthData>" + rec.format(60, 0) + "<Correlation>" + rec.format(70, 1) + '</Correlation><Workout workoutActivityType="HKWorkoutActivityTypeRunning" sourceName="W" duration="30" durationUnit="min" startDate="2024-01-10 10:00:00 +0000" endDate="2024-01-10 10:30:00 +0000">'
        '<WorkoutStatistics type="HKQuantityTypeIdentifierDistanceWalkingRunning" sum="5" unit="km"/><MetadataEntry key="HKIndoorWorkout" value="0"/><MetadataEntry key="HKElevationAscended" value="1710 cm"/></Workout></HealthData>'
    )
    rows, workouts = export.read_export(spark, str(tmp_path / "export.xml"))
    assert [r.value for r in rows.collect()] == [60.0]
    w = workouts.first()
    assert (w.activity, w.duration_s, w.distance_m, w.indoor, round(w.elevation_up_m, 6)) == ("Running", 1800.0, 5000.0, False, 17.1)
    types = spark.createDataFrame([("HR", "count/s", "quantity")], "type string, unit string, kind string")
    assert [(r.value, r.skip_reason) for r in export.read_export(spark, str(tmp_path / "export.xml"), types)[0].collect()] == [(None, "unit_mismatch")]
    assert [r.skip_reason for r in export.read_export(spark, str(tmp_path / "export.xml"), types.limit(0))[0].collect()] == ["unknown_type"]
    for _ in range(2):
        wire.write_rows(rows.withColumn("day", F.to_date("start_ts")), str(tmp_path / "sink"), "type", "day")
    assert spark.read.parquet(str(tmp_path / "sink")).where("type = 'HR' and day = '2024-01-10'").count() == 2


def test_contracts_are_checked(spark):
    types = spark.createDataFrame([("a",), ("b",)], "type string")
    rows = lambda *r: spark.createDataFrame(list(r), "code int, type string")
    assert M.checked_contract(rows((1, "a"), (2, "b")), types, ["code"]).count() == 2
    for bad, what in ((rows((None, "a")), "without a key"), (rows((1, "a"), (1, "b")), "twice"), (rows((1, "weight"),), "unknown types")):
        with pytest.raises(ValueError, match=what):
            M.checked_contract(bad, types, ["code"])


ELEMENT = '<Record type="HR" sourceName="{}" unit="count/min" value="{}" startDate="2024-01-10 10:00:00 +0000" endDate="2024-01-10 10:00:00 +0000"'
SESSION = '<Workout workoutActivityType="HKWorkoutActivityTypeRunning" sourceName="W &amp; V" duration="{}" durationUnit="min" startDate="2024-01-10 10:00:00 +0000" endDate="2024-01-10 11:00:00 +0000"'


def exported(n):
    """n blocks of elements, nested and not, with the values that count."""
    out, want = ['<?xml version="1.0"?>\n<!DOCTYPE HealthData [\n<!ELEMENT Record (MetadataEntry*)>\n]>\n<HealthData>\n'], []
    for k in range(n):
        nested = ELEMENT.format("W", -1) + "/>"
        out += [ELEMENT.format("A &lt;b&gt; &quot;c&quot; &#233;\u00a0", k), '>\n<MetadataEntry key="HKIndoorWorkout" value="1"/>\n</Record>\n']
        out += ["<Correlation type='x'>\n", nested * 3, ELEMENT.format("W", -1), '><MetadataEntry key="a" value="b"/></Record></Correlation>\n']
        out += [SESSION.format(k), '>\n<WorkoutStatistics type="HKQuantityTypeIdentifierDistanceCycling" sum="2" unit="km"/>\n<WorkoutStatistics type="HKQuantityTypeIdentifierDistanceWalkingRunning" sum="500" unit="m"/>\n', nested]
        out += ['<WorkoutActivity uuid="u">\n<WorkoutStatistics type="HKQuantityTypeIdentifierDistanceCycling" sum="99" unit="km"/>\n<MetadataEntry key="HKIndoorWorkout" value="1"/></WorkoutActivity>\n']
        out += ['<WorkoutRoute><MetadataEntry key="HKElevationAscended" value="9 m"/></WorkoutRoute><MetadataEntry key="HKElevationAscended" value="150 cm"/>\n</Workout>\n', SESSION.format(k), "/>\n"]
        want.append(float(k))
    return "".join([*out, "</HealthData>\n"]), want


def test_export_is_read_by_ranges_with_what_is_open_around_them(spark, tmp_path):
    import zipfile

    from pulseframe.sources import export

    text, want = exported(40)
    (tmp_path / "export.xml").write_text(text)
    with zipfile.ZipFile(tmp_path / "export.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("apple/other.xml", "<a/>")
        z.writestr("apple/export.xml", text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for path, most in (("export.xml", "3333"), ("export.zip", "8000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows, workouts = export.read_export(spark, str(tmp_path / path))
            got = rows.collect()
            assert sorted(r.value for r in got) == want and {r.source for r in got} == {'A <b> "c" é'}
            w = workouts.toPandas()
            assert len(w) == 80 and set(w["source"]) == {"W & V"}
            full = w[w["distance_m"].notna()]
            assert len(full) == 40 and set(full["distance_m"]) == {2500.0} and set(full["elevation_up_m"]) == {1.5} and full["indoor"].isna().all()
            assert sorted(full["duration_s"]) == [k * 60.0 for k in range(40)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    ranges = export.elements(spark, str(tmp_path / "export.xml"))
    assert "Scan xml" not in ranges._jdf.queryExecution().toString()
