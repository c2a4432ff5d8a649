"""What only larger or odder tables than the fixtures show."""

import os
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from oracle import same
from pyspark.sql import functions as F

from pulseframe.operators import series as S
from pulseframe.plans import catalog, ingest_queries, intake_queries
from pulseframe.sources import normalise, wire
from pulseframe.sources.canonical import Tables
from pulseframe.streaming import intake

DIR = "/root/testdata/sf0.001"


def folder(spark, tmp_path, **changed):
    """The small tables, some of them changed."""
    for t in os.listdir(DIR):
        name = t.removesuffix(".parquet")
        if name in changed:
            changed[name](spark.read.parquet(f"{DIR}/{t}")).write.parquet(f"{tmp_path}/{t}")
        else:
            os.symlink(f"{DIR}/{t}", f"{tmp_path}/{t}")
    return str(tmp_path)


def test_values_of_zero_are_formatted(spark, tmp_path):
    where = folder(spark, tmp_path, events=lambda e: e.withColumn("value", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value"))))
    assert same(catalog.QUERIES["formatted_values"](spark, where), catalog.ORACLES["formatted_values"], where)


def test_payloads_are_parsed_once(spark):
    """One parse for all of a payload's series and points, refused ones too."""
    t = Tables(spark, DIR)
    for rows in (normalise.push_series(ingest_queries.push(t, "sessions")), normalise.push_routes(ingest_queries.push(t, "sessions")), normalise.native_sessions(wire.native_documents(ingest_queries.native(t, "sessions")))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("parseJson(") == 1


def test_an_intake_sends_no_table_of_subjects_through_the_driver(spark):
    """Joins are dealt by key however small the files are, and the session's setting is as it was."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    took = intake_queries.stored(Tables(spark, DIR))
    before = spark.conf.get(name)
    with intake.dealt(spark):
        held = took.store.read("observations").join(took.inventory(), ["subject_id", "type"])
        plan = held._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and spark.conf.get(name) == before
    assert all(hasattr(getattr(intake.Intake, step), "__wrapped__") for step in ("ingest", "drain", "newest"))


def test_received_payloads_are_read_once(spark):
    """Neither the files nor the bodies are read again to find their order or their text."""
    files = spark.createDataFrame([("/l/push/subject=1/device=2/a.json", None, b'{"data": {}}')], "path string, modificationTime timestamp, content binary")
    took = intake.Intake(intake.lake(spark, "/nowhere"), *intake_queries.contract(Tables(spark, DIR)))
    rows = took.received(files)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    (r,) = rows.collect()
    assert (r.subject_id, r.device_id, r.format, r.batch, r.body, r.error) == (1, 2, "push", "0|/l/push/subject=1/device=2/a.json", '{"data": {}}', None)


def records(spark) -> int:
    """Rows that the session has shuffled."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_a_dense_axis_of_buckets_is_not_shuffled(spark):
    t0 = datetime(2024, 1, 10, tzinfo=timezone.utc)
    subjects = [(i, "UTC") for i in range(60)] + [(None, None)]
    rows = [(i, "UTC", k, t0 + timedelta(seconds=s), Decimal(i + k)) for i in range(0, 60, 2) for k, s in enumerate((-1, 0, 30, 61, 7200, 86399, 86400))]
    rows += [(None, "UTC", 0, t0, Decimal(1)), (99, "UTC", 0, t0, Decimal(1))]
    obs = spark.createDataFrame(rows, "subject_id long, tz string, event_id long, start_ts timestamp, value decimal(18,2)")
    out = S.bucket_series(obs, spark.createDataFrame(subjects, "subject_id long, tz string"), "2024-01-10", "2024-01-11", 60, "start_ts", S.value_of("sum"), [F.count("value").alias("n")])
    want = {(i, t0 + timedelta(minutes=m)): None for i in range(60) for m in range(1440)}
    for i, _, k, at, v in rows:
        b = (i, at.replace(second=0))
        if b in want:
            want[b] = (want[b] or (0, 0))[0] + float(v), (want[b] or (0, 0))[1] + 1
    before = records(spark)
    got = out.select("subject_id", F.unix_seconds("bucket").alias("b"), "value", "n").collect()
    assert records(spark) - before < 1000
    assert {(r[0], datetime.fromtimestamp(r[1], timezone.utc)): r[2] if r[2] is None else (r[2], r[3]) for r in got} == want and len(got) == len(want)
