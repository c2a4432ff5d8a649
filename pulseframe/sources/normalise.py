"""Payloads of both push formats as canonical rows: metrics, minutes, nights, sessions and their series.

Every function takes documents that ``wire`` has parsed, one row for each batch, and keeps refused rows
with a reason. Names and units come from the payload and are never assumed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions.timefns import iso_date, push_date, quantise
from ..functions.units import convert, source_name
from ..operators.merge import first_of_batch

#: The minute series of a push session with the units that they are kept in.
SERIES = {"active_energy": ("activeEnergy", "kJ"), "basal_energy": ("basalEnergy", "kJ"), "step_count": ("stepCount", "count"), "walking_running_distance": ("walkingAndRunningDistance", "m")}
#: The statistics of a push session that are trusted, with their units. Heart rates come from
#: after the session and are never kept.
STATS = {
    "active_energy_burned_kj": ("activeEnergyBurned", "kJ"), "flights_climbed": ("flightsClimbed", "count"), "step_cadence_per_min": ("stepCadence", "count/min"), "temperature_c": ("temperature", "degC"),
    "humidity_fraction": ("humidity", "fraction"),
}
#: The phases of a reported night and the payload's names.
PHASES = {"asleep_s": "asleep", "core_s": "core", "deep_s": "deep", "rem_s": "rem", "awake_s": "awake", "in_bed_s": "inBed"}
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _quantity(q: str, unit: str) -> Column:
    return F.when(finite(F.col(f"w.{q}.qty")), convert(F.col(f"w.{q}.qty"), F.col(f"w.{q}.units"), F.lit(unit)))


def push_sessions(docs: DataFrame) -> DataFrame:
    """(subject_id, batch, external_id, activity, source, start_ts, end_ts, tz_offset_min, indoor, duration_s,
    distance_m, energy_kj, elevation_up_m, stats, unmapped, skip_reason) of push batches.

    A session needs an id and an end after its start. Its source is that of its first minute series that
    has one, as sessions name none."""
    w = docs.select("subject_id", "batch", F.explode("doc.data.workouts").alias("w"))
    (start, offset), (end, _) = push_date(F.col("w.start")), push_date(F.col("w.end"))
    source = F.coalesce(*[F.get(F.col(f"w.{field}"), F.lit(0))["source"] for field, _ in SERIES.values()])
    indoor = F.coalesce(F.col("w.isIndoor"), F.when(F.col("w.location").isNotNull(), F.col("w.location") == "Indoor"))
    stats = {"hae_name": F.col("w.name"), **{k: _quantity(*v).cast("string") for k, v in STATS.items()}, "intensity_kcal_hr_kg": F.col("w.intensity.qty").cast("string"), "location": F.col("w.location")}
    held = F.map_filter(F.create_map(*[x for k, v in stats.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    out = w.select(
        "subject_id", "batch", F.col("w.id").alias("external_id"), N.activity(F.col("w.name")).alias("activity"), F.coalesce(source_name(source), F.lit("")).alias("source"),
        start.alias("start_ts"), end.alias("end_ts"), offset.alias("tz_offset_min"), indoor.alias("indoor"), F.when(finite(F.col("w.duration")), F.col("w.duration")).otherwise(0.0).alias("duration_s"),
        _quantity("distance", "m").alias("distance_m"), _quantity("totalEnergy", "kJ").alias("energy_kj"), _quantity("elevationUp", "m").alias("elevation_up_m"),
        held.alias("stats"), N.lookup(N.ACTIVITIES, F.col("w.name")).isNull().alias("unmapped"),
    )
    fine = F.col("external_id").isNotNull() & (F.col("end_ts") > F.col("start_ts"))
    return out.withColumn("skip_reason", F.when(~F.coalesce(fine, F.lit(False)), "skipped_invalid"))


def push_series(docs: DataFrame) -> DataFrame:
    """(subject_id, external_id, series, ts, value, skip_reason): minute series of push sessions, in canonical
    units; of equal instants of a series the first counts."""
    w = docs.select("subject_id", "batch", F.posexplode("doc.data.workouts").alias("session", "w"))
    kinds = F.array(*[F.struct(F.lit(name).alias("series"), F.lit(unit).alias("to"), F.col(f"w.{field}").alias("points")) for name, (field, unit) in SERIES.items()])
    rows = w.select("subject_id", "batch", "session", F.col("w.id").alias("external_id"), F.explode(kinds).alias("s"))
    rows = rows.select("subject_id", "batch", "session", "external_id", "s.series", "s.to", F.posexplode("s.points").alias("place", "p"))
    ts, value = push_date(F.col("p.date"))[0], F.when(finite(F.col("p.qty")), convert(F.col("p.qty"), F.col("p.units"), F.col("to")))
    rows = rows.select("subject_id", "batch", "session", "external_id", "series", "place", ts.alias("ts"), value.alias("value"))
    rows = rows.withColumn("skip_reason", F.when(F.col("ts").isNull() | F.col("value").isNull(), "points_skipped"))
    return _first_fine(rows, ["subject_id", "external_id", "series", "ts"]).drop("batch", "session", "place")


def _first_fine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All refused rows, and of the others the first of each key in the order of batch, session and place."""
    w = Window.partitionBy(*keys, "skip_reason").orderBy("batch", "session", "place")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1 or skip_reason is not null").drop("__n")


def push_routes(docs: DataFrame) -> DataFrame:
    """(subject_id, external_id, ts, lat, lon, altitude_m, speed_ms, course_deg, h_acc_m, skip_reason): positions
    of push sessions; of equal instants the first counts."""
    w = docs.select("subject_id", "batch", F.posexplode("doc.data.workouts").alias("session", "w"))
    rows = w.select("subject_id", "batch", "session", F.col("w.id").alias("external_id"), F.posexplode("w.route").alias("place", "p"))
    own = {"lat": "latitude", "lon": "longitude", "altitude_m": "altitude", "speed_ms": "speed", "course_deg": "course", "h_acc_m": "horizontalAccuracy"}
    cols = [F.when(finite(F.col(f"p.{field}")), F.col(f"p.{field}")).alias(name) for name, field in own.items()]
    rows = rows.select("subject_id", "batch", "session", "external_id", "place", push_date(F.col("p.timestamp"))[0].alias("ts"), *cols)
    rows = rows.withColumn("skip_reason", F.when(F.col("ts").isNull() | F.col("lat").isNull() | F.col("lon").isNull(), "route_points_skipped"))
    return _first_fine(rows, ["subject_id", "external_id", "ts"]).drop("batch", "session", "place")


def push_metrics(docs: DataFrame, types: DataFrame) -> DataFrame:
    """(subject_id, batch, name, place, type, regime, ts, tz_offset_min, value, value_key, source, skip_reason): the
    points of push metrics in their types' units. A fused blood pressure point is two rows, or one refused row where
    either side is no number.

    A heart rate of the raw regime counts if its least, mean and largest value are given and equal: others are averages.
    All other points count by their quantity alone, whatever else they hold. types: (type, regime, unit, opted_out), and
    scale where values are not quantised by 1,000. Unknown names, types that the subject opted out of, bad dates, values
    that are no number or in no convertible unit are kept with the reason."""
    m = docs.select("subject_id", "batch", F.explode("doc.data.metrics").alias("m")).where("m.name <> 'sleep_analysis'")
    p = m.select("subject_id", "batch", "m.name", "m.units", F.posexplode("m.data").alias("place", "p"))
    whole = reduce(lambda a, b: a & b, [finite(F.col(f"p.{side}")) for side in N.PRESSURE])
    fused = [F.struct(F.lit(t).alias("type"), F.when(whole, F.col(f"p.{side}")).alias("v")) for side, t in N.PRESSURE.items()]
    single = F.struct(N.metric_identifier(F.col("name")).alias("type"), F.col("p.qty").alias("v"))
    parts = F.when(F.col("name") != "blood_pressure", F.array(single)).when(whole, F.array(*fused)).otherwise(F.array(fused[0]))
    ts, offset = push_date(F.col("p.date"))
    rows = p.withColumn("x", F.explode(parts)).select(
        "subject_id", "batch", "name", "units", "place", "x.type", "x.v", ts.alias("ts"), offset.alias("tz_offset_min"),
        F.coalesce(source_name(F.col("p.source")), F.lit("")).alias("source"), F.col("p.Min").alias("lo"), F.col("p.Avg").alias("mid"), F.col("p.Max").alias("hi"),
    )
    scale = F.col("scale").cast("double") if "scale" in types.columns else F.lit(1000.0)
    # A row for each type of the contract.
    known = types.select("type", "regime", F.col("unit").alias("to"), "opted_out", scale.alias("scale"))
    rows = rows.join(F.broadcast(known), "type", "left")
    heart = (F.col("name") == "heart_rate") & (F.col("regime") == "raw")
    rows = rows.withColumn("v", F.when(heart, F.col("mid")).otherwise(F.col("v")))
    value = F.when(finite(F.col("v")), convert(F.col("v"), F.col("units"), F.coalesce("to", "units")))
    given = finite(F.col("lo")) & finite(F.col("mid")) & finite(F.col("hi"))
    averaged = heart & ~((F.col("lo") == F.col("mid")) & (F.col("mid") == F.col("hi")))
    reason = (
        F.when(F.col("regime").isNull(), "unknown_metric").when(F.col("opted_out"), "opted_out").when(heart & ~given, "skipped_bad_point")
        .when(averaged, "skipped_aggregated").when(F.col("ts").isNull() | ~finite(F.col("v")), "skipped_bad_point").when(value.isNull(), "skipped_unit")
    )
    out = rows.withColumn("value", value).withColumn("skip_reason", reason).withColumn("value_key", quantise(F.col("value"), F.col("scale")))
    return out.drop("v", "lo", "mid", "hi", "to", "units", "opted_out", "scale")


def minute_rows(points: DataFrame) -> DataFrame:
    """(subject_id, type, minute_ts, value, source): accepted points of cumulative types; of a minute the last
    of a batch counts."""
    some = points.where("skip_reason is null and regime = 'cumulative'").withColumn("minute_ts", F.date_trunc("minute", "ts"))
    last = first_of_batch(some, ["subject_id", "type", "minute_ts"], [F.col("batch").desc(), F.col("place").desc()])
    return last.select("subject_id", "type", "minute_ts", "value", "source")


def push_nights(docs: DataFrame) -> DataFrame:
    """(subject_id, batch, night, channel, …_s, sleep_start, sleep_end, id, skip_reason): reported nights, under
    the local date that the point names. Phases are whole seconds, null where they are not given."""
    m = docs.select("subject_id", "batch", F.explode("doc.data.metrics").alias("m")).where("m.name = 'sleep_analysis'")
    p = m.select("subject_id", "batch", "m.units", F.posexplode("m.data").alias("place", "p"))
    phase = lambda f: F.floor(F.when(finite(F.col(f"p.{f}")), convert(F.col(f"p.{f}"), F.col("units"), F.lit("s"))) + 0.5).cast("long")
    at = push_date(F.col("p.date"))[0]
    out = p.select(
        "subject_id", "batch", F.to_date(F.left("p.date", F.lit(10))).alias("night"), F.lit("hae").alias("channel"), *[phase(f).alias(k) for k, f in PHASES.items()],
        push_date(F.col("p.sleepStart"))[0].alias("sleep_start"), push_date(F.col("p.sleepEnd"))[0].alias("sleep_end"), F.struct("batch", "place").alias("id"), at.alias("at"),
    )
    return out.withColumn("skip_reason", F.when(F.col("at").isNull(), "skipped_bad_point")).drop("at")


def native_sessions(docs: DataFrame) -> DataFrame:
    """(subject_id, batch, external_id, activity, source, start_ts, end_ts, tz_offset_min, indoor, duration_s,
    distance_m, energy_kj, elevation_up_m, stats, unmapped, skip_reason) of native batches. A session needs a
    uuid, an activity and an end after its start; without a duration it lasts from one to the other."""
    w = docs.select("subject_id", "batch", F.explode("doc.workouts").alias("w"))
    (start, offset), (end, _) = iso_date(F.col("w.start")), iso_date(F.col("w.end"))
    lasted = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(1e6)
    number = lambda f: F.when(finite(F.col(f"w.{f}")), F.col(f"w.{f}"))
    out = w.select(
        "subject_id", "batch", F.col("w.uuid").alias("external_id"), F.regexp_replace("w.activity", "^HKWorkoutActivityType", "").alias("activity"), F.coalesce(source_name(F.col("w.source")), F.lit("")).alias("source"),
        start.alias("start_ts"), end.alias("end_ts"), offset.alias("tz_offset_min"), F.col("w.indoor").alias("indoor"), number("duration_s").alias("duration_s"), number("distance_m").alias("distance_m"),
        number("energy_kj").alias("energy_kj"), number("elevation_up_m").alias("elevation_up_m"), F.create_map(F.lit("channel"), F.lit("native")).alias("stats"), F.lit(False).alias("unmapped"),
    ).withColumn("duration_s", F.coalesce("duration_s", lasted))
    fine = F.col("external_id").rlike(UUID) & F.col("activity").isNotNull() & (F.col("end_ts") > F.col("start_ts"))
    return out.withColumn("skip_reason", F.when(~F.coalesce(fine, F.lit(False)), "skipped_invalid"))


def native_minute_points(docs: DataFrame, types: DataFrame) -> DataFrame:
    """(subject_id, batch, place, type, minute_ts, value, skip_reason): whole minutes of cumulative types in their own
    unit."""
    m = docs.select("subject_id", "batch", F.posexplode("doc.minutes").alias("place", "m")).select("subject_id", "batch", "place", "m.*")
    # A row for each type of the contract.
    m = m.join(F.broadcast(types.select("type", "regime", F.col("unit").alias("to"), "opted_out")), "type", "left")
    ts = iso_date(F.col("minute"))[0]
    reason = (
        F.when(F.col("regime").isNull(), "unknown_metric").when(F.col("opted_out"), "opted_out").when(F.col("regime") != "cumulative", "not_a_minute_type").when(ts.isNull(), "bad_date")
        .when(F.col("to").isNotNull() & ~F.col("unit").eqNullSafe(F.col("to")), "unit_mismatch").when(~finite(F.col("value")), "bad_value")
    )
    return m.select("subject_id", "batch", "place", "type", F.date_trunc("minute", ts).alias("minute_ts"), "value", reason.alias("skip_reason"))


def native_minutes(docs: DataFrame, types: DataFrame) -> DataFrame:
    """(subject_id, type, minute_ts, value, skip_reason) of native batches; of a minute the last counts."""
    rows = native_minute_points(docs, types)
    last = Window.partitionBy("subject_id", "type", "minute_ts", "skip_reason").orderBy(F.col("batch").desc(), F.col("place").desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1 or skip_reason is not null").drop("__n", "batch", "place")


def counters(rows: DataFrame, by: str) -> DataFrame:
    """(by, counts): refused rows by reason, and accepted ones, as a map."""
    g = rows.groupBy(by, F.coalesce("skip_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    return g.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("counts"))
