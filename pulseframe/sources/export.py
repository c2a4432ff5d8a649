"""Reader of XML export files, zipped or not: one scan by byte ranges, with what each range begins inside of."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timefns import push_date
from ..functions.units import convert, elevation_m, source_name
from ..shipping import ship
from ..store import kept_table, scratch_path

#: The attributes that are read, and the elements within which they are another element's.
ATTRIBUTES = "type sourceName unit value startDate endDate workoutActivityType duration durationUnit sum key".split()
KINDS = {"Record": "record", "Workout": "workout", "WorkoutStatistics": "statistic", "MetadataEntry": "metadata"}
CORRELATION, WORKOUT, WITHIN = "Correlation", "Workout", ("WorkoutActivity", "WorkoutRoute", "Record")
#: Metres of a distance's unit, kilometres else.
METRES = 1000
ATTRIBUTE = re.compile(r'([A-Za-z]+)\s*=\s*"([^"]*)"')
STATE = ["correlation", "session", "within", "sessions"]
FIELDS = ", ".join(["path string", "block long", "kind string", *[f"{s} long" for s in STATE], *[f"{a} string" for a in ATTRIBUTES]])


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (value, path, block), each value what stands from one < to the next, the elements of ``KINDS`` with how many
    correlations, workouts and other elements are open there and how many workouts began, all counted from the
    range's start. The last row of a range, of kind end, holds the counts at its end."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * len(STATE), *[pa.string()] * len(ATTRIBUTES)]
    at, now, rows = None, [0] * len(STATE), []

    def packed() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for text, path, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, block) != at:
                if at:
                    rows.append((*at, "end", *now, *[None] * len(ATTRIBUTES)))
                at, now = (path, block), [0] * len(STATE)
            name = re.match(r"/?[A-Za-z]*", text)[0]
            element, step = name.lstrip("/"), -1 if name[:1] == "/" else 0 if text.rstrip().endswith("/>") else 1
            if step >= 0 and element in KINDS:
                if element == WORKOUT:
                    now[3] += 1
                found = {k: html.unescape(v) for k, v in ATTRIBUTE.findall(text)}
                rows.append((*at, KINDS[element], *now, *[found.get(a) for a in ATTRIBUTES]))
            if element == CORRELATION:
                now[0] += step
            elif element == WORKOUT:
                now[1] += step
            elif element in WITHIN:
                now[2] += step
        if len(rows) >= 4096:
            yield packed()
            rows = []
    if at:
        rows.append((*at, "end", *now, *[None] * len(ATTRIBUTES)))
        yield packed()


def unzipped(spark: SparkSession, path: str, member: str = "export.xml") -> str:
    """A zip's first member whose name ends so, as a file in the shared folder. What is deflated is one stream, which one
    process must unpack: the driver's JVM copies it in small pieces."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(path), hadoop(f"{scratch_path(spark, 'unzipped')}/{member}")
    zipped = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while (entry := zipped.getNextEntry()) is not None:
            if entry.getName().endswith(member):
                out = target.getFileSystem(conf).create(target, True)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(zipped, out, 1 << 16, False)
                finally:
                    out.close()
                return target.toString()
    finally:
        zipped.close()
    raise ValueError(f"{path} holds no {member}")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of ``KINDS`` of an export with their attributes, ``correlation``, ``session`` and ``within``: how many
    correlations, workouts, and activities, routes and records are open around each, and ``sessions``: the number of the
    last workout that began.

    The file is read once, split at any <, which stands nowhere else in well-formed XML. Ranges count from their own
    start; what they begin inside of follows from the counts at the ends of those before, one row a range."""
    ship(spark)
    path = unzipped(spark, path) if path.endswith(".zip") else path
    tags = spark.read.option("lineSep", "<").text(path).select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    rows = kept_table(tags.mapInArrow(_elements, FIELDS), "elements")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("kind = 'end'").select("path", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__{s}") for s in STATE])
    out = rows.where("kind <> 'end'").join(F.broadcast(ends), ["path", "block"])  # a row for each range of the file
    return out.withColumns({s: F.col(s) + F.col(f"__{s}") for s in STATE}).drop(*[f"__{s}" for s in STATE])


def _records(rows: DataFrame, types: DataFrame | None) -> DataFrame:
    own = rows.where("kind = 'record' and correlation = 0 and session = 0")
    (a, off), (b, _) = push_date(F.col("startDate")), push_date(F.col("endDate"))
    out = own.select(
        "type", source_name(F.col("sourceName")).alias("source"), "unit", F.col("value").try_cast("double").alias("value"), F.col("value").alias("raw_value"),
        a.alias("start_ts"), b.alias("end_ts"), off.alias("tz_offset_min"),
    )
    reason = F.when(F.col("start_ts").isNull(), "bad_date").when(F.abs("tz_offset_min") > 900, "bad_offset").when(F.col("value").isNull() & F.col("unit").isNotNull(), "bad_value")
    if types is None:
        return out.withColumn("skip_reason", reason)
    # A row for each type of the contract.
    out = out.join(F.broadcast(types.select("type", F.col("unit").alias("__to"), F.col("kind").alias("__kind"))), "type", "left")
    quantity = F.col("__kind") == "quantity"
    value = F.when(quantity, convert(F.col("value"), F.col("unit"), F.col("__to")))
    reason = reason.when(F.col("__kind").isNull(), "unknown_type").when(quantity & value.isNull(), "unit_mismatch")
    return out.withColumn("skip_reason", reason).withColumn("value", value).drop("__to", "__kind")


def _workouts(rows: DataFrame) -> DataFrame:
    """Workouts with their own statistics and metadata, not those of activities, routes and records within."""
    at = ["path", "sessions"]
    own = rows.where("session = 1 and within = 0")
    value, unit = F.col("sum").try_cast("double"), F.col("unit")
    distance = F.coalesce(convert(value, unit, F.lit("m")), value * METRES)
    energy = F.coalesce(convert(value, unit, F.lit("kJ")), value)
    stats = own.where("kind = 'statistic'").groupBy(*at).agg(
        F.sum(F.when(F.contains("type", F.lit("Distance")), distance)).alias("distance_m"), F.sum(F.when(F.col("type") == "HKQuantityTypeIdentifierActiveEnergyBurned", energy)).alias("energy_kj"),
    )

    def entry(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    meta = own.where("kind = 'metadata'").groupBy(*at).agg(entry("HKIndoorWorkout").alias("__in"), entry("HKElevationAscended").alias("__up"))
    w = rows.where("kind = 'workout'").join(stats, at, "left").join(meta, at, "left")
    (start, offset), end = push_date(F.col("startDate")), push_date(F.col("endDate"))[0]
    given = F.col("duration").try_cast("double")
    lasted = F.when(given >= 0, F.coalesce(convert(given, F.coalesce("durationUnit", F.lit("min")), F.lit("s")), given))
    out = w.select(
        F.regexp_replace("workoutActivityType", "^HKWorkoutActivityType", "").alias("activity"), source_name(F.col("sourceName")).alias("source"), start.alias("start_ts"), end.alias("end_ts"), offset.alias("tz_offset_min"),
        F.coalesce(lasted, (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)).alias("duration_s"), "distance_m", "energy_kj", (F.col("__in") == "1").alias("indoor"), elevation_m(F.col("__up")).alias("elevation_up_m"),
    )
    return out.where("end_ts > start_ts").distinct()


def read_export(spark: SparkSession, path: str, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, workouts) of an XML export or of a zip that holds one. Records nested in a correlation or workout are left out,
    as are workouts that come again or don't end after their start.

    types: (type, unit, kind) of the contract; with it records of unknown types and quantities in units that
    don't convert are refused, and values are in the types' units."""
    rows = elements(spark, path)
    return _records(rows, types), _workouts(rows)
