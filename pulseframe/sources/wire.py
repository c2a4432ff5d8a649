"""Readers of wire payloads and export files, with explicit schemas and reasons for refused rows."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import iso_date, quantise
from ..shipping import ship
from .normalise import UUID

POINT = "date string, qty double, Min double, Avg double, Max double, systolic double, diastolic double, asleep double, core double, deep double, rem double, awake double, inBed double, sleepStart string, sleepEnd string, source string"
QTY = "struct<qty:double,units:string>"
SERIES = "array<struct<date:string,qty:double,units:string,source:string>>"
QUANTITIES = "distance activeEnergyBurned totalEnergy elevationUp flightsClimbed stepCadence temperature humidity intensity".split()
ROUTE = "array<struct<timestamp:string,latitude:double,longitude:double,altitude:double,speed:double,course:double,horizontalAccuracy:double>>"
WORKOUT = ", ".join([
    "id string, name string, start string, end string, duration double, isIndoor boolean, location string", *[f"{q} {QTY}" for q in QUANTITIES],
    *[f"{s} {SERIES}" for s in ("activeEnergy", "basalEnergy", "stepCount", "walkingAndRunningDistance")], f"route {ROUTE}",
])
PUSH = f"data struct<metrics:array<struct<name:string,units:string,data:array<struct<{POINT.replace(' ', ':').replace(',:', ',')}>>>>,workouts:array<struct<{WORKOUT.replace(', ', ',').replace(' ', ':')}>>>"
NATIVE = "format string, app_version string, exported_at string, samples array<struct<uuid:string,type:string,start:string,end:string,value:double,unit:string,category:int,source:string>>, minutes array<struct<type:string,minute:string,value:double,unit:string>>, workouts array<struct<uuid:string,activity:string,start:string,end:string,duration_s:double,distance_m:double,energy_kj:double,elevation_up_m:double,indoor:boolean,source:string>>"
#: Bytes that a body may have when it is unpacked; larger ones are refused.
MOST_BYTES = 256 << 20


def _unzipped(data: bytes, most: int) -> tuple[bytes, str | None]:
    """The content of all gzip members of data, which zeros may follow."""
    parts, size = [], 0
    while data:
        try:
            unpack = zlib.decompressobj(wbits=31)
            parts.append(unpack.decompress(data, most + 1 - size))
        except zlib.error:
            return b"", "gunzip_failed"
        size += len(parts[-1])
        if size > most:
            return b"", "too_large"
        if not unpack.eof:
            return b"", "gunzip_failed"
        data = unpack.unused_data.lstrip(b"\0")
    return b"".join(parts), None


def _body(data: bytes, most: int) -> tuple[str | None, str | None]:
    error = "too_large" if len(data) > most else None
    if data[:2] == b"\x1f\x8b":
        data, error = _unzipped(data, most)
    if error:
        return None, error
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "not_text"


def unpacked_files(files: DataFrame, most: int = MOST_BYTES, kept: tuple[str, ...] = ()) -> DataFrame:
    """(path, sha256, body, error) of files (path, content), and the columns ``kept`` as they are; see ``read_batches``."""
    ship(files.sparkSession)

    def read(batches):
        for batch in batches:
            for i, (name, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = content.as_py()
                row = (name, hashlib.sha256(data).hexdigest(), *_body(data, most))
                rest = [batch.column(k).slice(i, 1) for k in range(2, 2 + len(kept))]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.string()) for x in row], *rest], names=["path", "sha256", "body", "error", *kept])

    given = files.select("path", "content", *kept)
    schema = ", ".join(["path string, sha256 string, body string, error string", *[f"{n} {t}" for n, t in given.dtypes[2:]]])
    return given.mapInArrow(read, schema)


def read_batches(spark: SparkSession, path: str, ledger: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(path, sha256, body, error): one row for each spooled JSON body, packed by gzip, in one member or several, or not. Each
    file is read once; the checksum is that of the file as it lies there.

    error: gunzip_failed, too_large or not_text, and no body. ledger: (path, sha256) as received; a missing
    file or another checksum fails the batch."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = unpacked_files(files, most)
    if ledger is None:
        return out
    out = out.join(ledger.select("path", F.col("sha256").alias("__want")), "path", "full")
    error = F.when(F.col("sha256").isNull(), "raw_file_missing").when(~F.col("sha256").eqNullSafe(F.col("__want")), "sha256_mismatch")
    return out.withColumn("error", F.coalesce(error, "error")).drop("__want")


def parsed(batches: DataFrame, schema: str, fits: Column) -> DataFrame:
    """batches with ``doc`` in place of their body; json_invalid or shape_invalid where it is not such a
    document. Each body is parsed once: what is read of it passes an explode of one row, into which neither the filters nor
    the columns of readers copy the parsing."""
    read = F.struct(F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("doc"), F.try_parse_json("body").isNull().alias("bad"))
    out = batches.withColumn("__read", F.explode(F.array(read))).drop("body").withColumn("doc", F.col("__read.doc"))
    error = F.coalesce("error", F.when(F.col("__read.bad"), "json_invalid").when(~F.coalesce(fits, F.lit(False)), "shape_invalid"))
    return out.withColumn("error", error).drop("__read")


def push_documents(batches: DataFrame) -> DataFrame:
    """The batches that hold a document of the push format."""
    return parsed(batches, PUSH, F.col("doc.data").isNotNull()).where("error is null")


def native_documents(batches: DataFrame) -> DataFrame:
    """The batches that hold a document of the native format."""
    return parsed(batches, NATIVE, F.col("doc.format").endswith("native/1")).where("error is null")


def native_samples(batches: DataFrame, units: DataFrame, categories: DataFrame, minute_types: list[str]) -> DataFrame:
    """Samples of native batches (subject_id, batch, body, error) with a skip_reason: bad_uuid, bad_date,
    minute_type, unknown_type, unit_mismatch, bad_category, bad_value."""
    docs = native_documents(batches)
    s = docs.select("subject_id", "batch", F.posexplode("doc.samples").alias("idx", "s")).select("subject_id", "batch", "idx", "s.*")
    (a, off), (b, _) = iso_date(F.col("start")), iso_date(F.col("end"))
    s = s.join(units.select("type", F.col("unit").alias("__unit"), "kind"), "type", "left").join(categories.select("type", F.col("category").alias("category"), F.lit(True).alias("__known")), ["type", "category"], "left")
    cat = F.col("kind") == "category"
    reason = (
        F.when(~F.coalesce(F.col("uuid").rlike(UUID), F.lit(False)), "bad_uuid").when(a.isNull() | (F.col("end").isNotNull() & b.isNull()), "bad_date").when(F.col("type").isin(*minute_types), "minute_type")
        .when(F.col("kind").isNull(), "unknown_type").when(~cat & ~F.col("unit").eqNullSafe(F.col("__unit")), "unit_mismatch").when(cat & F.col("__known").isNull(), "bad_category")
        .when(~cat & (F.col("value").isNull() | F.isnan("value")), "bad_value")
    )
    return s.withColumn("start_ts", a).withColumn("end_ts", b).withColumn("tz_offset_min", off).withColumn("value_key", quantise(F.col("value"), 1000)).withColumn("skip_reason", reason).drop("__unit", "__known", "start", "end")


def write_rows(rows: DataFrame, path: str, *partitions: str) -> None:
    """Bulk sink: rows appended by partition, dealt so that a partition gets few files. Spark's committer
    shows a job's files all at once when it ends."""
    (rows.hint("rebalance", *partitions) if partitions else rows).write.mode("append").partitionBy(*partitions).parquet(path)
