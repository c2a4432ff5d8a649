"""Ingestion of a landing folder as a stream: each micro-batch is merged by key, with a ledger and the
dirty ranges of the rollup. A batch that comes again changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import dirty_ranges, first_of_batch, not_in_history
from ..store import kept_table, utc_day

SAMPLE = "uuid string, subject_id long, type string, source_id int, start_ts timestamp, end_ts timestamp, value double, category_value int"

LEDGER = "received long, valid long, inserted long, checksum string, status string, batch long"
#: States of a batch whose rows are in the store.
DONE = ("normalized", "rollups_ready")


@dataclass
class Spool:
    """Folders of a store: observations by subject's bucket, ledger and dirty ranges, append-only Parquet.

    A batch's files are written under its number and replaced as a whole when it is run again, so a
    retry after a lost executor or driver gives the same store. The history that a batch is compared with
    is read in the buckets of its subjects only."""

    spark: SparkSession
    root: str
    category_types: tuple[str, ...] = ("error",)
    buckets: int = 64

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{self.root}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @property
    def observations(self) -> DataFrame:
        return self.table("observations", f"{SAMPLE}, batch long, bucket int")

    @property
    def ledger(self) -> DataFrame:
        return self.table("ledger", LEDGER)

    def _put(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.drop("batch").write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def _bucket(self):
        return F.pmod(F.xxhash64("subject_id"), F.lit(self.buckets)).cast("int")

    def seen(self, checksum: str, batch: int) -> bool:
        """Whether another batch with this content was normalised."""
        return bool(self.ledger.where((F.col("checksum") == checksum) & (F.col("batch") != batch) & F.col("status").isin(*DONE)).limit(1).count())

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """foreachBatch: the first row of each uuid that the history knows neither by uuid nor as an equal row
        without one. The ledger gets the batch's content as a checksum and its state: normalized, duplicate
        where the same content came before, or empty; ``rollups_ready`` follows once its ranges are drained."""
        keys = ["subject_id", "type", "source_id", "start_ts", "end_ts", "value", "category_value"]
        rows = kept_table(rows.drop("batch", "bucket"), "batch")
        # Sums, in which a row that comes twice counts twice.
        content = [F.sum(F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(38,0)")) for seed in (0, 1)]
        received, a, b = rows.agg(F.count("*"), *content).first()
        checksum = f"{received}:{a}:{b}"
        if received and self.seen(checksum, batch):
            rows, state = rows.limit(0), "duplicate"
        else:
            state = "normalized" if received else "empty"
        ok = rows.where("uuid is not null and start_ts is not null and (value is not null or category_value is not null)").withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in ok.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        history = self.observations.where((F.col("batch") != batch) & F.col("bucket").isin(*touched))
        fresh = first_of_batch(ok, ["subject_id", "uuid"], [F.col("start_ts"), F.col("value")])
        fresh = not_in_history(not_in_history(fresh, history.where("uuid is not null"), ["bucket", "subject_id", "uuid"]), history.where("uuid is null"), ["bucket", *keys])
        self._put(fresh, "observations", batch, "bucket")
        new = self.observations.where(F.col("batch") == batch).drop("bucket")
        self._put(dirty_ranges(new, list(self.category_types)), "dirty", batch)
        counts = new.agg(F.count("*").alias("inserted")).crossJoin(ok.agg(F.count("*").alias("valid")))
        counts = counts.select(F.lit(received).cast("long").alias("received"), "valid", "inserted", F.lit(checksum).alias("checksum"), F.lit(state).alias("status"))
        self._put(counts, "ledger", batch)

    def drained(self, batch: int) -> None:
        """Marks a batch whose ranges the rollup has taken in."""
        row = kept_table(self.ledger.where(F.col("batch") == batch).withColumn("status", F.lit("rollups_ready")), "ledger")
        self._put(row, "ledger", batch)

    def run(self, landing: str, checkpoint: str):
        """Takes all files that have landed, each once; returns when done."""
        stream = self.spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 100).json(landing)
        return stream.writeStream.foreachBatch(lambda df, n: self.ingest(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_counters(spark: SparkSession, store: str, events: DataFrame, batch: int) -> None:
    """foreachBatch: counters per minute of events, each event counted once however late it comes.

    A batch's events that no earlier batch held are added under its number, by the UTC day of their
    minute, as partial counts; a batch that is run again replaces its own. ``minutes`` sums them up."""
    day = utc_day("ts")
    rows = first_of_batch(events.withColumn("utc_day", day), ["utc_day", "event_id"], [F.col("ts")])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/seen")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        seen = spark.read.schema("event_id long, batch long, utc_day date").parquet(f"{store}/seen").where(F.col("batch") != batch)
        rows = rows.join(seen.select("utc_day", "event_id"), ["utc_day", "event_id"], "left_anti")
    rows = kept_table(rows, "events")
    rows.select("event_id", "utc_day").write.mode("overwrite").partitionBy("utc_day").parquet(f"{store}/seen/batch={batch}")
    g = rows.groupBy("utc_day", "subject_id", "type", F.date_trunc("minute", "ts").alias("minute_ts")).agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    g.write.mode("overwrite").partitionBy("utc_day").parquet(f"{store}/parts/batch={batch}")


def minutes(spark: SparkSession, store: str) -> DataFrame:
    """(subject_id, type, minute_ts, value, n) over all batches."""
    parts = spark.read.schema("subject_id long, type string, minute_ts timestamp, value double, n long, batch long, utc_day date").parquet(f"{store}/parts")
    return parts.groupBy("utc_day", "subject_id", "type", "minute_ts").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).drop("utc_day")
