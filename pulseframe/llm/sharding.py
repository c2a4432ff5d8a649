"""Contiguous balanced shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import written

#: Shards, and bytes that a row takes beside its text.
SHARDS, OVERHEAD = 40, 16
NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the sorted rows of one partition the bytes and rows that stand before each in it."""
    bytes_before = rows_before = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        sums = bytes_before + np.cumsum(sizes)
        at = rows_before + np.arange(len(sizes))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sums - sizes, pa.int64()), pa.array(at, pa.int64())],
            names=[*batch.schema.names, "__before", "__at"],
        )
        if len(sizes):
            bytes_before, rows_before = int(sums[-1]), int(at[-1]) + 1


def _offsets(rows: DataFrame) -> DataFrame:
    """(__part, __bytes, __rows): what stands before each partition. One row for each partition of the
    sorted table, whatever its rows, so the window is small."""
    totals = rows.groupBy("__part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("bytes", "rows")]
    return totals.select("__part", *sums)


def shard_of(before: Column, size: Column, total: int, shards: int) -> Column:
    """The shard whose stretch of the corpus holds the middle of a row that begins after ``before`` bytes."""
    wide = "decimal(38,0)"
    middle = (before.cast(wide) * 2 + size.cast(wide)) * F.lit(shards).cast(wide)
    return F.call_function("div", middle, F.lit(2 * total).cast(wide)).cast("int")


def sharded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, columns: list[str] | None = None
) -> DataFrame:
    """docs with size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) beside their columns.

    Rows stand in the order of their ids, nulls first, of equal ids by the text's size, checksum and hash of
    all columns. The corpus is cut at equal numbers of bytes (UTF-8 bytes of a text, and 16 a row), each cut
    at the row's border nearest to it: a shard is a contiguous stretch of ids and misses its target by one
    row's size at most. slot counts from 0 within a shard. A row larger than a target leaves the shards that
    it covers empty, as do fewer rows than shards. Equal texts aren't kept together: a group of copies may be
    larger than a shard. columns: those to keep, by default all; others, such as the texts, are not dealt.

    The rows are dealt by range and sorted once; a task adds up what stands before each row in its
    partition while it writes them. The totals of the partitions give each partition's offset, and so the
    prefix sum over the whole corpus: no window runs over rows. Null and empty texts have no bytes; rows
    that are equal in all columns are told apart by their places only. Columns named like the new ones are
    replaced. No documents: no rows."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in NEW]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept], (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("__tie"),
    )
    order = [F.col(id_col).asc_nulls_first(), "size", "text_crc32", "__tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = written(rows.mapInArrow(_running, f"{fields}, __before long, __at long"), "sharded")
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = rows.join(F.broadcast(_offsets(rows)), "__part")  # a row for each partition
    placed = placed.withColumn("__at", F.col("__at") + F.col("__rows"))
    placed = placed.withColumn("shard", shard_of(F.col("__before") + F.col("__bytes"), F.col("size"), total, shards))
    firsts = placed.groupBy("shard").agg(F.min("__at").alias("__first"))
    out = placed.join(F.broadcast(firsts), "shard")  # a row for each shard
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__at") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """The shards as Parquet folders shard=k under path, rows in the order of their slots."""
    out = sharded(docs, id_col, text_col, shards)
    # Partitions keep to the corpus' order, so a shard's files follow each other and none is one task's alone.
    out = out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return sharded(docs.select(id_col, text_col), id_col, text_col, columns=[id_col])
