"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import kept_table, scratch_path, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return kept_table(df, name)


def held(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small frames in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3; rows at 1 are held out from every fit."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


__all__ = ["fold", "held", "scratch_path", "shared_dir", "table", "written"]
