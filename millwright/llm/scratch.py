"""Intermediate tables in the folder that all executors share, and rows that a join may need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.sinks import new_path


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder if the session runs on this machine alone, else an error.

    What is written there goes when the application ends.
    """
    return new_path(spark)


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, written once: cuts the lineage and is not lost with an executor."""
    path = folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: ``likely`` marks the digests of keys in 2**BUCKET_BITS bitmaps of 2**15 bits, 8 MB in all.
BUCKET_BITS = 11


def likely(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of ``df`` that ``keys`` has a row for, and few others: what an inner join of large rows need not shuffle. ``keys`` is read beside the join, so it should be a written table.

    The bitmaps have one size whatever the number of keys, so they are broadcast; of more keys than a few times ten million more other rows pass."""
    digest = F.xxhash64(*on)
    bucket, at = (F.shiftrightunsigned(digest, 64 - BUCKET_BITS), F.shiftrightunsigned(digest, 64 - BUCKET_BITS - 15).bitwiseAND(F.lit((1 << 15) - 1)))
    marks = keys.select(bucket.alias("_bucket"), at.alias("_at")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = df.withColumns({"_bucket": bucket, "_at": at}).join(F.broadcast(marks), "_bucket")
    return known.filter(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1).select(df.columns)
