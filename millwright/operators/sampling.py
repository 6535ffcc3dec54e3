"""Samples, shuffles, splits and numbers that are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.sources.sinks import stage


def permuted(key: Column) -> Column:
    """A fixed permutation of 32-bit keys, by a multiplicative hash."""
    return (key * F.lit(2654435761)) % F.lit(4294967296)


def exact_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer). A top-k per partition, merged: no global sort."""
    return df.orderBy(permuted(F.col(key)), F.col(key)).limit(n)


def numbered(df: DataFrame, order: list[str], first: int) -> DataFrame:
    """``df`` with ``id``: first, first + 1, ... in an order. Each partition of a range sort numbers its rows, and the sizes of those before it are added: one row for each partition
    reaches the driver. Rows are written before they are numbered, so a lost executor cannot change a number."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_at")))
    starts, at = [], first
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        starts.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``, from 1 on, in an order that looks random: that of the seeded hashes of a key, equal ones by the key."""
    mixed = df.withColumn("_h", permuted(F.pmod(F.col(key).cast("long") + F.lit(seed), F.lit(1 << 31))))
    return numbered(mixed, ["_h", key], 1).drop("_h").withColumnRenamed("id", "place").orderBy("place")


def split_exact(df: DataFrame, key: str, share: float) -> DataFrame:
    """``part``: val for exactly ceil(share n) rows, train for the rest.

    The cut is found among bucket counts and then within one bucket only, so no task sorts all rows.
    """
    marked = df.withColumn("_h", permuted(F.col(key)))
    n = df.count()
    wanted = -int(-share * n // 1)
    buckets = sorted(marked.groupBy(F.expr("_h div 1048576").alias("b")).count().collect())
    cut, before = -1, 0
    for b, count in buckets:
        cut = b
        if before + count >= wanted:
            break
        before += count
    edge = marked.filter(F.expr("_h div 1048576") == cut).orderBy("_h", key).limit(max(0, wanted - before)).agg(F.max(F.struct("_h", key)).alias("m")).first().m
    bucket = F.expr("_h div 1048576")
    inside = (F.struct("_h", key) <= F.struct(F.lit(edge[0]).cast("long").alias("_h"), F.lit(edge[1]).alias(key))) if edge else F.lit(False)
    val = (bucket < cut) | ((bucket == cut) & inside)
    return marked.withColumn("part", F.when(val, "val").otherwise("train")).drop("_h")


def skewed(u: Column, low: float, high: float) -> Column:
    """A whole number between the bounds with a triangular density whose mode is at 5 %, from a uniform one."""
    r, mode = high - low, 0.05
    return F.when(u < mode, low + F.sqrt(u * mode) * r).otherwise(high - F.sqrt((1 - u) * (1 - mode)) * r).cast("int")


def uniform(key: Column, k: int, seed: int) -> Column:
    """The k-th number of a key between 0 and 1, by a multiplicative hash: the same wherever and however often it is computed."""
    return ((F.pmod(key + F.lit(k * 7919 + seed), F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(1 << 32)).cast("double") / F.lit(float(1 << 32))


def dummy_values(key: str, seed: int) -> dict[str, Column]:
    """A date, a cost and a time that look random, from a row's key."""
    u = lambda k: uniform(F.col(key).cast("long"), k, seed)
    whole = lambda k, low, n: (F.floor(u(k) * n) + low).cast("int")
    return {"start_date": F.make_date(whole(0, 2000, 21), whole(1, 1, 12), whole(2, 1, 28)), "cost": skewed(u(3), 0, 50000).cast("double"), "time": skewed(u(4), 0, 84).cast("double")}


def dummy_columns(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with those of the three columns that it lacks."""
    return df.withColumns({name: value for name, value in dummy_values(key, seed).items() if name not in df.columns})
