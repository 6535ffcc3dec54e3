"""Summaries of triples, types and lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOTS = ("Object", "Activity", "Process", "Property", "State")


def type_counts(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("head_type", "tail_type")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def typing_report(triples: DataFrame) -> DataFrame:
    """Of each root type, how much got a finer one: the root's own share counts in both terms; null where there is none."""
    counts = type_counts(triples)
    roots = triples.sparkSession.createDataFrame([(r,) for r in ROOTS], "root string")
    root_of = F.substring_index(F.col("type"), "/", 1)
    sums = counts.groupBy(F.initcap(root_of).alias("root")).agg(F.sum("n").alias("typed"), F.sum(F.when(F.col("type") == root_of, F.col("n")).otherwise(0)).alias("plain"))
    return roots.join(sums, "root", "left").select("root", F.bround(100.0 * F.col("typed") / F.nullif(F.col("typed") + F.col("plain"), F.lit(0)), 0).alias("percent"))


def per_record(records: DataFrame, triples: DataFrame) -> DataFrame:
    """``record_id, c``: triples of each record, also of those without any."""
    counts = triples.groupBy("record_id").agg(F.count("*").alias("c"))
    return records.join(counts, "record_id", "left").select("record_id", F.coalesce("c", F.lit(0)).alias("c"))


def non_empty(df: DataFrame, what: str = "input") -> DataFrame:
    """The rows, or an error if there are none."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def coverage(records: DataFrame) -> DataFrame:
    """``texts_no_ie, texts_entity_only``: records with neither entities nor relations, and with entities alone. ``records``: arrays ``entities, relations``."""
    entities, relations = (F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("entities", "relations"))
    return records.agg(F.count_if(~relations & ~entities).alias("texts_no_ie"), F.count_if(~relations & entities).alias("texts_entity_only"), F.count("*").alias("n"))


def enriched(normalised: DataFrame) -> DataFrame:
    """``enriched_triples``: those of which an end has a finer type than its root, before they are validated again."""
    finer = F.col("head_type").contains("/") | F.col("tail_type").contains("/")
    return normalised.agg(F.count_if(finer).alias("enriched_triples"), F.count("*").alias("n"))


def _tops(counts: DataFrame, kind: str, top: int | None) -> DataFrame:
    """``kind, item, n``; the most frequent ones only, if a number is given, ties by item."""
    rows = counts.select(F.lit(kind).alias("kind"), "item", "n")
    return rows if top is None else rows.orderBy(F.desc("n"), "item").limit(top)


def triple_details(triples: DataFrame, top: int | None = None) -> DataFrame:
    """``kind, item, n``: counts of entity types at both ends, of relations and of patterns, and the number of distinct mentions (a name with its type).

    All counts are sums over distinct triples, from one shuffle of the occurrences.
    """
    kinds = triples.groupBy("head", "head_type", "relation", "tail", "tail_type").agg(F.count("*").alias("n"))
    types = kinds.select(F.explode(F.array("head_type", "tail_type")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))
    relations = kinds.groupBy(F.col("relation").alias("item")).agg(F.sum("n").alias("n"))
    patterns = kinds.groupBy(F.concat_ws("|", "head_type", "relation", "tail_type").alias("item")).agg(F.sum("n").alias("n"))
    ends = F.array(*(F.struct(F.col(s).alias("name"), F.col(f"{s}_type").alias("type")) for s in ("head", "tail")))
    mentions = kinds.select(F.explode(ends).alias("e")).distinct().agg(F.count("*").alias("n")).select(F.lit("unique_mentions").alias("kind"), F.lit("").alias("item"), "n")
    return _tops(types, "entity_type", top).union(_tops(relations, "relation", top)).union(_tops(patterns, "pattern", top)).union(mentions)


def triple_analysis(records: DataFrame, triples: DataFrame) -> DataFrame:
    kinds = triples.groupBy("head", "head_type", "relation", "tail", "tail_type").agg(F.count("*").alias("k")).agg(F.sum("k").alias("total"), F.count("*").alias("n_unique"))
    return kinds.crossJoin(per_record(records, triples).agg(F.avg("c").alias("mean"), F.min("c").alias("low"), F.max("c").alias("high")))


def item_analysis(docs: DataFrame, items: str) -> DataFrame:
    """Total and distinct items of lists, and their mean, least and greatest number per document, empty ones included."""
    size = F.greatest(F.size(items), F.lit(0))
    sizes = docs.agg(F.sum(size).alias("total"), F.avg(size).alias("mean"), F.min(size).alias("low"), F.max(size).alias("high"))
    return sizes.crossJoin(docs.select(F.explode(items).alias("_i")).agg(F.countDistinct("_i").alias("n_unique")))


def density(stats: DataFrame, value: str, weight: str, points: int = 50) -> DataFrame:
    """``x, density``: a Gaussian kernel estimate over ``points`` places from the least to the greatest value, as wide as Scott's rule says.

    Each distinct value meets each of the fixed places once, and partial sums are all that is moved.
    """
    v, w = F.col(value), F.col(weight)
    # Values are taken from the least one on: else the difference of two large sums would stand for a small spread.
    ends = stats.agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    from_low = v - F.col("_low")
    one = stats.crossJoin(F.broadcast(ends)).groupBy("_low", "_high").agg(F.sum(w).alias("_n"), F.sum(w * from_low).alias("_s"), F.sum(w * from_low * from_low).alias("_q"))
    n = F.col("_n")
    spread = F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / n) / (n - 1)) * F.pow(n.cast("double"), F.lit(-0.2))
    places = one.withColumn("_h", spread).withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("_low") + (F.col("_high") - F.col("_low")) * k / (points - 1))))
    near = stats.crossJoin(F.broadcast(places.select("x", "_h", "_n")))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - v) / F.col("_h"), F.lit(2.0))) / (F.col("_h") * (2 * math.pi) ** 0.5)
    return near.groupBy("x").agg((F.sum(w * kernel) / F.first("_n")).alias("density"))


def top_n(df: DataFrame, by: str, n: int) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def histogram(df: DataFrame, value: str, weight: str, low: float, high: float, buckets: int) -> DataFrame:
    """Weighted counts of equal buckets; values outside the range fall into the outer ones."""
    bucket = F.greatest(F.lit(1), F.least(F.lit(buckets), F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets).cast("int"))))
    return df.groupBy(bucket.alias("bucket")).agg(F.sum(weight).alias("n"))
