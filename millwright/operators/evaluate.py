"""Evaluation of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What must agree for a loose match, and what else for a strict one.
RELATION = (["item", "head", "relation", "tail"], ["head_type", "tail_type"])
ENTITY = (["item", "name"], ["type"])


def tried(labels: DataFrame, predictions: DataFrame, of: tuple[list[str], list[str]]) -> DataFrame:
    """``labels`` with ``loose, strict``: predictions are tried by ``pos`` for each label until one matches with its types, too.

    Each loose match up to that one counts, so loose may exceed 1. Labels and predictions are not paired: they stand below each other, one shuffle by the loose key brings
    them together, and running counts tell how many predictions a label tries. So a key costs its labels and predictions, not their product. A null in a loose
    key matches nothing; null types are equal.
    """
    keys, types = of
    names = [*keys, *types]
    found = predictions.dropna(subset=keys).filter("pos is not null").select(*names, F.col("pos").cast("long").alias("_pos"))
    both = labels.select(*names, F.lit(None).cast("long").alias("_pos")).unionByName(found).repartition(*keys)
    upto = W.partitionBy(*keys).orderBy(F.col("_pos").asc_nulls_first()).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumns({"_upto": F.count("_pos").over(upto), "_all": F.count("_pos").over(W.partitionBy(*keys))})
    same = W.partitionBy(*keys, *types)
    # The first prediction with a label's types: how many it takes to get there, and how many stand at that place.
    counted = counted.withColumn("_first", F.min(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_upto"))).over(same))
    counted = counted.withColumn("_strict", F.count_if(F.col("_pos") == F.col("_first._pos")).over(same))
    tried_ = F.coalesce("_first._upto", "_all").alias("loose")
    return counted.filter("_pos is null").select(*names, tried_, F.col("_strict").alias("strict"))


def _metrics(found: DataFrame, kind: str) -> DataFrame:
    """``metric, correct, total``: of a kind's labels, two rows."""
    n = found.agg(F.count("*").alias("total"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loose", "strict")))
    pairs = F.array(*(F.struct(F.lit(f"{c}_{kind}").alias("metric"), F.col(c).alias("correct"), "total") for c in ("loose", "strict")))
    return n.select(F.explode(pairs).alias("m")).select("m.*")


def relation_matches(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """``total, loose, strict`` of relations."""
    found = tried(labels, predictions, RELATION)
    return found.agg(F.count("*").alias("total"), F.coalesce(F.sum("loose"), F.lit(0)).alias("loose"), F.coalesce(F.sum("strict"), F.lit(0)).alias("strict"))


def _bags(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """How often each item stands among labels and among predictions. One shuffle."""
    both = labels.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("p")).unionByName(predictions.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("p")))
    return both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("p").alias("p"))


def bag_overlap(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``correct, total, wrong`` of two bags: common occurrences, labelled ones, and predicted ones beyond them."""
    n = _bags(labels, predictions, keys)
    return n.agg(F.sum(F.least("l", "p")).alias("correct"), F.sum("l").alias("total"), F.sum(F.greatest(F.col("p") - F.col("l"), F.lit(0))).alias("wrong"))


def report(labels: dict[str, DataFrame], predictions: dict[str, DataFrame], norm_keys: list[str]) -> DataFrame:
    """``metric, correct, total, score`` of relations and entities, loose and strict, and of norms; a score over nothing is null."""
    norms = bag_overlap(labels["norms"], predictions["norms"], norm_keys).select(F.lit("normalisation").alias("metric"), F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("total", F.lit(0)).alias("total"))
    parts = [_metrics(tried(labels["relations"], predictions["relations"], RELATION), "relation"), _metrics(tried(labels["entities"], predictions["entities"], ENTITY), "entity"), norms]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.withColumn("score", F.col("correct").cast("double") / F.nullif("total", F.lit(0)))


def incorrect(labels: dict[str, DataFrame], predictions: dict[str, DataFrame], norm_keys: list[str]) -> DataFrame:
    """``item, kind, what``: labels that no prediction matches, loosely or strictly, and predicted norms beyond the labelled ones."""
    told = lambda keys, types: F.concat_ws("|", *(c for c in (*keys[1:], *types)))
    rows = []
    for kind, of in (("relation", RELATION), ("entity", ENTITY)):
        found = tried(labels[f"{kind}s" if kind == "relation" else "entities"], predictions[f"{kind}s" if kind == "relation" else "entities"], of)
        rows += [found.filter(F.col(c) == 0).select("item", F.lit(f"{c}_{kind}").alias("kind"), told(*of).alias("what")) for c in ("loose", "strict")]
    more = _bags(labels["norms"], predictions["norms"], norm_keys).filter("p > l")
    rows.append(more.select("item", F.lit("norm").alias("kind"), F.concat_ws("|", *norm_keys[1:]).alias("what")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
