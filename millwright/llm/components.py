"""Connected components by contraction, all in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.scratch import saved

#: Contraction ends when no link is left, after a number of rounds near the logarithm of the longest chain; more than this many are a fault.
MOST_ROUNDS = 200
#: Times that a round replaces labels by their labels' labels.
JUMPS = 2


def components(links: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``links`` (a, b: of one type that has an order) to (id, component): the smallest id that each linked id reaches.

    Each round labels an id with the smallest of itself and its neighbours, follows labels to their labels, and replaces the ends of all links by their labels: links within
    a label vanish and equal ones become one, so that later rounds have far fewer. Rounds are written to the shared folder. Without links there are no rows; links
    of an id with itself and links to null are ignored; links that are left after ``most_rounds`` rounds raise.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = saved(links.filter("a <> b").select(*ends("a", "b")).distinct())
    labels = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        near = saved(both.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("label")))
        for _ in range(JUMPS):
            near = near.join(near.select(F.col("id").alias("label"), F.col("label").alias("next")), "label").select("id", F.col("next").alias("label"))
        near = saved(near)
        one, two = (near.select(F.col("id").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b"))
        edges = saved(edges.join(one, "a").join(two, "b").filter("to_a <> to_b").select(*ends("to_a", "to_b")).distinct())
        if labels is None:
            labels = near
        else:
            later = near.select(F.col("id").alias("label"), F.col("label").alias("next"))
            labels = labels.join(later, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    else:
        raise RuntimeError(f"components: {edges.count()} links still change labels after {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels.select("id", F.col("label").alias("component"))
