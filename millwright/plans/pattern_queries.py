"""The competency questions again, asked by patterns that are data, over one saved graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import competency, graph, patterns, score
from millwright.plans import graph_queries as fixed
from millwright.plans.registry import oracle, query
from millwright.sources.sinks import once

COMPONENT, PART_OF = "gear", "Brand#13"
ASKED = patterns.questions(COMPONENT, PART_OF)


def saved_graph(spark: SparkSession, d: str) -> graph.Graph:
    """The graph of the given tables, built and saved once in an application, however many questions are asked."""
    return graph.load(spark, once(spark, ("graph", d), lambda path: graph.save(fixed.the_graph(spark, d), path), "record_edges/_SUCCESS"))


def _found(spark: SparkSession, d: str, question: str) -> DataFrame:
    g = saved_graph(spark, d)
    return patterns.with_records(patterns.match(g, ASKED[question]), g, "r").withColumn("year", F.year("start_date").cast("long"))


def _costs(n: str = "totalCost"):
    return F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias(n)


@query("s07_cq1_pattern", oracle("cq1_j08_p16_undesirable_states"))
def cq1(spark, d):
    return _found(spark, d, "undesirable states").groupBy(F.col("floc").alias("asset"), F.col("n").alias("state"), F.col("m").alias("component")).agg(F.count("*").alias("count")).filter(F.col("count") > 2)


@query("s07_cq2_pattern", oracle("cq2_failure_shares"))
def cq2(spark, d):
    counts = _found(spark, d, "failure shares").groupBy(F.col("floc").alias("system"), F.col("m").alias("component"), F.col("n").alias("state")).agg(F.count("*").alias("stateCount"))
    return score.shares(counts, ["system", "component"], "stateCount")


@query("s07_cq3_pattern", oracle("cq3_j11_mtbf"))
def cq3(spark, d):
    days = F.datediff(F.max("start_date"), F.min("start_date")).cast("long").alias("days")
    found = _found(spark, d, "time between failures").groupBy(F.col("floc").alias("Asset")).agg(F.count("*").alias("Events"), F.count("start_date").alias("k"), days)
    return found.filter("k > 1").withColumn("MTBF", F.expr("days div (k - 1)")).filter("MTBF > 0").select("Asset", "MTBF", "Events")


@query("s07_cq4_pattern", oracle("cq4_p14_yearly_costs"))
def cq4(spark, d):
    found = _found(spark, d, "yearly activity costs").groupBy("year", F.col("floc").alias("asset"), competency.activity_type(F.col("n_label")).alias("activityType"))
    return found.agg(F.count("*").alias("events"), _costs())


@query("s07_cq5_pattern", oracle("cq5_j09_replacement_costs"))
def cq5(spark, d):
    found = _found(spark, d, "replacement costs")
    first = spark.read.parquet(f"{d}/nation.parquet").agg(F.min("n_name").alias("floc"))
    found = found.join(first, "floc", "left_semi").filter(F.col("year").between(1993, 1997))
    return found.groupBy("year").agg(F.count("*").alias("eventCount"), F.array_sort(F.collect_set("m")).alias("components"), _costs())


@query("s07_cq6_pattern", oracle("cq6_activity_costs"))
def cq6(spark, d):
    return _found(spark, d, "activity costs").groupBy("year", F.col("floc").alias("asset"), F.col("n_label").alias("activity")).agg(F.count("*").alias("recordCount"), _costs())


@query("s07_cq7_pattern", oracle("cq7_j10_leak_costs"))
def cq7(spark, d):
    found = _found(spark, d, "leak costs").groupBy(F.col("floc").alias("system"), F.col("a").alias("component"), F.col("n").alias("event"), F.col("m").alias("substance"))
    return found.agg(F.count("*").alias("count"), _costs()).filter("totalCost > 5000")


@query("s07_cq8_pattern", oracle("cq8_g07_p18_parts"))
def cq8(spark, d):
    g = saved_graph(spark, d)
    found = patterns.match(g, ASKED["parts"])
    e = graph.edges(g).filter("relation = 'HAS_PART' and frequency > 1").select(F.col("head").alias("n"), F.col("head_type").alias("n_label"), F.col("tail").alias("m"), F.col("tail_type").alias("m_label"), "frequency")
    return found.join(e, ["n", "n_label", "m", "m_label"]).select(F.col("n").alias("component"), F.col("m").alias("part"), F.col("frequency").alias("count"))
