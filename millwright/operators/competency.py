"""The competency questions over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.operators.graph import Graph, edges, mentions, motif, undirected_motif, with_records
from millwright.operators.score import shares

FAILED = "State/UndesirableState/FailedState"


def undesirable_states(g: Graph, above: int = 10) -> DataFrame:
    """Frequent states of components, by asset."""
    m = motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: n_label.contains("State") & m_label.contains("Object"))
    found = with_records(m, g).groupBy(F.col("floc").alias("asset"), F.col("n").alias("state"), F.col("m").alias("component")).agg(F.count("*").alias("count"))
    return found.filter(F.col("count") > above)


def failure_shares(g: Graph, component: str | None) -> DataFrame:
    """Frequency and share of failure states of a component (of each component, if none is named), by asset."""
    m = motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: (n_label == FAILED) & (F.lit(True) if component is None else m == component))
    found = with_records(m, g).groupBy(F.col("floc").alias("system"), F.col("m").alias("component"), F.col("n").alias("state")).agg(F.count("*").alias("stateCount"))
    return shares(found, ["system", "component"], "stateCount")


def time_between_failures(g: Graph, component: str) -> DataFrame:
    """Whole mean days between failures. Gaps between sorted dates add up to the last less the first date."""
    m = undirected_motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: (n_label == FAILED) & (m == component))
    found = with_records(m, g).groupBy(F.col("floc").alias("Asset"), "m").agg(F.count("*").alias("Events"), F.count("start_date").alias("k"), F.datediff(F.max("start_date"), F.min("start_date")).alias("days"))
    found = found.withColumn("MTBF", F.when(F.col("k") > 1, F.expr("cast(days as bigint) div (k - 1)")).otherwise(F.lit(0).cast("long")))
    return found.filter("MTBF > 0").select("Asset", F.abs("MTBF").alias("MTBF"), "Events")


def activity_type(label):
    """The part between ``Activity`` and the next slash: Maintenance or Supporting."""
    return F.split(F.substring(F.replace(label, F.lit("Activity"), F.lit("")), F.lit(2), F.length(label)), "/")[0]


def yearly_activity_costs(g: Graph) -> DataFrame:
    """Costs of records by year, asset and kind of activity; a record's cost counts once for each activity it mentions."""
    of = mentions(g, F.col("label").startswith("Activity/MaintenanceActivity/") | F.col("label").startswith("Activity/SupportingActivity/"))
    df = with_records(of, g).select(F.year("start_date").cast("long").alias("year"), F.col("floc").alias("asset"), activity_type(F.col("label")).alias("activityType"), "cost")
    return df.groupBy("year", "asset", "activityType").agg(F.count("*").alias("events"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("totalCost"))


def replacement_costs(g: Graph, asset: str, first: int, last: int, label: str = "Activity/MaintenanceActivity/Replace") -> DataFrame:
    """Yearly costs of one activity on one asset, with the components."""
    m = undirected_motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: n_label == label)
    df = with_records(m, g).filter(F.col("floc") == asset).withColumn("year", F.year("start_date").cast("long")).filter(F.col("year").between(first, last))
    return df.groupBy("year").agg(F.count("*").alias("eventCount"), F.array_sort(F.collect_set("m")).alias("components"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("totalCost"))


def activity_costs(g: Graph) -> DataFrame:
    """Costs of maintenance activities by year and asset."""
    m = undirected_motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: n_label.contains("Activity/MaintenanceActivity"))
    df = with_records(m, g).groupBy(F.year("start_date").cast("long").alias("year"), F.col("floc").alias("asset"), F.col("n_label").alias("activity"))
    return df.agg(F.count("*").alias("recordCount"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("totalCost"))


def leak_costs(g: Graph, above: float = 5000.0) -> DataFrame:
    """Costs of leaks by the component that causes them and what they affect: two edges of one event within a record."""
    agents = undirected_motif(g, "HAS_AGENT", lambda n_label, n, m_label, m: n.contains("leak")).select("record_id", "n_label", "n", F.col("m_label").alias("a_label"), F.col("m").alias("agent"))
    patients = motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: n.contains("leak"))
    both = agents.join(patients, ["record_id", "n_label", "n"]).filter((F.col("agent") != F.col("m")) | (F.col("a_label") != F.col("m_label")))
    df = with_records(both, g).groupBy(F.col("floc").alias("system"), F.col("agent").alias("component"), F.col("n").alias("event"), F.col("m").alias("substance"))
    return df.agg(F.count("*").alias("count"), F.sum("cost").alias("totalCost")).filter(F.col("totalCost") > above)


def parts_of(g: Graph, name: str) -> DataFrame:
    """Parts of a component that it has more than once."""
    e = edges(g).filter((F.col("relation") == "HAS_PART") & F.col("head_type").contains("Object") & F.col("tail_type").contains("Object") & (F.col("head") == name) & (F.col("frequency") > 1))
    return e.select(F.col("head").alias("component"), F.col("tail").alias("part"), F.col("frequency").alias("count"))


def grid(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All combinations of the keys' values, which are few names, with 0 where there is none."""
    every = None
    for k in keys:
        values = df.select(k).distinct()
        every = values if every is None else every.crossJoin(values)
    return every.join(df.select(*keys, value), keys, "left").fillna(0, [value])


def running_offset(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Where each bar of a stack begins."""
    before = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(value).over(before), F.lit(0.0)))
