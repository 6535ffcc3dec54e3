"""The graph's tables, the competency questions and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import competency as cq
from millwright.operators import graph, score
from millwright.plans.oracle import sql
from millwright.plans.registry import query
from millwright.plans.triple_queries import kept, surviving, surviving_of, triples
from millwright.sources.sinks import new_path, stage
from millwright.sources.tables import GAZETTEER, table, work_orders

FAILED = "State/UndesirableState/FailedState"


def the_graph(spark: SparkSession, d: str) -> graph.Graph:
    found = kept(spark, d)
    return graph.build_indexed(work_orders(spark, d), found.occurrences, found.triples)


def _md5(*columns: str) -> str:
    return "md5(" + " || chr(31) || ".join(columns) + ")"


_EDGE_ID = _md5("head_type", "head", "relation", "tail_type", "tail")


@query("g01_k05_nodes", sql(f"SELECT DISTINCT {_md5('label', 'm.name')} AS node_id, label, m.name, f AS frequency, round(f / (SELECT n FROM n), 9) AS probability FROM mentions AS m JOIN (SELECT name, count(*) AS f FROM (SELECT head AS name FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1) AS k ON k.name = m.name", "stats"))
def g01(spark, d):
    """Refined triples are read by the statistics of names and by the graph, so they are written once."""
    t = stage(triples(spark, d))
    g = graph.build(work_orders(spark, d), surviving_of(t))
    return graph.nodes(g, score.node_stats(t)).select(graph.identity("label", "name").alias("node_id"), "label", "name", "frequency", F.round("probability", 9).alias("probability"))


@query("g02_k06_j07_edges", sql(f"SELECT {_EDGE_ID} AS edge_id, {_md5('head_type', 'head')} AS head_id, {_md5('tail_type', 'tail')} AS tail_id, head_type, head, relation, tail_type, tail, frequency, round(probability, 9) AS probability, round(pmi, 9) AS pmi FROM edges", "stats"))
def g02(spark, d):
    return graph.with_ids(graph.edges(the_graph(spark, d))).withColumns({"probability": F.round("probability", 9), "pmi": F.round("pmi", 9)})


@query("j07_edges_by_name", sql("WITH e AS (SELECT DISTINCT head, relation, tail, frequency FROM edges), n AS (SELECT DISTINCT label, name FROM mentions) SELECT DISTINCT a.label AS head_type, head, relation, b.label AS tail_type, tail, frequency FROM e JOIN n AS a ON a.name = head JOIN n AS b ON b.name = tail".replace("WITH e AS", "SELECT * FROM (WITH e AS", 1) + ")", "stats"))
def j07(spark, d):
    """Edges matched by name alone: homonyms of other labels fan out."""
    return graph.edges_by_name(the_graph(spark, d)).drop("probability", "pmi")


@query("k07_saved_graph", sql("SELECT relation, count(*) AS n FROM edges GROUP BY 1", "stats"))
def k07(spark, d):
    """A graph that is built once, written over an older one, and read by a question."""
    path = new_path(spark)
    g = the_graph(spark, d)
    own, keys = g.numbered
    graph.save(graph.build_indexed(g.records, own.limit(1), keys), path)
    return graph.edges(graph.save(g, path)).groupBy("relation").agg(F.count("*").alias("n"))


@query("g03_record_relations", sql(f"SELECT id, coalesce(ids, []) AS relationIds FROM wo LEFT JOIN (SELECT record_id, list_sort(list({_EDGE_ID})) AS ids FROM surviving GROUP BY 1) ON id = record_id", "wo", "stats"))
def g03(spark, d):
    """The relations of every record, repeats included; none for records without triples."""
    found = kept(spark, d)
    return graph.record_relations_indexed(work_orders(spark, d), found.occurrences, found.triples)


@query("g04_has_record", sql("SELECT floc, id AS record_id FROM wo", "wo"))
def g04(spark, d):
    return graph.has_record(graph.Graph(work_orders(spark, d), None))


@query("g05_mentions", sql("SELECT * FROM mentions", "stats"))
def g05(spark, d):
    return graph.mentions(the_graph(spark, d))


@query("a29_progress_counts", sql("SELECT (SELECT count(*) FROM surviving) AS semantic, (SELECT count(*) FROM wo) AS system, (SELECT count(*) FROM mentions) AS record", "wo", "stats"))
def a29(spark, d):
    s = stage(surviving(spark, d))
    g = graph.build(work_orders(spark, d), s)
    return s.agg(F.count("*").alias("semantic")).crossJoin(g.records.agg(F.count("*").alias("system"))).crossJoin(graph.mentions(g).agg(F.count("*").alias("record")))


_R = "JOIN wo AS r ON r.id = x.record_id"
CQ1 = f"SELECT r.floc AS asset, n AS state, m AS component, count(*) AS \"count\" FROM m AS x {_R} WHERE relation = 'HAS_PATIENT' AND contains(n_label, 'State') AND contains(m_label, 'Object') GROUP BY ALL HAVING count(*) > 2"


def _cq1(spark, d):
    return cq.undesirable_states(the_graph(spark, d), above=2)


query("cq1_j08_p16_undesirable_states", sql(CQ1, "wo", "stats"))(_cq1)


@query("cq1_j12_j13_grid", sql(f"SELECT * FROM (WITH c AS ({CQ1}) SELECT asset, component, state, coalesce(\"count\", 0) AS \"count\" FROM (SELECT * FROM (SELECT DISTINCT asset FROM c) CROSS JOIN (SELECT DISTINCT component FROM c) CROSS JOIN (SELECT DISTINCT state FROM c)) LEFT JOIN c USING (asset, component, state))", "wo", "stats"))
def cq1_grid(spark, d):
    return cq.grid(stage(_cq1(spark, d)), ["asset", "component", "state"], "count")


@query("a24_colour_range", sql(f"SELECT min(\"count\") AS low, max(\"count\") AS high FROM ({CQ1})", "wo", "stats"))
def a24(spark, d):
    return _cq1(spark, d).agg(F.min("count").alias("low"), F.max("count").alias("high"))


#: States that the hierarchy knows, in order; explicit values spare a job that looks for them. What else there is goes into one more column.
STATES = sorted(name for name, _ in GAZETTEER["State"])


def _pivoted(df, keys, value, aggregate):
    """Sorted rows of keys, a column for each state, and ``other``; 0 where there is none."""
    known = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("other")
    columns = [*STATES, "other"]
    return df.withColumn("state", known).groupBy(*keys).pivot("state", columns).agg(aggregate(value)).fillna(0, columns).orderBy(*keys)


def _pivot_sql(source: str, keys: str, value: str, aggregate: str) -> str:
    columns = [(f"state = '{s}'", s) for s in STATES] + [("state NOT IN (" + ", ".join(f"'{s}'" for s in STATES) + ")", "other")]
    return f"SELECT {keys}, " + ", ".join(f'coalesce({aggregate}({value}) FILTER ({test}), 0)::BIGINT AS "{name}"' for test, name in columns) + f" FROM ({source}) GROUP BY {keys} ORDER BY {keys}"


@query("a22_cq1_pivot", sql(_pivot_sql(CQ1, "asset, component", '"count"', "sum"), "wo", "stats"))
def a22(spark, d):
    return _pivoted(_cq1(spark, d), ["asset", "component"], "count", F.sum)


_S = f"SELECT r.floc AS system, m AS component, n AS state, count(*) AS stateCount FROM m AS x {_R} WHERE relation = 'HAS_PATIENT' AND n_label = '{FAILED}' GROUP BY ALL"


@query("cq2_failure_shares", sql(f"SELECT *, stateCount * 100.0 / sum(stateCount) OVER (PARTITION BY system, component) AS percentage FROM ({_S})".replace("stateCount * 100.0 /", "stateCount * 100.0::DOUBLE /"), "wo", "stats"))
def cq2(spark, d):
    return cq.failure_shares(the_graph(spark, d), None)


@query("cq2_g06_subgraph", sql(f"SELECT record_id, n_label, n, m_label, m FROM m WHERE relation = 'HAS_PATIENT' AND n_label = '{FAILED}' AND m = 'gear'", "stats"))
def cq2_sub(spark, d):
    return graph.motif(the_graph(spark, d), "HAS_PATIENT", lambda n_label, n, m_label, m: (n_label == FAILED) & (m == "gear"))


@query("w01_w03_a25_stacked", sql(f"SELECT system, state, coalesce(round(sum(p) OVER (PARTITION BY system ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), 0) AS \"offset\" FROM (SELECT system, state, 100.0::DOUBLE * stateCount / sum(stateCount) OVER (PARTITION BY system) AS p FROM ({_S}) WHERE component = 'gear')", "wo", "stats"))
def a25(spark, d):
    return cq.running_offset(cq.failure_shares(the_graph(spark, d), "gear"), "system", "state", "percentage").select("system", "state", F.round("offset", 6).alias("offset"))


@query("p26_visible_labels", sql(f"SELECT system, component, state FROM (SELECT *, 100.0::DOUBLE * stateCount / sum(stateCount) OVER (PARTITION BY system, component) AS p FROM ({_S})) WHERE p > 20", "wo", "stats"))
def p26(spark, d):
    return cq.failure_shares(the_graph(spark, d), None).filter("percentage > 20").select("system", "component", "state")


@query("a23_o06_system_state_pivot", sql(_pivot_sql(_S, "system", "stateCount", "sum"), "wo", "stats"))
def a23(spark, d):
    return _pivoted(cq.failure_shares(the_graph(spark, d), None), ["system"], "stateCount", F.sum)


@query("cq3_j11_mtbf", sql(f"SELECT Asset, MTBF, Events FROM (SELECT r.floc AS Asset, count(*) AS Events, datediff('day', min(start_date), max(start_date)) // nullif(count(start_date) - 1, 0) AS MTBF FROM mu AS x {_R} WHERE relation = 'HAS_PATIENT' AND n_label = '{FAILED}' AND m = 'gear' GROUP BY 1) WHERE MTBF > 0", "wo", "stats"))
def cq3(spark, d):
    return cq.time_between_failures(the_graph(spark, d), "gear")


CQ4 = f"SELECT year(start_date)::BIGINT AS year, floc AS asset, split_part(substr(replace(label, 'Activity', ''), 2), '/', 1) AS activityType, count(*) AS events, round(sum(cost), 4) AS totalCost FROM mentions AS x {_R} WHERE starts_with(label, 'Activity/MaintenanceActivity/') OR starts_with(label, 'Activity/SupportingActivity/') GROUP BY ALL"


def _cq4(spark, d):
    return cq.yearly_activity_costs(the_graph(spark, d)).withColumn("totalCost", F.round("totalCost", 4))


query("cq4_p14_yearly_costs", sql(CQ4, "wo", "stats"))(_cq4)


@query("p19_a23_cost_pivot", sql(f"SELECT year, asset, coalesce(round(sum(totalCost / 1e6) FILTER (activityType = 'Maintenance'), 8), 0) AS Maintenance, coalesce(round(sum(totalCost / 1e6) FILTER (activityType = 'Supporting'), 8), 0) AS Supporting FROM ({CQ4}) WHERE totalCost > 10000 GROUP BY ALL", "wo", "stats"))
def p19(spark, d):
    kinds = ["Maintenance", "Supporting"]
    df = _cq4(spark, d).filter("totalCost > 10000").withColumn("totalCost", F.col("totalCost") / 1e6)
    return df.groupBy("year", "asset").pivot("activityType", kinds).sum("totalCost").fillna(0.0, kinds).select("year", "asset", *(F.round(k, 8).alias(k) for k in kinds))


@query("cq5_j09_replacement_costs", sql(f"SELECT year(start_date)::BIGINT AS year, count(*) AS eventCount, list_sort(list_distinct(list(m))) AS components, round(sum(cost), 4) AS totalCost FROM mu AS x {_R} WHERE relation = 'HAS_PATIENT' AND n_label = 'Activity/MaintenanceActivity/Replace' AND floc = (SELECT min(n_name) FROM nation) AND year(start_date) BETWEEN 1993 AND 1997 GROUP BY 1", "wo", "stats"))
def cq5(spark, d):
    asset = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return cq.replacement_costs(the_graph(spark, d), asset, 1993, 1997).withColumn("totalCost", F.round("totalCost", 4))


CQ6 = f"SELECT year(start_date)::BIGINT AS year, floc AS asset, n_label AS activity, count(*) AS recordCount, round(sum(cost), 4) AS totalCost FROM mu AS x {_R} WHERE relation = 'HAS_PATIENT' AND contains(n_label, 'Activity/MaintenanceActivity') GROUP BY ALL"


@query("cq6_activity_costs", sql(CQ6, "wo", "stats"))
def cq6(spark, d):
    return cq.activity_costs(the_graph(spark, d)).withColumn("totalCost", F.round("totalCost", 4))


ACTIVITIES = sorted({path.rsplit("/", 1)[1] for _, path in GAZETTEER["Activity"] if "MaintenanceActivity" in path})


@query("a22_o06_year_activity", sql("SELECT asset, year, " + ", ".join(f"coalesce(round(sum(totalCost) FILTER (activity = 'Activity/MaintenanceActivity/{a}'), 2), 0) AS \"{a}\"" for a in ACTIVITIES) + f" FROM ({CQ6}) GROUP BY ALL ORDER BY ALL", "wo", "stats"))
def a22_years(spark, d):
    """Costs by year and kind of activity, a table for each asset, sorted."""
    df = cq6(spark, d).withColumn("activity", F.element_at(F.split("activity", "/"), -1)).groupBy("asset", "year").pivot("activity", ACTIVITIES).sum("totalCost")
    return df.select("asset", "year", *(F.coalesce(F.round(a, 2), F.lit(0.0)).alias(a) for a in ACTIVITIES)).orderBy("asset", "year")


@query("cq6_grid", sql(f"SELECT * FROM (WITH c AS (SELECT year, asset, string_split(activity, '/')[-1] AS activity, totalCost / 1e6 AS totalCost FROM ({CQ6})) SELECT asset, activity, year, round(coalesce(totalCost, 0), 8) AS totalCost FROM (SELECT * FROM (SELECT DISTINCT asset FROM c) CROSS JOIN (SELECT DISTINCT activity FROM c) CROSS JOIN (SELECT DISTINCT year FROM c)) LEFT JOIN c USING (asset, activity, year))", "wo", "stats"))
def cq6_grid(spark, d):
    df = cq6(spark, d).select("year", "asset", F.element_at(F.split("activity", "/"), -1).alias("activity"), (F.col("totalCost") / 1e6).alias("totalCost"))
    return cq.grid(df, ["asset", "activity", "year"], "totalCost").withColumn("totalCost", F.round("totalCost", 8))


@query("cq7_j10_leak_costs", sql(f"SELECT system, component, event, substance, n AS \"count\", round(c, 4) AS totalCost FROM (SELECT r.floc AS system, a.m AS component, x.n AS event, x.m AS substance, count(*) AS n, sum(cost) AS c FROM m AS x JOIN mu AS a ON a.record_id = x.record_id AND a.n = x.n AND a.n_label = x.n_label {_R} WHERE x.relation = 'HAS_PATIENT' AND a.relation = 'HAS_AGENT' AND contains(x.n, 'leak') AND (a.m <> x.m OR a.m_label <> x.m_label) GROUP BY ALL) WHERE c > 5000", "wo", "stats"))
def cq7(spark, d):
    return cq.leak_costs(the_graph(spark, d)).withColumn("totalCost", F.round("totalCost", 4))


@query("cq8_g07_p18_parts", sql("SELECT head AS component, tail AS part, frequency AS \"count\" FROM edges WHERE relation = 'HAS_PART' AND contains(head_type, 'Object') AND contains(tail_type, 'Object') AND head = 'Brand#13' AND frequency > 1", "stats"))
def cq8(spark, d):
    return cq.parts_of(the_graph(spark, d), "Brand#13")


@query("o03_head", sql("SELECT head AS component, tail AS part, frequency AS \"count\" FROM edges WHERE relation = 'HAS_PART' ORDER BY frequency DESC, head, tail LIMIT 25", "stats"))
def o03(spark, d):
    e = graph.edges(the_graph(spark, d)).filter("relation = 'HAS_PART'")
    return e.orderBy(F.desc("frequency"), "head", "tail").limit(25).select(F.col("head").alias("component"), F.col("tail").alias("part"), F.col("frequency").alias("count"))


# A published table of failure states of one component.
CHART = [
    ("A", "no power", 1), ("A", "blowing hot air", 3), ("B", "no power", 1), ("B", "blowing hot", 1), ("B", "will not turn off", 1), ("B", "unserviceable", 2),
    ("B", "blowing hot air", 2), ("B", "not getting cold", 2), ("B", "not work", 3), ("C", "not work", 1), ("C", "not cool", 10), ("D", "unserviceable", 1),
    ("D", "not cool", 2), ("D", "blowing hot air", 3), ("D", "no power", 3), ("D", "blowing hot", 3), ("D", "not getting cold", 4), ("D", "not work", 12),
    ("E", "not work", 2), ("E", "not cool", 7),
]
_CHART = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in CHART) + ") AS v(system, state, n)"


@query("s12_literal_chart", f"SELECT asset, state, round(100.0::DOUBLE * sum(n) / sum(sum(n)) OVER (PARTITION BY asset), 6) AS percentage FROM (SELECT n_name AS asset, chr(65 + n_regionkey) AS system FROM nation) JOIN {_CHART} USING (system) GROUP BY asset, state")
def s12(spark, d) -> DataFrame:
    """The literal table beside given ones: each nation has the chart of the system that its region stands for."""
    chart = spark.createDataFrame(CHART, "system string, state string, n long")
    nations = table(spark, d, "nation").select(F.col("n_name").alias("asset"), F.char(F.lit(65) + F.col("n_regionkey")).alias("system"))
    df = nations.join(chart, "system").groupBy("asset", "state").agg(F.sum("n").alias("n"))
    return score.shares(df, ["asset"], "n").select("asset", "state", F.round("percentage", 6).alias("percentage"))
