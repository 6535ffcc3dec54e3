"""A graph merged from two batches: its tables equal those of one build, and ids stay what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import score, store
from millwright.plans.oracle import sql
from millwright.plans.registry import query
from millwright.plans.triple_queries import triples
from millwright.sources.sinks import once, stage
from millwright.sources.tables import work_orders

#: Two batches of unequal size, by the record's number.
BATCHES = (("first", "{} % 3 <> 0"), ("second", "{} % 3 = 0"))


def merged(spark: SparkSession, d: str) -> str:
    """The path of a graph into which both batches were merged; the second one twice, as after a run that was repeated. Queries of one application share it."""

    def make(path: str) -> None:
        t, orders = stage(triples(spark, d)), stage(work_orders(spark, d))  # each merge reads both
        for name, test in (*BATCHES, BATCHES[1]):
            store.merge(path, name, orders.filter(test.format("id")), t.filter(test.format("record_id")))

    return once(spark, ("merged", d), make, "counts/batch=second/_SUCCESS")


_BATCH = "CASE WHEN record_id % 3 <> 0 THEN 1 ELSE 2 END"
_IDS = f"""
ends AS (SELECT label, name, row_number() OVER (ORDER BY b, label, name) AS node_id FROM (
  SELECT label, name, min(b) AS b FROM (SELECT {_BATCH} AS b, head_type AS label, head AS name FROM triples UNION ALL SELECT {_BATCH}, tail_type, tail FROM triples) GROUP BY label, name)),
links AS (SELECT *, row_number() OVER (ORDER BY b, head_type, head, relation, tail_type, tail) AS edge_id FROM (SELECT head_type, head, relation, tail_type, tail, min({_BATCH}) AS b FROM triples GROUP BY ALL))
"""


def _sql(body: str, *parts: str) -> str:
    """A statement that knows the ids of nodes and edges, too."""
    return sql(f"SELECT * FROM (WITH {_IDS.strip()}\n{body})", *parts)


@query("k05_merged_nodes", _sql("SELECT node_id, label, name, f AS frequency, round(f / n.n, 9) AS probability FROM (SELECT DISTINCT label, name FROM mentions) JOIN ends USING (label, name) JOIN (SELECT name, count(*) AS f FROM (SELECT head AS name FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1) USING (name), n", "stats"))
def k05(spark: SparkSession, d: str) -> DataFrame:
    path = merged(spark, d)
    return store.nodes(store.load(spark, path), spark, path).select("node_id", "label", "name", "frequency", F.round("probability", 9).alias("probability"))


_EDGES = "SELECT edge_id, a.node_id AS head_id, b.node_id AS tail_id, head_type, head, relation, tail_type, tail, frequency, round(probability, 9) AS probability, round(pmi, 9) AS pmi FROM edges JOIN links USING (head_type, head, relation, tail_type, tail) JOIN ends AS a ON a.label = head_type AND a.name = head JOIN ends AS b ON b.label = tail_type AND b.name = tail"


@query("k06_merged_edges", _sql(_EDGES, "stats"))
def k06(spark, d):
    path = merged(spark, d)
    e = store.edges(store.load(spark, path), spark, path)
    return e.select("edge_id", "head_id", "tail_id", "head_type", "head", "relation", "tail_type", "tail", "frequency", F.round("probability", 9).alias("probability"), F.round("pmi", 9).alias("pmi"))


@query("j07_first_edge_ids", _sql("SELECT head, relation, tail, edge_id, a.k * b.k AS matched FROM (SELECT head, relation, tail, min(edge_id) AS edge_id FROM edges JOIN links USING (head_type, head, relation, tail_type, tail) GROUP BY ALL) JOIN (SELECT name AS head, count(DISTINCT label) AS k FROM mentions GROUP BY 1) AS a USING (head) JOIN (SELECT name AS tail, count(DISTINCT label) AS k FROM mentions GROUP BY 1) AS b USING (tail)", "stats"))
def j07(spark, d):
    """Edges matched by name alone: one id stands for all that homonyms match."""
    path = merged(spark, d)
    return store.relations_by_name(store.load(spark, path), spark, path)


@query("g03_f58_relation_ids", _sql("SELECT id, coalesce(ids, []) AS relationIds FROM wo LEFT JOIN (SELECT record_id, list_sort(list(edge_id)) AS ids FROM surviving JOIN links USING (head_type, head, relation, tail_type, tail) GROUP BY 1) ON id = record_id", "wo", "stats"))
def g03(spark, d):
    return store.record_relations(spark, merged(spark, d))


_KINDS = (("head", "head, NULL, NULL", "triples"), ("relation", "NULL, relation, NULL", "triples"), ("tail", "NULL, NULL, tail", "triples"), ("triple", "head, relation, tail", "triples"), ("node", "name, NULL, NULL", "(SELECT head AS name FROM triples UNION ALL SELECT tail FROM triples)"))


@query("a15_frequency_tables", sql("SELECT f.*, round(frequency / n.n, 9) AS probability FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {cols.replace('NULL', 'NULL::VARCHAR')}, count(*) AS frequency FROM {of} GROUP BY ALL" for k, cols, of in _KINDS).replace("'head' AS kind, head, NULL::VARCHAR, NULL::VARCHAR", "'head' AS kind, head, NULL::VARCHAR AS relation, NULL::VARCHAR AS tail") + ") AS f, n", "stats"))
def a15(spark, d):
    """All five frequency tables, from the counts of two batches."""
    return score.frequencies(stage(store.counts(spark, merged(spark, d)))).withColumn("probability", F.round("probability", 9))


@query("a16_a18_merged_scores", sql("SELECT s.head, s.relation, s.tail, s.frequency, round(s.pmi, 9) AS pmi, round(lower, 9) AS lower, round(upper, 9) AS upper FROM stats AS s, bounds", "stats"))
def a16(spark, d):
    """Scores and thresholds that a second batch moved, without a look at the occurrences of the first."""
    stats = stage(score.scored_of(stage(store.counts(spark, merged(spark, d)))))
    return stats.crossJoin(F.broadcast(score.thresholds(stats))).select("head", "relation", "tail", "frequency", *(F.round(c, 9).alias(c) for c in ("pmi", "lower", "upper")))


@query("a29_merged_progress", sql("SELECT (SELECT count(*) FROM surviving) AS semantic, (SELECT count(*) FROM wo) AS system, (SELECT count(*) FROM mentions) AS record", "wo", "stats"))
def a29(spark, d):
    return store.progress(spark, merged(spark, d))
