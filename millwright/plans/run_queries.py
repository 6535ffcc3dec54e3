"""One call from a CSV file and settings to a saved graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import pipeline
from millwright.plans.oracle import sql
from millwright.plans.registry import query
from millwright.sources import settings, sinks
from millwright.sources.tables import GAZETTEER, work_orders

WORDS = {"blown": "state", "replace": "activity", "insp": "activity", "sensor": "object", "filter": "object", "pump": "object"}


class Pairs:
    """An extractor that relates each state and activity that it knows to each object of the text."""

    def outputs(self, inputs: list[str]) -> list[str]:
        found = [[(w, WORDS[w]) for w in dict.fromkeys(x.split()) if w in WORDS] for x in inputs]
        return [" ".join(f"<relation> {a} <{kind}> {b} <object> has patient" for a, kind in words if kind != "object" for b, other in words if other == "object") for words in found]


def given(spark, d: str, **more: str) -> settings.Settings:
    """Settings as an environment has them, for work orders in a CSV file with other names in another order."""
    path = sinks.new_path(spark)
    orders = work_orders(spark, d).select("cost", F.col("text").alias("what"), F.lit("").alias("remark"), F.col("id").alias("number"), "type", F.col("floc").alias("where"), F.date_format("start_date", "dd/MM/yyyy").alias("when"))
    sinks.write_csv(orders, f"{path}/input/orders")
    return settings.load(None, {
        "FOLDERS__ROOT": path, "INPUT__CSV_FILENAME": "orders", "INPUT__ID_COL": "number", "INPUT__TEXT_COL": "what", "INPUT__FLOC_COL": "where", "INPUT__START_DATE_COL": "when", "INPUT__COST_COL": "cost",
        "INPUT__UNPLANNED_CODES": "1-URGENT,2-HIGH", "PROCESSING__UNPLANNED_ONLY": "true", "PROCESSING__SYSTEMS": "_1,_2$", **more,
    })


_KINDS = (("temp sensor", "State", "blow", "sensor"), ("repl hyd", "Activity/MaintenanceActivity/Replace", "replace", "filter"), ("c/o", "Activity", "insp", "pump"))


@query("s08_k07_csv_to_graph", sql("SELECT floc, head_type, head, 'HAS_PATIENT' AS relation, 'Object' AS tail_type, tail, count(*) AS records, round(sum(cost), 2) AS cost FROM wo JOIN (VALUES " + ", ".join(map(str, _KINDS)) + ") AS v(part, head_type, head, tail) ON contains(text, part) WHERE type IN ('1-URGENT', '2-HIGH') AND regexp_matches(floc, '(?i)_1|_2$') GROUP BY ALL", "wo"))
def s08(spark, d):
    """The edges of the graph by asset; a second run reads what the first one wrote."""
    known = given(spark, d)
    pipeline.run(spark, known, Pairs(), "pairs", GAZETTEER)
    g, _, made = pipeline.run(spark, known, Pairs(), "pairs", GAZETTEER)
    if made:
        raise RuntimeError(f"{made} ran again without a change")
    of = g.record_edges.join(g.records.select(F.col("id").alias("record_id"), "floc", "cost"), "record_id")
    return of.groupBy("floc", "head_type", "head", "relation", "tail_type", "tail").agg(F.count("*").alias("records"), F.round(F.sum("cost"), 2).alias("cost"))
