"""What only larger tables showed."""

import math
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from millwright.operators import graph, patterns, refine, score
from millwright.plans import record_queries, registry, store_queries
from millwright.sources import sinks, tables
from millwright.sources import sinks, tables


def test_bounds_of_scores_taken_for_normal_are_by_deviations_in_large_tables_too(spark, tmp_path):
    spark.range(1, 2001).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.queries()["a18_thresholds_of_normal_scores"](spark, str(tmp_path)).first()
    scores = [sum(((s + k * 7919) * 2654435761) % (1 << 32) / (1 << 32) for k in range(1, 7)) for s in range(1, 2001)]
    mean, middle = sum(scores) / 2000, median(scores)
    sd = math.sqrt(sum((v - mean) ** 2 for v in scores) / 2000)
    assert list(got) == pytest.approx([middle, middle - 2 * sd, middle + 2 * sd], abs=1e-8)

def test_a_group_of_more_than_a_thousand_files_is_read_in_order(spark):
    df = spark.range(1003).select(F.lit("g").alias("g"), "id")
    back = sinks.read_groups(spark, sinks.write_groups(df, "g", ["id"], rows_per_file=1), df)
    assert [r.id for r in back.orderBy("file", "at").collect()] == list(range(1003))


def test_an_undirected_edge_of_a_pattern_needs_no_shuffle(spark):
    edge = "record_id long, head_type string, head string, relation string, tail_type string, tail string, frequency long, probability double, pmi double"
    rows = [(1, "State", "leak", "HAS_PATIENT", "Object", "pump", 2, 0.5, 0.1), (2, "State", "leak", "HAS_PATIENT", "State", "leak", 1, 0.2, 0.1)]
    g = graph.Graph(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame(rows, edge))
    found = patterns.match(g, patterns.Pattern(edges=(patterns.Edge("n", "HAS_PATIENT", "m", "r", False),)))
    assert "Exchange" not in found._jdf.queryExecution().sparkPlan().toString() and "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.r, r.n, r.m) for r in found.collect()) == [(1, "leak", "pump"), (1, "pump", "leak"), (2, "leak", "leak")]


def test_lines_to_be_loaded_stand_in_many_files_with_one_header_each(spark, monkeypatch):
    seen, load = [], record_queries.setup.load
    monkeypatch.setattr(record_queries.setup, "load", lambda s, known: seen.append(known.input.csv_filename) or load(s, known))
    monkeypatch.setattr(record_queries, "work_orders", lambda s, d: s.range(0, 1000, 1, 4).selectExpr("id", "'1-URGENT' AS type", "' a \"b\"' AS text", "'N' AS floc", "date'1995-01-02' AS start_date", "1.5D AS cost", "2D AS time"))
    got = {r.reason: r.n for r in record_queries.s01_quarantine(spark, "").collect()}
    lines = [i for i in range(1000) if i % 13 == 2]
    dates, costs = ([i for i in range(1000) if i % 13 != 2 and i % every == rest] for every, rest in ((7, 0), (11, 1)))
    assert got == {"line": len(lines), "start_date": len(dates), "cost": len(costs), "loaded": 1000 - len({*lines, *dates, *costs})}
    files = spark.read.text(seen[0]).filter("value = 'text,id,remark,type,floc,start_date,cost,time'")
    assert files.select(F.col("_metadata.file_name")).distinct().count() == files.count() == 4
    assert spark.read.text(seen[0]).filter(F.col("value").startswith('" a ""b""",')).count() == 1000


def test_sums_of_normal_scores_take_no_step_for_each_rank():
    direct = [score._normal_score(i, 30_000) for i in range(501, 29_501)]
    assert score.score_sums(500, 29_500, 30_000) == pytest.approx((math.fsum(direct), math.fsum(v * v for v in direct)), abs=1e-8)
    one, two = score.score_sums(0, 10**9, 10**9)
    assert abs(one) < 1e-3 and 0.999999 < two / 10**9 < 1


def test_numbered_triples_make_the_same_graph(spark):
    raw = [
        (1, "leaky", "<state>", "pumps", "<object>", "has patient"), (1, "leak", "<state>", "pump", "<object>", "has patient"), (2, "leak", "<state>", "pump", "<object>", "has patient"),
        (2, "pump", "<object>", "pump", "<object>", "has part"), (3, None, "<state>", "pump", "<object>", "has patient"), (3, "pump", "<object>", "seal", "<object>", "has part"),
    ]
    raw = spark.createDataFrame(raw, "record_id long, head string, head_type string, tail string, tail_type string, relation string")
    found = refine.indexed(raw, tables.read_gazetteer(spark, tables.GAZETTEER))
    assert found.occurrences.columns == ["record_id", "t"] and found.occurrences.count() == 5 and found.triples.count() == 3
    stats = {"frequency": F.lit(1), "probability": F.lit(0.1), "pmi": F.lit(0.2)}
    plain = graph.build(raw.select("record_id"), found.occurrences.join(found.triples, "t").withColumns(stats))
    numbered = graph.build_indexed(raw.select("record_id"), found.occurrences, found.triples.withColumns(stats))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(plain.record_edges) == rows(numbered.record_edges) and len(rows(plain.record_edges)) == 4
    assert rows(graph.edges(plain)) == rows(graph.edges(numbered)) and rows(graph.mentions(plain)) == rows(graph.mentions(numbered))
    assert rows(graph.mentions(plain, F.col("label") == "State")) == rows(graph.mentions(numbered, F.col("label") == "State"))


def test_batches_of_a_merge_are_cut_from_written_orders(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(store_queries, "triples", lambda s, d: s.range(3).selectExpr("id AS record_id"))
    monkeypatch.setattr(store_queries, "work_orders", lambda s, d: s.range(3))
    monkeypatch.setattr(store_queries.store, "merge", lambda path, name, records, triples: seen.append(records))
    monkeypatch.setattr(store_queries, "once", lambda s, key, make, mark: make("unused"))
    store_queries.merged(spark, "")
    assert len(seen) == 3 and all(df.inputFiles() for df in seen)


def _numbered(spark, monkeypatch):
    written, stage = [], sinks.stage
    for module in (refine, graph):
        monkeypatch.setattr(module, "stage", lambda df: written.append(df.columns) or stage(df))
    rows = [(r, head, "<state>", tail, "<object>", "has patient") for r in (1, 2, 2) for head, tail in (("leak", "pump"), ("leaky", "pumps"), ("no power", "seal"))]
    raw = spark.createDataFrame([*rows, (3, "pump", "<object>", "seal", "<object>", "has part")], "record_id long, head string, head_type string, tail string, tail_type string, relation string")
    found = refine.indexed(raw, tables.read_gazetteer(spark, tables.GAZETTEER))
    stats = {"frequency": F.lit(1), "probability": F.lit(0.1), "pmi": F.lit(0.2)}
    triples = sinks.stage(found.triples.withColumns(stats))
    return graph.build_indexed(spark.range(1, 5), found.occurrences, triples), found.occurrences.join(triples, "t"), written


def test_no_occurrence_is_written_with_its_names_and_none_is_written_twice(spark, monkeypatch):
    _, _, written = _numbered(spark, monkeypatch)
    assert [c for c in written if "record_id" in c] == [["record_id", "t"]]


def test_a_question_shuffles_wanted_occurrences_once_and_by_record(spark, monkeypatch):
    g, occurrences, _ = _numbered(spark, monkeypatch)
    failed = lambda n_label, n, m_label, m: (n_label == "State/UndesirableState/FailedState") & (m == "pump")
    m, plain = graph.motif(g, "HAS_PATIENT", failed), graph.motif(graph.build(g.records, occurrences), "HAS_PATIENT", failed)
    assert sorted(m.collect()) == sorted(plain.collect()) and sorted(r.record_id for r in m.collect()) == [1, 2]
    either = graph.undirected_motif(g, "HAS_PATIENT", lambda n_label, n, m_label, m: n == "pump")
    assert sorted((r.record_id, r.n, r.m) for r in either.collect()) == [(1, "pump", "leak"), (2, "pump", "leak")]
    for df in (m, graph.mentions(g, F.col("name") == "pump")):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(record_id") == 1


def test_relations_of_numbered_triples_are_the_same(spark, monkeypatch):
    g, occurrences, _ = _numbered(spark, monkeypatch)
    own, keys = g.numbered
    df = graph.record_relations_indexed(g.records, own, keys)
    got, want = ({r.id: r.relationIds for r in x.collect()} for x in (df, graph.record_relations(g.records, occurrences)))
    assert got == want and {k: len(v) for k, v in got.items()} == {1: 3, 2: 6, 3: 1, 4: 0}
    assert "hashpartitioning(edge" not in df._jdf.queryExecution().executedPlan().toString()
