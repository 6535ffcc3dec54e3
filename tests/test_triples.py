import math
import random

import pytest
from pyspark.sql import functions as F

from millwright.functions import naming, parse
from millwright.operators import competency, evaluate, extract, graph, score, summary
from millwright.plans.graph_queries import CHART
from millwright.plans.text_queries import LEMMAS

VALIDATION = [
    ("leak", "State", "pump", "Object", "HAS_PATIENT", "valid"),
    ("pump", "Object", "pump", "Object", "HAS_PART", "self-reference"),
    (" ", "Object", "", "Object", "HAS_PART", "self-reference"),
    (" ", "Object", "pump", "Object", "HAS_PART", "empty entity surface form"),
    ("pump", "Thing", "valve", "Object", "HAS_PART", "invalid entity type(s)"),
    ("pump", "Object", "valve", "Object", "HAS_PARTICIPANT", "invalid relation type"),
    ("pump", "Object", "leak", "State", "HAS_PATIENT", "invalid triple pattern"),
    ("leak", "State/UndesirableState/FailedState", "pump", "Object", "HAS_AGENT", "valid"),
]


def test_validation(spark):
    df = spark.createDataFrame(VALIDATION, "h string, ht string, t string, tt string, r string, want string")
    got = df.select("want", naming.validation(*map(F.col, ("h", "ht", "r", "t", "tt"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_normalisation_and_its_operations(spark):
    rows = [("leaky", "State"), ("wont start", "State"), ("wont start", "Object"), ("air conditioning", "Object"), ("gears", "Object"), ("", "Object"), ("replacing", "Activity")]
    df = spark.createDataFrame(rows, "s string, t string").select(naming.normalised(F.col("s"), F.col("t")).alias("r")).select("r.*")
    assert [(r.name, r.ops) for r in df.collect()] == [
        ("leak", ["colloquialism"]), ("will not start", ["negation"]), ("wont start", []), ("air conditioner", ["colloquialism"]), ("gear", ["lemmatize"]), ("", []), ("replace", ["lemmatize"]),
    ]


TRIPLES = [("leak", "HAS_PATIENT", "pump")] * 2 + [("leak", "HAS_PATIENT", "valve"), ("pump", "HAS_PART", "seal")]


def test_scores(spark):
    t = spark.createDataFrame(TRIPLES, "head string, relation string, tail string")
    got = {(r.head, r.tail): (r.frequency, r.probability, round(r.pmi, 9)) for r in score.scored(t).collect()}
    assert got == {("leak", "pump"): (2, 0.5, 0.575364145), ("leak", "valve"): (1, 0.25, 0.575364145), ("pump", "seal"): (1, 0.25, 2.772588722)}
    nodes = {r.name: (r.frequency, r.probability) for r in score.node_stats(t).collect()}
    assert nodes == {"leak": (3, 0.75), "pump": (3, 0.75), "valve": (1, 0.25), "seal": (1, 0.25)}


def test_lemmas_of_words_outside_any_list(spark):
    df = spark.createDataFrame(LEMMAS, "s string, root string, want string")
    assert [(r.s, r.got) for r in df.select("s", naming.lemmatized(F.col("s"), F.col("root")).alias("got")).collect()] == [(s, want) for s, _, want in LEMMAS]


def test_thresholds_of_normal_scores_are_by_deviations(spark):
    rng = random.Random(5)
    values = [rng.gauss(3, 2) for _ in range(400)]
    median, low, high = score.thresholds(spark.createDataFrame([(v, 1) for v in values], "pmi double, frequency long")).first()
    mean = sum(values) / 400
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / 400)
    assert math.isclose(low, median - 2 * sd) and math.isclose(high, median + 2 * sd)


def test_predictions_fail_one_by_one(spark, tmp_path):
    class Odd:
        def outputs(self, inputs):
            if "bad" in inputs:
                raise ValueError
            return [f"<entity> {x} <object>" for x in inputs if x != "short"]

    records = spark.createDataFrame([(1, "pump"), (2, "bad"), (3, "pump"), (4, "short"), (5, None)], "id long, input string")
    found, cache, failed = extract.run(records, Odd, None)
    assert sorted((r.id, r.predicted, len(r.entities)) for r in found.collect()) == [(1, True, 1), (2, False, 0), (3, True, 1), (4, False, 0), (5, False, 0)]
    assert [r.input for r in spark.read.parquet(cache).collect()] == ["pump"] and sorted(r.input for r in spark.read.json(failed).collect()) == ["bad", "short"]


def test_coverage_and_guard(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a"], ["r"]), ([], ["r"]), (None, None)], "entities array<string>, relations array<string>")
    assert tuple(summary.coverage(rows).first()) == (2, 1, 5)
    assert summary.non_empty(rows) is rows
    with pytest.raises(ValueError, match="no rows"):
        summary.non_empty(rows.limit(0))


def test_evaluation_report(spark):
    relation, entity = "item long, head string, relation string, tail string, head_type string, tail_type string", "item long, name string, type string"
    labels = {"relations": spark.createDataFrame([(1, "a", "r", "b", "o", "o"), (2, "c", "r", "d", "o", "o")], relation), "entities": spark.createDataFrame([(1, "a", "o")], entity), "norms": spark.createDataFrame([(1, "x"), (1, "x")], "item long, head string")}
    predictions = {"relations": spark.createDataFrame([(1, "a", "r", "b", "s", "o", 0)], relation + ", pos int"), "entities": spark.createDataFrame([], entity + ", pos int"), "norms": spark.createDataFrame([(1, "x"), (2, "y")], "item long, head string")}
    got = {r.metric: (r.correct, r.total, r.score) for r in evaluate.report(labels, predictions, ["item", "head"]).collect()}
    assert got == {"loose_relation": (1, 2, 0.5), "strict_relation": (0, 2, 0.0), "loose_entity": (0, 1, 0.0), "strict_entity": (0, 1, 0.0), "normalisation": (1, 2, 0.5)}
    wrong = {tuple(r) for r in evaluate.incorrect(labels, predictions, ["item", "head"]).collect()}
    assert wrong == {(1, "strict_relation", "a|r|b|o|o"), (2, "loose_relation", "c|r|d|o|o"), (2, "strict_relation", "c|r|d|o|o"), (1, "loose_entity", "a|o"), (1, "strict_entity", "a|o"), (2, "norm", "y")}
    none = {k: v.limit(0) for k, v in labels.items()}
    assert all(r.score is None for r in evaluate.report(none, predictions, ["item", "head"]).collect())


def test_a_saved_graph_is_replaced(spark, tmp_path):
    one = _graph(spark, [(1, "A", "2020-01-01", 1.0)], [(1, "Object", "pump", "HAS_PART", "Object", "seal")])
    two = _graph(spark, [(1, "A", "2020-01-01", 1.0)], [(1, "Object", "pump", "HAS_PART", "Object", "hose"), (1, "State", "hose", "HAS_PATIENT", "Object", "pump")])
    path = f"file://{tmp_path}/g"
    graph.save(one, path)
    g = graph.save(two, path)
    assert sorted(r.tail for r in graph.edges(g).collect()) == ["hose", "pump"]
    assert graph.edges_by_name(g).count() == 4  # hose stands for an object and a state
    ids = graph.with_ids(graph.edges(g)).collect()
    assert len({r.edge_id for r in ids}) == 2 and len({x for r in ids for x in (r.head_id, r.tail_id)}) == 3


def test_thresholds_of_nothing(spark):
    assert score.thresholds(spark.createDataFrame([], "pmi double, frequency long")).count() == 0


def test_shapiro_wilk_on_published_values():
    assert score.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]) < 0.01  # a textbook sample: W 0.79, p 0.007
    normal = [math.sin(i * 12.9898) * 43758.5453 % 1 + math.sin(i * 78.233) * 12345.678 % 1 + math.sin(i) * 999.1 % 1 for i in range(60)]
    assert score.shapiro_wilk(normal) > 0.05
    assert score.shapiro_wilk([1.0, 1.0, 1.0]) == 0.0
    assert score.shapiro_wilk([1.0]) == 0.0


def test_thresholds_judge_all_values(spark):
    rng = random.Random(3)
    values = [rng.gammavariate(1200, 1) for _ in range(20_000)]
    stats = spark.createDataFrame([(v, 1) for v in values], "pmi double, frequency long")
    q1, median, q3 = stats.agg(F.percentile("pmi", [0.25, 0.5, 0.75])).first()[0]
    assert tuple(score.thresholds(stats).first()) == (median, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))  # by 5,000 quantiles they look normal
    normal = spark.createDataFrame([(rng.gauss(0, 1), 1) for _ in range(20_000)], "pmi double, frequency long")
    assert score.thresholds(normal).first().upper != tuple(score.thresholds(stats).first())[2]
    few = [(float(round(v)), values[:2000].count(v) + 1) for v in values[:2000]]
    flat = [v for v, n in few for _ in range(n)]
    mean = sum(flat) / len(flat)
    got = score.shapiro_wilk_of(score.ranked(spark.createDataFrame(few, "pmi double, frequency long")), len(flat), mean, sum((v - mean) ** 2 for v in flat))
    assert math.isclose(got, score.shapiro_wilk(flat), rel_tol=1e-6, abs_tol=1e-12)


def test_chart_shares(spark):
    df = score.shares(spark.createDataFrame(CHART, "system string, state string, n long"), ["system"], "n")
    got = {(r.system, r.state): round(r.percentage, 2) for r in df.collect()}
    assert got["A", "blowing hot air"] == 75.0
    assert got["C", "not cool"] == 90.91
    assert got["D", "not work"] == 42.86


def _graph(spark, records, edges):
    r = spark.createDataFrame(records, "id long, floc string, start_date string, cost double").withColumn("start_date", F.col("start_date").cast("date"))
    e = spark.createDataFrame(edges, "record_id long, head_type string, head string, relation string, tail_type string, tail string").withColumns({"frequency": F.lit(1).cast("long"), "probability": F.lit(0.1), "pmi": F.lit(1.0)})
    return graph.build(r, e)


FAILED = "State/UndesirableState/FailedState"


def test_time_between_failures(spark):
    dates = {"A": ["2020-01-01", "2020-01-11", "2020-01-31"], "B": ["2020-01-01", "2020-01-11", "2020-01-31", None], "C": ["2020-01-01", "2020-01-02", "2020-01-02"], "D": ["2020-01-01"]}
    records = [(10 * i + k, a, d, 1.0) for i, (a, ds) in enumerate(dates.items()) for k, d in enumerate(ds)]
    g = _graph(spark, records, [(r[0], FAILED, "leak", "HAS_PATIENT", "Object", "engine") for r in records])
    assert sorted(map(tuple, competency.time_between_failures(g, "engine").collect())) == [("A", 15, 3), ("B", 15, 4)]


def test_motif_needs_the_records_own_edge(spark):
    g = _graph(spark, [(1, "A", "2020-01-01", 1.0), (2, "A", "2020-01-01", 1.0)], [(1, FAILED, "leak", "HAS_PATIENT", "Object", "pump"), (1, "Object", "pump", "HAS_PART", "Object", "seal"), (2, "Object", "pump", "HAS_PART", "Object", "hose")])
    assert [tuple(r) for r in competency.undesirable_states(g, above=0).collect()] == [("A", "leak", "pump", 1)]


def test_sections_and_structured_output(spark):
    out = "<norm> guage [ gauge ] <relation> faulty <state> gauge <object> has patient <relation> pedestal bearing <object> bearing <object> is a <entity> service <activity>"
    df = spark.createDataFrame([("pedestal bearing 3 guage faulty", out)], "i string, o string").select(parse.structured(F.col("i"), F.col("o")).alias("r")).select("r.*")
    r = df.first()
    assert [tuple(x) for x in r.norms] == [("guage", "gauge")]
    assert {(x.head, x.head_type, x.tail, x.tail_type, x.relation) for x in r.relations} == {("faulty", "<state>", "gauge", "<object>", "has patient"), ("pedestal bearing", "<object>", "bearing", "<object>", "is a")}
    assert r.entities == [["service", "<activity>"]]
    assert all(v == 0 for v in r.issues)
    assert r.passed


def test_multi_word_entities_and_short_ones(spark):
    df = spark.createDataFrame([("x", "<entity> two words <object>"), ("x", "<entity> lone <relation> a <thing> b <object> is a"), ("x", "no marker"), ("x", "")], "i string, o string")
    rows = df.select(parse.structured(F.col("i"), F.col("o")).alias("r")).select("r.*").collect()
    assert rows[0].entities == [] and rows[0].issues.entity_type_invalidation == 1
    assert rows[1].issues.fatal_error == 1 and len(rows[1].relations) == 1
    assert [r.passed for r in rows] == [True, True, False, True]


def test_loose_matches_may_exceed_the_total(spark):
    key = "item long, head string, relation string, tail string, head_type string, tail_type string"
    labels = spark.createDataFrame([(1, "a", "has part", "b", "obj", "obj")], key)
    predictions = spark.createDataFrame([(1, "a", "has part", "b", "state", "obj", 0), (1, "a", "has part", "b", "obj", "obj", 1), (1, "a", "has part", "b", "process", "obj", 2)], key + ", pos int")
    assert tuple(evaluate.relation_matches(labels, predictions).first()) == (1, 2, 1)


def test_typing_report_of_an_absent_root_is_null(spark):
    t = spark.createDataFrame([("Object/X", "Object")], "head_type string, tail_type string")
    got = {r.root: r.percent for r in summary.typing_report(t).collect()}
    assert got["Object"] == 67.0 and got["State"] is None


def test_matching_is_linear_in_a_hot_key(spark):
    """30,000 labels and predictions of one loose key, of which pairs would be 900 million, beside small keys against brute force."""
    import random

    rng = random.Random(4)
    types = ["o", "s", "p", None]
    labels = [("hot", "a", "r", "b", rng.choice(types), "o") for _ in range(30_000)] + [(f"i{rng.randint(0, 9)}", rng.choice("ab"), "r", rng.choice(["b", None]), rng.choice(types), "o") for _ in range(200)]
    predictions = [("hot", "a", "r", "b", "z" if k < 29_990 else rng.choice(types), "o", k) for k in range(30_000)] + [(f"i{rng.randint(0, 9)}", rng.choice("ab"), "r", rng.choice(["b", None]), rng.choice(types), "o", rng.choice([0, 1, 2, 3, None])) for _ in range(200)]
    df = spark.createDataFrame(labels, "item string, head string, relation string, tail string, head_type string, tail_type string")
    found = evaluate.tried(df, spark.createDataFrame(predictions, "item string, head string, relation string, tail string, head_type string, tail_type string, pos int"), evaluate.RELATION)
    by_key = {}
    for p in predictions:
        if p[3] is not None and p[6] is not None:
            by_key.setdefault(p[:4], []).append(p[4:])
    want = {}
    for x in set(labels):
        near = by_key.get(x[:4], []) if x[3] is not None else []
        first = min((pos for a, b, pos in near if (a, b) == x[4:]), default=None)
        want[x] = (sum(first is None or pos <= first for _, _, pos in near), sum((a, b, pos) == (*x[4:], first) for a, b, pos in near))
    got = found.collect()
    assert len(got) == len(labels) and {tuple(r)[:6]: tuple(r)[6:] for r in got} == want
    assert "Join" not in found._jdf.queryExecution().toString()
