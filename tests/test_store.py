"""A graph that grows by batches: equal to one build, with ids and files that stay."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.operators import graph, score, store
from millwright.sources.sinks import files_of, remove, written_folders



@pytest.fixture(autouse=True, scope="module")
def few_buckets():
    kept, store.BUCKETS = store.BUCKETS, 8
    yield
    store.BUCKETS = kept


TRIPLE = "record_id long, head_type string, head string, relation string, tail_type string, tail string"
RECORD = "id long, floc string, start_date date, cost double"


def batch(spark, rng, ids, names):
    rows = []
    for i in ids:
        for _ in range(rng.choice([0, 1, 2, 4])):
            a, b = rng.choice(names), rng.choice(names)
            rows += [(i, rng.choice(["State", "Object"]), a, rng.choice(["HAS_PATIENT", "HAS_PART"]), "Object", b)] * rng.choice([1, 1, 2])
    records = spark.createDataFrame([(i, f"f{i % 3}", None, float(i)) for i in ids], RECORD)
    return records, spark.createDataFrame(rows, TRIPLE)


def files(spark, path):
    return {f: t for name in store.KEYS for folder in written_folders(spark, f"{path}/{name}") for f, t in files_of(spark, folder).items()}


def one_build(records, triples):
    stats = score.scored(triples)
    g = graph.build(records, score.without_rare_outliers(triples, stats, score.thresholds(stats)))
    return g, score.node_stats(triples)


def rounded(df, *columns):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two batches in a store, and what they were; the second has names of the first, new ones and one that is null."""
    path, rng = f"file://{tmp_path_factory.mktemp('graph')}/g", random.Random(1)
    one, two = batch(spark, rng, range(40), [f"n{k}" for k in range(9)]), batch(spark, rng, range(40, 70), [*(f"n{k}" for k in range(5, 12)), "", None])
    store.merge(path, "b1", *one)
    before = {name: {tuple(r)[: len(key)]: r.id for r in store.keys(spark, path, name).collect()} for name, key in store.KEYS.items()}, files(spark, path)
    store.merge(path, "b2", *two)
    return path, one, two, before


def test_records_of_all_batches(spark, grown):
    path, one, two, _ = grown
    assert store.batches(spark, path) == ["b1", "b2"]
    assert Counter(map(tuple, store.load(spark, path).records.collect())) == Counter(map(tuple, one[0].union(two[0]).collect()))


def test_batches_without_nulls_equal_one_build_with_all_statistics(spark, tmp_path):
    path, rng = f"file://{tmp_path}/g", random.Random(3)
    parts = [batch(spark, rng, ids, [f"n{k}" for k in range(lo, hi)]) for ids, lo, hi in ((range(60), 0, 8), (range(60, 61), 3, 20), (range(61, 90), 2, 14))]
    for k, p in enumerate(parts):
        store.merge(path, f"b{k}", *p)
    records, triples = parts[0][0].union(parts[1][0]).union(parts[2][0]), parts[0][1].union(parts[1][1]).union(parts[2][1])
    want, stats = one_build(records, triples)
    got = store.load(spark, path)
    columns = ("record_id", *graph.KEY, "frequency", "probability", "pmi")
    assert rounded(got.record_edges, *columns) == rounded(want.record_edges, *columns)
    assert rounded(store.nodes(got, spark, path), "label", "name", "frequency", "probability") == rounded(graph.nodes(want, stats), "label", "name", "frequency", "probability")
    assert rounded(store.edges(got, spark, path), *graph.KEY, "pmi") == rounded(graph.edges(want), *graph.KEY, "pmi")
    per_record = {r.id: r.relationIds for r in store.record_relations(spark, path).collect()}
    all_scores = score.scored(triples)
    kept = score.without_rare_outliers(triples, all_scores, score.thresholds(all_scores))
    occurrences = Counter(r.record_id for r in kept.collect())
    assert {i: len(x) for i, x in per_record.items()} == {i: occurrences[i] for i in range(90)} and all(x == sorted(x) for x in per_record.values())


def test_ids_are_dense_and_never_change(spark, grown):
    path, one, two, (before, _) = grown
    for name, key in store.KEYS.items():
        rows = store.keys(spark, path, name).collect()
        ids = {tuple(r)[: len(key)]: r.id for r in rows}
        assert sorted(ids.values()) == list(range(1, len(rows) + 1)) and len(ids) == len(rows)
        assert before[name].items() <= ids.items() and len(ids) > len(before[name])
        new = sorted((k for k in ids if k not in before[name]), key=lambda k: [(x is not None, x) for x in k])
        assert [ids[k] for k in new] == list(range(len(before[name]) + 1, len(ids) + 1))


def test_a_merge_leaves_files_as_they_are_and_adds_to_touched_buckets(spark, grown):
    path, _, _, (_, before) = grown
    after = files(spark, path)
    assert before.items() <= after.items()
    folder = lambda f: f.rsplit("/", 1)[0]
    new = store.keys(spark, path, "nodes").filter("batch = 'b2'").select("bucket").distinct().count()
    assert len({folder(f) for f in after.keys() - before.keys() if "/nodes/" in f}) == new


def test_a_batch_that_is_merged_again_replaces_itself(spark, grown):
    path, _, two, _ = grown
    seen = lambda: (rounded(store.counts(spark, path), "head", "relation", "tail", "frequency"), files(spark, path), rounded(store.progress(spark, path), "semantic", "system", "record"))
    before = seen()
    store.merge(path, "b2", *two)
    assert seen() == before


def test_a_batch_without_counts_is_not_seen(spark, grown, tmp_path):
    path, one, two, _ = grown
    store.merge(path, "b3", *batch(spark, random.Random(9), range(100, 110), ["n1", "z"]))
    remove(spark, f"{path}/counts/batch=b3", path)  # as if the run had ended before it wrote them
    assert store.batches(spark, path) == ["b1", "b2"] and store.load(spark, path).records.count() == 70


def test_compaction_rewrites_full_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    found = spark.range(3000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).withColumn("b", F.pmod(F.xxhash64(F.lit("Object"), "name"), F.lit(store.BUCKETS))).filter("b = 5").limit(4)
    for k, r in enumerate(found.collect()):
        store.add_keys(path, "nodes", f"b{k}", spark.createDataFrame([("Object", r.name), ("Object", "other")], "label string, name string"))
    keys = lambda: {(r.name, r.id, r.batch, r.bucket) for r in store.keys(spark, path, "nodes").collect()}
    before, kept = keys(), {f: t for f, t in files(spark, path).items() if "bucket=5/" not in f}
    assert store.compact(spark, path, "nodes", 3) == [5] and keys() == before and len(before) == 5
    assert len(files_of(spark, f"{path}/nodes/bucket=5")) == 1 and kept.items() <= files(spark, path).items()
    assert store.compact(spark, path, "nodes", 3) == []


def test_empty_batches_and_stores(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    with pytest.raises(ValueError, match="no batch"):
        store.load(spark, path)
    store.merge(path, "none", spark.createDataFrame([], RECORD), spark.createDataFrame([], TRIPLE))
    assert store.load(spark, path).record_edges.count() == 0 and store.record_relations(spark, path).count() == 0
    store.merge(path, "b1", *batch(spark, random.Random(2), range(5), ["a", "b"]))
    assert store.load(spark, path).records.count() == 5


def test_all_frequencies_come_from_counts(spark):
    rows = [("leak", "HAS_PATIENT", "pump")] * 2 + [("leak", "HAS_PATIENT", "valve"), ("pump", "HAS_PART", "seal")]
    df = spark.createDataFrame(rows, "head string, relation string, tail string")
    halves = [score.triple_counts(df.limit(1)), score.triple_counts(spark.createDataFrame(rows[1:], df.schema))]
    got = {(r.kind, *(x for x in (r.head, r.relation, r.tail) if x)): (r.frequency, r.probability) for r in score.frequencies(score.merged_counts(*halves)).collect()}
    assert got["node", "leak"] == got["node", "pump"] == (3, 0.75) and got["node", "seal"] == (1, 0.25)
    assert got["head", "leak"] == (3, 0.75) and got["tail", "pump"] == (2, 0.5) and got["relation", "HAS_PART"] == (1, 0.25) and got["triple", "leak", "HAS_PATIENT", "pump"] == (2, 0.5)
    assert len(got) == 2 + 3 + 2 + 3 + 4
