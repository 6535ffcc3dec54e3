"""What the Jaccard join shuffles and what its counting takes: no more than is needed, with the same results."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwright.llm import bpe, fingerprints, jaccard
from millwright.llm.scratch import likely, saved


def test_rows_that_a_join_may_need(spark):
    df = spark.range(50_000).select(F.md5(F.col("id").cast("string").cast("binary")).cast("binary").alias("node"), "id", F.lit("x").alias("set"))
    keys = saved(df.filter("id % 100 = 7").select("node"))
    got = likely(df, keys.union(keys), "node")
    assert got.columns == df.columns
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(range(7, 50_000, 100)) <= set(ids) and len(ids) < 550
    assert likely(df, keys.limit(0), "node").count() == 0 and likely(df.limit(0), keys, "node").count() == 0


def test_only_sets_of_pairs_are_shuffled(spark):
    sets = saved(spark.range(4000).select(F.col("id").cast("string").cast("binary").alias("node"), F.col("id").cast("string").cast("binary").alias("set")))
    pairs = spark.range(3).select(F.lit("1").cast("binary").alias("a"), (F.col("id") + 2).cast("string").cast("binary").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = jaccard._with_sets(pairs, sets)
        got = sorted((bytes(r.a), bytes(r.b), bytes(r.x), bytes(r.y)) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(b"1", b, b"1", b) for b in (b"2", b"3", b"4")]
    assert "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") == 2


def test_short_lists_are_shuffled_once(spark):
    made = saved(spark.createDataFrame([(k, t, n, 9, 1) for k in (jaccard.ENTRY, jaccard.FREQUENT) for t, n in ((k, b"a"), (k, b"b"), (k, b"a"), (k + 10, b"a"), (k + 10, b"a"))], "kind int, token long, node binary, n int, pos int"), "kind")
    got = sorted((r.token, bytes(r.node), r.size) for r in jaccard._lists(made).collect())
    assert got == [(t, n, 2) for t in (jaccard.ENTRY, jaccard.FREQUENT) for n in (b"a", b"b")]
    plan = jaccard._lists(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.split("Window", 1)[1].split("\n:- ")[0].count("REPARTITION_BY_COL") == 1


@pytest.mark.parametrize("level", [0, 2])
def test_lists_of_frequent_shingles_give_the_same_components(spark, monkeypatch, level):
    rng = random.Random(level)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice([w, w, w, w, f"{w}x"]) if k % 6 == 0 else w for k, w in enumerate(base))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.join(df, 4, 85, 100).collect()))
    monkeypatch.setattr(jaccard, "FREQUENT_LEVEL", level)
    assert sorted(map(tuple, jaccard.join(df, 4, 85, 100).collect())) == want and len({c for *_, c in want}) > 1


def test_counting_takes_little_besides_the_fingerprints():
    rng = np.random.default_rng(3)
    held = rng.integers(0, 1 << 64, 500_000, dtype=np.uint64)
    held[:100_000] = held[100_000:200_000]
    want = dict(zip(*np.unique(held, return_counts=True), strict=True))
    tracemalloc.start()
    try:
        batch = fingerprints.packed(held, 9)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < held.nbytes  # sorted copies and masks of all of them took four times that
    arrays = lambda r, c, kind: np.frombuffer(r[c], kind)
    whole = lambda part, short: (np.uint64(part) << np.uint64(55)) | (short.astype(np.uint64) << np.uint64(23))
    got = {}
    for r in batch.to_pylist():
        got |= dict.fromkeys(whole(r["part"], arrays(r, "single", np.uint32)).tolist(), 1)
        got |= dict(zip(whole(r["part"], arrays(r, "many", np.uint32)).tolist(), arrays(r, "counts", np.uint32).tolist(), strict=True))
    assert got == {int(k) >> 23 << 23: int(v) for k, v in want.items()}
    assert fingerprints.packed(held[:0], 9).num_rows == 0


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    """What the byte pairs' codec holds goes when a task of the join begins in the same process, and the reverse; caches stay from one task to the next of an operator."""

    class Docs:
        """Runs what a task would, in this process."""

        def mapInArrow(self, f, ddl):
            list(f([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words of a text that is long enough"]})]))

    for module in (bpe, jaccard):
        monkeypatch.setattr(module, "narrow", lambda docs, *_: docs)
    encode = lambda: bpe.digest(Docs(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    table = SimpleNamespace(value=bytes(1 << fingerprints.TABLE_BITS))
    bpe.codec.cache_clear()
    encode()
    encode()
    assert bpe.codec.cache_info().currsize == 1 and bpe.codec.cache_info().misses == 1
    jaccard.index(Docs(), table, 5, 4, 5)
    assert bpe.codec.cache_info().currsize == 0 and fingerprints._hashes
    encode()
    assert bpe.codec.cache_info().currsize == 1 and not fingerprints._hashes


@pytest.mark.parametrize("strays", [3, 40])
def test_entries_of_long_lists_meet_strays_alone(spark, monkeypatch, strays):
    monkeypatch.setattr(jaccard, "LIST_PIECE", 16)
    rows = [(1, n, jaccard.STRAY if n < strays else jaccard.CORE) for n in range(200)] + [(2, 7, jaccard.CORE), (2, 8, jaccard.STRAY)] + [(3, n, jaccard.CORE) for n in range(30)]
    lists = saved(spark.createDataFrame(rows, "token long, node long, kind int"))
    sizes = lists.groupBy("token").agg(F.count("*").alias("size"), F.sum((F.col("kind") == jaccard.STRAY).cast("int")).alias("strays"))
    wanted, long = jaccard._wanted(sizes, "strays > 0")
    assert {r.token for r in wanted.collect()} == {1, 2} and {(r.token, r.wanted) for r in long.collect()} == {(1, True), (3, False)}
    df = jaccard._in_pieces_of_strays(lists, ["token"], long, "node")
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    groups = {}
    for r in df.collect():
        groups.setdefault((r.token, r.low, r.high), []).append(r)
    met = [(k[0], *sorted((a.node, b.node))) for k, g in groups.items() for i, a in enumerate(g) for b in g[:i] if jaccard.STRAY in (a.kind, b.kind) and (k[1] == k[2] or a.own != b.own)]
    assert len(met) == len(set(met)) and set(met) == {(1, a, b) for b in range(200) for a in range(min(b, strays))} | {(2, 7, 8)}
    pieces = -(-strays // 16)
    assert sum(r.kind == jaccard.CORE and r.token == 1 for g in groups.values() for r in g) == (200 - strays) * pieces  # before: one for each of 13 pieces
