"""Byte tokens and batches by length."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millwright.functions import training
from millwright.operators import batches, extract


def test_byte_ids_end_with_a_mark(spark):
    df = spark.createDataFrame([("ab",), ("é",), ("",), ("x" * 600,), (None,)], "t string")
    got = [r[0] for r in df.select(training.byte_ids(F.col("t"), 512)).collect()]
    assert got[:3] == [[100, 101, 1], [198, 172, 1], [1]] and got[3] == [123] * 511 + [1] and got[4] is None
    assert [r[0] for r in df.limit(2).select(training.byte_tokens(F.col("t"), 5)).collect()] == [[100, 101, 1, 0, 0], [198, 172, 1, 0, 0]]
    assert df.limit(1).select(training.padded(training.byte_ids(F.col("t"), 512), F.lit(2))).first()[0] == [100, 101, 1]


@pytest.mark.parametrize("partitions", [1, 6])
def test_batches_hold_all_rows_within_their_bounds(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [(i, "x" * n) for i, n in enumerate([*range(0, 300), *([40] * 500), 5000, 3])] + [(None, None)]
        df = spark.createDataFrame(rows, "id long, text string").withColumn("n", F.length("text"))
        batched = batches.by_length(df, "n", 2000, 64)
        found = batched.collect()
        assert sorted(((r.id, r.text) for r in found), key=str) == sorted(rows, key=str)
        groups = defaultdict(list)
        for r in found:
            groups[r.batch].append(r)
        for g in groups.values():
            longest = max(r.n or 0 for r in g)
            assert {r.longest for r in g} == {longest} and len(g) <= 64 and (len(g) * longest <= 2000 or len(g) == 1)
        share = batches.padding_share(batched, "n").first().share
        assert 0 <= share < 0.15
        as_they_come = 1 - sum(len(t or "") for _, t in rows) / sum(64 * max(len(t or "") for _, t in rows[k : k + 64]) for k in range(0, len(rows), 64))
        assert share < as_they_come / 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_of_nothing(spark):
    df = spark.createDataFrame([], "text string, n int")
    assert batches.by_length(df, "n").count() == 0 and batches.padding_share(batches.by_length(df, "n"), "n").first().share == 0.0


def test_predictions_in_batches_equal_those_of_single_inputs(spark):
    inputs = spark.createDataFrame([(f"pump {'x ' * (k % 50)}{k}",) for k in range(300)], "input string")
    model = extract.DictionaryExtractor({"pump": "object"})
    rows = lambda most: sorted((r.input, r.gen_output, r.passed) for r in extract.predictions(inputs, model, most_padded=most).collect())
    assert rows(1) == rows(500) == rows(1 << 20)
