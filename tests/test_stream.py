import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millwright.operators import extract
from millwright.sources import cache as cached
from millwright.sources.sinks import new_path
from millwright.streaming import ingest


def put(spark, path, *inputs, run="first"):
    cached.append(path, spark.createDataFrame([(x,) for x in inputs], "input string"), run)


def held(spark, path):
    return sorted(r.input for r in cached.read(spark, path, ingest.SCHEMA).collect())


def test_stream_cleans_and_skips_known_inputs(spark, tmp_path):
    source, cache, out = (str(tmp_path / n) for n in ("in", "cache", "out"))
    spark.createDataFrame([(1, "Repl pump"), (2, "temp u/s")], "id long, text string").write.json(source)
    put(spark, cache, "replace pump")
    ingest.start(spark, source, cache, out, str(tmp_path / "state")).awaitTermination(60)
    assert [r.input for r in spark.read.parquet(out).collect()] == ["temperature unserviceable"]
    assert held(spark, cache) == ["replace pump", "temperature unserviceable"]


def test_a_batch_that_fails_between_its_writes_is_repeated_without_a_trace(spark, tmp_path, monkeypatch):
    source, cache, out, state = (str(tmp_path / n) for n in ("in", "cache", "out", "state"))
    spark.createDataFrame([(1, "Repl pump"), (2, "temp u/s")], "id long, text string").write.json(source)
    put(spark, cache, "replace pump")
    write, failed = cached.append, []

    def fails_once(*args):
        if not failed:
            failed.append(True)
            raise OSError("gone")
        return write(*args)

    monkeypatch.setattr(cached, "append", fails_once)
    with pytest.raises(Exception, match="gone"):
        ingest.start(spark, source, cache, out, state).awaitTermination(60)
    assert failed and [r.input for r in spark.read.parquet(out).collect()] == ["temperature unserviceable"] and held(spark, cache) == ["replace pump"]
    ingest.start(spark, source, cache, out, state).awaitTermination(60)
    assert [r.input for r in spark.read.parquet(out).collect()] == ["temperature unserviceable"]
    assert held(spark, cache) == ["replace pump", "temperature unserviceable"]
    ingest.handle(spark.createDataFrame([("temperature unserviceable",), ("replace pump",)], "input string"), 0, cache, out)  # all written, but not noted as done
    assert [r.input for r in spark.read.parquet(out).collect()] == ["temperature unserviceable"] and held(spark, cache) == ["replace pump", "temperature unserviceable"]


def test_probes_read_only_the_folders_of_their_inputs(spark):
    path = new_path(spark)
    put(spark, path, *(f"input {k}" for k in range(500)))
    found = cached.probe(path, spark.createDataFrame([("input 7",), ("input 8",), ("unknown",)], "input string"), ingest.SCHEMA)
    assert sorted(r.input for r in found.collect()) == ["input 7", "input 8"]
    asked = {hashlib.sha256(x.encode()).hexdigest()[:2] for x in ("input 7", "input 8", "unknown")}
    read = re.findall(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    pruned = [re.search(r"prefix#\d+ IN \(([^)]*)\)", x) for x in read]
    assert asked in [set(m[1].split(",")) for m in pruned if m]


def test_runs_at_once_leave_no_duplicates_and_unfinished_ones_no_rows(spark):
    path = new_path(spark)
    schema = spark.createDataFrame([], "input string, value int").schema
    for run, value in (("b", 2), ("a", 1)):
        cached.append(path, spark.createDataFrame([("both", value), (f"only {run}", value)], schema), run)
    spark.createDataFrame([("lost", 3)], "input string, value int").withColumn("prefix", cached.prefix(F.col("input"))).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("prefix").parquet(f"{path}/run=c")
    asked = spark.createDataFrame([("both",), ("lost",), ("only b",), (None,)], "input string")
    want = {("both", 1), ("only b", 2)}
    assert {tuple(r) for r in cached.probe(path, asked, schema).collect()} == want
    cached.append(path, spark.createDataFrame([("both", 1), ("only a", 1)], schema), "a")  # repeated
    assert cached.read(spark, path, schema).count() == 4
    cached.compact(spark, path, schema)
    assert len(cached.runs(spark, path)) == 1 and {tuple(r)[:2] for r in cached.read(spark, path, schema).collect()} == {("both", 1), ("only a", 1), ("only b", 2)}
    assert {tuple(r) for r in cached.probe(path, asked, schema).collect()} == want


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return extract.DictionaryExtractor({"pump": "object"})

    inputs = spark.range(400).select(F.concat(F.lit("pump "), F.col("id").cast("string")).alias("input")).repartition(40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert extract.predictions(inputs, load).filter("size(entities) = 1").count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) <= 8
