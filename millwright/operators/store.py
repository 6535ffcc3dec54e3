"""A graph that grows: batches of work orders and refined triples, merged into tables below one path.

- ``records``, ``record_edges`` and ``counts`` have a folder for each batch, which is written as a whole: a batch that is merged again replaces itself, and other batches' files stay as
  they are. ``counts`` is written last and makes a batch visible; a run that ends before that leaves the graph without the batch, and is repeated.
- ``nodes`` and ``edges`` are key tables: each key once, with an id that never changes, in ``BUCKETS`` folders by the hash of the key. A merge reads the buckets that its
  keys fall in, and appends the keys that are not there yet to them. Ids are dense: the new keys in order, from the highest id on.

Statistics are no part of what is stored by key, since each batch changes all of them: they follow from the counts of all batches, which are partial sums
of distinct triples, so occurrences of earlier batches are never read again. What is an outlier is decided over all batches, too: a graph that was merged from
batches equals one that was built at once.

One writer at a time. Records of different batches differ; null names are keys like any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators import graph, score
from millwright.operators.graph import KEY, Graph
from millwright.operators.sampling import numbered
from millwright.sources.sinks import exists, files_of, remove, stage, written_folders

NODE = ["label", "name"]
KEYS = {"nodes": NODE, "edges": KEY}
BUCKETS = 64
#: Files of a bucket from which on it is worth compacting.
MOST_FILES = 16


def _schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} string" for c in KEYS[name]) + ", id long, batch string, bucket int")


def keys(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A key table: the key's columns, ``id``, the batch that brought it, and its bucket."""
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], _schema(name))
    return spark.read.schema(_schema(name)).parquet(f"{path}/{name}")


def add_keys(path: str, name: str, batch: str, found: DataFrame) -> int:
    """Appends the keys that are not there yet, and gives their number."""
    spark, key = found.sparkSession, KEYS[name]
    asked = stage(found.select(*key).distinct().withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")))
    touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    known = keys(spark, path, name)
    there = known.filter(F.col("bucket").isin(touched)).select(*(F.col(c).alias(f"_{c}") for c in key))
    new = asked.join(there, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key)), "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = stage(numbered(new, key, last + 1).withColumn("batch", F.lit(batch)))
    # Rows of a bucket go to one task, so that a batch adds one file to it.
    made.select(*_schema(name).names).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")
    return made.count()


def compact(spark: SparkSession, path: str, name: str, most_files: int = MOST_FILES) -> list[int]:
    """Rewrites the buckets of a key table that have more files than that, and gives them; other buckets stay as they are.

    Rows are written to a stage first, then in place of the bucket: a run that ends in between leaves the stage to take them from."""
    found = [int(f.rsplit("=", 1)[1]) for f in written_folders(spark, f"{path}/{name}") if len(files_of(spark, f)) > most_files]
    for bucket in found:
        rows = stage(keys(spark, path, name).filter(F.col("bucket") == bucket).drop("bucket"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/bucket={bucket}")
    return found


def merge(path: str, batch: str, records: DataFrame, triples: DataFrame) -> None:
    """Adds a batch. ``records``: work orders, all of them with the columns of the first batch; ``triples``: refined ones."""
    spark = records.sparkSession
    t = stage(triples.select("record_id", *KEY))
    if exists(spark, f"{path}/counts/batch={batch}"):
        remove(spark, f"{path}/counts/batch={batch}", path)
    ends = F.array(*(F.struct(F.col(f"{s}_type").alias("label"), F.col(s).alias("name")) for s in ("head", "tail")))
    add_keys(path, "nodes", batch, t.select(F.explode(ends).alias("e")).select("e.*"))
    add_keys(path, "edges", batch, t)
    records.write.mode("overwrite").parquet(f"{path}/records/batch={batch}")
    t.groupBy("record_id", *KEY).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/record_edges/batch={batch}")
    score.triple_counts(t).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def batches(spark: SparkSession, path: str) -> list[str]:
    """The batches whose counts are complete."""
    return sorted(f.rsplit("batch=", 1)[1] for f in written_folders(spark, f"{path}/counts") if exists(spark, f"{f}/_SUCCESS"))


def _of_batches(spark: SparkSession, path: str, name: str) -> DataFrame:
    found = batches(spark, path)
    if not found:
        raise ValueError(f"{path} has no batch")
    return spark.read.parquet(*(f"{path}/{name}/batch={b}" for b in found))


def counts(spark: SparkSession, path: str) -> DataFrame:
    """``head, relation, tail, frequency`` over all batches: sums of their partial counts."""
    return score.merged_counts(_of_batches(spark, path, "counts"))


def surviving(spark: SparkSession, path: str) -> DataFrame:
    """``record_id``, the edge's key, ``n`` (how often the record has it) and its statistics over all batches, without rare outliers."""
    stats = stage(score.scored_of(stage(counts(spark, path))))
    return score.without_rare_outliers(_of_batches(spark, path, "record_edges"), stats, score.thresholds(stats))


def load(spark: SparkSession, path: str) -> Graph:
    """The graph of all batches, as if it was built at once."""
    return Graph(_of_batches(spark, path, "records"), stage(surviving(spark, path).drop("n")))


def _with_ids(df: DataFrame, spark: SparkSession, path: str, table: str, id_: str, own: list[str] | None = None) -> DataFrame:
    """``df`` with the ids of a key table as ``id_``; ``own``: what ``df`` calls the key's columns, if it calls them otherwise."""
    key = KEYS[table]
    ids = keys(spark, path, table).select(*(F.col(c).alias(f"_{c}") for c in key), F.col("id").alias(id_))
    return df.join(ids, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{k}")) for c, k in zip(own or key, key, strict=True))), "left").drop(*(f"_{c}" for c in key))


def nodes(g: Graph, spark: SparkSession, path: str) -> DataFrame:
    """``node_id, label, name, frequency, probability`` of the graph's nodes."""
    return _with_ids(graph.nodes(g, score.node_stats_of(stage(counts(spark, path)))), spark, path, "nodes", "node_id")


def edges(g: Graph, spark: SparkSession, path: str) -> DataFrame:
    """``edge_id, head_id, tail_id``, the key and the statistics of the graph's edges."""
    df = _with_ids(graph.edges(g), spark, path, "edges", "edge_id")
    for s in ("head", "tail"):
        df = _with_ids(df, spark, path, "nodes", f"{s}_id", [f"{s}_type", s])
    return df


def record_relations(spark: SparkSession, path: str) -> DataFrame:
    """``id, relationIds``: the edge ids of every record, repeats included; an empty list for records without any. A record has few edges."""
    own = _with_ids(surviving(spark, path), spark, path, "edges", "edge")
    repeats = F.flatten(F.collect_list(F.array_repeat("edge", F.col("n").cast("int"))))
    of = own.groupBy(F.col("record_id").alias("id")).agg(F.array_sort(repeats).alias("relationIds"))
    records = _of_batches(spark, path, "records").select("id")
    return records.join(of, "id", "left").select("id", F.coalesce("relationIds", F.array().cast("array<bigint>")).alias("relationIds"))


def relations_by_name(g: Graph, spark: SparkSession, path: str) -> DataFrame:
    """``head, relation, tail, edge_id, matched``: where edges are matched by names alone, the first of the ids that homonyms give, and how many of them there are."""
    e = edges(g, spark, path).groupBy("head", "relation", "tail").agg(F.min("edge_id").alias("edge_id"))
    labels = nodes(g, spark, path).groupBy("name").agg(F.count("*").alias("labels"))
    side = lambda c: labels.select(F.col("name").alias(c), F.col("labels").alias(f"_{c}"))
    return e.join(side("head"), "head").join(side("tail"), "tail").select("head", "relation", "tail", "edge_id", (F.col("_head") * F.col("_tail")).alias("matched"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """``semantic, system, record``: surviving triples, records, and mentions, over all batches."""
    s = stage(surviving(spark, path))
    g = Graph(_of_batches(spark, path, "records"), s.drop("n"))
    return s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("semantic")).crossJoin(g.records.agg(F.count("*").alias("system"))).crossJoin(graph.mentions(g).agg(F.count("*").alias("record")))
