"""The property graph as tables, and the patterns that queries ask of it.

A record mentions both ends of each of its edges, so a pattern in which a record mentions the ends of an edge of its own needs no join with mentions:
it is a row of ``record_edges``, whose ends differ since a pattern uses each relationship once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.sinks import stage

KEY = ["head_type", "head", "relation", "tail_type", "tail"]


class Graph(NamedTuple):
    #: id, floc, start_date, cost and other columns of work orders
    records: DataFrame
    #: record_id, the edge's key and statistics; one row for each record and edge
    record_edges: DataFrame
    #: if edges are numbered, the records' occurrences of them as record_id, t, and t with the edge's key and statistics
    numbered: tuple[DataFrame, DataFrame] | None = None


def build(records: DataFrame, surviving: DataFrame) -> Graph:
    return Graph(records, surviving.select("record_id", *KEY, "frequency", "probability", "pmi").dropDuplicates(["record_id", *KEY]))


def build_indexed(records: DataFrame, occurrences: DataFrame, triples: DataFrame) -> Graph:
    """The graph of triples that are numbered by ``t``: numbers, not names, are shuffled to find a record's distinct edges, and only those of edges that a question asks for.
    ``occurrences``: a written table; ``triples``: one of those that survive, with their statistics."""
    keys = triples.select("t", *KEY, "frequency", "probability", "pmi")
    return Graph(records, _distinct(occurrences, keys), (occurrences, keys))


def _distinct(occurrences: DataFrame, keys: DataFrame, number: str = "t") -> DataFrame:
    """``record_id`` and what ``keys`` has, for each record and number that ``keys`` knows. Rows are dealt out by record alone, so a join with records needs no other shuffle."""
    own = occurrences.join(keys.select(number), number, "left_semi").select("record_id", number)
    return own.repartition("record_id").distinct().join(keys, number).drop(number)


#: Stands between the parts of a key whose digest is an id; no name has it.
BETWEEN = "\x1f"


def identity(*parts: str) -> Column:
    """A surrogate id that any engine can compute: the digest of the key."""
    return F.md5(F.concat_ws(BETWEEN, *parts).cast("binary"))


def edges(g: Graph) -> DataFrame:
    if g.numbered:
        own, keys = g.numbered
        return keys.join(own.select("t").distinct(), "t", "left_semi").drop("t")
    return g.record_edges.drop("record_id").dropDuplicates(KEY)


def with_ids(e: DataFrame) -> DataFrame:
    """Edges with ``edge_id, head_id, tail_id``."""
    return e.withColumns({"edge_id": identity(*KEY), "head_id": identity("head_type", "head"), "tail_id": identity("tail_type", "tail")})


def edges_by_name(g: Graph) -> DataFrame:
    """Edges between all nodes of their ends' names, whatever the nodes' labels: homonyms fan out, as they do where edges are matched by name alone."""
    e = edges(g).select("head", "relation", "tail", "frequency", "probability", "pmi").distinct()
    n = _ends(edges(g))
    heads, tails = n.select(F.col("label").alias("head_type"), F.col("name").alias("head")), n.select(F.col("label").alias("tail_type"), F.col("name").alias("tail"))
    return e.join(heads, "head").join(tails, "tail").select(*KEY, "frequency", "probability", "pmi").dropDuplicates(KEY)


def record_relations(records: DataFrame, surviving: DataFrame) -> DataFrame:
    """``id, relationIds``: the edges of every record, repeats included; an empty list for records without any."""
    return _relation_ids(records, surviving.select(F.col("record_id").alias("id"), identity(*KEY).alias("edge")))


def record_relations_indexed(records: DataFrame, occurrences: DataFrame, triples: DataFrame) -> DataFrame:
    """The same of numbered triples: an id is made once for each triple, and numbers are dealt out to records before they become ids."""
    ids = triples.select("t", identity(*KEY).alias("edge"))
    dealt = occurrences.join(ids.select("t"), "t", "left_semi").repartition("record_id")
    return _relation_ids(records, dealt.join(ids, "t").select(F.col("record_id").alias("id"), "edge"))


def _relation_ids(records: DataFrame, edges: DataFrame) -> DataFrame:
    of = edges.groupBy("id").agg(F.array_sort(F.collect_list("edge")).alias("relationIds"))
    return records.select("id").join(of, "id", "left").select("id", F.coalesce("relationIds", F.array().cast("array<string>")).alias("relationIds"))


STORED = ("records", "record_edges")


def save(g: Graph, path: str) -> Graph:
    """Writes the graph below ``path``, in place of one that is there, and reads it back: questions then need no more than its tables."""
    for name in STORED:
        getattr(g, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return load(g.records.sparkSession, path)


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in STORED))


def _ends(df: DataFrame, *more: str) -> DataFrame:
    pair = F.array(F.struct(F.col("head_type").alias("label"), F.col("head").alias("name")), F.struct(F.col("tail_type").alias("label"), F.col("tail").alias("name")))
    return df.select(*more, F.explode(pair).alias("e")).select(*more, "e.label", "e.name").distinct()


def nodes(g: Graph, stats: DataFrame) -> DataFrame:
    return _ends(edges(g)).join(stats, "name").select("label", "name", "frequency", "probability")


def mentions(g: Graph, wanted: Column | None = None) -> DataFrame:
    """``record_id, label, name``: each node that a record mentions once. ``wanted``: what its label and name must be."""
    keep = lambda df: df if wanted is None else df.filter(wanted)
    if not g.numbered:
        return keep(_ends(g.record_edges, "record_id"))
    own, keys = g.numbered
    ends = stage(keep(_ends(keys, "t")))
    nodes = stage(ends.select("label", "name").distinct().withColumn("_node", F.monotonically_increasing_id()))
    same = ends["label"].eqNullSafe(nodes["label"]) & ends["name"].eqNullSafe(nodes["name"])
    of = stage(ends.join(nodes, same).select("t", "_node"))
    return _distinct(own.join(of, "t").select("record_id", "_node"), nodes, "_node").select("record_id", "label", "name")


def has_record(g: Graph) -> DataFrame:
    return g.records.select("floc", F.col("id").alias("record_id"))


#: What n_label, n, m_label and m must be.
Wanted = Callable[[Column, Column, Column, Column], Column]


def _own_edges(g: Graph, wanted: Column) -> DataFrame:
    """Rows of ``record_edges``. Of numbered edges, those that are wanted are chosen first, so only their occurrences are looked at."""
    if not g.numbered:
        return g.record_edges.filter(wanted)
    own, keys = g.numbered
    return _distinct(own, keys.filter(wanted))


def motif(g: Graph, relation: str, wanted: Wanted | None = None, either: bool = False) -> DataFrame:
    """(record)-mentions->(n)-relation->(m)<-mentions-(record): rows with n_label, n, m_label, m. ``either``: rows of which one of both readings is wanted."""
    ends = [F.col(c) for c in ("head_type", "head", "tail_type", "tail")]
    rows = (F.col("relation") == relation) & ((F.col("head") != F.col("tail")) | (F.col("head_type") != F.col("tail_type")))
    if wanted is not None:
        rows &= wanted(*ends) | wanted(*ends[2:], *ends[:2]) if either else wanted(*ends)
    return _own_edges(g, rows).select("record_id", *(c.alias(n) for c, n in zip(ends, ("n_label", "n", "m_label", "m"), strict=True)))


def undirected_motif(g: Graph, relation: str, wanted: Wanted) -> DataFrame:
    """The same in both directions: readings that are wanted."""
    return undirected(motif(g, relation, wanted, either=True)).filter(wanted(*map(F.col, ("n_label", "n", "m_label", "m"))))


def undirected(m: DataFrame) -> DataFrame:
    """Both readings of each row, from one scan."""
    there = F.struct("n_label", "n", "m_label", "m")
    back = F.struct(F.col("m_label").alias("n_label"), F.col("m").alias("n"), F.col("n_label").alias("m_label"), F.col("n").alias("m"))
    return m.select("record_id", F.explode(F.array(there, back)).alias("e")).select("record_id", "e.*")


def with_records(m: DataFrame, g: Graph) -> DataFrame:
    return m.join(g.records.select(F.col("id").alias("record_id"), "floc", "start_date", "cost"), "record_id")
