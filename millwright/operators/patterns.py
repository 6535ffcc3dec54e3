"""Patterns as data: nodes, edges and mentions as a list of terms, which become joins of the graph's tables.

A result has a row for each way to bind the variables, as in graph query languages: no edge is used twice, neither one between nodes nor a mention. An edge term may say which record owns the edge; both
readings of an edge are tried if the term has no direction. What a term asks of its nodes is filtered in its own table, before any join. A mention of an end by
the owner of the edge holds by itself and needs no join, but still counts as a mention that is used.

Tables are joined by the variables that they share, smallest first by measured rows, and never without a shared variable: terms that hang together nowhere raise. Records come last, since
each binding has one of each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators import graph
from millwright.operators.graph import Graph


class Node(NamedTuple):
    """A variable, and what its label and name must be: ``is``, ``contains`` or ``starts``, with values of which one must fit."""

    var: str
    label: tuple[str, ...] = ()
    name: tuple[str, ...] = ()


class Edge(NamedTuple):
    """An edge between two variables; ``of``: the record variable that owns it; without a direction, either end may be its head."""

    head: str
    relation: str
    tail: str
    of: str | None = None
    directed: bool = True


class Mention(NamedTuple):
    record: str
    node: str


class Pattern(NamedTuple):
    nodes: Sequence[Node] = ()
    edges: Sequence[Edge] = ()
    mentions: Sequence[Mention] = ()


def _fits(c: Column, asked: tuple[str, ...]) -> Column:
    how, *values = asked
    test = {"is": lambda v: c == v, "contains": c.contains, "starts": c.startswith}[how]
    return reduce(or_, map(test, values))


def _filtered(df: DataFrame, nodes: Sequence[Node]) -> DataFrame:
    """Rows whose nodes are what the pattern asks, for the variables that the table has."""
    for n in nodes:
        if n.var in df.columns:
            df = df.filter(_fits(F.col(f"{n.var}_label"), n.label)) if n.label else df
            df = df.filter(_fits(F.col(n.var), n.name)) if n.name else df
    return df


def _edge_table(g: Graph, e: Edge, number: int, nodes: Sequence[Node]) -> DataFrame:
    source = (g.record_edges if e.of else graph.edges(g)).filter(F.col("relation") == e.relation)
    key = F.struct("head_type", "head", "tail_type", "tail").alias(f"_edge{number}")
    owner = [F.col("record_id").alias(e.of)] if e.of else []
    one, two = (F.col("head_type"), F.col("head")), (F.col("tail_type"), F.col("tail"))
    read = lambda a, b: F.struct(a[0].alias(f"{e.head}_label"), a[1].alias(e.head), b[0].alias(f"{e.tail}_label"), b[1].alias(e.tail))
    reading = F.array(read(one, two))
    if not e.directed:  # a loop has one reading; edges are distinct, so no others are equal
        loop = one[0].eqNullSafe(two[0]) & one[1].eqNullSafe(two[1])
        reading = F.when(loop, reading).otherwise(F.array(read(one, two), read(two, one)))
    df = source.select(*owner, key, F.explode(reading).alias("_r")).select(*(e.of,) * bool(e.of), f"_edge{number}", "_r.*")
    return _filtered(df, nodes)


def _same(a: str, b: str) -> Column:
    return (F.col(a) == F.col(b)) & (F.col(f"{a}_label") == F.col(f"{b}_label"))


def match(g: Graph, p: Pattern) -> DataFrame:
    """A row for each binding: ``v, v_label`` of each node variable, and the id of each record variable."""
    tables = [_edge_table(g, e, k, p.nodes) for k, e in enumerate(p.edges)]
    held = {(e.of, v) for e in p.edges for v in (e.head, e.tail) if e.of}
    for m in p.mentions:
        if (m.record, m.node) not in held:
            own = graph.mentions(g).select(F.col("record_id").alias(m.record), F.col("label").alias(f"{m.node}_label"), F.col("name").alias(m.node))
            tables.append(_filtered(own, p.nodes))
    if not tables:
        raise ValueError("a pattern has edges or mentions")
    left = [(df.count(), k, df) for k, df in enumerate(tables)] if len(tables) > 1 else [(0, 0, tables[0])]
    left.sort(key=lambda x: x[:2])
    found = left.pop(0)[2]
    while left:
        at = next((k for k, (_, _, df) in enumerate(left) if set(df.columns) & set(found.columns)), None)
        if at is None:
            raise ValueError("the pattern's terms hang together nowhere")
        df = left.pop(at)[2]
        found = found.join(df, sorted(set(df.columns) & set(found.columns)))
    for (i, a), (j, b) in combinations(enumerate(p.edges), 2):
        if a.relation == b.relation:
            found = found.filter(F.col(f"_edge{i}") != F.col(f"_edge{j}"))
    for a, b in combinations(dict.fromkeys(p.mentions), 2):
        one_record = F.lit(True) if a.record == b.record else F.col(a.record) == F.col(b.record)
        found = found.filter(~(one_record & (F.lit(True) if a.node == b.node else _same(a.node, b.node))))
    return found.drop(*(f"_edge{k}" for k in range(len(p.edges))))


def with_records(found: DataFrame, g: Graph, var: str) -> DataFrame:
    """Bindings with the columns of one of their records."""
    return found.join(g.records.withColumnRenamed("id", var), var)


def of_one_record(relation: str, n: Node, m: Node, directed: bool = True) -> Pattern:
    """A record that mentions both ends of an edge of its own."""
    return Pattern((n, m), (Edge(n.var, relation, m.var, "r", directed),), (Mention("r", n.var), Mention("r", m.var)))


FAILED = "State/UndesirableState/FailedState"


def questions(component: str, part_of: str) -> dict[str, Pattern]:
    """The patterns of the competency questions; what they count and sum is left to the caller."""
    n, m = Node("n"), Node("m")
    return {
        "undesirable states": of_one_record("HAS_PATIENT", n._replace(label=("contains", "State")), m._replace(label=("contains", "Object"))),
        "failure shares": of_one_record("HAS_PATIENT", n._replace(label=("is", FAILED)), m),
        "time between failures": of_one_record("HAS_PATIENT", n._replace(label=("is", FAILED)), m._replace(name=("is", component)), False),
        "yearly activity costs": Pattern((n._replace(label=("starts", "Activity/MaintenanceActivity/", "Activity/SupportingActivity/")),), (), (Mention("r", "n"),)),
        "replacement costs": of_one_record("HAS_PATIENT", n._replace(label=("is", "Activity/MaintenanceActivity/Replace")), m, False),
        "activity costs": of_one_record("HAS_PATIENT", n._replace(label=("contains", "Activity/MaintenanceActivity")), m, False),
        "leak costs": Pattern(
            (n._replace(name=("contains", "leak")),), (Edge("n", "HAS_AGENT", "a", "r", False), Edge("n", "HAS_PATIENT", "m", "r")), (Mention("r", "n"), Mention("r", "a"), Mention("r", "m")),
        ),
        "parts": Pattern((Node("n", ("contains", "Object"), ("is", part_of)), Node("m", ("contains", "Object"))), (Edge("n", "HAS_PART", "m"),)),
    }
