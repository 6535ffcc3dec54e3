"""Patterns as data against an enumeration of all ways to use a small graph's edges and mentions."""

import itertools
import random
from collections import Counter

import pytest

from millwright.operators import graph
from millwright.operators.patterns import Edge, Mention, Node, Pattern, match, of_one_record, questions, with_records
from millwright.sources import sinks

LABELS, NAMES = ["State/Bad", "Object", "Object/Part"], ["leak", "oil leak", "pump", "seal"]


def small_graph(spark, rng):
    rows = set()
    for r in range(6):
        for _ in range(rng.randint(0, 6)):
            rows.add((r, rng.choice(LABELS), rng.choice(NAMES), rng.choice(["HAS_PATIENT", "HAS_AGENT", "HAS_PART"]), rng.choice(LABELS), rng.choice(NAMES)))
    records = spark.createDataFrame([(r, f"f{r % 2}", None, float(r)) for r in range(6)], "id long, floc string, start_date date, cost double")
    edges = spark.createDataFrame([(*x, 1, 0.1, 0.2) for x in sorted(rows)], "record_id long, head_type string, head string, relation string, tail_type string, tail string, frequency long, probability double, pmi double")
    return graph.Graph(records, edges), rows


def fits(value, asked):
    tests = {"is": lambda v: value == v, "contains": lambda v: v in value, "starts": value.startswith}
    return not asked or any(tests[asked[0]](v) for v in asked[1:])


def brute(rows, p):
    """Each edge term takes a distinct edge and each mention term a distinct mention; variables agree."""
    edges = {x[1:] for x in rows}
    owned = set(rows)
    mentions = {(r, x[k : k + 2]) for r, *x in rows for x in [tuple(x)] for k in (0, 3)}
    ways = []
    for e in p.edges:
        options = []
        for lab, name, rel, lab2, name2 in edges:
            if rel == e.relation:
                for a, b in {((lab, name), (lab2, name2))} | (set() if e.directed else {((lab2, name2), (lab, name))}):
                    options += [({e.head: a, e.tail: b}, {e.of: r} if e.of else {}, (lab, name, rel, lab2, name2)) for r in (range(6) if e.of else [None]) if not e.of or (r, lab, name, rel, lab2, name2) in owned]
        ways.append(options)
    found = Counter()
    wanted = {n.var: n for n in p.nodes}
    for used in itertools.product(*ways):
        if len({u[2] for u in used}) < len(used):
            continue
        for said in itertools.product(sorted(mentions), repeat=len(p.mentions)):
            if len(set(said)) < len(said):
                continue
            bound, ok = {}, True
            pairs = [x for u in used for part in u[:2] for x in part.items()] + [x for m, (r, node) in zip(p.mentions, said, strict=True) for x in ((m.record, r), (m.node, node))]
            for var, value in pairs:
                ok = ok and bound.setdefault(var, value) == value
            if ok and all(fits(bound[v][0], n.label) and fits(bound[v][1], n.name) for v, n in wanted.items() if v in bound):
                found[tuple(sorted(bound.items()))] += 1
    return found


N, M, A = Node("n"), Node("m"), Node("a")
PATTERNS = {
    "own edge": of_one_record("HAS_PATIENT", N._replace(label=("contains", "State")), M),
    "own edge, either way": of_one_record("HAS_PATIENT", N, M._replace(name=("is", "pump", "seal")), False),
    "edge without a record": Pattern((N, M), (Edge("n", "HAS_PART", "m"),)),
    "two edges of one relation": Pattern((), (Edge("n", "HAS_PART", "m"), Edge("m", "HAS_PART", "a"))),
    "two edges that could be one": Pattern((), (Edge("n", "HAS_PART", "m", None, False), Edge("m", "HAS_PART", "a", None, False))),
    "event": questions("pump", "pump")["leak costs"],
    "edge of one record, mentioned by another": Pattern((), (Edge("n", "HAS_AGENT", "m", "r"),), (Mention("r", "n"), Mention("s", "n"))),
    "mention alone": Pattern((N._replace(label=("starts", "Object/", "State")),), (), (Mention("r", "n"),)),
}


@pytest.mark.parametrize("name", PATTERNS)
def test_patterns_match_enumeration(spark, name):
    p = PATTERNS[name]
    for seed in (1, 2):
        g, rows = small_graph(spark, random.Random(seed))
        got = Counter()
        for r in match(g, p).collect():
            x = r.asDict()
            got[tuple(sorted((v, (x[f"{v}_label"], x[v]) if f"{v}_label" in x else x[v]) for v in x if not v.endswith("_label")))] += 1
        assert got == brute(rows, p)


def test_records_of_bindings_and_terms_that_hang_together_nowhere(spark):
    g, rows = small_graph(spark, random.Random(3))
    found = with_records(match(g, PATTERNS["mention alone"]), g, "r")
    assert {"r", "n", "n_label", "floc", "cost"} <= set(found.columns) and {r.cost for r in found.collect()} <= {float(r) for r, *_ in rows}
    with pytest.raises(ValueError, match="nowhere"):
        match(g, Pattern((), (Edge("a", "HAS_PART", "b"), Edge("c", "HAS_PART", "d"))))
    with pytest.raises(ValueError, match="edges or mentions"):
        match(g, Pattern((N,)))


def test_what_is_made_once_is_made_again_when_it_is_gone(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        spark.range(3).write.parquet(f"{path}/t")

    first = sinks.once(spark, ("x", str(tmp_path)), make, "t/_SUCCESS")
    assert sinks.once(spark, ("x", str(tmp_path)), make, "t/_SUCCESS") == first and made == [first]
    sinks.remove(spark, f"{first}/t", first)
    assert sinks.once(spark, ("x", str(tmp_path)), make, "t/_SUCCESS") == made[1] != first
    assert sinks.once(spark, ("y", str(tmp_path)), make, "t/_SUCCESS") == made[2]
