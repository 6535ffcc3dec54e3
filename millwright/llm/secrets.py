"""Secret scanning with a trigram index and built-in functions only.

From each rule's pattern a Boolean trigram query is derived: which sets of three-character strings must a text that matches hold.
An index by trigram, written as a table, has the postings of the trigrams that the queries name. The postings of each alternative of a query are intersected and give each
document the rules that it can match. Only those patterns run over it. Rules from whose patterns no trigram follows scan every text.

Positions come from the pieces between matches: ``split`` gives the pieces, ``regexp_extract_all`` the matches, and a running sum of
their lengths the spans. Sums are taken in blocks, so a text with very many matches costs little more than in proportion.

Edge cases: a null text counts as empty; an empty table gives an empty one; postings are kept by id and text, so rows with equal ids and other texts are judged row by row, and repeated rows get
equal results, one for each; null ids are joined as equal; spans of one rule never overlap, and of equal starts the kinds' order decides; other columns are ignored.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import narrow
from millwright.llm.scratch import saved


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts, and its least length.
    group: int
    least: int


_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)" + _VALUE, 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Added by the method: prefixes and headers that well-known credentials carry.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
RULES = (*BASE_RULES, *MORE_RULES)

#: Sets of strings with more members than this are cut when a trigram query is derived.
MOST_STRINGS = 64
#: Trigrams of an alternative that are asked for; the patterns themselves decide in any case.
MOST_TRIGRAMS = 62
#: Entries of a running sum that are handled together.
BLOCK = 512

#: A Boolean query: alternatives, of which one must hold all its trigrams. None: nothing follows.
Query = frozenset[frozenset[str]]


def _either(queries: list[Query | None]) -> Query | None:
    return None if None in queries else _least(frozenset().union(*queries))


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a if b is None else b
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(q: Query) -> Query:
    """Without alternatives that hold all of another's trigrams."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of(strings: set[str]) -> Query | None:
    found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return None if not found or frozenset() in found else _least(found)


def _walk(items) -> tuple[set[str] | None, Query | None]:
    """Of a parsed sequence: all strings that it matches if they are few, and a trigram query."""
    whole: set[str] | None = {""}
    run, query = {""}, None
    for op, arg in items:
        exact, more = _one(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            whole = None if whole is None else {a + b for a in whole for b in exact}
        else:
            query, run, whole = _both(_both(query, _of(run)), more), {""}, None
    return whole, _both(query, _of(run))


def _one(op, arg) -> tuple[set[str] | None, Query | None]:
    if op is ops.LITERAL:
        return {chr(arg).lower()}, None
    if op is ops.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is ops.LITERAL:
                chars.add(chr(x).lower())
            elif kind is ops.RANGE and x[1] - x[0] < 4:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is ops.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        whole = None if any(w is None for w, _ in parts) else set().union(*(w for w, _ in parts))
        return whole, _either([q for _, q in parts])
    if op is ops.SUBPATTERN:
        return _walk(arg[3])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        low, high, body = arg
        whole, query = _walk(body)
        if whole is not None and high != ops.MAXREPEAT and int(high) <= 2 and len(whole) <= 4:
            return {"".join(p) for n in range(low, int(high) + 1) for p in product(whole, repeat=n)}, None
        return None, query if low else None
    return None, None


def trigram_query(pattern: str) -> Query | None:
    """What each match of the pattern must hold, in lower case; None if no trigram follows from it."""
    return _walk(parser.parse(pattern))[1]


#: A row's key for the joins of its own results: rows that share it are equal, and so are their results; null ids are spread by their texts.
KEY = ("doc_id", "text_hash")


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``trigram, doc_id, text_hash``: the index of the trigrams that the queries name, over ``docs`` with ``text``."""
    present = F.filter(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in terms)), lambda t: t.isNotNull())
    return docs.select(*KEY, F.lower("text").alias("folded")).select(*KEY, F.explode(present).alias("trigram")).select("trigram", *KEY)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, text_hash, rules``: for documents that hold the trigrams of some rule, the rules to verify there.

    The postings of each alternative of a rule's query are intersected: a document is in the intersection if each of them holds it, which a bit for each says.
    """
    alternatives = [(r.kind, k, sorted(x)) for r in rules for k, x in enumerate(sorted(trigram_query(r.pattern) or (), key=sorted))]
    asked = [(kind, k, t, 1 << bit, (1 << min(len(x), MOST_TRIGRAMS)) - 1) for kind, k, x in alternatives for bit, t in enumerate(x[:MOST_TRIGRAMS])]
    queries = docs.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, bit long, needed long")
    index = saved(postings(docs, sorted({row[2] for row in asked})))
    both = index.join(F.broadcast(queries), "trigram")  # a row for each trigram of the rules' patterns, whatever the table's size
    met = both.groupBy(*KEY, "kind", "alternative", "needed").agg(F.bit_or("bit").alias("held")).filter("held = needed")
    return saved(met.groupBy(*KEY).agg(F.sort_array(F.collect_set("kind")).alias("rules")))


_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule's matches that are long enough."""
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.length if rule.group == 0 else lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))
    each = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), (counted(m) >= rule.least).alias("kept")))
    each = F.filter(each, lambda x: x["size"].isNotNull())

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        more = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    def block_step(acc, block):
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))[0]

    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))
    summed = lambda a: F.when(F.size(a) == 0, F.array().cast(_SPANS)).otherwise(F.flatten(F.aggregate(blocks(a), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("outs")), block_step, lambda acc: acc["outs"])))
    return F.transform(F.array(each), summed)[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, for each rule, ``in_<kind>``: its spans. One row for each row of ``docs``.

    Rules with a trigram query run over candidates alone, which are joined with the texts by their measured size; the others run over all texts where they are. Only
    spans are joined with each other, so texts are not shuffled unless there are very many candidates.
    """
    texts = narrow(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    found = texts.select(*KEY, *(spans(F.col("text"), r).alias(f"in_{r.kind}") for r in rules if r not in indexed))
    if indexed:
        same = lambda other: F.col("doc_id").eqNullSafe(other["c_id"]) & (F.col("text_hash") == other["c_hash"])
        renamed = lambda df: df.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
        to_verify = renamed(candidates(texts, tuple(indexed)))
        none = F.array().cast(_SPANS)
        verified = texts.join(to_verify, same(to_verify)).select(*KEY, *(F.when(F.array_contains("rules", r.kind), spans(F.col("text"), r)).otherwise(none).alias(f"in_{r.kind}") for r in indexed))
        verified = renamed(saved(verified.dropDuplicates(KEY)))
        found = found.join(verified, same(verified), "left").select("doc_id", *(f"in_{r.kind}" if r not in indexed else F.coalesce(f"in_{r.kind}", none).alias(f"in_{r.kind}") for r in rules))
    return found.select("doc_id", *(f"in_{r.kind}" for r in rules))


def told(kinds: list[str]) -> Column:
    """kind:start:end of the spans of these kinds, by start and kind, joined by commas."""
    tag = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))
    tagged = [F.transform(f"in_{k}", tag(i)) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``op2_secrets``: counts of the base kinds, the digest of their spans, and all spans."""
    base, every = [r.kind for r in BASE_RULES], [r.kind for r in RULES]
    found = scan(docs, RULES, id_col, text_col)
    return found.select("doc_id", *(F.size(f"in_{k}").cast("long").alias(f"n_{k}") for k in base), F.sha2(told(base), 256).alias("base_sha256"), told(every).alias("spans"))
