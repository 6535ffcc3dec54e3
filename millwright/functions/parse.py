"""Tagged model outputs to norms, entities and relations, by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.naming import let

# The scheme of the model's outputs.
ENTITY_TAGS = ("<object>", "<process>", "<state>", "<activity>", "<property>")
RELATION_NAMES = ("has agent", "has patient", "is a", "has part", "has property", "contains", "has participant")
PAIR_RULES = (
    ("<object>", "<object>"),
    ("<activity>", "<object>"),
    ("<process>", "<object>"),
    ("<state>", "<object>"),
    ("<activity>", "<activity>"),
    ("<activity>", "<state>"),
    ("<activity>", "<process>"),
    ("<object>", "<property>"),
)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _is_marker(w: Column) -> Column:
    return w.rlike("^<(norm|relation|entity)>")


def sections(output: Column) -> Column:
    """array<struct<kind, tokens>>: a section runs from its marker to the next one; a marker that ends the output opens none."""

    def cut(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _is_marker(F.get(w, i)))
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(w)))
        spans = F.arrays_zip(at.alias("a"), ends.alias("b"))
        made = F.transform(spans, lambda s: F.struct(F.regexp_replace(F.get(w, s["a"]), "[<>]", "").alias("kind"), F.slice(w, s["a"] + 2, s["b"] - s["a"] - 1).alias("tokens"), s["a"].alias("at")))
        opened = F.filter(made, lambda s: s["at"] < F.size(w) - 1)
        return F.transform(F.when(F.size(at) > 0, opened).otherwise(F.slice(made, 1, 0)), lambda s: F.struct(s["kind"].alias("kind"), s["tokens"].alias("tokens")))

    return let(tokens(output), lambda w: F.when(F.size(w) > 0, cut(w)))


def passed(output: Column) -> Column:
    """False if the output's only tokens stand before any marker."""
    return let(tokens(output), lambda w: (F.size(w) == 0) | F.exists(w, _is_marker))


def abbreviations(c: Column) -> Column:
    """array<struct<oov, iv>> of ``oov [ iv ]`` pairs; a tail without brackets has an empty full form."""
    plain = F.transform(F.filter(F.split(c, r"[\[\]]"), lambda x: F.trim(x) != ""), lambda x: F.trim(x))

    def pairs(p: Column) -> Column:
        first = F.filter(p, lambda _, i: i % 2 == 0)
        return F.transform(first, lambda x, i: F.struct(x.alias("oov"), F.coalesce(F.get(p, 2 * i + 1), F.lit("")).alias("iv")))

    return let(plain, pairs)


def triple(words: Column) -> Column:
    """struct<head, head_type, tail, tail_type, relation>: words up to the first tag, up to the second, and the rest without tags."""

    def made(w: Column) -> Column:
        tags = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i).startswith("<"))
        one, two = F.coalesce(F.get(tags, F.lit(0)), F.size(w) + 1), F.coalesce(F.get(tags, F.lit(1)), F.size(w) + 1)
        part = lambda a, b: F.array_join(F.slice(w, a, F.greatest(b - a, F.lit(0))), " ")
        rest = F.filter(F.slice(w, two + 1, F.size(w)), lambda x: ~x.startswith("<"))
        return F.struct(part(F.lit(1), one).alias("head"), F.coalesce(F.get(w, one - 1), F.lit("")).alias("head_type"), part(one + 1, two).alias("tail"), F.coalesce(F.get(w, two - 1), F.lit("")).alias("tail_type"), F.array_join(rest, " ").alias("relation"))

    return let(words, made)


def _kept(values: Column, *tests) -> tuple[Column, list[Column]]:
    """Distinct values that pass all tests, and the number that duplicates and each test take away."""
    steps = [values, F.array_sort(F.array_distinct(values))]
    for test in tests:
        steps.append(F.filter(steps[-1], test))
    return steps[-1], [F.size(a) - F.size(b) for a, b in zip(steps, steps[1:], strict=False)]


def structured(input_: Column, output: Column) -> Column:
    """struct<norms, entities, relations, issues, passed>.

    The last norm section holds. An entity is its raw tokens and needs its tag in second place; if one has fewer than two tokens, filtering
    of entities and relations does not take place, and ``fatal_error`` is 1.
    """

    def of(s: Column, kind: str) -> Column:
        return F.transform(F.filter(s, lambda x: x["kind"] == kind), lambda x: x["tokens"])

    def made(s: Column) -> Column:
        norm_sections = of(s, "norm")
        none = F.array().cast("array<struct<oov:string,iv:string>>")
        norms_raw = F.when(F.size(norm_sections) > 0, abbreviations(F.array_join(F.element_at(norm_sections, -1), " "))).otherwise(none)
        entities_raw, relations_raw = of(s, "entity"), F.transform(of(s, "relation"), triple)
        norms, n1 = _kept(norms_raw, lambda x: x["oov"] != x["iv"], lambda x: input_.contains(x["oov"]))
        entities, n2 = _kept(entities_raw, lambda x: F.get(x, F.lit(1)).isin(*ENTITY_TAGS))
        allowed = [f"{a}{b}" for a, b in PAIR_RULES]
        relations, n3 = _kept(
            relations_raw,
            lambda r: ~((r["head"] == r["tail"]) & (r["head_type"] == r["tail_type"])),
            lambda r: F.concat(r["head_type"], r["tail_type"]).isin(*allowed),
            lambda r: r["head_type"].isin(*ENTITY_TAGS) & r["tail_type"].isin(*ENTITY_TAGS) & r["relation"].isin(*RELATION_NAMES),
        )
        fatal = F.exists(entities_raw, lambda x: F.size(x) < 2)
        counted = [("norm_duplicates", n1[0]), ("norm_self_references", n1[1]), ("norm_invalid_oov", n1[2]), ("entity_duplicates", n2[0]), ("entity_type_invalidation", n2[1]), ("relation_duplicates", n3[0]), ("relation_self_references", n3[1]), ("relation_rule_invalidation", n3[2]), ("relation_type_invalidation", n3[3])]
        issues = F.struct(*(F.when(fatal & ~F.lit(k.startswith("norm")), 0).otherwise(v).alias(k) for k, v in counted), fatal.cast("int").alias("fatal_error"))
        return F.struct(norms.alias("norms"), F.when(fatal, entities_raw).otherwise(entities).alias("entities"), F.when(fatal, relations_raw).otherwise(relations).alias("relations"), issues.alias("issues"), passed(output).alias("passed"))

    empty = F.array().cast("array<struct<kind:string,tokens:array<string>>>")
    return let(F.coalesce(sections(output), empty), made)
