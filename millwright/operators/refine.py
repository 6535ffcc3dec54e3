"""Refinement: format, validate, normalise and type triples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import naming
from millwright.operators import lemmas
from millwright.sources.sinks import stage

TRIPLE = ["head", "head_type", "relation", "tail", "tail_type"]


def formatted(raw: DataFrame) -> DataFrame:
    """Types without brackets and capitalised, relations in capitals with underscores; and the outcome of validation."""
    f = raw.withColumns({"head_type": naming.format_entity_type(F.col("head_type")), "tail_type": naming.format_entity_type(F.col("tail_type")), "relation": naming.format_relation(F.col("relation"))})
    return f.withColumn("message", naming.validation(*map(F.col, ("head", "head_type", "relation", "tail", "tail_type"))))


def typed(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The path in the type hierarchy of each ``_name`` of a type ``_of``; a name without one keeps its root type."""
    places = gazetteer.select(F.col("type").alias("_of"), F.col("name").alias("_name"), F.col("path").alias("_path"))
    return names.join(places, ["_of", "_name"], "left").withColumn("_path", F.coalesce("_path", "_of"))


def name_table(valid: DataFrame, gazetteer: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``_from, _of`` to ``_name, _ops, _path``: each distinct name of a type once. It is far smaller than the triples, and written, so
    that Spark knows its size when it chooses how to join it. ``vocabulary``: word counts (``lemmas.word_counts``) that decide on lemmas; without it rules do."""
    ends = F.array(*(F.struct(F.col(s).alias("_from"), F.col(f"{s}_type").alias("_of")) for s in ("head", "tail")))
    distinct = valid.select(F.explode(ends).alias("_e")).select("_e.*").distinct()
    if vocabulary is None:
        named = distinct.withColumn("_n", naming.normalised(F.col("_from"), F.col("_of"))).select("_from", "_of", F.col("_n.name").alias("_name"), F.col("_n.ops").alias("_ops"))
    else:
        root = F.lower(F.substring_index("_of", "/", 1))
        spelt = distinct.withColumns({"_root": root, "_n": naming.spelt(F.col("_from"), F.col("_of"))}).withColumn("_spelt", F.col("_n.name"))
        found = lemmas.lemmatized(spelt, vocabulary, "_spelt", "_root")
        ops = F.array_compact(F.concat("_n.ops", F.array(F.when(F.col("lemma") != F.col("_spelt"), "lemmatize"))))
        named = found.select("_from", "_of", F.col("lemma").alias("_name"), ops.alias("_ops"))
    return stage(typed(named, gazetteer).select("_from", "_of", "_name", "_ops", "_path"))


def normalised(valid: DataFrame, gazetteer: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Names normalised, with the operations that changed them, then typed."""
    names = name_table(valid, gazetteer, vocabulary)
    df = valid
    for s in ("head", "tail"):
        side = names.select(*(F.col(c).alias(f"_{s}{c}") for c in names.columns))
        met = F.col(s).eqNullSafe(F.col(f"_{s}_from")) & F.col(f"{s}_type").eqNullSafe(F.col(f"_{s}_of"))
        df = df.join(side, met).withColumns({s: F.col(f"_{s}_name"), f"{s}_type": F.col(f"_{s}_path"), f"{s}_ops": F.col(f"_{s}_ops")}).drop(*side.columns)
    return df


class Indexed(NamedTuple):
    #: record_id, t; a row for each occurrence, none shuffled
    occurrences: DataFrame
    #: t, head, head_type, relation, tail, tail_type; each triple once
    triples: DataFrame


def indexed(raw: DataFrame, gazetteer: DataFrame, remove_subsumption: bool = False, vocabulary: DataFrame | None = None) -> Indexed:
    """Triples that are valid before and after normalisation, each distinct one once, and their occurrences by number. What refinement makes of a triple depends on nothing else, so it
    is worked out for each distinct triple and not for each occurrence. All tables are written, so that Spark knows their sizes when it chooses how to join them. ``raw`` is read twice, which costs
    less than writing its names: one that is costly to make, or not the same each time, must be a written table."""
    raw = raw.select("record_id", *TRIPLE)
    given = [f"_raw_{c}" for c in TRIPLE]
    once = stage(raw.select(*TRIPLE).distinct())  # written, so that no filter on what follows moves to the occurrences
    df = formatted(once.withColumns({g: F.col(c) for g, c in zip(given, TRIPLE, strict=True)})).filter(F.col("message") == "valid").drop("message")
    if remove_subsumption:
        df = df.filter(F.col("relation") != "IS_A")
    df = normalised(stage(df), gazetteer, vocabulary)  # its names are looked for and then replaced
    again = naming.validation(*map(F.col, ("head", "head_type", "relation", "tail", "tail_type")))
    forms = stage(df.filter(again == "valid").select(*given, *TRIPLE))
    triples = stage(forms.select(*TRIPLE).distinct().withColumn("t", F.monotonically_increasing_id()).select("t", *TRIPLE))
    # Structs are equal where their fields are, null ones too.
    key = lambda of: F.struct(*(F.col(c).alias(n) for c, n in zip(of, TRIPLE, strict=True)))
    numbers = stage(forms.select(key(given).alias("_given"), key(TRIPLE).alias("_key")).join(triples.select("t", key(TRIPLE).alias("_key")), "_key").select("_given", "t"))
    found = raw.select("record_id", key(TRIPLE).alias("_given")).join(numbers, "_given").select("record_id", "t")
    return Indexed(stage(found), triples)


def refined(raw: DataFrame, gazetteer: DataFrame, remove_subsumption: bool = False, vocabulary: DataFrame | None = None) -> DataFrame:
    """Triples that are valid before and after normalisation, a row for each occurrence."""
    found = indexed(raw, gazetteer, remove_subsumption, vocabulary)
    return found.occurrences.join(found.triples, "t").select("record_id", *TRIPLE)
