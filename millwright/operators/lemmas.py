"""Lemmas that a corpus attests: all endings that may be detached are tried, and what is left must be a word of the vocabulary.

The vocabulary is the corpus's own word counts, a table of two columns. Each distinct word is asked once, its candidates are joined with the vocabulary, and the best one wins: an irregular form's
lemma, else what the rules of inflection make of the word if that is attested, else the attested candidate that occurs most often, else what the rules make of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import naming

#: Endings and what may stand in their place.
NOUN_ENDINGS = [("s", ""), ("es", ""), ("es", "is"), ("ies", "y"), ("ies", "ie"), ("ves", "f"), ("ves", "fe"), ("ices", "ix"), ("ices", "ex"), ("i", "us"), ("a", "um"), ("a", "on"), ("men", "man"), ("ae", "a"), ("zes", "")]
VERB_ENDINGS = [("s", ""), ("es", ""), ("es", "e"), ("ies", "y"), ("ies", "ie"), ("ed", ""), ("ed", "e"), ("ied", "y"), ("ied", "ie"), ("ing", ""), ("ing", "e"), ("ying", "ie"), ("en", ""), ("en", "e"), ("cked", "c"), ("cking", "c")]
#: Forms that no ending explains, beyond those that the rules know.
NOUNS = {"children": "child", "radii": "radius", "clothes": "clothes", "oxen": "ox", "geese": "goose", "lice": "louse", "criteria": "criterion", "pliers": "pliers", "scissors": "scissors", "goods": "goods"}
VERBS = {
    "rebuilt": "rebuild", "chosen": "choose", "chose": "choose", "hung": "hang", "rewound": "rewind", "woken": "wake", "woke": "wake", "began": "begin", "begun": "begin", "grew": "grow", "grown": "grow", "drew": "draw", "drawn": "draw",
    "knew": "know", "known": "know", "flew": "fly", "flown": "fly", "rose": "rise", "risen": "rise", "spoke": "speak", "spoken": "speak", "swung": "swing", "sprang": "spring", "rang": "ring", "rung": "ring", "meant": "mean", "felt": "feel",
    "dug": "dig", "fed": "feed", "fought": "fight", "bought": "buy", "taught": "teach", "thought": "think", "told": "tell", "sold": "sell", "paid": "pay", "laid": "lay", "said": "say", "led": "lead", "met": "meet", "won": "win", "wrote": "write",
    "shone": "shine", "swept": "sweep", "slept": "sleep", "crept": "creep", "leapt": "leap", "leant": "lean", "dealt": "deal", "overran": "overrun", "withdrawn": "withdraw", "underwent": "undergo", "rode": "ride", "ridden": "ride", "hid": "hide",
    "hidden": "hide", "bit": "bite", "bitten": "bite", "ate": "eat", "eaten": "eat", "forgot": "forget", "forgotten": "forget", "came": "come", "became": "become", "stood": "stand", "understood": "understand", "lent": "lend",
}


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``word, n``: the vocabulary of a column of cleaned texts, words of small letters alone."""
    words = texts.select(F.explode(F.split(column, r"\s+")).alias("word")).filter(F.col("word").rlike("^[a-z]{2,}$"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def candidates(word: Column, noun: Column) -> Column:
    """What may be left of a word by each ending, doubled consonants made single as well; without repeats."""

    def of(endings: list[tuple[str, str]]) -> list[Column]:
        return [F.when(F.endswith(word, F.lit(old)) & (F.length(word) > len(old) + 1), F.concat(F.substring(word, F.lit(1), F.length(word) - len(old)), F.lit(new))) for old, new in endings]

    def sound(found: Column) -> Column:
        """A stem has a vowel, and of words in -eed only long ones are inflected: ``feed`` is none of ``fee``."""
        return F.filter(found, lambda c: c.rlike("[aeiouy]") & (~F.endswith(word, F.lit("eed")) | (F.length(c) > 3)))

    single = F.regexp_replace(word, r"([bdfgklmnprstvz])\1(?:ed|ing|en|es)$", "$1")
    verbs = [*of(VERB_ENDINGS), F.when(single != word, single)]
    return sound(F.array_distinct(F.array_compact(F.when(noun, F.array(*of(NOUN_ENDINGS))).otherwise(F.array(*verbs)))))


def attested(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, noun`` to ``lemma``, for distinct rows of ``words``. ``vocabulary``: word, n. Spark joins it by its size; its side of the join is one row for each word."""
    word, noun = F.col("word"), F.col("noun")
    irregular = F.when(noun, naming.literal_map(naming.IRREGULAR_NOUNS | NOUNS)[word]).otherwise(naming.literal_map(naming.IRREGULAR_VERBS | VERBS)[word])
    ruled = F.when(noun, naming.by_rules(word, naming.IRREGULAR_NOUNS, naming.NOUN_RULES)).otherwise(naming.by_rules(word, naming.IRREGULAR_VERBS, naming.VERB_RULES))
    asked = words.select("word", "noun").distinct().withColumns({"irregular": irregular, "ruled": ruled})
    plain = word.rlike("^[a-z]{3,}$") & F.col("irregular").isNull()
    tried = asked.withColumn("candidate", F.explode_outer(F.when(plain, F.array_union(F.array("ruled"), candidates(word, noun)))))
    known = vocabulary.select(F.col("word").alias("candidate"), "n")
    # What the rules leave alone is no evidence: inflected forms are attested as well as their lemmas.
    rank = F.struct(((F.col("candidate") == F.col("ruled")) & (F.col("ruled") != word)).alias("ruled"), F.col("n"), F.col("candidate").alias("lemma"))
    best = tried.join(known, "candidate", "left").groupBy("word", "noun", "irregular", "ruled").agg(F.max(F.when(F.col("n").isNotNull() & (F.col("candidate") != word), rank)).alias("best"))
    return best.select("word", "noun", F.coalesce("irregular", "best.lemma", "ruled").alias("lemma"))


def lemmatized(names: DataFrame, vocabulary: DataFrame, name: str, root: str) -> DataFrame:
    """``names`` with ``lemma``: a name with its last word's lemma, a noun's for objects and properties, a verb's for others; words are joined by single spaces."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    split = names.withColumns({"_words": words, "noun": F.col(root).isin("object", "property")}).withColumn("word", F.try_element_at("_words", F.lit(-1)))
    found = attested(split.filter("word is not null"), vocabulary)
    made = F.array_join(F.concat(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), F.array(F.col("lemma"))), " ")
    return split.join(found, ["word", "noun"], "left").withColumn("lemma", F.when(F.size("_words") == 0, F.lit("")).otherwise(made)).drop("_words", "word", "noun")
