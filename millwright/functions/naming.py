"""Names, types and relations of triples: formatting, normalisation, validation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of triples.
ENTITY_TYPES = ("object", "activity", "process", "property", "state")
RELATIONS = {
    "has_patient": [("activity", "activity"), ("activity", "state"), ("activity", "process"), ("activity", "object"), ("process", "object"), ("state", "activity"), ("state", "object")],
    "has_agent": [("state", "object"), ("process", "object"), ("activity", "object")],
    "contains": [("object", "object")],
    "has_part": [("object", "object")],
    "has_property": [("object", "property"), ("state", "property")],
    "is_a": [("object", "object"), ("activity", "activity"), ("process", "process"), ("property", "property"), ("state", "state")],
}
COLLOQUIALISMS = {"conditioning": "conditioner", "piping": "pipe", "leaky": "leak"}
NEGATIONS = {
    "wont": "will not",
    "won't": "will not",
    "wouldnt": "would not",
    "wouldn't": "would not",
    "dont": "does not",
    "don't": "does not",
    "doesnt": "does not",
    "doesn't": "does not",
}

#: Forms that the rules below would get wrong, by part of speech.
IRREGULAR_NOUNS = {
    "men": "man", "women": "woman", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse", "axes": "axis", "indices": "index", "vertices": "vertex", "matrices": "matrix",
    "knives": "knife", "halves": "half", "shelves": "shelf", "leaves": "leaf", "lives": "life", "wolves": "wolf", "ties": "tie", "dies": "die", "pies": "pie", "caches": "cache",
    "aches": "ache", "buses": "bus", "gases": "gas", "lenses": "lens", "viruses": "virus", "statuses": "status", "potatoes": "potato", "heroes": "hero",
    "lens": "lens", "gas": "gas", "chassis": "chassis", "series": "series", "means": "means", "news": "news", "species": "species",
}
IRREGULAR_VERBS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "has": "have", "had": "have", "did": "do", "done": "do", "goes": "go", "went": "go", "gone": "go", "got": "get",
    "gotten": "get", "blew": "blow", "blown": "blow", "broke": "break", "broken": "break", "wore": "wear", "worn": "wear", "tore": "tear", "torn": "tear", "bent": "bend", "stuck": "stick", "made": "make",
    "found": "find", "lost": "lose", "ran": "run", "fell": "fall", "fallen": "fall", "left": "leave", "burnt": "burn", "held": "hold", "froze": "freeze", "frozen": "freeze", "shook": "shake",
    "shaken": "shake", "sprung": "spring", "stole": "steal", "stolen": "steal", "swollen": "swell", "spun": "spin", "wound": "wind", "bound": "bind", "built": "build", "caught": "catch", "lit": "light",
    "ground": "grind", "kept": "keep", "sent": "send", "spent": "spend", "taken": "take", "took": "take", "given": "give", "gave": "give", "driven": "drive", "drove": "drive", "written": "write",
    "seen": "see", "shot": "shoot", "slid": "slide", "slipt": "slip", "struck": "strike", "sunk": "sink", "sank": "sink", "thrown": "throw", "threw": "throw", "brought": "bring", "bled": "bleed",
    "adding": "add", "added": "add", "creating": "create", "created": "create", "igniting": "ignite", "ignited": "ignite", "breathing": "breathe", "breathed": "breathe", "dying": "die", "tying": "tie",
    "lying": "lie", "focusing": "focus", "focused": "focus",
}


def _doubled() -> list[tuple[str, str]]:
    """Stems whose last consonant is doubled before an ending."""
    return [(rf"^(.*[aeiou]){c}{c}(?:ing|ed)$", rf"\1{c}") for c in "bdgmnprt"]


#: What stems end in that lose an e before -ing and -ed: the first group is the stem.
_SILENT_E = (
    r"^(.*(?:[cvzu]|[^s]s|[bcdfgkptz]l))(?:ing|ed)$",
    r"^(.*(?:[aeiou]|(?:ch|rr|[^aeiouhrsbtlw])an|d|r|l)g)(?:ing|ed)$",
    r"^(.{2,}[^aeiou](?:at|ur|in|id|ad|od|ud|ut))(?:ing|ed)$",
    r"^(.*uir)(?:ing|ed)$",
    r"^([^aeiou]*[aeiou][^aeiouwxy])(?:ing|ed)$",
)
#: The first pattern that a whole word matches gives its lemma; a word that none matches is its own.
NOUN_RULES = [(r"^(.*(?:ss|us|is))$", r"\1"), (r"^(.+[^aeiou])ies$", r"\1y"), (r"^(.+(?:ss|sh|ch|x|zz))es$", r"\1"), (r"^(.+[a-rt-z])s$", r"\1")]
VERB_RULES = [
    (r"^([^aeiouy]*(?:ing|ed)|.*eed)$", r"\1"), (r"^(.*(?:ss|us|is))$", r"\1"), (r"^(.+[^aeiou])(?:ies|ied)$", r"\1y"), (r"^(.+[^aeiou])ying$", r"\1y"), (r"^(.+(?:ss|sh|ch|x|zz|o))es$", r"\1"), (r"^(.+[a-rt-z])s$", r"\1"),
    *_doubled(), *((p, r"\1e") for p in _SILENT_E), (r"^(.+)(?:ing|ed)$", r"\1"),
]


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def format_entity_type(c: Column) -> Column:
    """Without angle brackets, the first letter upper and the others lower case."""
    c = F.btrim(c, F.lit("<>"))
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def format_relation(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: without it, nested steps would copy each other's expressions many times over."""
    return F.transform(F.array(value), body)[0]


def _last_mapped(c: Column, mapped: Callable[[Column], Column]) -> Column:
    """The words of ``c`` with the last one mapped, if the map has it, joined by single spaces."""

    def made(words: Column) -> Column:
        last = F.element_at(words, -1)
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.coalesce(mapped(last), last))), " "))

    return let(F.filter(F.split(c, r"\s+"), lambda w: w != ""), made)


def colloquial(c: Column) -> Column:
    """The last word in standard form."""
    return _last_mapped(c, lambda last: literal_map(COLLOQUIALISMS)[last])


def negated(c: Column) -> Column:
    """Contracted negations in full, as whole words."""
    for short, full in NEGATIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\b", full)
    return c


def by_rules(word: Column, irregular: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    first = F.lit(None).cast("string")
    for pattern, lemma in reversed(rules):
        first = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, lemma.replace("\\1", "$1"))).otherwise(first)
    return F.coalesce(literal_map(irregular)[word], F.when(word.rlike("^[a-z]{3,}$"), first), word)


def lemmatized(c: Column, root: Column) -> Column:
    """The last word's lemma: a noun's for objects and properties, a verb's for others. Only words of small letters have another one."""
    noun = root.isin("object", "property")
    return _last_mapped(c, lambda last: F.when(noun, by_rules(last, IRREGULAR_NOUNS, NOUN_RULES)).otherwise(by_rules(last, IRREGULAR_VERBS, VERB_RULES)))


def spelt(name: Column, type_: Column) -> Column:
    """struct(name, ops): colloquialism, then negation for states; ops that changed the name. What is left is the lemma."""
    root = F.lower(F.substring_index(type_, "/", 1))
    first = F.when(F.trim(name) == "", name).otherwise(colloquial(name))
    told = lambda one, two: F.struct(two.alias("name"), F.array_compact(F.array(F.when(one != name, "colloquialism"), F.when(two != one, "negation"))).alias("ops"))
    return let(first, lambda one: let(F.when(root == "state", negated(one)).otherwise(one), lambda two: told(one, two)))


def normalised(name: Column, type_: Column) -> Column:
    """struct(name, ops): colloquialism, then negation for states, then lemma; ops that changed the name."""
    root = F.lower(F.substring_index(type_, "/", 1))

    def told(one: Column, two: Column, three: Column) -> Column:
        ops = F.array_compact(F.array(F.when(one != name, "colloquialism"), F.when(two != one, "negation"), F.when(three != two, "lemmatize")))
        return F.struct(three.alias("name"), ops.alias("ops"))

    first = F.when(F.trim(name) == "", name).otherwise(colloquial(name))
    second = lambda one: F.when(root == "state", negated(one)).otherwise(one)
    return let(first, lambda one: let(second(one), lambda two: let(lemmatized(two, root), lambda three: told(one, two, three))))


#: In the order in which they are tested.
MESSAGES = ("self-reference", "empty entity surface form", "invalid entity type(s)", "invalid relation type", "invalid triple pattern", "valid")


def validation(head: Column, head_type: Column, relation: Column, tail: Column, tail_type: Column) -> Column:
    """The first failing test of a triple, or ``valid``. What the tests look at is bound once for each row."""
    root = lambda c: F.substring_index(c, "/", 1)
    seen = F.struct(F.trim(head).alias("h"), F.trim(tail).alias("t"), F.lower(head_type).alias("ht"), F.lower(tail_type).alias("tt"), F.lower(relation).alias("r"))
    allowed = [f"{r} {a} {b}" for r, pairs in RELATIONS.items() for a, b in pairs]

    def tested(x: Column) -> Column:
        a, b = root(x["ht"]), root(x["tt"])
        return (
            F.when((x["h"] == x["t"]) & (x["ht"] == x["tt"]), MESSAGES[0])
            .when((x["h"] == "") | (x["t"] == ""), MESSAGES[1])
            .when(~a.isin(*ENTITY_TYPES) | ~b.isin(*ENTITY_TYPES), MESSAGES[2])
            .when(~x["r"].isin(*RELATIONS), MESSAGES[3])
            .when(~F.concat_ws(" ", x["r"], a, b).isin(*allowed), MESSAGES[4])
            .otherwise(MESSAGES[5])
        )

    return let(seen, tested)
