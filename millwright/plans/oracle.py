"""SQL building blocks that restate the engine's tables for an independent engine."""

from __future__ import annotations

from millwright.functions import text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def cases(expr: str, pairs: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in pairs.items()) + " END"


def correct(x: str, corrections: dict[str, str] = text.CORRECTIONS) -> str:
    for wrong, right in text.ordered(corrections):
        x = f"regexp_replace({x}, {quoted(rf'\b{wrong}\b')}, {quoted(f' {right} ')}, 'g')"
    return x


def preserve(x: str) -> str:
    return rf"regexp_replace({x}, '[^a-zA-Z0-9 ,&.#@/\-\[\]()]', ' ', 'g')"


def single_marks(x: str) -> str:
    for mark in text.PRESERVED:
        x = f"regexp_replace({x}, {quoted(rf'\{mark}' + '{2,}')}, {quoted(mark)}, 'g')"
    return x


def drop_mixed(x: str) -> str:
    return rf"regexp_replace({x}, '\b(?:[A-Za-z]+\d|\d+[A-Za-z])\w*\b', ' ', 'g')"


def mask_numbers(x: str) -> str:
    return rf"regexp_replace({x}, '\b\d+\b', ' <num> ', 'g')"


def spell_marks(x: str) -> str:
    for old, new in ((",", " , "), (".", " "), ("[", "("), ("]", ")"), ("(", " ( "), (")", " ) "), ("&", " and "), ("#", " number "), ("@", " at ")):
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    return x


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean(x: str) -> str:
    x = f"replace({x}, {quoted(chr(39))}, '')"
    return squeeze(correct(f"lower({spell_marks(mask_numbers(drop_mixed(correct(single_marks(preserve(x))))))})"))


PER_ORDER = """
per AS (SELECT l_orderkey AS id, sum(l_quantity) AS "time", min(p_name) AS p_name, max(l_returnflag) AS flag FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
wo AS (
  SELECT o_orderkey AS id, o_orderpriority AS type,
         p.p_name || CASE p.flag WHEN 'R' THEN ' temp sensor (LH) blwn..' WHEN 'A' THEN ' repl hyd. filter @ cab' ELSE ' c/o & insp #2 pump - 2 way valve!!' END AS text,
         n_name AS floc, CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS cost, p."time" AS "time"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per AS p ON o_orderkey = p.id)
"""

# Fixed values, restated for the SQL.
ALLOWED = {
    "has_patient": [("activity", "activity"), ("activity", "state"), ("activity", "process"), ("activity", "object"), ("process", "object"), ("state", "activity"), ("state", "object")],
    "has_agent": [("state", "object"), ("process", "object"), ("activity", "object")],
    "contains": [("object", "object")],
    "has_part": [("object", "object")],
    "has_property": [("object", "property"), ("state", "property")],
    "is_a": [("object", "object"), ("activity", "activity"), ("process", "process"), ("property", "property"), ("state", "state")],
}
TYPES = ("object", "activity", "process", "property", "state")
STANDARD = {"conditioning": "conditioner", "piping": "pipe", "leaky": "leak"}
FULL = {"wont": "will not", "won't": "will not", "wouldnt": "would not", "wouldn't": "would not", "dont": "does not", "don't": "does not", "doesnt": "does not", "doesn't": "does not"}

_LI = """
li AS (
  SELECT *, string_split(p_name, ' ')[-1] AS component, string_split(p_name, ' ')[1] AS adjective,
         (['oil leak', 'leaky', 'no power', 'wont start', 'not working'])[l_linenumber % 5 + 1] AS state,
         CASE l_returnflag WHEN 'R' THEN (['oil leak', 'leaky', 'no power', 'wont start', 'not working'])[l_linenumber % 5 + 1]
              WHEN 'A' THEN (['replacing', 'repairs', 'inspect'])[l_linenumber % 3 + 1] ELSE (['transport', 'isolated'])[l_linenumber % 2 + 1] END AS h,
         CASE l_returnflag WHEN 'R' THEN '<state>' ELSE '<activity>' END AS ht
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
_RAW = [
    ("h, ht, component, '<object>', 'has patient'", "true"),
    ("h, ht, p_brand, '<object>', 'has agent'", "l_returnflag = 'R' AND l_linenumber % 5 <= 1"),
    ("p_brand, '<object>', component, '<object>', 'has part'", "l_linenumber % 2 = 0"),
    ("p_name, '<object>', component, '<object>', 'is a'", "l_linenumber % 3 = 0"),
    ("component, '<object>', adjective, '<property>', 'has property'", "l_linenumber = 5"),
    ("p_brand, '<object>', p_type, '<object>', 'contains'", "l_linenumber = 4"),
    ("component, '<object>', component, '<object>', 'has part'", "l_linenumber = 6"),
    ("'', '<object>', component, '<object>', 'has part'", "l_linenumber = 7"),
    ("component, '<thing>', p_brand, '<object>', 'has part'", "l_quantity >= 49"),
    ("component, '<object>', p_brand, '<object>', 'has participant'", "l_quantity <= 1"),
    ("component, '<object>', state, '<state>', 'has patient'", "l_quantity = 10"),
]
RAW = _LI + ",\nraw(record_id, head, head_type, tail, tail_type, relation) AS (\n" + "\nUNION ALL ".join(f"SELECT l_orderkey, {cols} FROM li WHERE {cond}" for cols, cond in _RAW) + ")\n"


def _format_type(c: str) -> str:
    return f"upper(left(trim({c}, '<>'), 1)) || lower(substr(trim({c}, '<>'), 2))"


def _root(c: str) -> str:
    return f"lower(split_part({c}, '/', 1))"


def validation(h: str, ht: str, r: str, t: str, tt: str) -> str:
    pairs = " OR ".join(f"(lower({r}) = '{name}' AND ({_root(ht)}, {_root(tt)}) IN ({', '.join(map(str, allowed))}))" for name, allowed in ALLOWED.items())
    return f"""CASE WHEN trim({h}) = trim({t}) AND lower({ht}) = lower({tt}) THEN 'self-reference'
      WHEN trim({h}) = '' OR trim({t}) = '' THEN 'empty entity surface form'
      WHEN {_root(ht)} NOT IN {listed(TYPES)} OR {_root(tt)} NOT IN {listed(TYPES)} THEN 'invalid entity type(s)'
      WHEN lower({r}) NOT IN {listed(ALLOWED)} THEN 'invalid relation type'
      WHEN NOT ({pairs}) THEN 'invalid triple pattern' ELSE 'valid' END"""


FORMATTED = f"""
f0 AS (SELECT record_id, head, {_format_type('head_type')} AS head_type, tail, {_format_type('tail_type')} AS tail_type, upper(replace(relation, ' ', '_')) AS relation FROM raw),
formatted AS (SELECT *, {validation('head', 'head_type', 'relation', 'tail', 'tail_type')} AS message FROM f0)
"""


def _tokens(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


def _last(tokens: str, mapped: str) -> str:
    return f"CASE WHEN len({tokens}) = 0 THEN '' ELSE array_to_string(list_concat({tokens}[1:len({tokens}) - 1], [coalesce({mapped}, {tokens}[-1])]), ' ') END"


def _negated(c: str) -> str:
    for short, full in FULL.items():
        c = f"regexp_replace({c}, {quoted(rf'\b{short}\b')}, {quoted(full)}, 'g')"
    return c


# Worked out by hand: what becomes of the last words of names that the given tables have, by part of speech; all others are lemmas.
VERB_LEMMAS = {"working": "work", "replacing": "replace", "repairs": "repair", "isolated": "isolate"}
NOUN_LEMMAS: dict[str, str] = {}


def _lemma(side: str) -> str:
    word = f"{side}_k[-1]"
    one = lambda known: f"coalesce({cases(word, known)}, {word})" if known else word
    return f"CASE WHEN {_root(f'{side}_type')} IN ('object', 'property') THEN {one(NOUN_LEMMAS)} ELSE {one(VERB_LEMMAS)} END"


NORMALISED = f"""
z1 AS (SELECT *, {_tokens('head')} AS head_k, {_tokens('tail')} AS tail_k FROM formatted WHERE message = 'valid'),
z2 AS (SELECT * EXCLUDE (head_k, tail_k), {_last('head_k', cases('head_k[-1]', STANDARD))} AS head_1, {_last('tail_k', cases('tail_k[-1]', STANDARD))} AS tail_1 FROM z1),
z3 AS (SELECT *, CASE WHEN {_root('head_type')} = 'state' THEN {_negated('head_1')} ELSE head_1 END AS head_2, CASE WHEN {_root('tail_type')} = 'state' THEN {_negated('tail_1')} ELSE tail_1 END AS tail_2 FROM z2),
z4 AS (SELECT *, {_tokens('head_2')} AS head_k, {_tokens('tail_2')} AS tail_k FROM z3),
z5 AS (SELECT *, {_last('head_k', _lemma('head'))} AS head_3, {_last('tail_k', _lemma('tail'))} AS tail_3 FROM z4),
gaz(type, name, path) AS (VALUES GAZETTEER),
normalised AS (
  SELECT record_id, head_3 AS head, coalesce(a.path, z5.head_type) AS head_type, relation, tail_3 AS tail, coalesce(b.path, z5.tail_type) AS tail_type,
         list_filter([CASE WHEN head_1 <> z5.head THEN 'colloquialism' END, CASE WHEN head_2 <> head_1 THEN 'negation' END, CASE WHEN head_3 <> head_2 THEN 'lemmatize' END], lambda x: x IS NOT NULL) AS head_ops,
         list_filter([CASE WHEN tail_1 <> z5.tail THEN 'colloquialism' END, CASE WHEN tail_2 <> tail_1 THEN 'negation' END, CASE WHEN tail_3 <> tail_2 THEN 'lemmatize' END], lambda x: x IS NOT NULL) AS tail_ops
  FROM z5 LEFT JOIN gaz AS a ON a.type = z5.head_type AND a.name = z5.head_3 LEFT JOIN gaz AS b ON b.type = z5.tail_type AND b.name = z5.tail_3),
triples AS (SELECT record_id, head, head_type, relation, tail, tail_type FROM normalised WHERE {validation('head', 'head_type', 'relation', 'tail', 'tail_type')} = 'valid')
"""

SCORED = """
n AS (SELECT count(*)::DOUBLE AS n FROM triples),
counts AS (SELECT head, relation, tail, count(*) AS frequency FROM triples GROUP BY ALL),
fh AS (SELECT head, count(*) AS k FROM triples GROUP BY 1), fr AS (SELECT relation, count(*) AS k FROM triples GROUP BY 1), ft AS (SELECT tail, count(*) AS k FROM triples GROUP BY 1),
stats AS (
  SELECT c.head, c.relation, c.tail, c.frequency, c.frequency / n.n AS probability, ln((c.frequency / n.n) / ((fh.k / n.n) * (fr.k / n.n) * (ft.k / n.n))) AS pmi
  FROM counts AS c JOIN fh USING (head) JOIN fr USING (relation) JOIN ft USING (tail), n),
occurrences AS (SELECT t.*, s.frequency, s.probability, s.pmi FROM triples AS t JOIN stats AS s USING (head, relation, tail)),
bounds AS (
  SELECT median(pmi) AS median, quantile_cont(pmi, 0.25) - 1.5 * (quantile_cont(pmi, 0.75) - quantile_cont(pmi, 0.25)) AS lower,
         quantile_cont(pmi, 0.75) + 1.5 * (quantile_cont(pmi, 0.75) - quantile_cont(pmi, 0.25)) AS upper FROM occurrences),
surviving AS (SELECT o.* FROM occurrences AS o, bounds AS b WHERE NOT (frequency = 1 AND (pmi < lower OR pmi > upper))),
record_edges AS (SELECT DISTINCT record_id, head_type, head, relation, tail_type, tail, frequency, probability, pmi FROM surviving),
edges AS (SELECT DISTINCT head_type, head, relation, tail_type, tail, frequency, probability, pmi FROM record_edges),
mentions AS (SELECT record_id, head_type AS label, head AS name FROM record_edges UNION SELECT record_id, tail_type, tail FROM record_edges),
m AS (SELECT record_id, relation, head_type AS n_label, head AS n, tail_type AS m_label, tail AS m FROM record_edges WHERE head <> tail OR head_type <> tail_type),
mu AS (SELECT * FROM m UNION ALL SELECT record_id, relation, m_label, m, n_label, n FROM m)
"""


def sql(body: str, *parts: str) -> str:
    """A statement over the named parts, in the order in which they depend on each other."""
    from millwright.sources.tables import GAZETTEER

    rows = ", ".join(f"({quoted(t)}, {quoted(n)}, {quoted(p)})" for t, pairs in GAZETTEER.items() for n, p in dict(pairs).items())
    known = {"wo": PER_ORDER, "raw": RAW, "formatted": FORMATTED, "triples": NORMALISED.replace("GAZETTEER", rows), "stats": SCORED}
    chain = {"wo": ["wo"], "raw": ["raw"], "formatted": ["raw", "formatted"], "triples": ["raw", "formatted", "triples"], "stats": ["raw", "formatted", "triples", "stats"]}
    wanted = list(dict.fromkeys(x for p in parts for x in chain[p]))
    return ("WITH " + ",".join(known[x].strip() for x in wanted) + "\n" if wanted else "") + body
