"""SQL for DuckDB that gives the rows of the license scan, the conversation repair and the filter audit, each on a way of its own."""

from __future__ import annotations

from itertools import permutations

from millwright.llm import licenses


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(parts: tuple[licenses.Part, ...]) -> str:
    """A template as a regular expression over words that a space follows each."""
    out = ""
    for p in parts:
        words = [w.decode() for w in p.words]
        out += {"word": lambda: words[0] + " ", "any": lambda: f"(?:{'|'.join(words)}) ", "var": lambda: f"(?:[^ ]+ ){{{p.least},{p.most}}}", "opt": lambda: f"(?:{_pattern(p.parts)})?"}[p.kind]()  # noqa: B023
    return out


def licenses_sql() -> str:
    """Labels by regular expressions, places of phrases by list slices."""
    tests = ", ".join(f"regexp_matches(joined, {_quoted(' ' + _pattern(licenses.parsed(t.markup)))})" for t in licenses.TEMPLATES)
    tried = [(t, f"hit[{k}]") for k, t in enumerate(licenses.TEMPLATES, 1)]
    by_label: dict[str, list[str]] = {}
    for t, test in tried:
        by_label.setdefault(t.label, []).append(test)
    labels = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN {_quoted(label)} END" for label, tests in sorted(by_label.items()))
    kinds = " ".join(f"WHEN {' OR '.join(test for t, test in tried if t.kind == kind)} THEN {weight}::DOUBLE" for kind, weight in licenses.KINDS.items())
    places = ", ".join(f"list_transform(list_filter(range(1, n_words + 1), lambda i: w[i : i + {phrase.count(' ')}] = {phrase.split()}), lambda i: struct_pack(label := {_quoted(label)}, at := i - 1))" for label, phrase in licenses.PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
j AS (SELECT *, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM d),
p AS (SELECT *, flatten([{places}]) AS found, [{tests}] AS hit FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, len(found)::BIGINT AS n_base, list_min(list_transform(found, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(found, lambda x: x.at))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ','), '') AS base_labels,
       array_to_string(list_filter([{labels}], lambda x: x IS NOT NULL), ',') AS labels,
       CASE {kinds} ELSE 0::DOUBLE END AS score,
       array_to_string(list_filter([{', '.join(f"CASE WHEN {test} THEN {_quoted(t.name)} END" for t, test in sorted(tried, key=lambda x: x[0].name))}], lambda x: x IS NOT NULL), ',') AS templates
FROM p
"""


_ORDER = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id"
REPAIR_SQL = rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (
  SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM keyed AS k, t),
after AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS u(n) WHERE hit <> 0),
numbered AS (SELECT *, row_number() OVER ({_ORDER}) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS seen, lag(role[1]) OVER ({_ORDER}) AS before FROM (SELECT *, row_number() OVER () AS id FROM after)),
faults AS (
  SELECT *, role[1] AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, seen > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM numbered),
r AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN again THEN 'duplicate' WHEN cut THEN 'truncated' ELSE '' END AS fault FROM faults),
ids AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
rows_of AS (SELECT c, k, r.role, r.text, i, fault FROM r JOIN ids ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
nxt(f, i, t) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
filled(f, t, edits) AS (
  SELECT f, f, '' FROM (VALUES (''), ('s'), ('u'), ('a')) AS v(f) UNION ALL SELECT f, t, 'I' FROM nxt WHERE i <> 's'
  UNION ALL SELECT a.f, b.t, 'II' FROM nxt AS a JOIN nxt AS b ON a.t = b.f WHERE a.i <> 's' AND b.i <> 's'),
dp AS (
  SELECT c, 0::BIGINT AS k, '' AS state, struct_pack(cost := 0::BIGINT, audit := '') AS best FROM ids
  UNION ALL
  SELECT c, k, state, min(struct_pack(cost := cost, audit := audit)) FROM (
    SELECT x.c, y.k, f.t AS state, best.cost + 2 * length(f.edits) + 3 AS cost, best.audit || f.edits || 'D' AS audit FROM dp AS x JOIN rows_of AS y ON y.c = x.c AND y.k = x.k + 1 JOIN filled AS f ON f.f = x.state
    UNION ALL
    SELECT x.c, y.k, n.t, best.cost + 2 * length(f.edits) + (e.edit = 'R')::BIGINT * 2 + (y.fault = 'truncated')::BIGINT, best.audit || f.edits || e.edit
    FROM dp AS x JOIN rows_of AS y ON y.c = x.c AND y.k = x.k + 1 JOIN filled AS f ON f.f = x.state JOIN nxt AS n ON n.f = f.t JOIN (VALUES ('K'), ('R')) AS e(edit) ON CASE e.edit WHEN 'K' THEN y.i = n.i ELSE n.i <> 's' END
    WHERE y.fault NOT IN ('blank', 'duplicate'))
  GROUP BY c, k, state),
last AS (SELECT c, coalesce(max(k), 0) AS k FROM ids LEFT JOIN rows_of USING (c) GROUP BY c),
ended AS (
  SELECT c, min(struct_pack(cost := best.cost + 2 * length(f.edits), audit := best.audit || f.edits)) AS best
  FROM dp JOIN last USING (c, k) JOIN filled AS f ON f.f = dp.state AND f.t IN ('', 'a') GROUP BY c),
edits AS (SELECT c, p, best.audit[p] AS edit, length(replace(best.audit[1 : p], 'I', '')) AS k, length(replace(best.audit[1 : p], 'D', '')) AS j FROM ended, unnest(range(1, length(best.audit) + 1)) AS u(p)),
stays AS (SELECT e.c, e.p, e.edit, e.j, y.role, y.text, max(coalesce((e.j = 1 AND e.edit = 'K' AND y.i = 's')::BIGINT, 0)) OVER (PARTITION BY e.c) AS s FROM edits AS e LEFT JOIN rows_of AS y ON y.c = e.c AND y.k = e.k AND e.edit <> 'I' WHERE e.edit <> 'D'),
said AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM stays GROUP BY c),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ids JOIN ended USING (c) LEFT JOIN said USING (c) LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

FILTERS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
orders(o) AS (VALUES {', '.join(f"('{''.join(p)}')" for p in permutations('ABCDE'))}),
steps AS (SELECT o, s::INT AS s, o[s] AS own, o[1 : s - 1] AS before FROM orders, unnest(range(1, 6)) AS u(s)),
m AS (
  SELECT part, o, s, own, n, good, toxic, fails[strpos('ABCDE', own)] AS fails_own, len(list_filter(string_split('ABCDE', ''), lambda x: strpos(before, x) > 0 AND fails[strpos('ABCDE', x)])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS k
  FROM g, steps),
x AS (
  SELECT part, o AS filter_order, s AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails_own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_own), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails_own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_own AND k = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails_own), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_own), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
"""
