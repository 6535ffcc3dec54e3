"""Text steps, scalar functions, set operations and model-output parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import naming, parse, text, training
from millwright.operators import batches, competency, extract, lemmas, sampling, summary
from millwright.plans import oracle as o
from millwright.plans.registry import query
from millwright.sources.tables import table

T = "SELECT conv_id, turn, {} AS out FROM conversations"


def _step(name: str, spark_step, sql_step: str | None) -> None:
    """A step of the clean-up over the texts of conversations."""
    query(name, T.format(sql_step) if sql_step else None)(lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", spark_step(F.col("text")).alias("out")))


_step("f01_clean", text.clean, o.clean("text"))
_step("f02_site_codes", lambda c: text.strip_codes(c, ["the", "and.", "is"]), r"regexp_replace(text, '(?i)\b(the|and\.|is)\b', ' ', 'g')")
_step("f03_apostrophes", lambda c: F.replace(F.replace(c, F.lit("e"), F.lit("'")), F.lit("'"), F.lit("")), "replace(replace(text, 'e', ''''), '''', '')")
_step("f04_preserve", text.preserve, o.preserve("text"))
_step("f05_single_marks", lambda c: text.single_marks(F.replace(c, F.lit("a"), F.lit("##"))), o.single_marks("replace(text, 'a', '##')"))
_step("f06_corrections", lambda c: text.correct(text.preserve(c)), o.correct(o.preserve("text")))
_step("f07_mixed_tokens", lambda c: text.drop_mixed_tokens(text.preserve(c)), o.drop_mixed(o.preserve("text")))
_step("f08_numbers", text.mask_numbers, o.mask_numbers("text"))
_step("f09_f13_marks", text.spell_marks, o.spell_marks("text"))
_step("f15_lower_correct", lambda c: text.correct(F.lower(text.preserve(c))), o.correct(f"lower({o.preserve('text')})"))
_step("f16_squeeze", text.squeeze, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
_step("f20_entity_type", naming.format_entity_type, o._format_type("text"))
_step("f21_f23_relation_type", naming.format_relation, "upper(replace(replace(text, ' ', '_'), 'ß', 'ss'))")
_step("f25_negations", lambda c: naming.negated(F.replace(c, F.lit("the"), F.lit("wont"))), o._negated("replace(text, 'the', 'wont')"))
#: As long as an input of the extraction model may be.
LENGTH = 512
_BYTES = "SELECT i, CASE WHEN i <= n THEN ('0x' || h[2 * i - 1:2 * i])::INTEGER + 3 WHEN i = n + 1 THEN 1 ELSE 0 END AS x FROM (SELECT hex(encode(text)) AS h, least(length(hex(encode(text))) // 2, {most}) AS n), unnest(range(1, {to})) AS u(i)"
_step("s11_t02_byte_tokens", lambda c: F.array_join(training.byte_tokens(c, LENGTH), ","), f"(SELECT string_agg(x::VARCHAR, ',' ORDER BY i) FROM ({_BYTES.replace('{most}', str(LENGTH - 1)).replace('{to}', str(LENGTH + 1))}))")


@query("s11_f59_batched_ids", f"SELECT conv_id, turn, (SELECT string_agg(x::VARCHAR, ',' ORDER BY i) FROM ({_BYTES.replace('{most}', str(LENGTH - 1)).replace('{to}', str(LENGTH + 1))}) WHERE x > 0) AS ids, true AS fits FROM conversations")
def s11(spark, d):
    """Ids of texts in batches by length, padded to the longest of each: without the padding they are those of the texts alone."""
    df = table(spark, d, "conversations").select("conv_id", "turn", training.byte_ids(F.col("text"), LENGTH).alias("ids")).withColumn("n", F.size("ids"))
    batched = batches.by_length(df, "n", most_padded=1 << 14).withColumn("padded", training.padded(F.col("ids"), F.col("longest")))
    fits = (F.size("padded") == F.col("longest")) & (F.col("longest") >= F.col("n"))
    return batched.select("conv_id", "turn", F.array_join(F.filter("padded", lambda x: x != training.PAD), ",").alias("ids"), fits.alias("fits"))


@query("f24_colloquialism", "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' conditioner' WHEN 1 THEN ' pipe' WHEN 2 THEN ' leak' ELSE ' leaky hose' END AS out FROM part")
def f24(spark, d):
    last = F.element_at(F.array(*map(F.lit, (" conditioning", " piping", " leaky", " leaky hose"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", naming.colloquial(F.concat("p_name", last)).alias("out"))


#: Name, root type and what becomes of it, by hand.
LEMMAS = [
    ("two rings", "object", "two ring"), ("oil leaks", "state", "oil leak"), ("batteries", "object", "battery"), ("replacing", "activity", "replace"), ("has blown", "state", "has blow"), ("limit switches", "object", "limit switch"),
    ("hoses", "object", "hose"), ("fuses", "object", "fuse"), ("chassis", "object", "chassis"), ("glass", "object", "glass"), ("valves", "object", "valve"), ("knives", "object", "knife"), ("grease lines", "object", "grease line"),
    ("tripping", "state", "trip"), ("stopped", "state", "stop"), ("overheated", "state", "overheat"), ("seized", "state", "seize"), ("isolated", "activity", "isolate"), ("lubricating", "process", "lubricate"),
    ("wiring", "process", "wire"), ("charging", "process", "charge"), ("changed", "activity", "change"), ("hanging", "state", "hang"), ("dried", "process", "dry"), ("corroded", "state", "corrode"), ("fitted", "activity", "fit"),
    ("welding", "activity", "weld"), ("throttling", "process", "throttle"), ("missing", "state", "miss"), ("measured", "activity", "measure"), ("repairs", "activity", "repair"), ("bleed", "activity", "bleed"), ("spring", "activity", "spring"),
    ("is broken", "state", "is break"), ("unknowns", "object", "unknown"), ("Brand#13", "object", "Brand#13"), ("ECUs", "object", "ECUs"), ("", "object", ""),
]


@query("f26_lemma", "SELECT p_partkey, p_name || ' ' || out AS out FROM part JOIN (VALUES " + ", ".join(f"({k}, '{lemma}')" for k, (_, _, lemma) in enumerate(LEMMAS)) + f") AS v(k, out) ON k = p_partkey % {len(LEMMAS)} WHERE out <> ''")
def f26(spark, d):
    """Rules alone, on a given name and what follows it."""
    k = (F.col("p_partkey") % len(LEMMAS) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in LEMMAS)), k)
    df = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", pick(0)).alias("s"), pick(1).alias("root"), pick(0).alias("own")).filter("own <> ''")
    return df.select("p_partkey", naming.lemmatized(F.col("s"), F.col("root")).alias("out"))


@query("f26_attested_lemmas", "SELECT DISTINCT split_part(p_name, ' ', 2) || e AS name, root, split_part(p_name, ' ', 2) AS lemma FROM part, (VALUES ('s', 'object'), ('s', 'state'), ('ed', 'activity'), ('ing', 'process'), ('', 'object')) AS v(e, root)")
def f26_attested(spark, d):
    """Forms of the words that parts are named by, and the corpus of their names as the vocabulary."""
    words = table(spark, d, "part").select(F.element_at(F.split("p_name", " "), 2).alias("w")).distinct()
    forms = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(root).alias("root")) for e, root in (("s", "object"), ("s", "state"), ("ed", "activity"), ("ing", "process"), ("", "object"))))
    names = words.select("w", F.explode(forms).alias("f")).select(F.concat("w", "f.e").alias("name"), "f.root")
    return lemmas.lemmatized(names, lemmas.word_counts(table(spark, d, "part"), "p_name"), "name", "root").select("name", "root", "lemma")


@query("f53_date_text", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS out FROM orders")
def f53(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", text.java_format("%d/%m/%Y")).alias("out"))


@query("f54_skewed_number", "SELECT p_partkey, trunc(CASE WHEN u < 0.05::DOUBLE THEN 10 + sqrt(u * 0.05::DOUBLE) * 84 ELSE 94 - sqrt((1 - u) * 0.95::DOUBLE) * 84 END)::INTEGER AS x FROM (SELECT p_partkey, (p_partkey % 1000)::DOUBLE / 1000 AS u FROM part)")
def f54(spark, d):
    return table(spark, d, "part").select("p_partkey", sampling.skewed((F.col("p_partkey") % 1000).cast("double") / 1000, 10, 94).alias("x"))


@query("f55_f56_arithmetic", "SELECT o_orderkey, round(ln(o_totalprice), 9) AS ln, round_even(o_totalprice * 100, 0)::DOUBLE AS even, abs(-o_totalprice) AS a, o_custkey // 7 AS q FROM orders")
def f55(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log("o_totalprice"), 9).alias("ln"), F.bround(F.col("o_totalprice") * 100, 0).alias("even"), F.abs(-F.col("o_totalprice")).alias("a"), F.expr("o_custkey div 7").alias("q"))


@query("f57_activity_type", "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'Maintenance' ELSE 'Supporting' END AS out FROM part")
def f57(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "MaintenanceActivity/").otherwise("SupportingActivity/")
    return table(spark, d, "part").select("p_partkey", competency.activity_type(F.concat(F.lit("Activity/"), kind, "p_type")).alias("out"))


@query("f58_unwind_positions", "SELECT conv_id, turn, i - 1 AS pos, w[i] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS u(i)")
def f58(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("f60_key_join", "SELECT p_partkey, p_name || ', ' || p_brand || ', ' || p_type AS key FROM part")
def f60(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_brand", "p_type").alias("key"))


@query("f61_so7_map_merge", "SELECT s_suppkey, 'b' || s_nationkey AS k1, 'a' AS k2 FROM supplier")
def f61(spark, d):
    """Two maps merged, the right one winning, without a session setting: keys of the right one are taken out of the left one first."""
    left = F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("a"))
    right = F.create_map(F.lit("x"), F.concat(F.lit("b"), F.col("s_nationkey").cast("string")))
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(F.create_map(F.lit("x"), F.lit("")), "x") | (k != "x")), right)
    return table(spark, d, "supplier").select("s_suppkey", merged["x"].alias("k1"), merged["y"].alias("k2"))


@query("f62_json", "SELECT event_id, (props->>'k')::BIGINT AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || (props->>'k') || '}' AS dumped, event_type AS loaded FROM events")
def f62(spark, d):
    """Loaded with a schema, dumped with another field, and loaded again."""
    loaded = table(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    dumped = loaded.withColumn("dumped", F.to_json(F.struct("event_type", "k")))
    return dumped.select("event_id", "k", "dumped", F.from_json("dumped", "event_type string, k long")["event_type"].alias("loaded"))


@query("f64_learning_rate", "SELECT s AS step, round(CASE WHEN s < 1000 THEN (1e-7::DOUBLE + s * ((5e-5::DOUBLE - 1e-7::DOUBLE) / 1000)) / 5e-5::DOUBLE ELSE sqrt(1000::DOUBLE) * s ** -0.5::DOUBLE END, 12) AS lr FROM (SELECT o_orderkey AS s FROM orders)")
def f64(spark, d):
    """The curve at the steps that orders number."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.round(training.learning_rate(F.col("o_orderkey")), 12).alias("lr"))


@query("f65_f66_shift_mask", "SELECT conv_id, turn, list_concat(a[2:], [0]) AS shifted, list_transform(a, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS masked FROM (SELECT conv_id, turn, [conv_id::INTEGER, turn::INTEGER, 0, 0] AS a FROM conversations)")
def f65(spark, d):
    a = F.array(F.col("conv_id").cast("int"), F.col("turn").cast("int"), F.lit(0), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", training.shift_left(a, 0).alias("shifted"), training.mask(a, 0).alias("masked"))


@query("so2_so3_distinct_union", "SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part)")
def so2(spark, d):
    return table(spark, d, "part").select(F.explode(F.array("p_brand", "p_type")).alias("name")).distinct()


@query("so4_vocabulary", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_concat(string_split(p_name, ' '), [p_brand]), lambda x: x <> string_split(p_name, ' ')[1]))) AS vocab FROM part")
def so4(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_except(F.array_union(words, F.array("p_brand")), F.array(words[0]))).alias("vocab"))


@query("so5_bag_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def so5(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("so6_bag_difference", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def so6(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("j15_zip", "SELECT p_partkey, i - 1 AS pos, string_split(p_name, ' ')[i] AS word, upper(string_split(p_name, ' ')[i]) AS up FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS u(i)")
def j15(spark, d):
    """Two lists of equal length side by side; other lengths are an error."""
    a = F.split("p_name", " ")
    b = F.split(F.upper("p_name"), " ")
    zipped = F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("word"), b.alias("up"))).otherwise(F.raise_error(F.lit("lists of different lengths")))
    return table(spark, d, "part").select("p_partkey", F.posexplode(zipped).alias("pos", "z")).select("p_partkey", F.col("pos").cast("long").alias("pos"), F.col("z.word").alias("word"), F.col("z.up").alias("up"))


# Model outputs: strings that a model could give, made from parts.
_OUT = "'<norm> ' || split_part(p_name, ' ', 1) || ' [ ' || p_brand || ' ] <entity> ' || split_part(p_name, ' ', 2) || ' <object> <relation> leak <state> ' || split_part(p_name, ' ', 2) || ' <object> has patient <relation> ' || split_part(p_name, ' ', 2) || ' <object> ' || split_part(p_name, ' ', 2) || ' <object> is a'"


def outputs(spark, d):
    one, two = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2)
    pieces = (F.lit("<norm> "), one, F.lit(" [ "), F.col("p_brand"), F.lit(" ] <entity> "), two, F.lit(" <object> <relation> leak <state> "), two, F.lit(" <object> has patient <relation> "), two, F.lit(" <object> "), two, F.lit(" <object> is a"))
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("input"), F.concat(*pieces).alias("output"))


@query("f30_sections", "SELECT p_partkey, split_part(p_name, ' ', 1) || ' [ ' || p_brand || ' ]' AS norm, split_part(p_name, ' ', 2) || ' <object>' AS entity, 2 AS n_relations FROM part")
def f30(spark, d):
    s = parse.sections(F.col("output"))
    df = outputs(spark, d).withColumn("s", s)
    of = lambda k: F.transform(F.filter("s", lambda x: x["kind"] == k), lambda x: F.array_join(x["tokens"], " "))
    return df.select("p_partkey", of("norm")[0].alias("norm"), of("entity")[0].alias("entity"), F.size(of("relation")).alias("n_relations"))


@query("f31_abbreviations", "SELECT p_partkey, [p_brand, p_type] AS oov, [p_name, ''] AS iv FROM part")
def f31(spark, d):
    pairs = parse.abbreviations(F.concat("p_brand", F.lit(" [ "), "p_name", F.lit(" ] "), "p_type"))
    return table(spark, d, "part").withColumn("p", pairs).select("p_partkey", F.col("p.oov").alias("oov"), F.col("p.iv").alias("iv"))


@query("f32_triples", "SELECT p_partkey, 'leak' AS head, '<state>' AS head_type, split_part(p_name, ' ', 2) AS tail, '<object>' AS tail_type, 'has patient' AS relation FROM part")
def f32(spark, d):
    t = parse.triple(F.filter(parse.sections(F.col("output")), lambda x: x["kind"] == "relation")[0]["tokens"])
    return outputs(spark, d).withColumn("t", t).select("p_partkey", "t.*")


#: Outputs of eight shapes, by p_partkey; one and two are the words of p_name.
SHAPES = (
    "<norm> {one} [ {brand} ] <entity> {two} <object> <relation> leak <state> {two} <object> has patient <relation> {two} <object> {two} <object> is a",
    "",
    "{one} {two}",
    "<entity> {two} <object>",
    "<norm> {one} [ x ] {one} [ x ] <entity> {two} <object> <entity> {two} <object> <relation> leak <state> {two} <object> has patient <relation> leak <state> {two} <object> has patient",
    "<norm> {one} [ {one} ] zzz [ y ] <entity> {two} <thing> <relation> {two} <object> leak <state> has patient <relation> leak <state> {two} <object> has friend",
    "<entity> lone <relation> leak <thing> {two} <object> is a",
    "<entity> {one} {two} <object>",
)


def shaped(spark, d):
    one, two = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), 2)
    out = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    for name, c in (("{one}", one), ("{two}", two), ("{brand}", F.col("p_brand"))):
        out = F.replace(out, F.lit(name), c)
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("input"), out.alias("output"))


COUNTERS = ("norm_duplicates", "norm_self_references", "norm_invalid_oov", "entity_duplicates", "entity_type_invalidation", "relation_duplicates", "relation_self_references", "relation_rule_invalidation", "relation_type_invalidation", "fatal_error")
#: Worked out by hand: shape; norms, entities, relations that stay; the counters in their order; passed.
EXPECTED = (
    (0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, True), (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, True), (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, False), (3, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, True),
    (4, 1, 1, 1, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, True), (5, 0, 0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0, True), (6, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, True), (7, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, True),
)


@query("f33_f39_structured", f"SELECT p_partkey, v.* EXCLUDE (shape) FROM part JOIN (VALUES {', '.join(map(str, EXPECTED))}) AS v(shape, n_norms, n_entities, n_relations, {', '.join(COUNTERS)}, passed) ON shape = p_partkey % {len(SHAPES)}")
def f38(spark, d):
    df = shaped(spark, d).withColumn("r", parse.structured(F.col("input"), F.col("output")))
    return df.select("p_partkey", F.size("r.norms").alias("n_norms"), F.size("r.entities").alias("n_entities"), F.size("r.relations").alias("n_relations"), *(F.col(f"r.issues.{c}").alias(c) for c in COUNTERS), F.col("r.passed").alias("passed"))


@query("a07_coverage", "SELECT count(*) FILTER (s IN (1, 2, 5, 7)) AS texts_no_ie, count(*) FILTER (s = 3) AS texts_entity_only, count(*) AS n FROM (SELECT p_partkey % 8 AS s FROM part)")
def a07(spark, d):
    """Records whose prediction has nothing, or entities alone."""
    r = shaped(spark, d).select(parse.structured(F.col("input"), F.col("output")).alias("r"))
    return summary.coverage(r.select("r.entities", "r.relations"))


KNOWN = ("ring", "bolt", "anvil", "widget", "gear", "gizmo", "rod", "plate")


class Flaky(extract.DictionaryExtractor):
    """Fails, with the whole batch, on inputs that hold a word."""

    def outputs(self, inputs: list[str]) -> list[str]:
        if any("anvil" in x for x in inputs):
            raise RuntimeError("no output for an anvil")
        return super().outputs(inputs)


@query("u02_u04_extraction", "SELECT DISTINCT p_name AS input, 'entity' AS kind, split_part(p_name, ' ', 2) AS name FROM part")
def u02(spark, d):
    """A pluggable model over distinct inputs, loaded by each worker; the default one knows a list of components."""
    inputs = table(spark, d, "part").select(F.col("p_name").alias("input"))
    found = extract.predictions(inputs, lambda: extract.DictionaryExtractor(dict.fromkeys(KNOWN, "object")))
    return found.select("input", F.lit("entity").alias("kind"), F.explode(F.expr("transform(entities, e -> e[0])")).alias("name"))


@query("j02_predictions_to_records", f"SELECT p_partkey, NOT contains(p_name, 'anvil') AS predicted, CASE WHEN contains(p_name, 'anvil') THEN 0 ELSE len(list_filter(string_split(p_name, ' '), lambda x: x IN {o.listed(KNOWN)})) END AS n_entities FROM part")
def j02(spark, d):
    """Predictions of distinct inputs joined to all records; an input that fails takes no other with it, and its records stay."""
    records = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("input"))
    found, _, _ = extract.run(records, Flaky(dict.fromkeys(KNOWN, "object")), None)
    return found.select("p_partkey", "predicted", F.size("entities").alias("n_entities"))


@query("u04_k04_failed_inputs", "SELECT DISTINCT p_name AS input FROM part WHERE contains(p_name, 'anvil')")
def u04(spark, d):
    """What a second run, with the first one's cache, still can't predict; the cache spares all other inputs the model."""
    records = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("input"))
    _, cache, _ = extract.run(records, Flaky(dict.fromkeys(KNOWN, "object")), None)
    _, _, failed = extract.run(records, Flaky({}), cache)
    return spark.read.schema("input string").json(failed)
