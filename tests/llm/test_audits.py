"""License scans, conversation repair and the filter audit: against brute force, enumeration, edge rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millwright.llm import conversations, decontaminate, interactions, licenses, site_quality, toxicity
from millwright.llm.common import SPACES

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]"


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in ("found", "kind", "part", "mask", "run", "print", "role_", "first", "again", "there", "n_words", "a.b", "step", "least")})


# --- licenses


def brute_licenses(text):
    """Templates by one regular expression each over words, phrases by comparing lists."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " " + "".join(x + " " for x in w)

    def pattern(parts):
        out = ""
        for p in parts:
            words = [re.escape(x.decode()) for x in p.words]
            out += {"word": lambda: words[0] + " ", "any": lambda: f"(?:{'|'.join(words)}) ", "var": lambda: f"(?:[^ ]+ ){{{p.least},{p.most}}}", "opt": lambda: f"(?:{pattern(p.parts)})?"}[p.kind]()  # noqa: B023
        return out

    found = [t for t in licenses.TEMPLATES if re.search(" " + pattern(licenses.parsed(t.markup)), joined)]
    places = [i for p in licenses.PHRASES.values() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = sorted({label for label, p in licenses.PHRASES.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))})
    score = max((licenses.KINDS[t.kind] for t in found), default=0.0)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({t.label for t in found})), score, ",".join(sorted(t.name for t in found)))


def wording(rng, parts):
    """A text that a template accepts, with optional regions left out or not."""
    out = []
    for p in parts:
        if p.kind == "opt":
            out += wording(rng, p.parts) if rng.random() < 0.5 else []
        elif p.kind == "var":
            out += [rng.choice(("Jane", "Doe", "2024", "é")) for _ in range(rng.randint(p.least, p.most))]
        else:
            out.append(rng.choice(p.words).decode())
    return out


def test_licenses_match_brute_force(spark):
    rng = random.Random(11)
    made = []
    for t in licenses.TEMPLATES:
        for change in (None, "drop", "swap", "upper"):
            w = wording(rng, licenses.parsed(t.markup))
            if change == "drop":
                del w[rng.randrange(len(w))]
            if change == "swap":
                w[rng.randrange(len(w))] = "other"
            text = rng.choice([" ", ", ", "\n  "]).join(w)
            made.append(f"aa bb {text.upper() if change == 'upper' else text}. cc")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(made)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "mit license mit license. MIT-License"), (20_003, "x"), (None, "Apache License CC BY"), (20_004, "MİT license"), (20_005, "mit license " * 20_000), (20_006, "copyright " * 3000)]
    got = licenses.digest(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_licenses(t)) for i, t in rows)


def test_mandatory_wording_must_be_exact_and_optional_regions_may_go():
    a = licenses.Automaton([licenses.Template("t", "t", "text", "one <<opt>>two <<opt>>three<</opt>><</opt>> <<any four five>> <<var who 0-2>> six")])
    accepted = lambda s: [n for _, _, n in a.find(licenses.tokens(s))]
    assert accepted("one four six") == [3] and accepted("One, TWO five x y six") == [6] and accepted("one two three four six six") == [6]
    assert accepted("one three four six") == accepted("one four x y z six") == accepted("one six") == accepted("one four") == []
    assert [at for _, at, _ in a.find(licenses.tokens("one four six one four six"))] == [0, 3]


@pytest.mark.parametrize("markup", ["<<opt>>a", "a <</opt>>", "<<var x 1-2>> a", "<<opt>>a<</opt>>", "a <<var x 3-2>>", "a <<what>>", ""])
def test_templates_that_say_nothing_raise(markup):
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("t", "t", "text", markup)])


def test_licenses_of_an_empty_table(spark):
    assert licenses.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- conversations


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # noqa: B018
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def valid(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def brute_repair(turns):
    """All edits of a conversation, by a search over whole audits: (cost, audit, repaired turns)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        visible = re.sub(SPACE, "", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", ())}  # by the initials that are left: states apart, so that nothing is pruned but equal initials
    fill = lambda b: [(c + 2 * len(x), a + "I" * len(x), (*t, *((r, "") for r in x)), s + "".join(r[0] for r in x)) for s, (c, a, t) in b.items() for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]

    def kept(ways):
        out = {}
        for c, a, t, s in ways:
            prefix = s == "" or re.fullmatch("s|s?(ua)*u?", s)
            if prefix and (s not in out or (c, a) < out[s][:2]):
                out[s] = (c, a, t)
        return out

    for (_, role, text), fault in zip(turns, faults, strict=True):
        ways = []
        for c, a, t, s in fill(best):
            ways.append((c + 3, a + "D", t, s))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    ways.append((c + more, a + "K", (*t, (role, text)), s + role[0]))
                ways += [(c + 2 + more, a + "R", (*t, (r, text)), s + r[0]) for r in ("user", "assistant")]
        best = kept(ways)
    cost, audit, said = min((c, a, t) for c, a, t, s in fill(best) if valid(s))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    count = Counter(faults)
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha), said


def conversation_rows(rng, n):
    texts = ("Yes.", "No!", "why", "", " \t", "Is it? ", "so.\n", "é…", "Yes.")
    rows = []
    for conv in range(n):
        for k in range(rng.randint(0, 6)):
            turn = rng.choice([k, k, k, k + 1, None, 3])
            rows.append((conv, turn, rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "u", None, "User")), rng.choice((*texts, None))))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_repairs_match_enumeration(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "BATCH", 5 * segment)
    rows = [*conversation_rows(random.Random(12), 250), (None, 0, "user", "Hi."), (None, None, None, None), (7_000, 1, "user", "a."), *((9_001, k, "user", "Same.") for k in range(7))]
    for k in itertools.count(8_000):  # a conversation that loses all its rows
        if zlib.crc32(f"{k}:0".encode()) % 20 == 0:
            rows.append((k, 0, "user", "gone"))
            break
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digest(df).collect()}
    damaged = brute_damage(rows)
    want = {c: brute_repair(turns) for c, turns in damaged.items()}
    assert got == {c: w for c, (w, _) in want.items()}
    turns = defaultdict(list)
    for r in conversations.repaired(conversations.damaged(df)).orderBy("conv_id", "position").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: list(said) for c, (_, said) in want.items() if said}


def test_a_long_conversation_goes_on_over_stretches(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.choice(("user", "assistant")), f"{rng.randint(0, 300)} {'.' if rng.random() < 0.9 else ''}") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = conversations.repairs(conversations.plain(df)).first()
    said = [(r.role, r.text) for r in conversations.repaired(conversations.plain(df)).orderBy("position").collect()]
    assert valid("".join(r[0] for r, _ in said)) and hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() == row.repaired_sha256
    assert len(row.audit.replace("I", "")) == 3000 and row.gaps == 0 and row.duplicate > 2000


def test_conversations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(df).count() == 0 and conversations.repaired(conversations.plain(df)).count() == 0


# --- interactions


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))  # a null id is no id
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = [x for x in re.split(SPACE + "+", t) if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for f, _, _ in own:
                shapley.update([x for x in order if x in f][:1])
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                out[part, "".join(order), step] = (len(left), len(removed), sum(x in d[0] for d in own) - len(removed), sum(d[0] == {x} for d in own), sum(d[1] for d in removed), sum(d[2] for d in removed), shapley[x])
    return out


@pytest.mark.parametrize("partitions", [1, 23])
def test_filter_audit_matches_brute_force(spark, partitions):
    """Runs of equal texts go on over many partitions."""
    rng = random.Random(13)
    base = [" ".join(rng.choice(("one", "Two", "three", "FOUR", "é", "#6")) + (str(k) if rng.random() < q else "") for k in range(n)) for n, q in ((60, 0.9), (70, 0.2), (10, 1.0), (55, 0.7), (200, 0.9))]
    docs = [(i, base[0], "hot") for i in range(300)] + [(rng.randint(0, 400), rng.choice([*base, None, "", "x"]), rng.choice(["a", "hot", "", None, "b.c"])) for _ in range(300)]
    docs += [(None, base[0], "a"), (None, base[1], "a"), (5, base[2], "a"), (5, base[2], "a"), (6, "K " * 50_000, "b.c"), (None, "alone", None)]
    labels = [(rng.randint(0, 400), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are joined
    try:
        df = clash(spark.createDataFrame(docs, "doc_id long, text string, source string"))
        got = interactions.digest(df, clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(docs, labels) and len(got) == 4 * 600


def test_counters_of_batches_add_up(spark):
    docs = [(i, " ".join(f"w{i}{k}" for k in range(40 + i)), "a" if i % 3 else "b") for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    count = lambda rows: interactions.counters(interactions.masks(spark.createDataFrame(rows, "doc_id long, text string, source string")), labels)
    assert Counter(interactions.merged(count(docs[:11]), count(docs[11:])).collect()) == Counter(count(docs).collect())


def test_filter_audit_of_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.digest(docs, labels).count() == 0
    one = interactions.digest(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


# --- bounds of samples and blocks


def test_samples_hold_one_row_of_each_labelled_id(spark, monkeypatch):
    words = ["calm", "vile", "kind", "awful"]
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some words and "), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 2 + 1).cast("int"))).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, other, share: given.append(len(toxic) + len(other)) or 0.5)
    monkeypatch.setattr(toxicity, "HELD_OUT", 99)
    toxicity.train(docs, labels)
    fit = site_quality.fit
    monkeypatch.setattr(site_quality, "fit", lambda x, y: given.append(len(y)) or fit(x, y))
    assert site_quality.judge(docs, labels, "source", "lang").count() == 20_000
    assert given == [2, 2]


def test_blocks_of_items_hold_no_more_than_their_bounds(spark):
    same = spark.range(50_000).select(F.col("id").alias("item_id"), F.lit("one two three four five six seven").alias("text"))
    items = same.withColumn("item", decontaminate._same("text"))
    assert [b.count() for b in decontaminate.item_blocks(items)] == [1]
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight")], "doc_id long, text string")
    found = decontaminate.matches(docs, same)
    assert found.count() == 50_000 and found.select("item_id").distinct().count() == 50_000
    many = spark.range(500).select(F.concat(F.lit("item "), F.col("id").cast("string"), F.repeat(F.lit(" word"), F.col("id").cast("int"))).alias("text")).withColumn("item", decontaminate._same("text"))
    for partitions in (1, 300):
        blocks = [b.collect() for b in decontaminate.item_blocks(many.repartition(partitions, "text"), 40, 20_000)]
        assert sum(map(len, blocks)) == 500 and all(len(b) <= 40 and sum(len(r.text) for r in b) <= 20_000 for b in blocks)
        size = [max(len(b) / 40, sum(len(r.text) for r in b) / 20_000) for b in blocks]
        assert all(a + b > 0.9 for a, b in zip(size, size[1:], strict=False))


def test_spaces_are_those_of_the_contract():
    assert sorted(SPACES.encode()) == [9, 10, 11, 12, 13, 32]
