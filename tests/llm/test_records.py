"""Operators that judge rows by themselves: against brute force, on edge cases, and with clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millwright.llm import bpe, pii, quality, secrets, toxicity, urls

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def edge_rows():
    return [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "x"), (900_004, "x"), (None, "a b c"), (900_005, "é🙂 " * 300), (900_006, "7" * 30_000), (900_007, "a" * 60_000)]


def frame(spark, rows):
    """With columns whose names clash with those that the operators use."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("found", "ids", "row", "n_words", "score", "rules", "host", "kind", "_row")})


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(len(x) < 5 and int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_pii_matches_brute_force():
    rng = random.Random(3)
    fuzz = ["".join(rng.choice("0123456789.- ()+@ab_%\n") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    for t in fuzz + ["4111 1111 1111 1111", "a@b.c_d@e.f", "call +1 (443) 555-5793 now"]:
        assert [(x.kind, x.start, x.end) for x in pii.find(t) if x.kind in PII] == brute_pii(t), t


def test_pii_method_adds_confirmed_and_contextual_spans():
    assert pii.told(pii.find("iban GB82 WEST 1234 5698 7654 32 THE")) == "iban:5:32"
    assert not pii.find("iban GB83 WEST 1234 5698 7654 32")
    assert pii.told(pii.find("my ssn 078-05-1120")) == "id:7:18"
    assert not pii.find("part 078-05-1120")


def test_pii_digest_and_redaction(spark):
    rows = texts(spark) + edge_rows()
    got = Counter((r.doc_id, r.base_sha256) for r in pii.digest(frame(spark, rows)).collect())
    assert got == Counter((i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute_pii(t)).encode()).hexdigest()) for i, t in rows)
    red = pii.redact(frame(spark, [(1, "mail a@b.co now"), (2, None)]))
    assert [r.text for r in red.collect()] == ["mail [EMAIL] now", None]
    assert red.columns == frame(spark, [(1, "")]).columns
    assert pii.digest(frame(spark, [])).count() == 0
    assert pii.digest(frame(spark, [])).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_pii_context_in_four_languages():
    for around in ("my passport {}", "mein Ausweis {}", "mon passeport {}", "pasaporte {}", "numéro d'identité {}"):
        assert [x.kind for x in pii.find(around.format("078-05-1120"))] == ["id"], around
    assert not pii.find("pièce 078-05-1120")


SECRETS = {"assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_secrets(text):
    out = []
    for k, (kind, p) in enumerate(SECRETS.items()):
        for m in re.finditer(p, text or ""):
            if (kind == "assign" and len(m[1]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_secrets_match_brute_force(spark):
    rng = random.Random(1)
    parts = ["token", "=", '"', " ", "AKIA", "ABCDEFGH12345678", "password:", "Secret", "'", "abcdefabcdefabcdefabcdef012", "é🙂", "api_key", "apikey", "xyz123", "\n", "passwd"]
    rows = texts(spark) + edge_rows() + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(10_000, 10_400)] + [(900_004, "token = abcdefg"), (None, "token: abcdefgh"), (7, "token=abcdefg " * 2000)]
    got = Counter((r.doc_id, r.base_sha256) for r in secrets.digest(frame(spark, rows)).collect())
    assert got == Counter((i, hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for i, t in rows)


def test_secret_postings_are_intersected(spark):
    rows = [(1, "Token: abcdefgh"), (2, "to ken oke tok"), (3, "xox ghp"), (4, None), (None, "passwd = longvalue"), (None, "nothing"), (5, "AKIA" + "B2" * 9), (5, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = {(r.doc_id, tuple(r.rules)) for r in secrets.candidates(df, secrets.RULES).collect()}
    assert found == {(1, ("assign",)), (2, ("assign",)), (None, ("assign",)), (5, ("access",))}  # the second holds all trigrams, and no secret
    assert [r.spans for r in secrets.digest(df.filter("doc_id = 2")).collect()] == [""]
    assert secrets.digest(frame(spark, [])).count() == 0


def test_secret_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == frozenset({frozenset({"aki", "kia"})})
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("abcd|xyz") == frozenset({frozenset({"abc", "bcd"}), frozenset({"xyz"})})
    assert secrets.trigram_query("(abc)?[0-9]+") is None


def test_secret_method_adds_rules(spark):
    df = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY-----"), (2, "ghp_" + "aB3" * 12)], "doc_id long, text string")
    assert [r.spans.split(":")[0] for r in secrets.digest(df).orderBy("doc_id").collect()] == ["pem", "github"]


def brute_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    at = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at), failed


def test_quality_matches_brute_force(spark):
    rows = texts(spark) + edge_rows() + [(5, "a b c a b c"), (6, "l\nl\n\n \nl"), (7, "w " * 5000)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(frame(spark, rows)).collect())
    assert got == Counter((i, *brute_quality(t)) for i, t in rows)
    assert all(not (r.base_failed and r.kept) for r in quality.judge(frame(spark, rows)).collect())


def test_quality_and_bpe_of_an_empty_table(spark):
    assert quality.judge(frame(spark, [])).count() == 0 and quality.keep(frame(spark, [])).count() == 0
    assert bpe.digest(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_quality_keeps_good_and_drops_bad_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 1
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0))


def test_quality_keep_has_all_columns(spark):
    df = frame(spark, texts(spark))
    assert quality.keep(df).columns == df.columns


def test_bpe_equals_the_rank_encoder_and_round_trips(spark):
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(PATH))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", "▁ ▁x", "<unk>", "a\x1c b \x1d\x85 c\u3000\u3000d\u200b e  f   g\n\n h", "日本語🙂🙂", "\x00\x01", "it's we'll", " \n \n", "0" * 3000]
    some = [t for _, t in texts(spark)[:60]] + odd
    c = bpe.codec(PATH, public_tokenizers.PATTERN)
    assert c.encode_all(some) == [want.encode_ordinary(t) for t in some]
    rows = [(i, t) for i, t in enumerate(some)] + edge_rows()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == Counter((i, len(x := want.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows)
    back = bpe.decode(bpe.encode(frame(spark, rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)


def test_bpe_of_patterns_that_take_line_ends_after_other_characters():
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(PATH))}
    pattern = r"""[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
    want = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    some = ["one.\n\ntwo !?\r\n x", "a;\n", "  \n b", ""]
    assert bpe.Codec(PATH, pattern).encode_all(some) == [want.encode_ordinary(t) for t in some]


def test_url_rules_of_one_length_and_odd_urls(spark):
    rules = (urls.Rule("allow", "a.org", "/x"), urls.Rule("block", "a.org", "/x"), urls.Rule("block", "org", "/yyy"), urls.Rule("allow", "a.org", "/y"))
    rows = [(1, "h://a.org/x"), (2, "h://a.org/yyy"), (3, "h://" + "b." * 3000 + "a.org/x" + "z" * 50_000), (4, "://"), (5, "")]
    judge = lambda rows: urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark, rules), [len(r.path) for r in rules], [r.host.count(".") + 1 for r in rules])
    got = {r.page_id: (r.rule, r.verdict) for r in judge(rows).collect()}
    assert got == {1: ("a.org/x", "block"), 2: ("a.org/y", "allow"), 3: ("a.org/x", "block"), 4: (None, "allow"), 5: (None, "allow")}  # equally long: the longer host, then block
    assert judge([]).count() == 0
    assert urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_frame(spark, ()), [], []).count() == 5


def test_url_rules(spark):
    rows = [(1, "http://a.example.org/en/17?x"), (2, "https://Example.ORG/es/"), (3, "x://b.com/fr/1"), (4, "x://b.com/de/1"), (5, "x://notcom/de/"), (6, "x://org"), (7, "x://org/"), (8, None), (9, "no scheme"), (10, "x://xexample.org/es/"), (4, "x://b.com/de/1"), (None, "x://example.org/en/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("row", "rule", "digest", "prefix", "host")})
    got = urls.judge(df, urls.rules_frame(spark, urls.RULES), [len(r.path) for r in urls.RULES], [r.host.count(".") + 1 for r in urls.RULES]).collect()
    want = {1: "example.org/en/1", 2: "example.org/es/", 3: "com/fr/", 4: "com/de/", 7: "org/", 10: "org/", None: "example.org/en/1"}
    assert len(got) == len(rows)
    for r in got:
        assert r.rule == want.get(r.page_id)
        assert r.verdict == ("block" if r.rule in ("example.org/en/1", "example.org/es/", "com/de/") else "allow")
    assert [(r.host, r.path) for r in got if r.page_id == 2] == [("example.org", "/es/")]
    assert {(r.host, r.path) for r in got if r.page_id in (8, 9)} == {("", "")}


def test_toxicity_held_out(spark):
    d = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 4000"), spark.read.parquet(f"{d}/labels.parquet").filter("doc_id < 4000")
    out = toxicity.digest(docs.select("text", "doc_id", "lang", F.lit(1).alias("score")), labels)
    assert out.count() == docs.count()
    n = Counter((r.toxic, r.predicted) for r in out.filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect())
    assert n[1, 1] >= 0.5 * (n[1, 1] + n[1, 0])
    assert n[0, 1] <= 0.02 * (n[0, 1] + n[0, 0])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out.limit(500).collect())


def brute_marginals(chain, tokens):
    """By summing over all sequences of tags."""
    e = [chain.bias + chain.own.get(t, 0) + (chain.before.get(tokens[i - 1], 0) if i else 0) + (chain.after.get(tokens[i + 1], 0) if i + 1 < len(tokens) else 0) for i, t in enumerate(tokens)]
    total, one = 0.0, [0.0] * len(tokens)
    for tags in itertools.product((0, 1), repeat=len(tokens)):
        w = math.exp(sum(v for v, t in zip(e, tags, strict=True) if t) + sum(chain.pairs[a][b] for a, b in zip(tags, tags[1:], strict=False)))
        total += w
        for i, t in enumerate(tags):
            one[i] += w * t
    return [x / total for x in one]


@pytest.mark.parametrize("pairs", [((0.0, 0.0), (0.0, 0.0)), ((1.5, -2.0), (-1.0, 3.0)), ((3.0, -3.0), (-3.0, 3.0))])
def test_marginals_match_enumeration(monkeypatch, pairs):
    rng = random.Random(7)
    chain = toxicity.Chain({"bad": 2.5, "fine": -3.0}, {"very": 1.5}, {"thing": -1.0, "bad": 0.7}, -1.0, pairs, (0.0, 1.0, 1.0))
    scorer = toxicity.Scorer(chain)
    for n in range(1, 12):
        tokens = [rng.choice(["bad", "fine", "very", "thing", "a", "b", "c"]) for _ in range(n)]
        p = scorer.marginals(tokens)
        monkeypatch.setattr(toxicity, "DENSE", rng.choice([0, 16]))  # both ways are tried
        assert all(math.isclose(p.get(i, scorer.rest), want, rel_tol=1e-9) for i, want in enumerate(brute_marginals(chain, tokens))), tokens


def test_marginals_reach_as_far_as_the_chain_remembers():
    pairs = ((3.0, -3.0), (-3.0, 3.0))
    chain = toxicity.Chain({"bad": 6.0}, {}, {}, 0.0, pairs, (0.0, 1.0, 1.0))
    scorer = toxicity.Scorer(chain)
    p = scorer.marginals(["a"] * 300 + ["bad"] + ["a"] * 300)
    assert 0.5 < p[260] < p[299] and p[260] > scorer.rest + 0.3  # 40 words away

    def full(n, at):  # both passes without any short cut
        x = [math.exp(6.0 if i == at else 0.0) for i in range(n)]
        m = [[math.exp(v) for v in row] for row in pairs]
        f, b = [x[0]], [1.0]
        for v in x[1:]:
            f.append((m[0][1] + f[-1] * m[1][1]) / (m[0][0] + f[-1] * m[1][0]) * v)
        for v in x[:0:-1]:
            b.append((m[1][0] + b[-1] * v * m[1][1]) / (m[0][0] + b[-1] * v * m[0][1]))
        return [u * v / (1 + u * v) for u, v in zip(f, b[::-1], strict=True)]

    assert all(math.isclose(p.get(i, scorer.rest), v, rel_tol=1e-9) for i, v in enumerate(full(601, 300)))


def test_toxic_spans_survive_lower_casing():
    chain = toxicity.Chain({"scum": 9.0}, {}, {}, -4.0, ((0.0, 0.0), (0.0, 0.0)), (0.0, 1.0, 1.0))
    text = "\u0130stanbul SCUM word"
    _, spans = toxicity.Scorer(chain).score(text)
    assert [text[a:b] for a, b in spans] == ["SCUM"]


def test_fitted_scorer_on_edge_rows(spark):
    rng = random.Random(11)
    some = lambda: [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrs") + rng.choice("aeiou") for _ in range(40)]
    bad, good = [" ".join([*some()[:20], "scum", *some()[:20]]) for _ in range(60)], [" ".join(some()) for _ in range(90)]
    train = [(i, t) for i, t in enumerate(bad + good)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in train], "doc_id long, toxic int")
    rows = train + edge_rows() + [(900_010, "word " * 12_000 + "scum"), (900_010, "word " * 12_000 + "scum")]
    out = toxicity.digest(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.n_toxic_words, r.spans), set()).add(r.score)
    assert all(len(v) == 1 for k, v in by.items() if k[0] is not None and k[0] >= 900_000)
    assert {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60} == {1} and {r.predicted for r in out if r.doc_id is not None and 60 <= r.doc_id < 150} == {0}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert {r.spans for r in out if r.doc_id == 900_010} == {"60000:60004"}


def test_toxicity_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, edge_rows())
    assert {r.score for r in toxicity.digest(docs, none).collect()} == {0.0}
    assert toxicity.digest(frame(spark, []), none).count() == 0
