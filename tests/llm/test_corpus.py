"""Operators that look across documents, and the pipeline: against brute force, on copies, ties and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millwright.llm import components, decontaminate, jaccard, site_quality, substrings

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_components(rows, k, num, den):
    sets = {i: ({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()) for i, t in rows for w in [words(t)]}
    lists, up = {}, {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x] if j < i).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(rng, n_bases, first):
    rows = []
    for _ in range(n_bases):
        w = [rng.choice("abcdefghijklm") + rng.choice("abcdefgh") for _ in range(rng.choice([3, 5, 12, 60, 150]))]
        for _ in range(rng.randint(1, 25)):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if v:
                    i = rng.randrange(len(v))
                    v[i : i + rng.choice([0, 1])] = rng.choice([[], ["new"], ["xyz"]])
            rows.append((first + len(rows), " ".join(v)))
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components_match_brute_force(spark, k, num, den):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += near_copies(random.Random(k), 25, 10_000) + [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "One two"), (90_005, "one  TWO"), (90_006, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "token", "kind", "component", "rep")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


@pytest.mark.parametrize("piece", [4, 4096])
def test_jaccard_of_one_large_group_in_pieces(spark, monkeypatch, piece):
    """Near copies of one text with edits that many of them share, in pieces so small that all lists are split; their differences are sent as they are and as sketches."""
    monkeypatch.setattr(jaccard, "PIECE", 2 * piece)
    monkeypatch.setattr(jaccard, "LIST_PIECE", piece)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            k = rng.randrange(0, 150, 3)
            w[k] = rng.choice([f"x{k}", f"y{k}", ""])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, 4, 85, 100).collect()}
    want = brute_components(rows, 4, 85, 100)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_combined_differences():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, one, two = (np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(3))
        d = lambda a, b: (np.setdiff1d(a, b), np.setdiff1d(b, a))
        added, removed = jaccard.combined(*d(x, one), *d(one, two))
        assert set(added) == set(x) - set(two) and set(removed) == set(two) - set(x)


def test_sketches_never_tell_too_much():
    rng = np.random.default_rng(5)
    for n in (1, 30, 500):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b[: n // 2], a[: n // 2]]))
        assert (jaccard.parity(a) ^ jaccard.parity(b)).bit_count() <= len(np.setxor1d(a, b))


def test_jaccard_of_very_long_and_null_id_texts(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, "a b c d e f g"), (None, "A b c d e f g"), (None, "x y z u v w"), (None, "x y z u v w"), (7, long), (8, long + " more"), (9, "lone text that nothing is like")]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect())
    assert got == Counter([(5, 5), (None, 5), (None, None), (None, None), (7, 7), (8, 7), (9, 9)])


def test_jaccard_of_nothing_and_of_repeated_rows(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(twice).collect())) == Counter({(1, 2, 1): 2, (None, 0, None): 1})


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_components_raise_when_they_are_not_final(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change"):
        components.components(links, most_rounds=1)
    assert components.components(links.limit(0)).count() == 0


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(8)
    passages = [prose(rng, 60) for _ in range(20)]
    rows = [(2 * i + k, prose(rng, 200 + i) + " " + p + " " + prose(rng, 150)) for i, p in enumerate(passages) for k in (0, 1)]
    clean = [(1000 + i, prose(rng, 400)) for i in range(40)]
    df = spark.createDataFrame(rows + clean + [(2000, None), (2001, ""), (2002, "short"), (2003, "short")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "digest", "start")})
    found = substrings.repeated(df).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows}
    by = dict(rows)
    for r in found:
        assert by[r.doc_id][r.start : r.end] in by[r.doc_id ^ 1]  # the passage, and by chance a few characters more
        assert len(by[r.doc_id][r.start : r.end]) <= len(passages[r.doc_id // 2]) + 20
        assert r.removable == (r.doc_id % 2 == 1) and r.owner_id == r.doc_id // 2 * 2


def test_cuts_survive_insertions_and_keep_characters_whole():
    rng = random.Random(2)
    text = prose(rng, 500) + " éàü🙂 " * 40
    raw = text.encode()
    ends = substrings.cuts(raw)
    assert b"".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)) == raw
    assert all(raw[a:b].decode() is not None for a, b in zip([0, *ends], ends, strict=False))
    before, after = (set(substrings.text_digests(t).tolist()) for t in (text, "inserted words " + text))
    assert len(before - after) <= 2
    assert len(substrings.cuts(b"")) == 0


def test_low_entropy_passages_are_cut_into_equal_chunks(spark):
    rng = random.Random(5)
    for unit in ("word ", "a", "| - ", "n/a, ", "\n", "0123456789 filler words of a table row | ", "é", "語"):
        chunks = []
        for n in (900, 1100, 1333):  # other lengths and neighbours
            raw = (prose(rng, 40 + n % 7) + unit * n + prose(rng, 50)).encode()
            ends = substrings.cuts(raw).tolist()
            chunks.append({raw[a:b] for a, b in zip(ends, ends[1:], strict=False) if b - a > 200 or raw[a:b].decode() in unit * 300})
        assert all(len(c) <= 200 for c in set().union(*chunks)) and chunks[0] & chunks[1] & chunks[2], unit
    filler = [(i, prose(rng, 100 + i) + " " + "word " * (300 + 37 * i) + prose(rng, 100)) for i in range(8)]
    assert {r.doc_id for r in substrings.repeated(spark.createDataFrame(filler, "doc_id long, text string")).collect()} >= set(range(1, 8))


def test_phrases_seen_before_do_not_divide_a_passage(spark):
    rng, rows = random.Random(6), []
    for i in range(40):  # two passages share a phrase that is no passage itself
        phrase = prose(rng, 16)
        for k, n in ((0, 14), (200, 14)):
            passage = prose(rng, n) + " " + phrase + " " + prose(rng, n)
            rows += [(k + j + i, prose(rng, 70 + j) + " " + passage + " " + prose(rng, 90)) for j in (0, 100)]
    found = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = dict(rows)
    assert all(by[r.doc_id][r.start : r.end] in by[r.owner_id] and r.owner_id == r.doc_id // 200 * 200 + r.doc_id % 100 for r in found)
    assert {r.doc_id for r in found} == set(by)


def test_windows_that_overlap_are_no_copies(spark):
    rows = [(1, "one " * 30), (2, "two " * 90)]
    found = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own, copy = sorted(found, key=lambda r: r.removable)
    assert own.doc_id == copy.doc_id == copy.owner_id == 2 and not own.removable and copy.removable and own.end <= copy.start


def test_passages_against_brute_force(spark):
    """Each run of 60 words or more that two documents share byte by byte is covered, but for its ends, in all but the first of them; what is found repeats."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(50_000, "filler " * 9000), (50_001, None), (50_001, ""), (50_002, prose(random.Random(1), 20_000)), (50_002, prose(random.Random(1), 20_000))]
    found = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "digest")})).collect()
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    assert all(any(r.end <= len(t) and any(t[r.start : r.end] in u for u in texts[r.owner_id]) for t in texts[r.doc_id]) for r in found)
    first, missed, total = {}, 0, 0
    for i, t in sorted(((i, t) for i, t in rows if t), key=lambda x: x[0]):
        if i >= 50_000:
            continue
        words_at = [m.span() for m in re.finditer(r"\S+", t)]
        at = 0
        while at + 60 <= len(words_at):
            a, b = words_at[at][0], words_at[at + 59][1]
            if first.setdefault(t[a:b], i) != i:
                total += 1
                inside = sum(min(e, b) - max(s, a) for s, e in spans.get(i, ()) if s < b and e > a)
                missed += inside < 0.5 * (b - a)
                at += 60
            else:
                at += 1
    assert total > 10 and not missed


def test_chunks_of_an_empty_table(spark):
    assert substrings.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_window(doc, item):
    a, b = decontaminate.words(doc), decontaminate.words(item)
    s = [tuple(a[i : i + 5]) for i in range(len(a) - 4)]
    want = Counter(tuple(b[i : i + 5]) for i in range(len(b) - 4))
    n, best = len(b) - 4, 0.0
    for i in range(max(1, len(s) - n + 1)):
        c = Counter(s[i : i + n])
        shared = sum((c & want).values())
        if shared:
            best = max(best, shared / (sum(c.values()) + sum(want.values()) - shared))
    return best


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = []
    for i in range(80):
        _, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, prose(rng, 50) + " " + " ".join(w).upper() + ". " + prose(rng, 50)))
    df = spark.createDataFrame(rows + [(500, prose(rng, 300)), (501, None), (502, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(df, bench).collect()}
    want = {(i, j): round(s, 9) for i, t in rows for j, item in items if (s := brute_window(t, item)) >= 0.8}
    assert got == want
    assert decontaminate.matches(df, bench.limit(0)).count() == 0


def test_decontamination_recall_near_the_threshold(spark):
    """Windows of similarities just above 0.8, where the radius could lose some: at least nine of ten are found, and nothing else."""
    rng = random.Random(9)
    vocabulary = [prose(rng, 1) + str(i) for i in range(3000)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 120)))) for j in range(60)]
    rows = []
    for i in range(500):
        w = rng.choice(items)[1].split()
        for _ in range(max(1, round(len(w) * rng.uniform(0.005, 0.025)))):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)))
    want = {(i, j): s for i, t in rows for j, item in items if (s := brute_window(t, item)) >= 0.8}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs, bench).collect()}
    assert all(k in want and abs(want[k] - s) < 1e-9 for k, s in got.items())
    close = [k for k, s in want.items() if s < 0.85]
    assert len(close) > 30 and len([k for k in close if k in got]) >= 0.9 * len(close)
    print("recall", len(got) / len(want), "below 0.85", len([k for k in close if k in got]) / len(close), "of", len(close))


def test_the_hamming_index_guarantees_its_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 16, (200, decontaminate.N_BLOCKS)).astype(np.uint16)
    index = decontaminate.HammingIndex(list(enumerate(prints)))
    asked = []
    for p in prints:
        bits = np.unpackbits(p.view(np.uint8))
        bits[rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)] ^= 1
        asked.append(np.packbits(bits).view(np.uint16))
    assert {(i, i) for i in range(200)} <= set(index.near(np.array(asked)))
    assert np.mean([len(index.candidates(p)) for p in rng.integers(0, 1 << 16, (50, decontaminate.N_BLOCKS)).astype(np.uint16)]) < 0.15 * 200


def test_decontamination_edge_rows(spark):
    item = " ".join(f"t{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item), (None, item), (None, item), (2, None)], "item_id long, text string")
    long = prose(random.Random(2), 25_000)
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, f"{long} {item} {long}"), (3, None), (4, item + " " + item)], "doc_id long, text string").withColumn("similarity", F.lit("clash"))
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    assert got == Counter({(i, j): n * m for i, n in ((1, 2), (None, 1), (2, 1), (4, 1)) for j, m in ((1, 1), (None, 2))})
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_short_benchmark_items(spark):
    bench = spark.createDataFrame([(1, "only three words"), (2, None), (3, ""), (4, "Only three words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are only three words."), (2, "only three other words")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == {(1, 1), (1, 4)}


def test_site_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.unionByName(spark.createDataFrame([(99_001, None, None, None, None), (99_002, "", "en", "src1", 0)], docs.schema)).withColumn("host", F.lit("clash"))
    out = site_quality.judge(more, labels, "source", "lang")
    assert out.count() == more.count()
    n = Counter((r.quality, r.kept) for r in out.join(labels, "doc_id").select("quality", "kept").collect())
    assert n[1, True] >= 0.95 * (n[1, True] + n[1, False])
    assert n[0, False] >= 0.7 * (n[0, True] + n[0, False])
    assert site_quality.judge(docs.limit(0), labels.limit(0), "source", "lang").count() == 0


def test_site_posteriors_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for h in range(6):
        for p in range(4):
            share = np.clip(0.5 + 0.08 * h + 0.05 * p + rng.normal(0, 0.1), 0.05, 0.95)
            for _ in range(int(rng.choice([1, 2, 5, 40]))):
                good = rng.random() < share
                rows.append((i, " ".join(["the"] * (60 if good else 3) + [f"word{rng.integers(900)}" for _ in range(60 if good else 4)]), f"h{h}", f"p{p}", int(good)))
                i += 1
    rows += [(i, None, None, None, 0), (i + 1, "", None, None, 0), (i + 2, "word " * 30_000, "h0", "p0", 1), (i + 2, "word " * 30_000, "h0", "p0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    out = site_quality.judge(df.drop("quality"), df.select("doc_id", "quality").distinct(), "source", "lang").collect()
    assert len(out) == len(rows)
    site = {r[0]: (r[2] or "", r[3] or "") for r in rows}
    p = [(site[r.doc_id][0], site[r.doc_id], r.doc_score) for r in out]
    mean = np.mean([x for *_, x in p])

    def pseudo(parent_of, groups):
        n, within, between, same = len(p), 0.0, 0.0, 0.0
        parents = {}
        for g, v in groups.items():
            parents.setdefault(parent_of(g), []).extend(v)
        for g, v in groups.items():
            own, above = np.mean(v), parents[parent_of(g)]
            within += np.sum((np.array(v) - own) ** 2)
            between += len(v) * (own - np.mean(above)) ** 2
            same += len(v) ** 2 / len(above)
        df = len(groups) - len(parents)
        chance = within / (n - len(groups))
        true = (between / df - chance) * df / (n - same)
        return min(1e6, max(1.0, chance / true)) if true > 0 else 1e6

    hosts, paths = {}, {}
    for h, hp, x in p:
        hosts.setdefault(h, []).append(x)
        paths.setdefault(hp, []).append(x)
    k_host, k_path = pseudo(lambda g: 0, hosts), pseudo(lambda g: g[0], paths)
    for r, (h, hp, x) in zip(out, p, strict=True):
        host = (k_host * mean + sum(hosts[h]) - x) / (k_host + len(hosts[h]) - 1)
        path = (k_path * host + sum(paths[hp]) - x) / (k_path + len(paths[hp]) - 1)
        assert np.isclose(r.host_score, host, rtol=1e-6) and np.isclose(r.site_score, path, rtol=1e-6)


def test_pipeline_run_equals_its_stages_and_handles_edge_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.filter("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").limit(1).first()
    odd = [(None, good.text, "en", "s", 1), (None, good.text, "en", "s", 1), (good.doc_id, good.text, "en", "s", 1), (None, None, None, None, None), (77_777, "", "", "", 0), (77_778, good.text + " " + good.text[:40] + " and more words " * 3, "en", "s", 2)]
    for name, rows in (("full", odd), ("empty", None)):
        d = tmp_path / name
        data = docs.limit(0) if rows is None else docs.unionByName(spark.createDataFrame(rows, docs.schema))
        data.withColumns({c: F.lit("clash") for c in ("node", "component_id", "row", "item_id")}).write.parquet(f"{d}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(d)).collect()
        if rows is None:
            assert out == []
            continue
        kept = Counter(r.doc_id for r in out)
        assert max(kept.values()) == 1 and None not in kept and 77_777 not in kept and 77_778 not in kept and set(kept) <= {r.doc_id for r in docs.collect()}
        plain = corpus_pipeline.run(spark, SF).collect()
        assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in out} == {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in plain}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items()), 5, 4, 5).items() if c == i}
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x in t for x in items for t in after.values())
            assert all(any(brute_window(before[i], x) >= 0.8 for x in items) for i in set(before) - set(after))
        if name == "PII":
            assert set(after) == set(before)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and min(r.n_tokens for r in last.collect()) > 0


def test_pipeline_stages_take_columns_of_any_name(spark, tmp_path):
    """Dots, the stage's own key, and letters in either case."""
    rows = [(i, " ".join(f"{'the of ' if k == 7 else ''}w{(i // 2) * 1000 + k}" for k in range(80)), "en", "s", 0, "kept", "mine") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, _Pipeline_id string")
    spark.createDataFrame([(1, "nothing like it here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_Pipeline_id"], name
        assert {tuple(r)[5:] for r in docs.collect()} == {("kept", "mine")}, name
    assert docs.count() == 3


def test_lists_are_split_by_set_size_only_where_sets_may_link(spark, monkeypatch):
    """Every pair of sets that may link meets, and an entry of a long list is copied for its own and the neighbouring classes alone."""
    monkeypatch.setattr(jaccard, "LIST_PIECE", 8)
    rng = random.Random(6)
    rows = [(1, f"n{i}".encode(), rng.choice([1, 2, 3, 5, 8, 10, 11, 13, 50, 62, 63, 64, 65, 80, 81, 100, 1000])) for i in range(300)] + [(2, f"m{i}".encode(), i + 1) for i in range(8)]
    df = spark.createDataFrame(rows, "token long, node binary, n int")
    sizes = df.groupBy("token").agg(F.count("*").alias("size"))
    cut = jaccard._in_classed_pieces(df, ["token"], sizes, "node", jaccard.size_class(F.col("n"), 4, 5)).collect()
    groups = {}
    for r in cut:
        groups.setdefault((r.token, r.low, r.high), []).append((bytes(r.node), r.own))
    met = Counter()
    for (_, low, high), found in groups.items():
        for i, (a, own) in enumerate(found):
            for b, other in found[i + 1 :]:
                if low == high or own != other:
                    met[min(a, b), max(a, b)] += 1
    sizes_of = {bytes(node): n for _, node, n in rows}
    links = {(a, b) for a in sizes_of for b in sizes_of if a < b and a[:1] == b[:1] and 5 * min(sizes_of[a], sizes_of[b]) >= 4 * max(sizes_of[a], sizes_of[b])}
    assert links <= met.keys() and set(met.values()) == {1}
    assert len(cut) < 300 * 38  # all pieces with all pieces would be 38 copies of each
