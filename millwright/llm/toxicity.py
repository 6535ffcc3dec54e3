"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels are given for documents, so token labels are derived first: words, and beginnings of words since some languages inflect
them, that significantly more toxic training documents hold than others. A chain with two tags is fitted to those labels: emissions
weigh a word, its beginnings and its two neighbours, transitions weigh tag pairs. Forward-backward marginals give each word's probability of being toxic; the largest one and the number above one half
make up a document's evidence, which a logistic function, weighted to the labels' true rate, turns into the score.

Training uses at most ``MOST_TOXIC`` and ``MOST_OTHER`` labelled documents of ``MOST_CHARS`` characters at most, those with the smallest hashes of their ids, outside the held-out fold,
and of their segments without toxic words at most ``MOST_SEGMENTS``, evenly spread. Scoring covers every word of every text, and marginals are those of the whole text.

Edge cases: null and empty texts have the score of a text without toxic words; very long texts take time in proportion; without labels of both classes every score is the
labels' mean (0 without any); repeated rows get equal results; an empty table gives an empty one; ids may repeat or be null (null: held_out is false); columns besides
id, text and label are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import Batcher, narrow, rows

FOLDS, HELD_OUT = 4, 2
MOST_TOXIC, MOST_OTHER, MOST_CHARS = 800, 1600, 100_000
#: A toxic feature is in this many times the share of the other documents, by at least this log-likelihood ratio.
LEAST_RATIO, LEAST_EVIDENCE = 8.0, 25.0
#: A training document is left out if earlier ones of its class have more than this share of its word triples.
MOST_COPIED = 0.4
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)
#: Words of a training segment; segments without toxic words that are trained on at most.
SEGMENT, MOST_SEGMENTS = 32, 12_000
ROUNDS, RATE, L2 = 50, 1.0, 1e-4
#: A pass has settled when it is this near, relatively, to where it stays.
SETTLED = 1e-12
#: Of so many words one with a weight makes a text dense.
DENSE = 16
THRESHOLD = 0.3
#: Smaller weights are dropped.
LEAST_WEIGHT = 0.5
WORDS_KEPT = 300_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """In lower case; cut before that, since lower-casing may change the number of characters."""
    return [w.lower() for w in _WORD.findall(text)]


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Chain:
    """Log weights of tag 1 against tag 0, and of tag pairs (previous, next)."""

    own: dict[str, float]
    before: dict[str, float]
    after: dict[str, float]
    bias: float
    pairs: tuple[tuple[float, float], tuple[float, float]]
    #: Of 1, largest logit of a marginal, log(1 + number of toxic words).
    evidence: tuple[float, float, float]


def _forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 and of tag pairs in segments. e: (segments, length) log odds; t: (2, 2) log weights."""
    s, n = e.shape
    x, m = np.exp(np.clip(e, -30, 30)), np.exp(t)
    a, b = np.empty((n, s, 2)), np.empty((n, s, 2))
    a[0] = np.stack([np.ones(s), x[:, 0]], 1)
    a[0] /= a[0].sum(1, keepdims=True)
    for k in range(1, n):
        a[k] = a[k - 1] @ m
        a[k, :, 1] *= x[:, k]
        a[k] /= a[k].sum(1, keepdims=True)
    b[n - 1] = 0.5
    for k in range(n - 2, -1, -1):
        y = b[k + 1].copy()
        y[:, 1] *= x[:, k + 1]
        b[k] = y @ m.T
        b[k] /= b[k].sum(1, keepdims=True)
    one = a * b
    one /= one.sum(2, keepdims=True)
    pair = np.zeros((2, 2))
    for k in range(1, n):
        y = b[k].copy()
        y[:, 1] *= x[:, k]
        both = a[k - 1][:, :, None] * m * y[:, None, :]
        pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
    return one[:, :, 1].T, pair


def _apart(docs: list[list[str]]) -> list[list[str]]:
    """Without near copies of earlier ones, which would make their common words look like evidence."""
    seen: set[int] = set()
    out = []
    for doc in docs:
        triples = {hash(t) for t in zip(doc, doc[1:], doc[2:], strict=False)}
        if len(triples & seen) <= MOST_COPIED * len(triples):
            seen |= triples
            out.append(doc)
    return out


def _toxic_features(toxic: list[list[str]], other: list[list[str]]) -> set[str]:
    bad, good = (Counter(f for doc in docs for f in {f for w in set(doc) for f in features(w)}) for docs in (toxic, other))
    n, m = len(toxic), len(other)
    out = set()
    for f, a in bad.items():
        b = good[f]
        rate = (a + b) / (n + m)
        evidence = 2 * (a * math.log(a / (n * rate)) + (b * math.log(b / (m * rate)) if b else 0))
        if evidence >= LEAST_EVIDENCE and a * (m + 1) >= LEAST_RATIO * (b + 0.5) * n:
            out.add(f)
    return out


def fit(toxic: list[str | None], other: list[str | None], rate: float) -> Chain:
    """``rate``: the share of toxic documents among all labelled ones, to which the score is calibrated."""
    bad, good = ([words(t or "") for t in texts] for texts in (toxic, other))
    listed = _toxic_features(_apart(bad), _apart(good))
    is_toxic = {w: not listed.isdisjoint(features(w)) for w in {w for doc in bad for w in doc}}

    chosen, plain = [], []
    for docs, toxic_class in ((bad, True), (good, False)):
        for doc in docs:
            for k in range(0, len(doc), SEGMENT):
                part = doc[k : k + SEGMENT]
                tags = [toxic_class and is_toxic[w] for w in part]
                (chosen if any(tags) else plain).append((part, tags))
    chosen += plain[:: -(-len(plain) // MOST_SEGMENTS) or 1]
    seen = Counter(f for part, _ in chosen for w in part for f in features(w))
    ids = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}  # 0: none
    width, size = 1 + len(BEGINNINGS), len(ids) + 1
    own = np.zeros((width, len(chosen), SEGMENT), np.int64)
    tag = np.zeros((len(chosen), SEGMENT))
    known = {w: [ids.get(f, 0) for f in features(w)] for w in {w for part, _ in chosen for w in part}}
    for s, (part, tags) in enumerate(chosen):
        tag[s, : len(tags)] = tags
        for k, w in enumerate(part):
            own[: len(known[w]), s, k] = known[w]
    left, right = np.zeros_like(own[0]), np.zeros_like(own[0])
    left[:, 1:], right[:, :-1] = own[0, :, :-1], own[0, :, 1:]
    y = tag.astype(int)
    observed = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)

    w = [np.zeros(size) for _ in range(3)]
    bias, t = -4.0, np.zeros((2, 2))
    moments, bias_moment, pair_moment = [np.zeros(size) for _ in range(3)], 0.0, np.zeros((2, 2))
    for _ in range(ROUNDS if listed else 0):  # diagonal adaptive gradient steps
        p, pair = _forward_backward(bias + w[0][own].sum(0) + 0.25 * (w[1][left] + w[2][right]), t)
        rest = tag - p
        for k, (at, scale) in enumerate(((own, 1.0), (left[None], 0.25), (right[None], 0.25))):
            g = scale * sum(np.bincount(x.ravel(), weights=rest.ravel(), minlength=size) for x in at) - L2 * rest.size * w[k] / size
            g[0] = 0
            moments[k] += g * g
            w[k] += RATE * g / np.sqrt(moments[k] + 1e-8)
        g = rest.sum()
        bias_moment += g * g
        bias += RATE * g / math.sqrt(bias_moment + 1e-8)
        g = observed - pair
        pair_moment += g * g
        t = np.clip(t + 0.3 * RATE * g / np.sqrt(pair_moment + 1e-8), -3, 3)
    names = [None, *ids]
    maps = [{names[i]: float(v[i] * scale) for i in np.flatnonzero(np.abs(v * scale) >= LEAST_WEIGHT) if i} for v, scale in zip(w, (1, 0.25, 0.25), strict=True)]
    chain = Chain(*maps, float(bias), tuple(map(tuple, t.tolist())), (0.0, 0.0, 0.0))
    scorer = Scorer(chain)
    x = np.array([scorer.evidence(doc) for doc in bad + good]).reshape(-1, 2)
    label = np.array([1.0] * len(bad) + [0.0] * len(good))
    weight = np.where(label == 1, rate / max(1, len(bad)), (1 - rate) / max(1, len(good))) * len(label)
    chain.evidence = _logistic(x, label, weight)
    return chain


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Coefficients of a weighted, slightly regularised logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        c = c + np.linalg.solve(h, x.T @ (weight * (label - p)) - 1e-2 * c)
    return tuple(c.tolist())


class Weights(dict):
    """What each word adds to its own log odds and to those of the words after and before it, computed when first asked for; None: nothing."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, word: str) -> tuple[float, float, float] | None:
        if len(self) >= WORDS_KEPT:
            self.clear()
        w = word.lower()
        found = sum(self.chain.own.get(f, 0.0) for f in features(w)), self.chain.before.get(w, 0.0), self.chain.after.get(w, 0.0)
        self[word] = found = found if any(found) else None
        return found


class Scorer:
    """Marginals and scores of texts under a fitted chain."""

    def __init__(self, chain: Chain):
        self.c = chain
        self.m = [[math.exp(x) for x in row] for row in chain.pairs]
        self.x0 = math.exp(chain.bias)
        self.weights = Weights(chain)
        self.f, self.b = self._fixed(lambda r: self._next(r) * self.x0), self._fixed(lambda r: self._back(r * self.x0))
        self.rest = self.f * self.b / (1 + self.f * self.b)

    @staticmethod
    def _fixed(step) -> float:
        """Where a pass settles among words without weights."""
        r = 1.0
        for _ in range(100_000):
            r, before = step(r), r
            if r == before:
                break
        return r

    def _next(self, r: float) -> float:
        (a, b), (c, d) = self.m
        return (b + r * d) / (a + r * c)

    def _back(self, r: float) -> float:
        (a, b), (c, d) = self.m
        return (c + r * d) / (a + r * b)

    def marginals(self, tokens: list[str]) -> dict[int, float]:
        """Forward-backward over all words. Where both passes have settled, up to rounding, at the values that they have far from any weight, a
        word's marginal is ``rest``, and it is left out."""
        n = len(tokens)
        marked = [(i, found) for i, found in enumerate(map(self.weights.__getitem__, tokens)) if found]
        if DENSE * len(marked) > n:
            return dict(enumerate(self._dense(n, marked)))
        more: dict[int, float] = {}
        for i, found in marked:
            for at, v in zip((i, i + 1, i - 1), found, strict=True):
                if v and 0 <= at < n:
                    more[at] = more.get(at, 0.0) + v
        x = {i: math.exp(min(30.0, self.c.bias + v)) for i, v in more.items()}
        places = sorted(x)
        (a, b), (c, d) = self.m
        x0, settled, get = self.x0, self.f, x.get
        forward: dict[int, float] = {}
        i, k = 0, 0
        while i < n:
            r = (b + r * d) / (a + r * c) * get(i, x0) if i else get(0, x0)
            forward[i] = r
            i += 1
            if abs(r - settled) <= SETTLED * settled:  # as it stays up to the next weighted word
                while k < len(places) and places[k] < i:
                    k += 1
                i, r = places[k] if k < len(places) else n, settled
        backward: dict[int, float] = {}
        settled, i, k, r = self.b, n - 1, len(places) - 1, 1.0
        while i >= 0:
            backward[i] = r
            r *= get(i, x0)
            r = (c + r * d) / (a + r * b)
            i -= 1
            if abs(r - settled) <= SETTLED * settled:
                while k >= 0 and places[k] > i:
                    k -= 1
                i, r = places[k] if k >= 0 else -1, settled
        out = {}
        for i in forward.keys() | backward.keys() if self.rest < 0.5 else range(n):
            odds = forward.get(i, self.f) * backward.get(i, self.b)
            out[i] = odds / (1 + odds)
        return out

    def _dense(self, n: int, marked: list[tuple[int, tuple[float, float, float]]]) -> list[float]:
        """The same where weights are so close to each other that both passes seldom settle: all words in turn."""
        e = [self.c.bias] * (n + 2)  # with a place before and after
        for i, (own, after, before) in marked:
            e[i + 1] += own
            e[i + 2] += after
            e[i] += before
        x = [math.exp(v) if v < 30.0 else math.exp(30.0) for v in e[1 : n + 1]]
        (a, b), (c, d) = self.m
        r = x[0]
        forward = [r]
        for v in x[1:]:
            r = (b + r * d) / (a + r * c) * v
            forward.append(r)
        r, out = 1.0, []
        for f, v in zip(reversed(forward), reversed(x), strict=True):
            odds = f * r
            out.append(odds / (1 + odds))
            r *= v
            r = (c + r * d) / (a + r * b)
        return out[::-1]

    def evidence(self, tokens: list[str], p: dict[int, float] | None = None) -> tuple[float, float]:
        p = self.marginals(tokens) if p is None else p
        top = min(1 - 1e-6, max([self.rest, *p.values()])) if tokens else self.rest
        return math.log(top / (1 - top)), math.log1p(sum(v >= 0.5 for v in p.values()))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The document's score, and the spans of its toxic words in code points."""
        text = text or ""
        tokens = _WORD.findall(text)
        p = self.marginals(tokens)
        c0, c1, c2 = self.c.evidence
        top, many = self.evidence(tokens, p)
        z = c0 + c1 * top + c2 * many
        toxic = sorted(i for i, v in p.items() if v >= 0.5)
        places = [m.span() for m in _WORD.finditer(text)] if toxic else []
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), [places[i] for i in toxic]


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Chain | float:
    """A chain from the training fold; without both classes there, the mean label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # one row for each id, else repeated ones would grow the sample
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or positive in (0, n):
        return positive / n if n else 0.0
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [known.filter(F.col("label") == v).select("doc_id", "label").orderBy(*order).limit(most) for v, most in ((1, MOST_TOXIC), (0, MOST_OTHER))]
    texts = narrow(docs, "doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS)
    met = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = met.collect()  # a text for each chosen id
    sample.sort()
    return fit([r.text for r in sample if r.label], [r.text for r in sample if not r.label], positive / n)


def digest(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """The result of ``op4_toxicity``: ``doc_id, held_out, score, predicted``, the number of toxic words and their spans."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_toxic_words", pa.int64()), ("spans", pa.string())])

    def each(batches):
        out = Batcher(schema)
        scorer = model.value if isinstance(model.value, float) else Scorer(model.value)
        for i, text in rows(batches):
            score, spans = (scorer, []) if isinstance(scorer, float) else scorer.score(text)
            if out.add((i, score, len(spans), ",".join(f"{a}:{b}" for a, b in spans))):
                yield out.take()
        yield out.take()

    scored = narrow(docs, "doc_id", "text").mapInArrow(each, "doc_id long, score double, n_toxic_words long, spans string")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_words", "spans")
