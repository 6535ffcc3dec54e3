"""Benchmark items inside documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are lower-cased (A-Z) and stripped of ASCII punctuation at their ends, and shingles of ``SHINGLE`` words are formed. A window is as long as an item; its SimHash is
the sign of the sum of its shingles' random vectors, ``BITS`` of them. Fingerprints within ``RADIUS`` bits of each other differ by ``FLIPS`` bits at most
in one of their blocks, so for each block the items that have one of the values that near to the window's are looked up, which finds all of them. Candidates within the radius are then verified by
the weighted Jaccard similarity of their shingle counts, sum of minima over sum of maxima.

The search is exact but for the radius: a window of similarity 0.8 has vectors at an angle of 27 degrees at most from its item's, if counts are even, so of 128
bits 19.5 differ on average, and more than 31 in one case of 400. Only windows that can be similar are formed: shingles that items have are looked up, and a window needs as many of them as the
similarity asks for, in a document that holds so many of one item of that length.

Equal items are searched once and told apart by a join of what is found. Items are handled in blocks of ``ITEMS`` and ``ITEM_BYTES`` at most, each block broadcast by itself; documents are never shuffled.

Edge cases: null and empty texts and items match nothing; items of fewer words than a shingle have one shingle of all their words; items with equal
words, also those of equal or null ids, are all reported; repeated documents are reported row by row; very long texts are searched as a whole; a tie between windows
goes to the first; an empty table of documents or items gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import fingerprints as fp
from millwright.llm.common import Batcher, narrow, rows, task_of
from millwright.llm.scratch import saved

SHINGLE, LEAST = 5, 0.8
#: Bits of a fingerprint, and in how many of them a window may differ from an item.
BITS, RADIUS = 128, 31
#: Bits of a block, blocks, and in how many bits fingerprints within the radius differ at most in the block in which they are nearest.
WIDTH = 16
N_BLOCKS = BITS // WIDTH
FLIPS = RADIUS // N_BLOCKS
#: Items of a block, and bytes of their texts: what is broadcast at once holds no more.
ITEMS, ITEM_BYTES = 20_000, 64 << 20
#: Windows that are compared at once.
WINDOWS = 500
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: str | bytes | None) -> list[bytes]:
    return [w for w in (x.strip(PUNCTUATION) for x in fp.words(text)) if w]


class StrippedHashes(fp.WordHashes):
    """Hashes of words without punctuation at their ends, looked up by the words with it; 0 for punctuation alone."""

    def hash_of(self, word: bytes) -> int:
        word = word.strip(PUNCTUATION)
        return super().hash_of(word) or 1 if word else 0


_stripped = StrippedHashes()


def word_hashes(text: str | bytes | None) -> np.ndarray:
    h = fp.hashes(fp.words(text), _stripped)
    return h[h != 0]


_BITS = np.arange(64, dtype=np.uint64)


def vectors(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's BITS bits as -1 and 1."""
    words = [fp.mixed(shingles + np.uint64(k)) for k in range(BITS // 64)]
    return np.concatenate([((w[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1 for w in words], axis=1)


def simhash(total: np.ndarray) -> np.ndarray:
    """The fingerprints of sums of vectors: rows of N_BLOCKS numbers of WIDTH bits."""
    return np.packbits(total > 0, axis=-1).view(np.uint16)


#: All changes of a block's value by FLIPS bits or less.
NEAR = np.array([sum(1 << k for k in bits) for n in range(FLIPS + 1) for bits in combinations(range(WIDTH), n)], np.uint16)


class HammingIndex:
    """Items whose windows are equally long: for each block the items in the order of its value."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = np.array([at for at, _ in items])
        self.prints = np.array([p for _, p in items], np.uint16)
        self.order = np.argsort(self.prints, axis=0, kind="stable")
        self.values = np.take_along_axis(self.prints, self.order, axis=0)

    def candidates(self, window: np.ndarray) -> np.ndarray:
        """Positions of the items that differ from the window by FLIPS bits or less in some block."""
        found = []
        for k in range(N_BLOCKS):
            asked = window[k] ^ NEAR
            low, high = (np.searchsorted(self.values[:, k], asked, side) for side in ("left", "right"))
            found += [self.order[a:b, k] for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def near(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) within the radius."""
        out = []
        for window, p in enumerate(prints):
            met = self.candidates(p)
            close = met[np.bitwise_count(self.prints[met] ^ p).sum(axis=1) <= RADIUS]
            out += [(window, at) for at in self.items[close].tolist()]
        return out


def least_common(n):
    """The fewest common shingles of an item of n shingles and a window: those of a window that holds nothing else."""
    return np.ceil(LEAST * n - 1e-9)


class Items:
    """The index of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.counts: dict[int, Counter] = {}
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by the number of a window's shingles
        self.whole: dict[int, list[int]] = defaultdict(list)
        known = []
        self.ids = [i for i, _ in items]
        for at, (_, text) in enumerate(items):
            tokens = word_hashes(text)
            if not len(tokens):
                continue
            s = fp.runs(tokens, SHINGLE)
            if len(tokens) < SHINGLE:
                self.whole[len(tokens)].append(at)
            self.counts[at] = Counter(s.tolist())
            if len(tokens) >= SHINGLE:
                prints[len(s)].append((at, simhash(vectors(s).sum(axis=0))))
                known.append((s, at))
        self.index = {n: HammingIndex(found) for n, found in prints.items()}
        shingles = np.concatenate([s for s, _ in known]) if known else np.zeros(0, np.uint64)
        owners = np.concatenate([np.full(len(s), at) for s, at in known]) if known else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([shingles, owners.astype(np.uint64)]), axis=1)
        self.known, self.first, self.owned = *np.unique(pairs[0], return_index=True), pairs[1].astype(np.int64)  # postings of each shingle: the items that have it
        self.last = np.append(self.first[1:], len(self.owned))
        self.length = np.zeros(len(items), np.int64)
        for s, at in known:
            self.length[at] = len(s)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.short = {n: {next(iter(self.counts[a])) for a in found} for n, found in self.whole.items()}

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has, and the places of their postings."""
        maybe = np.flatnonzero(self.filter[(s >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        met = self.known[at] == s[maybe]
        return maybe[met], at[met]

    def lengths(self, postings: np.ndarray) -> np.ndarray:
        """The lengths of items of which a document has enough shingles, given the postings of those it has."""
        places, times = np.unique(postings, return_counts=True)
        size = self.last[places] - self.first[places]
        runs = np.repeat(self.first[places] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        held = np.bincount(self.owned[runs], weights=np.repeat(times, size), minlength=len(self.length))
        return np.unique(self.length[(self.length > 0) & (held >= least_common(self.length))])

    def found(self, tokens: np.ndarray):
        """(item position, first word, number of words, similarity): the most similar window of each item."""
        best: dict[int, tuple[float, int, int]] = {}
        s = fp.runs(tokens, SHINGLE) if len(tokens) >= SHINGLE else np.zeros(0, np.uint64)
        hits, postings = self.hits(s)
        if len(hits):
            before = np.concatenate([[0], np.cumsum(np.bincount(hits, minlength=len(s)))])
            for n in self.lengths(postings).tolist():
                starts = np.arange(max(1, len(s) - n + 1))
                starts = starts[before[np.minimum(starts + n, len(s))] - before[starts] >= least_common(n)]
                for part in np.array_split(starts, -(-len(starts) // WINDOWS)) if len(starts) else ():
                    self._windows(s, part, n, self.index[n], best)
        for n, marks in self.short.items():
            if len(tokens) >= n:
                w = fp.runs(tokens, n)
                for start in np.flatnonzero(np.isin(w, list(marks))).tolist():
                    for at in self.whole[n]:
                        if at not in best and int(w[start]) in self.counts[at]:
                            best[at] = (1.0, start, n)
        return [(at, start, n, similarity) for at, (similarity, start, n) in best.items()]

    def _windows(self, s, starts, n, index, best) -> None:
        low, high = int(starts[0]), min(len(s), int(starts[-1]) + n)
        total = np.zeros((high - low + 1, BITS), np.int32)
        np.cumsum(vectors(s[low:high]), axis=0, out=total[1:])
        ends = np.minimum(starts + n, len(s)) - low
        prints = simhash(total[ends] - total[starts - low])
        at_window, counts = -1, Counter()
        for window, at in index.near(prints):
            start = int(starts[window])
            if window != at_window:
                at_window, counts = window, Counter(s[start : start + n].tolist())
            item = self.counts[at]
            shared = sum((counts & item).values())
            similarity = shared / (sum(counts.values()) + sum(item.values()) - shared)
            if similarity >= LEAST and similarity > best.get(at, (0.0,))[0]:
                best[at] = (similarity, start, n + SHINGLE - 1)


@functools.lru_cache(1)
def index_of(shared: Broadcast) -> Items:
    """The index of a broadcast block of items, made once by each worker for all its tasks."""
    return Items(shared.value)


def _forget() -> None:
    index_of.cache_clear()
    _stripped.clear()


def _same(text: str):
    """What equal texts have in common, nulls and empty ones included."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def item_blocks(items: DataFrame, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> list[DataFrame]:
    """Tables of ``item, text``: each distinct text once, no more than so many texts and bytes in a table (a longer text is alone in its own). ``items``: item, text.

    Each partition cuts its stream of texts where a running count would go beyond a bound; then the pieces, of which there are few more than full ones would be and
    partitions, are packed into blocks one after the other, so that two neighbouring blocks are more than one full one, however texts are dealt out.
    """
    schema = pa.schema([("item", pa.binary()), ("text", pa.string()), ("piece", pa.string())])

    def each(batches):
        out, part, cut, n, size = Batcher(schema), TaskContext.get().partitionId(), 0, 0, 0
        for item, text in rows(batches):
            length = len(text.encode())
            if n and (n == most or size + length > most_bytes):
                cut, n, size = cut + 1, 0, 0
            n, size = n + 1, size + length
            if out.add((item, text, f"{part}:{cut}"), length):
                yield out.take()
        yield out.take()

    distinct = items.groupBy("item").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    pieces = saved(distinct.mapInArrow(each, "item binary, text string, piece string"))
    blocks, n, size = [], most, most_bytes
    for r in pieces.groupBy("piece").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy("piece").collect():
        if n + r.n > most or size + r.size > most_bytes:
            blocks.append([])
            n = size = 0
        blocks[-1].append(r.piece)
        n, size = n + r.n, size + r.size
    return [pieces.filter(F.col("piece").isin(block)).select("item", "text") for block in blocks]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity``: the best window of each item in each document that holds it."""
    spark = docs.sparkSession
    items = narrow(benchmark, item_col, item_text_col, id_="item_id").withColumn("item", _same("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.binary()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())])
    texts = narrow(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))  # words are split as bytes anyway
    ddl = "doc_id long, item binary, first_word int, n_words int, similarity double"
    found = [texts.select("doc_id", F.lit(None).cast("binary").alias("item"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).filter(F.lit(False))]
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast([(bytes(x.item), x.text) for x in block.collect()])

        def each(batches, shared=shared):
            task_of("decontaminate", _forget)
            index, out = index_of(shared), Batcher(schema)
            for i, text in rows(batches):
                for at, start, n, similarity in sorted(index.found(word_hashes(text))):
                    if out.add((i, index.ids[at], start, n, similarity)):
                        yield out.take()
            yield out.take()

        found.append(texts.mapInArrow(each, ddl))
    met = reduce(DataFrame.union, found)
    return met.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "first_word", "n_words", "similarity")
