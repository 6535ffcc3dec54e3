"""Exact Jaccard self-join of documents' word n-gram sets, and its connected components.

Two documents link when ``den * |A & B| >= num * |A | B|``. The join follows set-relation skipping for exact set similarity
joins:

* A set is a node, named by a 128-bit digest; documents with equal sets share a node, so copies are never paired.
* Shingles are ordered rarest first by the corpus-wide occurrence levels; two similar sets share a shingle in the prefixes of
  their orders. A shingle of level 0 occurs in one document only and is left out of the index.
* Answers are derived from a similar set's answers. Each set goes to one of its index lists once, and meets a few leading sets there. If it has
  at least half of all shingles in common with one of them, that is its hub: its overlap with it is computed, and only the
  shingles in which it differs from it are kept, as added and removed ones. Hubs that are alike are brought under one of them by combining differences.
  For two sets x and y of a hub of l shingles the overlap is then l - removed(x) - removed(y) + what their differences have in common,
  so ``common * (num + den) >= w(x) + w(y) - (den - num) * l`` decides, with w = num * added + den * removed. Sets of w up to
  (den - num) * l link with the hub itself. The others are looked for in an index of differences: what all sets of a group of near
  copies have in common is no part of them, so its lists are short. Full sets are never compared again within a hub.
* Sets of different hubs meet in the lists of the shingle index, which are read in order of set size and cut into
  blocks by position: a block whose positions leave too little room for the overlap that is needed is skipped as a whole.

Long lists are split into pieces by classes of set sizes, and each pair of pieces whose sets may link is a group of its own, so that no task holds a list as a whole.

Edge cases: null and empty texts have empty sets and link with nothing; texts with fewer words than a shingle have one shingle of
all their words; very long texts have large sets and need nothing special; repeated rows are repeated in the result; rows of equal ids and other
texts are judged apart; a null id is never the smallest one of a component, and a component without any other has a null one;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm import fingerprints as fp
from millwright.llm.common import Batcher, narrow, rows, task_of
from millwright.llm.components import components
from millwright.llm.scratch import likely, saved

INFO, ENTRY, SET, FREQUENT = 0, 1, 2, 3
#: From this occurrence level on the entries of a shingle are of kind FREQUENT. A shingle below it occurs in fewer than 8,192 documents, so its list may be counted by one task.
FREQUENT_LEVEL = 13
#: Positions of an index list that make up a block.
BLOCK = 8
#: Nodes of a task whose entries are not sent twice, and pairs that it does not send twice.
NODES_KEPT = 500_000
#: Leading sets of a piece that are remembered; the one that was met longest ago makes room for a new one.
LEADERS = 16
#: Sets of a list that look for their hub together, and entries of a list that are compared together.
PIECE, LIST_PIECE = 1024, 4096
#: Pieces of a list from which on it is split by classes of set sizes first: each class meets two others, so fewer pieces would be copied more often by classes.
CLASSED = 5

CORE, STRAY = 0, 1
#: Differences of so many shingles at most are entries as they are; larger ones as a sketch of SKETCH bits, which takes as many bytes.
EXACT, SKETCH = 128, 8192

_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_FOUND = pa.schema([*_PAIR, ("sure", pa.bool_())])


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def overlap_needed(n: int, m: int, num: int, den: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return _ceil(num * (n + m), num + den)


def index(docs: DataFrame, table: Broadcast, size: int, num: int, den: int) -> DataFrame:
    """The nodes of all documents, index entries of rare shingles, and the sets of nodes with entries, in one table.

    Kinds: INFO (doc_id, node, n), ENTRY and FREQUENT (token, node, n, pos), SET (node, n, set).
    """
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("token", pa.int64()), ("pos", pa.int32()), ("set", pa.binary())])
    frequent = FREQUENT_LEVEL

    def each(batches):
        task_of("fingerprints", fp.forget)
        levels, out, sent = np.frombuffer(table.value, np.uint8), Batcher(schema, most_rows=20_000), set()
        for i, text in rows(batches):
            s = fp.shingle_set(text, size)
            n = len(s)
            node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None
            if out.add((INFO, i, node, n, None, None, None)):
                yield out.take()
            if not n or node in sent:
                continue
            prefix = n - _ceil(num * n, den) + 1
            level = fp.level_of(levels, s)
            if prefix <= np.count_nonzero(level == 0):
                continue
            if len(sent) >= NODES_KEPT:
                sent.clear()
            sent.add(node)
            order = np.argsort(level, kind="stable")[:prefix]
            for pos, (token, shared) in enumerate(zip(s[order].view(np.int64).tolist(), level[order].tolist(), strict=True)):
                if shared and out.add((ENTRY if shared < frequent else FREQUENT, None, node, n, token, pos, None), 48):
                    yield out.take()
            if out.add((SET, None, node, n, None, None, s.tobytes()), 8 * n):
                yield out.take()
        yield out.take()

    return narrow(docs, "doc_id", "text").mapInArrow(each, "kind int, doc_id long, node binary, n int, token long, pos int, `set` binary")


def _held(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each of x, is it in s? s is ascending."""
    if not len(s):
        return np.zeros(len(x), bool)
    return s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x


def _hub_of(x: np.ndarray, leads: OrderedDict[bytes, np.ndarray], num: int, den: int) -> bytes | None:
    """The leading set that is most like x and has at least half of both sets' shingles in common with it."""
    best, found = 0.5, None
    for lead in reversed(leads):
        s = leads[lead]
        if 2 * min(len(s), len(x)) < max(len(s), len(x)):
            continue
        shared = np.count_nonzero(_held(x, s))
        likeness = shared / (len(x) + len(s) - shared)
        if likeness >= best:
            best, found = likeness, lead
            if den * shared >= num * (len(x) + len(s) - shared):
                break
    return found


_MEMBER = pa.schema([("node", pa.binary()), ("hub", pa.binary()), ("hub_n", pa.int32()), ("added", pa.binary()), ("removed", pa.binary())])
_MEMBER_DDL = "node binary, hub binary, hub_n int, added binary, removed binary"


def hubs(homes: DataFrame, num: int, den: int) -> DataFrame:
    """``node, hub, hub_n, added, removed`` of each set; ``homes``: token, piece, node, set. A set without a hub is its own."""

    def each(batches):
        out = Batcher(_MEMBER, most_rows=20_000)
        for _, group in groupby(rows(batches), key=lambda r: (r[0], r[1])):
            leads, last = OrderedDict(), None
            for _, _, node, raw in group:
                if node == last:
                    continue
                last, x = node, np.frombuffer(raw, np.uint64)
                hub = _hub_of(x, leads, num, den)
                if hub is None:
                    leads[node] = x
                    if len(leads) > LEADERS:
                        leads.popitem(last=False)
                    row = (node, node, len(x), b"", b"")
                else:
                    leads.move_to_end(hub)
                    s = leads[hub]
                    row = (node, hub, len(s), x[~_held(x, s)].tobytes(), s[~_held(s, x)].tobytes())
                if out.add(row, len(row[3]) + len(row[4])):
                    yield out.take()
        yield out.take()

    return homes.select("token", "piece", "node", "set").repartition("token", "piece").sortWithinPartitions("token", "piece", F.xxhash64("node"), "node").mapInArrow(each, _MEMBER_DDL)


def _with_sets(pairs: DataFrame, sets: DataFrame, *keep: str) -> DataFrame:
    """``a, b, x, y``: pairs with their sets. A set may be there more than once; then so is its pair."""
    pairs = saved(pairs)  # read for their sets' names first, so that no other sets are shuffled
    sets = likely(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", *keep)


def _moves(members: DataFrame, entries: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, to, to_n, hub_added, hub_removed``: hubs that are brought under a larger one, and their differences from it."""
    sizes = members.groupBy(F.col("hub").alias("node")).agg(F.count("*").alias("members")).filter("members > 1")
    listed = entries.join(sizes, "node").select("token", F.struct("members", "node").alias("lead"), "n")
    tops = listed.groupBy("token").agg(F.max("lead").alias("top"), F.count("*").alias("leads")).filter("leads > 1")
    pairs = listed.join(tops, "token").filter("lead.node <> top.node").select(F.col("lead.node").alias("a"), F.col("top.node").alias("b"), F.col("top.members").alias("members")).distinct()
    schema = pa.schema([("hub", pa.binary()), ("to", pa.binary()), ("to_n", pa.int32()), ("members", pa.int64()), ("hub_added", pa.binary()), ("hub_removed", pa.binary())])

    def each(batches):
        out = Batcher(schema)
        for a, b, x, y, n in rows(batches):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            new = x[~_held(x, y)]
            shared = len(x) - len(new)
            if 2 * shared >= len(x) + len(y) - shared and out.add((a, b, len(y), n, new.tobytes(), y[~_held(y, x)].tobytes()), 8 * len(x)):
                yield out.take()
        yield out.take()

    alike = _with_sets(pairs, sets, "members").mapInArrow(each, "hub binary, `to` binary, to_n int, members long, hub_added binary, hub_removed binary")
    best = saved(alike.groupBy("hub").agg(F.max(F.struct("members", "to", "to_n", "hub_added", "hub_removed")).alias("best")).select("hub", "best.*").drop("members"))
    return best.join(best.select(F.col("hub").alias("to")), "to", "left_anti")  # a hub that is moved itself takes none


def combined(a1: np.ndarray, r1: np.ndarray, a2: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a set adds to and removes from another hub, from its difference to its own hub and that hub's difference to the other."""
    return np.concatenate([a1[~_held(a1, r2)], a2[~_held(a2, r1)]]), np.concatenate([r1[~_held(r1, a2)], r2[~_held(r2, a1)]])


def _moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    """The members of moved hubs with their differences from the new ones."""

    def each(batches):
        out = Batcher(_MEMBER)
        for node, *raw, to, to_n in rows(batches):
            added, removed = (np.sort(x).tobytes() for x in combined(*(np.frombuffer(x, np.uint64) for x in raw)))
            if out.add((node, to, to_n, added, removed), len(added) + len(removed)):
                yield out.take()
        yield out.take()

    return members.join(moves, "hub").select("node", "added", "removed", "hub_added", "hub_removed", "to", "to_n").mapInArrow(each, _MEMBER_DDL)


def size_class(n: Column, num: int, den: int) -> Column:
    """Sets that link are of one class or of neighbouring ones: sizes of a class differ by a factor of ``den / num`` at most, and a bit, for rounding."""
    return F.floor(F.log(n.cast("double")) / (math.log(den / num) + 1e-9)).cast("long")


def _wanted(sizes: DataFrame, wanted: str) -> tuple[DataFrame, DataFrame]:
    """The lists that may give pairs, and those of more than LIST_PIECE entries with ``wanted``. The latter are at most one for so many entries, and written, so that their size
    lets them be broadcast and entries stay where they are until they are cut."""
    sizes = saved(sizes.withColumn("wanted", F.expr(wanted)).filter(F.col("wanted") | (F.col("size") > LIST_PIECE)))
    return sizes.filter("wanted").drop("wanted"), saved(sizes.filter(F.col("size") > LIST_PIECE))


def _in_pieces(lists: DataFrame, keys: list[str], long: DataFrame, node: str) -> DataFrame:
    """``lists`` with ``own``, an entry's piece of its list, and ``low, high``, for each group of two pieces that it is part of.
    ``long``: keys, ``size`` and ``wanted`` of lists of more than LIST_PIECE entries; others are one piece in one group."""
    pieces = F.coalesce(F.ceil(F.col("size") / LIST_PIECE), F.lit(1)).cast("long")
    owned = lists.join(long, keys, "left").filter(F.coalesce("wanted", F.lit(True))).withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64(node), F.col("pieces")))
    return _met(owned, F.col("pieces")).drop("pieces", "size", "wanted")


def _met(owned: DataFrame, others: Column) -> DataFrame:
    """``low, high`` of the groups in which an entry's own piece meets the first ``others`` ones."""
    other = owned.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return other.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def _in_pieces_of_strays(lists: DataFrame, keys: list[str], long: DataFrame, node: str) -> DataFrame:
    """The same for lists of which only strays meet others: they have the first pieces of a list, with which all its pieces meet, and no two pieces of other entries do.
    ``long`` has ``strays`` too, their number."""
    count = lambda n: F.coalesce(F.ceil(n / LIST_PIECE), F.lit(0)).cast("long")
    first, rest, stray = F.greatest(count(F.col("strays")), F.lit(1).cast("long")), count(F.col("size") - F.col("strays")), F.col("kind") == STRAY
    owned = lists.join(long, keys, "left").filter(F.coalesce("wanted", F.lit(True))).withColumns({"first": first, "rest": rest})
    at = F.xxhash64(node)
    own = F.when(stray | (F.col("rest") == 0), F.pmod(at, F.col("first"))).otherwise(F.col("first") + F.pmod(at, F.greatest("rest", F.lit(1).cast("long"))))
    met = _met(owned.withColumn("own", own), F.col("first") + F.when(stray, F.col("rest")).otherwise(F.lit(0)))
    return met.drop("first", "rest", "size", "strays", "wanted")


def _in_classed_pieces(lists: DataFrame, keys: list[str], sizes: DataFrame, node: str, of_class: Column) -> DataFrame:
    """The same for lists of which some are very long: of a list of CLASSED pieces or more each class has pieces of its own, and only pieces of one class or of
    neighbouring ones meet, since no other sets link. Entries are copied for those alone. A list has a few dozen classes at most."""
    place = lambda c, piece: c * (1 << 24) + piece
    of_class = F.when(F.col("size") > (CLASSED - 1) * LIST_PIECE, of_class).otherwise(F.lit(0).cast("long"))
    known = lists.join(sizes, keys).withColumn("class", of_class)
    long = lists.join(sizes.filter(F.col("size") > LIST_PIECE), keys).groupBy(*keys, of_class.alias("class")).agg(F.ceil(F.count("*") / LIST_PIECE).cast("long").alias("n"))
    pieces = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("pieces"))
    owned = known.join(pieces, keys, "left")
    of = lambda c: F.coalesce(F.try_element_at("pieces", c), F.lit(0).cast("long"))
    here = F.greatest(of(F.col("class")), F.lit(1).cast("long"))
    owned = owned.withColumn("own", place(F.col("class"), F.pmod(F.xxhash64(node), here)))
    near = lambda by, n: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: place(F.col("class") + by, k - 1))
    some = lambda by: F.when(of(F.col("class") + by) > 0, near(by, of(F.col("class") + by))).otherwise(F.array().cast("array<bigint>"))
    other = owned.withColumn("other", F.explode(F.concat(some(-1), near(0, here), some(1))))
    return other.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("pieces", "other", "size", "class")


class _Sent:
    """Drops pairs that a task has sent lately."""

    def __init__(self, schema: pa.Schema = _PAIR):
        self.seen: set[tuple] = set()
        self.out = Batcher(schema, most_rows=20_000)

    def add(self, a: bytes, b: bytes, *more) -> bool:
        row = (*((a, b) if a < b else (b, a)), *more)
        if row in self.seen:
            return False
        if len(self.seen) >= NODES_KEPT:
            self.seen.clear()
        self.seen.add(row)
        return self.out.add(row)


def parity(d: np.ndarray) -> int:
    """A bit for each of SKETCH values, set if an odd number of members falls on it: two sketches differ in no more bits than the sets in members."""
    counts = np.bincount((d >> np.uint64(7)).astype(np.int64) % SKETCH, minlength=SKETCH)
    return int.from_bytes(np.packbits(counts & 1 == 1).tobytes())


class Difference:
    """A set in the index of differences: its members if they are few, else their sketch."""

    def __init__(self, own: int, node: bytes, comp: bytes, w: int, size: int, pos: int, raw: bytes):
        self.own, self.node, self.comp, self.w, self.size, self.pos = own, node, comp, w, size, pos
        self.members = frozenset(np.frombuffer(raw, np.uint64).tolist()) if size <= EXACT else None
        self.sketch = int.from_bytes(raw) if size > EXACT else None

    def bits(self) -> int:
        if self.sketch is None:
            self.sketch = parity(np.fromiter(self.members, np.uint64, len(self.members)))
        return self.sketch

    def common(self, other: Difference) -> int:
        """Their number of common members, or no less than it."""
        if self.members is not None and other.members is not None:
            return len(self.members & other.members)
        return (self.size + other.size - (self.bits() ^ other.bits()).bit_count()) // 2


def _root(of: dict[bytes, bytes], x: bytes) -> bytes:
    while (y := of.get(x, x)) != x:
        x = y
    return x


def _of_differences(members: DataFrame, table: Broadcast, num: int, den: int) -> DataFrame:
    """Pairs (a, b, sure) of one hub whose differences have enough in common, where at least one does not link with the hub: sure
    links between components, as many as a task needs to join what its lists join, and pairs of sets that are too different from the hub to be sure.

    An entry of a difference d in the index is one of its first |d| - floor(w / (num + den)) shingles, since partners need at least
    floor(w / (num + den)) + 1 common ones; sets that do not link with the hub also look up further ones in the entries of those that do.
    """
    both = num + den
    schema = pa.schema([("hub", pa.binary()), ("token", pa.int64()), ("node", pa.binary()), ("kind", pa.int32()), ("w", pa.int64()), ("slack", pa.int64()), ("d", pa.int32()), ("pos", pa.int32()), ("indexed", pa.bool_()), ("held", pa.binary())])
    ddl = "hub binary, token long, node binary, kind int, w long, slack long, d int, pos int, indexed boolean, held binary"

    def entries(batches):
        levels, out = np.frombuffer(table.value, np.uint8), Batcher(schema, most_rows=20_000)
        for node, hub, hub_n, added, removed in rows(batches):
            a, r = np.frombuffer(added, np.uint64), np.frombuffer(removed, np.uint64)
            w, slack = num * len(a) + den * len(r), (den - num) * hub_n
            d = np.concatenate([a, r])
            prefix = len(d) - w // both
            looked_up = len(d) - max(1, _ceil(w - slack, den)) + 1 if w > slack else 0
            order = np.lexsort((d, np.arange(len(d)) >= len(a), fp.level_of(levels, d)))[: max(prefix, looked_up)]
            held = d.tobytes() if len(d) <= EXACT else parity(d).to_bytes(SKETCH // 8)
            for pos, token in enumerate(d[order].view(np.int64).tolist()):
                if out.add((hub, token, node, STRAY if w > slack else CORE, w, slack, len(d), pos, pos < prefix, held), len(held)):
                    yield out.take()
        yield out.take()

    strays = members.filter(F.col("comp") != F.col("hub")).select("hub").distinct()
    listed = saved(members.join(strays, "hub", "left_semi").select(_MEMBER.names).mapInArrow(entries, ddl))
    sizes = listed.groupBy("hub", "token").agg(F.count("*").alias("size"), F.sum((F.col("kind") == STRAY).cast("int")).alias("strays"), F.sum(F.col("indexed").cast("int")).alias("n_indexed"))
    sizes, long = _wanted(sizes, "size > 1 and strays > 0 and n_indexed > 0")
    cut = _in_pieces_of_strays(likely(listed, sizes, "hub", "token"), ["hub", "token"], long.drop("n_indexed"), "node")  # a short list that is not wanted gives no pairs

    def each(batches):
        sent, joined = _Sent(_FOUND), {}
        for (hub, _, low, high), group in groupby(rows(batches), key=lambda r: r[:4]):
            known = []
            if len(joined) >= NODES_KEPT:
                joined.clear()
            for *_, own, indexed, kind, node, w, slack, d, pos, raw in group:  # entries of the index come first, those of the hub's own partners before others
                x = Difference(own, node, node if kind == STRAY else hub, w, d, pos, raw)
                if kind == STRAY:
                    for y in known:
                        if (low != high and own == y.own) or not (indexed or y.comp == hub) or node == y.node:
                            continue
                        need = w + y.w - slack
                        if both * (1 + min(d - pos - 1, y.size - y.pos - 1)) < need or (mine := _root(joined, x.comp)) == (its := _root(joined, y.comp)) or both * x.common(y) < need:
                            continue
                        sure = x.members is not None and y.members is not None
                        if sure:
                            joined[max(mine, its)] = min(mine, its)
                        if sent.add(*((mine, its) if sure else (node, y.node)), sure):
                            yield sent.out.take()
                if indexed:
                    known.append(x)
        yield sent.out.take()

    ordered = cut.select("hub", "token", "low", "high", "own", "indexed", "kind", "node", "w", "slack", "d", "pos", "held").repartition("hub", "token", "low", "high")
    return ordered.sortWithinPartitions("hub", "token", "low", "high", F.desc("indexed"), "kind", "node").mapInArrow(each, "a binary, b binary, sure boolean")


def _links_in_hubs(found: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The links between components: the sure ones, and those of the other pairs that link by their differences from the hub."""
    side = lambda c: members.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"), "hub_n", F.col("added").alias(f"{c}_added"), F.col("removed").alias(f"{c}_removed"))

    def each(batches):
        out = Batcher(_PAIR)
        for a, b, n, *raw in rows(batches):
            a1, r1, a2, r2 = (np.frombuffer(x, np.uint64) for x in raw)
            common = np.count_nonzero(_held(a1, a2)) + np.count_nonzero(_held(r1, r2))
            if (num + den) * common >= num * (len(a1) + len(a2)) + den * (len(r1) + len(r2)) - (den - num) * n and out.add((a, b)):
                yield out.take()
        yield out.take()

    both = found.filter("not sure").select("a", "b").distinct().join(side("b").drop("hub_n"), "b").join(side("a"), "a")
    more = both.select("a_comp", "b_comp", "hub_n", "a_added", "a_removed", "b_added", "b_removed").mapInArrow(each, "a binary, b binary")
    return found.filter("sure").select("a", "b").union(more)


def _room(n: int, m: int, i: int, j: int, num: int, den: int) -> bool:
    """Could sets of n and m shingles link whose first common shingle is at these positions?"""
    return 1 + min(n - i - 1, m - j - 1) >= overlap_needed(n, m, num, den)


def _pairs_of_list(entries: Iterable[tuple], apart: bool, num: int, den: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of different hubs from one list of (n, node, pos, hub, piece), ascending by n. ``apart``: of different pieces only."""
    blocks: dict[int, deque[tuple]] = {}
    for n, node, j, hub, own in entries:
        for at, block in blocks.items():
            if n - at * BLOCK < overlap_needed(n, n, num, den):  # then no smaller set has room from there on either
                continue
            while block and den * block[0][0] < num * n:
                block.popleft()
            for n0, other, i, hub0, own0 in block:
                if hub0 != hub and (not apart or own0 != own) and _room(n0, n, i, j, num, den):
                    yield other, node
        blocks.setdefault(j // BLOCK, deque()).append((n, node, j, hub, own))


def _candidates(entries: DataFrame, place: DataFrame, longest: int, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different hubs; ``entries``: token, n, node, pos; ``place``: node, hub; ``longest``: the number of entries of the longest list."""
    sizes = entries.select("token", "node").join(place, "node").groupBy("token").agg(F.count("*").alias("size"), F.min("hub").alias("first"), F.max("hub").alias("last"))
    sizes, long = _wanted(sizes, "first <> last")  # lists of one hub are most, and only entries of others are shuffled as a whole
    sizes, long = sizes.select("token", "size"), long.select("token", "size", "wanted")
    entries = likely(entries, sizes, "token").join(place, "node")

    def each(batches):
        sent = _Sent()
        for (_, low, high), group in groupby(rows(batches), key=lambda r: r[:3]):
            for a, b in _pairs_of_list((r[3:] for r in group), low != high, num, den):
                if sent.add(a, b):
                    yield sent.out.take()
        yield sent.out.take()

    # Classes cost further joins, so they are for tables that have lists which they shorten; results are the same.
    made = _in_classed_pieces(entries, ["token"], sizes, "node", size_class(F.col("n"), num, den)) if longest > (CLASSED - 1) * LIST_PIECE else _in_pieces(entries, ["token"], long, "node")
    cut = made.select("token", "low", "high", "n", "node", "pos", "hub", "own")
    return cut.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "node").mapInArrow(each, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs that link, by the sets themselves, which their hubs' differences do not tell."""

    def each(batches):
        out = Batcher(_PAIR)
        for a, b, x, y in rows(batches):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = np.count_nonzero(_held(x, y))
            if den * shared >= num * (len(x) + len(y) - shared) and out.add((a, b)):
                yield out.take()
        yield out.take()

    return _with_sets(pairs, sets).mapInArrow(each, "a binary, b binary")


def _lists(made: DataFrame) -> DataFrame:
    """``token, n, node, pos, size``: entries of lists of two nodes or more. Lists that are known to be short are dealt out by token, once; others are counted in parts."""
    of = lambda kind: made.filter(F.col("kind") == kind).select("token", "n", "node", "pos")
    short = of(ENTRY).repartition("token").dropDuplicates(["token", "node"]).withColumn("size", F.count("*").over(W.partitionBy("token"))).filter("size > 1")
    frequent = of(FREQUENT).dropDuplicates(["token", "node"])
    return short.unionByName(frequent.join(frequent.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1"), "token"))


def join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document: components of the links at Jaccard ``num / den``."""
    texts = narrow(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(fp.levels(texts, lambda text: fp.shingle_set(text, size)).tobytes())
    made = saved(index(texts, table, size, num, den), "kind")
    info = made.filter(F.col("kind") == INFO).select("doc_id", "node", "n")
    entries = saved(_lists(made))
    sets = made.filter(F.col("kind") == SET).select("node", "set")

    home = entries.groupBy("node").agg(F.max(F.struct("size", "token")).alias("home")).select("node", "home.token", F.pmod(F.xxhash64("node"), F.ceil(F.col("home.size") / PIECE)).alias("piece"))
    home = saved(home)
    members = saved(hubs(likely(sets, home, "node").join(home, "node"), num, den))
    moves = saved(_moves(members, entries, sets))
    moved = saved(moves.select("hub"))  # narrow, so that its size decides on joins that need no more, and members of other hubs stay where they are
    members = members.join(moved, "hub", "left_anti").select(_MEMBER.names).union(_moved(members.join(moved, "hub", "left_semi"), moves))
    with_hub = num * F.length("added") / 8 + den * F.length("removed") / 8 <= (den - num) * F.col("hub_n")
    members = saved(members.withColumn("comp", F.when(with_hub, F.col("hub")).otherwise(F.col("node"))))

    inside = _links_in_hubs(saved(_of_differences(members, table, num, den)), members, num, den)
    place = members.select("node", "hub", "comp")
    across = _verified(_candidates(entries.drop("size"), place.select("node", "hub"), entries.agg(F.max("size")).first()[0] or 0, num, den), sets, num, den)
    ends = [place.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")) for c in ("a", "b")]
    across = across.join(ends[0], "a").join(ends[1], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    last = components(inside.union(across)).select(F.col("id").alias("comp"), "component")

    nodes = info.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")).join(place.select("node", "comp"), "node", "left")
    nodes = nodes.select("node", "rep", F.coalesce("comp", "node").alias("comp")).join(last, "comp", "left").select("node", "rep", F.coalesce("component", "comp").alias("comp"))
    least = nodes.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = nodes.join(least, "comp").select("node", "component_id")
    return info.join(known, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
