"""Conversation structure repair: the cheapest edits that give each conversation the shape ``system? (user assistant)+``, or none at all.

Rows are hash-partitioned by conversation, sorted by turn, and read as a stream. Stretches of up to ``SEGMENT`` rows of many conversations make a batch of ``BATCH`` rows, of which
DuckDB sees one letter for each row. A recursive query advances all stretches of a batch by one row in each recursion, and keeps for each state of the grammar the least
cost and, of equally cheap edits, the ASCII-least audit. That choice is safe: audits that end in one state after the same rows at the same cost are never
prefixes of each other (only an insertion makes one longer, and it costs something), so what follows never turns their order around.

A conversation longer than a stretch goes on where the last one ended: a stretch is solved from each state, and its results are joined with the least costs and
audits so far. A digest is kept for each state, too, so that no task holds more than a stretch of any conversation besides its audit; one conversation is read by one
task, since its digest covers all its rows in order. Earlier rows of the same role and text are found by an aggregation of its own, partial before the shuffle, so a conversation of very many rows is spread over tasks there.

Faults of a row, of which the first counts: ``blank`` (no visible character), ``duplicate`` (role and text of an earlier row), ``truncated`` (the last visible character ends no sentence).
Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty turn) 2; blank and duplicate rows must go, and a truncated row that stays costs 1 more.

Edge cases: a null role or text is one space; a null turn stands before all others; turns of equal number are ordered by role and text, so equal rows are neighbours; a
role without a user's, an assistant's or a system's initial, such as an empty one, can't be kept; a null conv_id is a conversation of its own; a conversation whose rows are all dropped has zeros, an empty
audit and the digest of nothing; very long texts and conversations need nothing special; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import SPACE_CLASS, Batcher, rows
from millwright.llm.scratch import saved

#: Rows of a stretch that is solved at once, and rows of all stretches of a batch.
SEGMENT, BATCH = 128, 16_384
#: Characters of the texts of a batch, beyond the last row.
BATCH_CHARS = 8 << 20

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: States by the last role: nothing yet, system, user, assistant; and where each initial leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: A repaired conversation ends after an assistant, or is empty.
ENDS = (NONE, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: A row's letter if it must go, and if it may stay under another role only.
GONE, OTHER = "x", "o"

_INVISIBLE = rf"[{SPACE_CLASS}]+"


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, there``: the test damage, by the checksum of ``conv_id:turn``. A dropped row stays, without a role and a text, as one that is not there."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    df = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(F.col(f"`{role_col}`").cast("string")).alias("role"), space(F.col(f"`{text_col}`").cast("string")).alias("text"))
    key = F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))
    df = df.withColumn("_hit", F.crc32(key.cast("binary")) % 20)
    hit, there = F.col("_hit"), F.col("_hit") != 0
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(there, F.when(hit == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(there, text).alias("text"), there.alias("there"), F.when(hit == 3, 2).otherwise(1).alias("_times"))
    return df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_n", "_times")


def plain(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, there``: conversations as they are."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.lit(True).alias("there"))


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _said() -> Column:
    """What of a row is compared with earlier ones: the digest of role and text."""
    return F.md5(F.concat_ws("\x1f", "role", "text").cast("binary"))


def with_first_turns(df: DataFrame) -> DataFrame:
    """``df`` with ``again`` and ``first``: does its role and text stand in its conversation more than once, and in which turn for the first time? Only what is
    repeated is joined, one row for each."""
    said = df.withColumn("_said", _said())
    times = said.filter("there").groupBy("conv_id", "_said").agg(F.count("*").alias("_times"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"))
    repeated = times.filter("_times > 1").select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_of"), F.col("_first.turn").alias("first"))
    met = said.join(repeated, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_of")), "left")
    return met.select("conv_id", "turn", "role", "text", "there", F.col("_of").isNotNull().alias("again"), "first")


def steps() -> pa.Table:
    """``code, state, to_state, cost, edits``: what one row allows in each state, with up to two insertions before it. A row's letter is in capitals if it is truncated."""
    found = []
    for letter, state, inserted in product(("s", "u", "a", OTHER, GONE), range(4), range(3)):
        at, edits = state, INSERT * inserted
        for _ in range(inserted):
            at = NEXT[at, "a" if at == USER else "u"]
        ways = [(DELETE, at)]
        if letter != GONE:
            ways += [(KEEP, NEXT[at, letter])] if (at, letter) in NEXT else []
            ways += [(REROLE, NEXT[at, to]) for to in ROLES if (at, to) in NEXT]
        for edit, to in ways:
            cost = COST[INSERT] * inserted + COST[edit]
            found.append((letter, state, to, cost, edits + edit))
            if letter != GONE:
                found.append((letter.upper(), state, to, cost + TRUNCATED * (edit != DELETE), edits + edit))
    return pa.table(dict(zip(("code", "state", "to_state", "cost", "edits"), map(list, zip(*found, strict=True)), strict=True)))


_SOLVE = """
WITH RECURSIVE dp(id, codes, start, k, state, best) AS (
  SELECT id, codes, start, 0, start, {'cost': 0::BIGINT, 'audit': ''} FROM stretches
  UNION ALL
  SELECT id, codes, start, k + 1, to_state, min({'cost': best.cost + cost, 'audit': best.audit || edits})
  FROM dp JOIN steps ON code = codes[k + 1] AND steps.state = dp.state
  WHERE k < length(codes)
  GROUP BY id, codes, start, k, to_state)
SELECT id, start, state, best.cost, best.audit FROM dp WHERE k = length(codes)
"""


class Solver:
    """The recursive query, over stretches of many conversations."""

    def __init__(self):
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.register("given", steps())
        self.con.execute("CREATE TABLE steps AS SELECT code, state, to_state, cost::BIGINT AS cost, edits FROM given")

    def solve(self, stretches: list[tuple[int, str, int]]) -> dict[tuple[int, int], list[tuple[int, int, str]]]:
        """(id, start) to (state, cost, audit) of all states that the letters of a stretch can lead to; ``stretches``: id, letters, start."""
        ids, codes, starts = zip(*stretches, strict=True)
        self.con.register("stretches", pa.table({"id": pa.array(ids, pa.int64()), "codes": pa.array(codes, pa.string()), "start": pa.array(starts, pa.int32())}))
        found: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
        for i, start, *way in self.con.execute(_SOLVE).fetchall():
            found.setdefault((i, start), []).append(tuple(way))
        return found


def applied(audit: str, turns: Iterable[tuple[str, str]], state: int = NONE) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, insertions included; ``state``: where the audit begins."""
    turns = iter(turns)
    for edit in audit:
        if edit == INSERT:
            initial, role, text = "a" if state == USER else "u", None, ""
        else:
            role, text = next(turns)
            if edit == DELETE:
                continue
            initial = role[0] if edit == KEEP else "a" if state == USER else "u"
        state = NEXT[state, initial]
        yield edit, role if edit == KEEP else ROLES[initial], text


_ENDS_SENTENCE = re.compile(rf"[.!?][{SPACE_CLASS}]*\Z")
_VISIBLE = re.compile(rf"[^{SPACE_CLASS}]")


class _Conversation:
    """What is known of a conversation so far; turns of its unsolved stretch are held."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.low = self.high = self.last = None
        self.distinct = 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.before = None
        self.initial = None
        #: state: (cost, parts of the audit, digest of what is repaired so far)
        self.ways: dict[int, tuple[int, str, tuple]] = {NONE: (0, "", _Digest())}
        self.over = False

    def add(self, turn: int | None, role: str, text: str, again: bool, first: int | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += turn != self.last
            self.last = turn
        initial = role[:1]
        self.count["illegal"] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        fault = None
        if not _VISIBLE.search(text):
            fault = "blank"
        elif again and (turn != first or (turn, role, text) == self.before):
            fault = "duplicate"
        elif not _ENDS_SENTENCE.search(text):
            fault = "truncated"
        self.before = (turn, role, text) if again else None
        code = initial if initial in ("s", "u", "a") else OTHER
        if fault:
            self.count[fault] += 1
            code = code.upper() if fault == "truncated" else GONE
        self.turns.append((role, text))
        self.codes.append(code)

    def stretches(self, i: int) -> list[tuple[int, str, int]]:
        return [(i, "".join(self.codes), start) for start in self.ways]

    def advance(self, solved: dict, i: int) -> None:
        """Joins the results of the held stretch with what came before."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for start, (cost, audit, _) in self.ways.items():
            for state, more, edits in solved.get((i, start), ()):
                way = (cost + more, audit + edits, start, edits)
                if state not in best or way < best[state]:
                    best[state] = way
        if self.over:  # only the cheapest end matters
            best = {s: w for s, w in best.items() if s == self._end({s: w[:2] for s, w in best.items()})}
        ways = {}
        for state, (cost, audit, start, edits) in best.items():
            digest = self.ways[start][2].copy()
            digest.add(applied(edits, self.turns, start))
            ways[state] = (cost, audit, digest)
        self.ways, self.turns, self.codes = ways, [], []

    @staticmethod
    def _closing(state: int) -> str:
        """Insertions that make an end of a state."""
        return {NONE: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}[state]

    def _end(self, ways: dict[int, tuple]) -> int:
        return min(ways, key=lambda s: (ways[s][0] + COST[INSERT] * len(self._closing(s)), ways[s][1] + self._closing(s)))

    def row(self) -> tuple:
        state = self._end(self.ways)
        cost, audit, digest = self.ways[state]
        closing = self._closing(state)
        digest = digest.copy()
        digest.add(applied(closing, (), state))
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return (self.conv_id, gaps, *self.count.values(), cost + COST[INSERT] * len(closing), audit + closing, digest.hex())


class _Digest:
    """SHA-256 of turns, one a line."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def copy(self) -> _Digest:
        other = _Digest.__new__(_Digest)
        other.sha, other.any = self.sha.copy(), self.any
        return other

    def add(self, turns: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.sha.update(("\n" if self.any else "").encode() + role.encode() + b":" + text.encode())
            self.any = True

    def hex(self) -> str:
        return self.sha.hexdigest()


_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(turns: DataFrame) -> DataFrame:
    """``conv_id``, counts of faults, ``cost, audit`` and the digest of the repaired turns, for each conversation. ``turns``: as ``damaged`` or ``plain`` give them."""

    def each(batches):
        solver, out = Solver(), Batcher(_RESULT)
        held: list[_Conversation] = []
        n_rows = n_chars = 0

        def flush():
            nonlocal held, n_rows, n_chars
            asked = [x for i, c in enumerate(held) if c.codes for x in c.stretches(i)]
            solved = solver.solve(asked) if asked else {}
            for i, c in enumerate(held):
                if c.codes:
                    c.advance(solved, i)
                if c.over and out.add(c.row()):
                    yield out.take()
            held = [c for c in held if not c.over]  # the one that is still read
            n_rows = n_chars = 0

        for conv_id, turn, role, text, there, again, first in rows(batches):
            if not held or held[-1].conv_id != conv_id:
                if held:
                    held[-1].over = True
                if n_rows >= BATCH or n_chars >= BATCH_CHARS or len(held) >= BATCH:
                    yield from flush()
                held.append(_Conversation(conv_id))
            if there:
                held[-1].add(turn, role, text, again, first)
                n_rows += 1
                n_chars += len(text)
                if len(held[-1].codes) >= SEGMENT or n_chars >= BATCH_CHARS:
                    yield from flush()
        if held:
            held[-1].over = True
            yield from flush()
        yield out.take()

    return _ordered(with_first_turns(turns)).mapInArrow(each, _RESULT_DDL)


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, edit`` of all turns of the repaired conversations: audits and turns of a conversation meet in one task, which reads its turns as a stream."""
    audits = saved(repairs(turns).select("conv_id", "audit"))
    both = turns.filter("there").select(F.lit(1).alias("kind"), "conv_id", "turn", "role", "text").unionByName(audits.select(F.lit(0).alias("kind"), "conv_id", F.col("audit").alias("text")), allowMissingColumns=True)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def each(batches):
        out = Batcher(schema)
        given = rows(batches)
        row = next(given, None)
        while row is not None:
            _, conv_id, _, _, audit = row
            ahead = [next(given, None)]

            def its(ahead=ahead, conv_id=conv_id):
                while ahead[0] is not None and ahead[0][0] == 1 and ahead[0][1] == conv_id:
                    yield ahead[0][3], ahead[0][4]
                    ahead[0] = next(given, None)

            for position, (edit, role, text) in enumerate(applied(audit, own := its())):
                if out.add((conv_id, position, role, text, edit), len(text)):
                    yield out.take()
            for _ in own:  # none: an audit has an edit for each turn
                pass
            row = ahead[0]
        yield out.take()

    ordered = both.select("kind", "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.mapInArrow(each, "conv_id long, position long, role string, text string, edit string")


def digest(conversations: DataFrame) -> DataFrame:
    """The result of ``op12_conversation_repair``: repairs of the damaged conversations."""
    return repairs(damaged(conversations))
