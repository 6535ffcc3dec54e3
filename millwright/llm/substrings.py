"""Passages that repeat across the corpus, by content-defined chunks.

A gear rolling hash over the last ``WINDOW`` bytes cuts a text where its top bits are zero, or where it is the least of ``FARTHEST`` bytes without
such a place, so cuts depend on nearby bytes only: after an insertion the next cuts fall on the same places again. Equal chunks are found by their digests, corpus-wide: from
each chunk on, the fewest chunks in which ``least_words`` words begin are one window, and windows of equal digests repeat. The first occurrence of a
window, by document id and position, is its owner, and later ones can be removed, but for those that overlap it. A passage is a run of
neighbouring repeated windows of one owner, so the owner's document holds each window of it, and what is common in short pieces only does not
divide a passage. Passages of several owners in a document may overlap by less than a window.

Windows that the table of occurrence levels proves unique are dropped before the shuffle. That is exact: they cannot be part of a result.

Edge cases: null and empty texts have no chunks; one word or byte repeated is cut into equal chunks; repeated rows hold repeated passages
(rows of equal ids count as occurrences of their own); other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import fingerprints as fp
from millwright.llm.common import Batcher, narrow, rows
from millwright.llm.scratch import saved

#: Bytes that a cut's hash depends on; zero bits of a cut; least distance of cuts; bytes in which there is a cut anyway.
WINDOW, CUT_BITS, NEAREST, FARTHEST = 16, 4, 8, 64
LEAST_WORDS = 20
#: An odd factor for digests of neighbouring chunks.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: A random 16-bit value for each byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=16) & 0xFFFF for b in range(256)], np.uint16)


def _over(h: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each window of ``size`` values."""
    out, have = h, 1
    while have < size:
        step = min(have, size - have)
        out, have = of(out[:-step], out[step:]), have + step
    return out


def cuts(raw: bytes) -> np.ndarray:
    """The ends of a text's chunks. All three rules look at nearby bytes only; where equal hashes are close, the text repeats with
    that distance, so any choice among them gives the same chunks."""
    data = np.frombuffer(raw, np.uint8)
    if len(raw) <= WINDOW:
        return np.array([len(raw)] if raw else [], np.int64)
    gear = GEAR[data]
    h = gear.copy()
    for k in range(1, WINDOW):
        h[k:] += gear[:-k] << np.uint16(k)
    h = h[WINDOW - 1 : -1]  # of the cuts from WINDOW to the last but one byte
    whole = data[WINDOW:] & 0xC0 != 0x80  # whole characters
    top = np.uint16(0xFFFF)
    h = np.where(whole, np.minimum(h, top - np.uint16(1)), top)
    cut = (h >> np.uint16(16 - CUT_BITS)) == 0
    if len(h) >= FARTHEST:  # in a window without a cut the least hash cuts
        least = np.pad(_over(h, FARTHEST, np.minimum), FARTHEST - 1)
        cut |= whole & (_over(least, FARTHEST, np.maximum) == h)
    near = np.pad(np.where(cut, h, top), NEAREST, constant_values=top)
    cut &= _over(near, 2 * NEAREST + 1, np.minimum) == h  # of cuts close to each other the one of the least hash
    at = np.flatnonzero(cut) + WINDOW
    if len(at) and np.diff(at).min(initial=NEAREST + 1) <= NEAREST:
        kept = [int(at[0])]
        for x in at[1:].tolist():
            if x - kept[-1] > NEAREST:
                kept.append(x)
        at = np.array(kept, np.int64)
    return np.append(at, len(raw))


def chunk_digests(raw: bytes, ends: np.ndarray) -> np.ndarray:
    view, digest, start, out = memoryview(raw), xxhash.xxh3_64_intdigest, 0, []
    for end in ends.tolist():
        out.append(digest(view[start:end]))
        start = end
    return np.array(out, np.uint64)


def text_digests(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    return chunk_digests(raw, cuts(raw))


def _word_starts(data: np.ndarray) -> np.ndarray:
    """For each place of a text, its end included, the words that begin before it."""
    black = data > 32
    black[1:] &= data[:-1] <= 32
    return np.concatenate([[0], np.cumsum(black)])


def windows(raw: bytes, ends: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each chunk on, the fewest chunks in which ``least_words`` words begin: byte ranges and fingerprints of the chunks' digests."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    begun = _word_starts(np.frombuffer(raw, np.uint8))
    last = np.searchsorted(begun[ends], begun[starts] + least_words)
    last = last[last < len(ends)]
    first = np.arange(len(last))
    power, back = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(len(ends) - 1, b, np.uint64))) for b in (BASE, BASE_INVERSE))
    total = np.append(np.zeros(1, np.uint64), np.cumsum(chunk_digests(raw, ends) * power))
    value = (total[last + 1] - total[first]) * back[first]
    return starts[first], ends[last].astype(np.int64), fp.mixed(value + (last - first).astype(np.uint64))


def text_windows(text: str | None, least_words: int = LEAST_WORDS) -> np.ndarray:
    raw = (text or "").encode()
    return windows(raw, cuts(raw), least_words)[2] if raw else np.zeros(0, np.uint64)


def repeated(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated passage: ``doc_id, start, end`` (code points), ``n_words``, ``n_copies`` (the most
    frequent window's occurrences), ``owner_id`` and ``removable`` (not the first occurrence)."""
    texts = narrow(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(fp.levels(texts, lambda text: text_windows(text, least_words)).tobytes())
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("to_word", pa.int32()), ("digest", pa.int64())])

    def each(batches):
        levels, out = np.frombuffer(table.value, np.uint8), Batcher(schema, most_rows=20_000)
        for i, row, text in rows(batches):
            if not text:
                continue
            raw = text.encode()
            start, end, digest = windows(raw, cuts(raw), least_words)
            at = np.flatnonzero(fp.level_of(levels, digest) > 0)
            if not len(at):
                continue
            data = np.frombuffer(raw, np.uint8)
            begun, point = _word_starts(data), np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            start, end, digest = start[at], end[at], digest[at].astype(np.int64)
            for found in zip(*(x.tolist() for x in (at, point[start], point[end], begun[start], begun[end], digest)), strict=True):
                if out.add((i, row, *found)):
                    yield out.take()
        yield out.take()

    numbered = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    found = saved(numbered.mapInArrow(each, "doc_id long, row long, ord int, start int, end int, word int, to_word int, digest long"))
    place = F.struct("doc_id", "row", "start", "end")
    owners = found.groupBy("digest").agg(F.count("*").alias("n_copies"), F.min(place).alias("owner"), F.max(place).alias("last"))
    apart = lambda c: (F.col(f"{c}row") != F.col("owner.row")) | (F.col(f"{c}start") >= F.col("owner.end"))
    owners = saved(owners.filter(apart("last.")).drop("last"))  # written: their join then reads both sides as they are, so that a digest with very many windows can be dealt to several tasks
    own = (F.col("owner.row") == F.col("row")) & (F.col("owner.start") == F.col("start"))
    known = found.join(owners, "digest").withColumn("removable", ~own).filter(~F.col("removable") | apart(""))

    # Neighbours: windows' numbers less their ranks are the same along a run. Runs of one document stay within it, so this window's groups are one document each.
    from pyspark.sql import Window as W

    by = ["row", "removable", "owner.row"]
    ranked = known.withColumn("run", F.col("ord") - F.row_number().over(W.partitionBy(*by).orderBy("ord")))
    spans = ranked.groupBy("row", "removable", F.col("owner.row").alias("owner_row"), "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to_word") - F.min("word")).alias("n_words"),
        F.max("n_copies").alias("n_copies"), F.first("owner.doc_id").alias("owner_id"),
    )
    return spans.select("doc_id", "start", "end", F.col("n_words").cast("long").alias("n_words"), "n_copies", "owner_id", "removable")
