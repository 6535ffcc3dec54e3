"""64-bit fingerprints of word shingles and how often each occurs in the corpus.

``levels`` counts fingerprints over all documents exactly (up to 32 bits below a range's prefix) and folds the counts into a table of fixed size, one byte
for each of ``2**TABLE_BITS`` cells: the largest ``floor(log2(count))`` of the fingerprints in the cell. That table has a proven
bound, so it may be collected and broadcast at any corpus size. A cell of level 0 proves that its fingerprints occur once. As the corpus
outgrows the table, more cells show more than their fingerprints' own counts; users only rely on level 0 and on one order for all
documents, so results stay exact and only their cost grows.

Counts travel as packed arrays: each task sorts its fingerprints, merges equal ones before the shuffle, and sends each range of
fingerprints as one row; so a fingerprint that every document holds reaches its reducer once per task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from millwright.llm.common import narrow, returned, rows, task_of

TABLE_BITS = 24
#: Fingerprints that a task gathers before it sends them.
FLUSH = 4_000_000
#: Distinct words whose hashes a worker keeps.
WORDS_KEPT = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = self.hash_of(word)
        return value

    def hash_of(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_hashes = WordHashes()
forget = _hashes.clear


def words(text: str | bytes | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space, which is what bytes know of either."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(tokens: list[bytes], known: WordHashes = _hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def shingles(tokens: list[bytes], size: int) -> np.ndarray:
    """A fingerprint for each run of ``size`` words; of fewer words for all of them; none for no words."""
    return runs(hashes(tokens), size)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of runs of word hashes, which are spread over 64 bits already: a polynomial of them with an odd base."""
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1 if width else 0, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mixed(out + np.uint64(width))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct fingerprints, ascending."""
    return np.unique(shingles(words(text), size))


#: Fingerprints of a range, on average: what a reducer holds at once, at four bytes and a few copies each. A text has one for each six bytes or so.
RANGE, BYTES_EACH = 8_000_000, 6


def _range_bits(df: DataFrame) -> int:
    """As many ranges as keep every reducer's share small, whatever the number of shuffle partitions: by the size of the input, of which Parquet may hold a third, and some for each partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 3 * int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(TABLE_BITS - 4, max(7, math.ceil(math.log2(2 * partitions)), math.ceil(math.log2(max(1, size / BYTES_EACH / RANGE)))))


#: Ranges are counted in so many groups, since what counting takes besides the fingerprints goes with the size of a group.
GROUP_BITS = 5


def packed(held: np.ndarray, bits: int) -> pa.RecordBatch:
    """For each of ``2**bits`` ranges of which there are fingerprints, those that occur once, others, and their counts; of each the 32 bits below the range's prefix. Sorts ``held`` itself."""
    held.sort()
    low, within = np.uint64(64 - bits - 32), 1 << (bits - GROUP_BITS)
    out = []
    for group, of_group in enumerate(np.split(held, np.searchsorted(held, np.arange(1, 1 << GROUP_BITS, dtype=np.uint64) << np.uint64(64 - GROUP_BITS)))):
        value, count = np.unique(of_group, return_counts=True)
        edges = np.searchsorted(value, np.arange(group * within + 1, (group + 1) * within, dtype=np.uint64) << np.uint64(64 - bits))
        short = (value >> low).astype(np.uint32)
        for part, (v, c) in enumerate(zip(np.split(short, edges), np.split(count, edges), strict=True), group * within):
            if len(v):
                one = c == 1
                out.append((part, v[one].tobytes(), v[~one].tobytes(), c[~one].astype(np.uint32).tobytes()))
    parts, *payload = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(p, pa.binary()) for p in payload)], names=["part", "single", "many", "counts"])


def levels(docs: DataFrame, fingerprints: Callable[[str | None], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The table of levels over all documents; ``fingerprints`` gives those of one text."""
    bits = _range_bits(docs)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("fingerprints", forget)
        held, size = np.empty(FLUSH, np.uint64), 0
        for _, text in rows(batches):
            found = fingerprints(text)
            if size + len(found) > FLUSH:
                yield packed(held[:size], bits)
                size = 0
            if len(found) > FLUSH:
                yield packed(found, bits)
                continue
            held[size : size + len(found)] = found
            size += len(found)
        if size:
            yield packed(held[:size], bits)
        del held
        returned()

    cells = 1 << (TABLE_BITS - bits)

    def merge(table: pa.Table) -> pa.Table:
        arrays = lambda name: [np.frombuffer(x.as_py(), np.uint32) for x in table[name]]
        single, many, counts = (np.concatenate(arrays(n)) for n in ("single", "many", "counts"))
        single.sort()
        edge = np.flatnonzero(np.concatenate([[True], single[1:] != single[:-1]])) if len(single) else np.zeros(0, np.int64)
        value = np.concatenate([single[edge], many])
        number = np.concatenate([np.diff(np.append(edge, len(single))), counts]).astype(np.int64)
        repeated = np.zeros(0, np.uint32)
        if len(many):  # values may be in both, or in many rows
            value, where = np.unique(value, return_inverse=True)
            number = np.bincount(where, weights=number).astype(np.int64)
        repeated = number > 1
        level = np.zeros(cells, np.uint8)
        np.maximum.at(level, value[repeated] >> np.uint32(32 - (TABLE_BITS - bits)), np.log2(number[repeated]).astype(np.uint8))
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "levels": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})

    sections = narrow(docs, id_col, text_col).mapInArrow(count, "part int, single binary, many binary, counts binary").groupBy("part").applyInArrow(merge, "part int, levels binary")
    out = np.zeros((1 << bits, cells), np.uint8)
    for part, section in sections.collect():  # 2**TABLE_BITS bytes at most, before compression
        out[part] = np.frombuffer(zlib.decompress(section), np.uint8)
    return out.reshape(-1)


def level_of(table: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    return table[(fingerprint >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
