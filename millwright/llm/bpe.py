"""Byte-level BPE with a SentencePiece model that is written straight from a rank file.

A rank file maps byte strings to ranks. Each byte becomes one printable character, so that every piece is
a string without white space; the pieces in rank order, scored by their negative ranks, and an identity normaliser
make up a SentencePiece BPE model, which then merges the same neighbours in the same order as a rank-based encoder.
Texts are first split by the public pattern; each split is encoded by itself, and equal splits are looked up in a cache of
bounded size. Decoding maps pieces back to bytes.

Edge cases: a null text counts as empty and has no ids; very long splits go through the same model; repeated rows and ties need nothing
special, since rows are independent; an empty table gives an empty one; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millwright.llm.common import Batcher, narrow, rows, task_of

#: Distinct splits, and segments of a text, that a worker keeps; a fuller cache starts anew.
CACHE_SPLITS = 250_000
#: Longer ones are not kept.
CACHE_CHARS = 64
#: Texts of this many characters are encoded together.
GROUP_CHARS = 1_000_000


@functools.cache
def _segments(pattern: str):
    """Cuts a text before white space that follows other characters, where no match of a pattern like the public one can
    cross: its matches hold white space at their start or nothing else. White space is what the pattern's library takes for it. A pattern
    that takes white space after other characters, as some do with line ends after punctuation, is given the whole text.
    """
    splits = regex.compile(pattern).findall
    crossing = regex.compile(r"\S\s")
    probes = (a + space + b for a in ("a", "A", "1", ".", "!!", "'s", "é", "語", "_") for space in (" ", "  ", "\n", "\r\n", "\n\n ", "\t", "\u3000") for b in ("", "b", "2", "?", "'s"))
    if any(crossing.search(part) for probe in probes for part in splits(probe)):
        return lambda text: [text] if text else []
    space = "".join(f"\\u{i:04x}" for i in range(0x10000) if regex.match(r"\s", chr(i)))
    return re.compile(f"[{space}]*[^{space}]+|[{space}]+").findall


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces = [b""] * len(pairs)
    for token, rank in pairs:
        pieces[int(rank)] = base64.b64decode(token)
    return pieces


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: a varint, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


#: Field numbers and values of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NORM_NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
NO_ID = (1 << 64) - 1


def serialised(pieces: list[bytes]) -> bytes:
    """The SentencePiece model of a vocabulary; ids are ranks, and the obligatory unknown piece comes last."""
    chars = byte_characters()
    out = [_field(PIECES, _field(PIECE, "".join(map(chars.__getitem__, p)).encode()) + _field(SCORE, float(-rank)) + _field(KIND, NORMAL)) for rank, p in enumerate(pieces)]
    out.append(_field(PIECES, _field(PIECE, b"<unk>") + _field(SCORE, float(-len(pieces))) + _field(KIND, UNKNOWN)))
    out.append(_field(TRAINER, _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces) + 1) + _field(UNK_ID, len(pieces)) + b"".join(_field(k, NO_ID) for k in (BOS_ID, EOS_ID, PAD_ID))))
    out.append(_field(NORMALIZER, _field(NORM_NAME, b"identity") + b"".join(_field(k, 0) for k in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))))
    return b"".join(out)


class Codec:
    """Encodes texts to ids and ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.pieces = read_ranks(path)
        self.whole = {p: i for i, p in enumerate(self.pieces)}
        self.chars = dict(enumerate(byte_characters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.pieces))
        self.splits = regex.compile(pattern).findall
        self.segments = _segments(pattern)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.split_cache: dict[str, tuple[int, ...]] = {}

    def _learn_splits(self, splits: set[str]) -> None:
        """Encodes new splits: whole tokens by lookup, the others by one call of the model."""
        if len(self.split_cache) > CACHE_SPLITS:
            self.split_cache.clear()
        merged = []
        for split in splits:
            known = self.whole.get(split.encode())
            if known is None:
                merged.append(split)
            else:
                self.split_cache[split] = (known,)
        mapped = [s.encode().decode("latin-1").translate(self.chars) for s in merged]
        self.split_cache.update(zip(merged, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))

    def _learn(self, segments: set[str]) -> None:
        parts = {s: self.splits(s) for s in segments}
        if new := {s for s in itertools.chain.from_iterable(parts.values()) if s not in self.split_cache}:
            if len(self.split_cache) > CACHE_SPLITS:
                new.update(*parts.values())
            self._learn_splits(new)
        known = self.split_cache.__getitem__
        for segment, splits in parts.items():
            self.cache[segment] = known(splits[0]) if len(splits) == 1 else tuple(itertools.chain.from_iterable(map(known, splits)))

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of some texts; new segments of all of them are learnt together."""
        cut = [self.segments(t or "") for t in texts]
        every = set(itertools.chain.from_iterable(cut))
        if new := {s for s in every if s not in self.cache}:
            if len(self.cache) > CACHE_SPLITS:
                self.cache.clear()
                new = every
            self._learn(new)
        known = self.cache.__getitem__
        out = [list(itertools.chain.from_iterable(map(known, segments))) for segments in cut]
        for cache in (self.cache, self.split_cache):
            for key in [k for k in new if len(k) > CACHE_CHARS]:
                cache.pop(key, None)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def told(self, ids: Iterable[int]) -> str:
        """The ids as decimals, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process, as long as that has no tasks of other operators."""
    return Codec(path, pattern)


def grouped(pairs: Iterable[tuple[int, str | None]]):
    """The rows in groups of about GROUP_CHARS characters, at least one row each."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[1] or "")
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema: pa.Schema, ddl: str, row) -> DataFrame:
    def each(batches):
        task_of("bpe", codec.cache_clear)
        c, out = codec(path, pattern), Batcher(schema)
        for held in grouped(rows(batches)):
            for (i, _), ids in zip(held, c.encode_all([t for _, t in held]), strict=True):
                if out.add((i, *row(c, ids)), 8 * len(ids)):
                    yield out.take()
        yield out.take()

    return narrow(docs, id_col, text_col).mapInArrow(each, ddl)


def _sha256(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` and ``n_tokens`` for each document. ``decoded``: and ``decoded_sha256``, of the bytes that the ids decode to."""
    schema = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())]
    ddl = "doc_id long, ids array<int>, n_tokens long"
    if not decoded:
        return _mapped(docs, path, pattern, id_col, text_col, pa.schema(schema), ddl, lambda c, ids: (ids, len(ids)))
    schema, ddl = pa.schema([*schema, ("decoded_sha256", pa.string())]), f"{ddl}, decoded_sha256 string"
    return _mapped(docs, path, pattern, id_col, text_col, schema, ddl, lambda c, ids: (ids, len(ids), _sha256(c.decode(ids))))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and the decoded ``text``; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def each(batches):
        task_of("bpe", codec.cache_clear)
        c, out = codec(path, pattern), Batcher(schema)
        for i, ids in rows(batches):
            if out.add((i, c.decode(ids or ()).decode(errors="replace")), 8 * len(ids or ())):
                yield out.take()
        yield out.take()

    return encoded.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(each, "doc_id long, text string")


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``op6_byte_bpe``: number of tokens and digests of the ids and of the bytes they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    row = lambda c, ids: (len(ids), _sha256(c.told(ids).encode()), _sha256(c.decode(ids)))
    return _mapped(docs, path, pattern, id_col, text_col, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
