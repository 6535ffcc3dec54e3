"""Filter interaction audit: what each filter removes in every order of filters, by part of the corpus.

Documents are range-sorted by the fingerprint of their text, the text itself and doc_id, so that copies are neighbours and also very many copies of one text are spread over partitions. Each task reads its partition as
a stream and compares a document with the first one of its run of equal texts; it holds one text of a run. A run that goes on across partitions has its least id in an earlier one: each
partition writes the digests and least ids of its first and its last run (two rows for each partition, whatever its size). An aggregation of these rows gives the least id of each such text, and so of the
first run of each partition; documents of first runs look it up by the number of their partition, not by their text, so that many copies stay spread.

What fails is a mask of bits, one for each filter. Masks are counted by part with partial aggregation, together with the labels: these counters are additive, so those of two sets of documents
add up. Every order and step follows from the counters of a part, without another look at documents.

Edge cases: a null or empty text has no words, so it fails A, and by the letter of the rules neither B, C nor D; null and empty texts are identical; a null source
is the empty part; documents of one id and text are no copies of each other, and each is counted; a null id is neither smaller than another nor the other way
round; several label rows of an id count once, if any of them says 1; very long texts are sorted as they are; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import Batcher, rows
from millwright.llm.scratch import saved

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: The bit of copies; the other bits are those of ``mask_of``.
COPY = 1 << FILTERS.index("E")

LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that go on with a character of UTF-8.
_LATER = bytes(range(0x80, 0xC0))

#: Kinds of rows: a document of a run that began in its partition, one of the first run of its partition, the first and the last run of a partition.
INSIDE, FIRST, FIRST_RUN, LAST_RUN = range(4)


def mask_of(text: bytes) -> int:
    """The filters that a text fails by itself: A few words, B few distinct ones, C many capitals, D symbols. Words are split at ASCII white space, as UTF-8 bytes are, too."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _LATER))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * upper > MOST_UPPER * points, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


_ROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("at", pa.int32()), ("run", pa.binary())])
_ROW_DDL = "kind int, doc_id long, part string, mask int, at int, run binary"


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of each document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    by_id = F.col("doc_id").asc_nulls_last()
    # Fingerprints are SHA-256, so ranges of them and of ids are those of texts and of ids; the samples that bound the ranges hold no texts.
    ordered = plain.withColumn("print", F.unhex(F.sha2("text", 256))).repartitionByRange("print", by_id).sortWithinPartitions("print", "text", by_id).select("print", "text", "doc_id", "part")

    def each(batches):
        out, number = Batcher(_ROW, most_rows=20_000), TaskContext.get().partitionId()
        fingerprint, text, least, own, n_runs = None, b"", None, 0, 0  # of the run: its fingerprint, text, least id and mask
        for its_print, its_text, doc_id, part in rows(batches):
            if its_print != fingerprint or its_text != text or not n_runs:
                if n_runs == 1 and out.add((FIRST_RUN, least, None, None, number, fingerprint)):
                    yield out.take()
                n_runs += 1
                fingerprint, text, least, own = its_print, its_text, doc_id, mask_of(its_text)
            copy = doc_id is not None and least is not None and doc_id > least
            if out.add((FIRST if n_runs == 1 else INSIDE, doc_id, part, own | (COPY if copy else 0), number, None)):
                yield out.take()
        if n_runs:
            out.add((LAST_RUN if n_runs > 1 else FIRST_RUN, least, None, None, number, fingerprint))
        yield out.take()

    found = saved(ordered.mapInArrow(each, _ROW_DDL))
    edges = found.filter(F.col("kind").isin(FIRST_RUN, LAST_RUN))
    starts = edges.filter(F.col("kind") == FIRST_RUN).select("at", "run").join(edges.groupBy("run").agg(F.min("doc_id").alias("least")), "run").select("at", "least")
    first = found.filter(F.col("kind") == FIRST).join(starts, "at")
    settled = F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask"))
    return found.filter(F.col("kind") == INSIDE).select("doc_id", "part", "mask").unionByName(first.select("doc_id", "part", settled.alias("mask")))


def counters(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """``part, mask, n, good, toxic``: additive counters of ``masks``."""
    said = lambda c: F.max((F.col(f"`{c}`") == 1).cast("int"))
    known = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(said(good_col).alias("good"), said(toxic_col).alias("toxic")).filter("good = 1 or toxic = 1")
    met = found.join(known, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def merged(*counted: DataFrame) -> DataFrame:
    """The counters of several disjoint sets of documents, such as batches, as one. Copies across sets aren't seen by it."""
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def audit(counted: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and what the step's filter does: every order and step of every part, from its counters alone."""
    arrays = {c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(MASKS))) for c in ("n", "good", "toxic")}
    parts = counted.groupBy("part").agg(*(a.alias(c) for c, a in arrays.items()))
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    each = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda letters: sum(((F.instr(letters, f) > 0).cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    each = each.withColumns({"_own": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "_before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("_own"), F.col("_before")
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(of: str, test) -> Column:
        """The counters of the masks that a test holds for."""
        return F.aggregate(F.filter(every, test), F.lit(0).cast("long"), lambda x, m: x + F.get(F.col(of), m))

    removed = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    # Of all orders a document is removed by each of its k failing filters in one of k.
    n_orders = len(list(permutations(FILTERS)))
    shapley = F.aggregate(F.filter(every, lambda m: m.bitwiseAND(own) != 0), F.lit(0).cast("long"), lambda x, m: x + (F.get("n", m) * n_orders / F.bit_count(m)).cast("long"))
    return each.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of ``op13_filter_audit``."""
    return audit(saved(counters(masks(docs), labels)))
