"""Preparation of training data: byte tokens, shifted and masked labels, the learning rate's curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids below this stand for padding, the end of a sequence, and unknown ones; and what a masked label gets.
OFFSET, PAD, END, IGNORED = 3, 0, 1, -100


def byte_ids(c: Column, most: int) -> Column:
    """The UTF-8 bytes of a text as ids, and the mark of its end: ``most`` ids at most, the mark included."""
    digits = F.hex(F.encode(c, "utf-8"))
    n = F.least(F.length(digits) / 2, F.lit(most - 1)).cast("int")
    bytes_ = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + OFFSET)
    return F.when(c.isNotNull(), F.concat(bytes_, F.array(F.lit(END))))


def padded(ids: Column, length: Column) -> Column:
    """Ids with padding up to a length, that of the longest of a batch or a fixed one."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def byte_tokens(c: Column, length: int) -> Column:
    """The same number of ids for each text."""
    return padded(byte_ids(c, length), F.lit(length))


def shift_left(a: Column, pad: int) -> Column:
    return F.concat(F.slice(a, 2, F.size(a) - 1), F.array(F.lit(pad)))


def mask(a: Column, pad: int) -> Column:
    return F.transform(a, lambda x: F.when(x == pad, IGNORED).otherwise(x))


def learning_rate(step: Column, warmup: int = 1000, first: float = 1e-7, peak: float = 5e-5) -> Column:
    """Relative to its peak: linear up to the end of the warm-up, then with the inverse square root of the step."""
    rising = (F.lit(first) + step * ((peak - first) / warmup)) / peak
    return F.when(step < warmup, rising).otherwise(F.lit(warmup**0.5) * F.pow(step.cast("double"), F.lit(-0.5)))
