"""What the document operators share: reading tables, and a narrow view of the columns they need."""

from __future__ import annotations

import ctypes
import operator
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words everywhere in this package.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str, text_col: str, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """Only the id and the text, under fixed names: other columns, whatever their names, never reach an operator."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias(id_), F.col(f"`{text_col}`").cast("string").alias(text))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, as the contracts ask; lower() would change other scripts too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


as_py = operator.methodcaller("as_py")


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches one by one, without a Python list of a whole batch."""
    for batch in batches:
        yield from zip(*(map(as_py, c) for c in batch.columns), strict=True)


class Batcher:
    """Gathers result rows and gives Arrow batches of a bounded number of rows and bytes."""

    def __init__(self, schema: pa.Schema, most_rows: int = 2000, most_bytes: int = 4 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self.held: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, weight: int = 0) -> bool:
        """True when the batch is full and should be taken."""
        self.held.append(row)
        self.bytes += weight
        return len(self.held) >= self.most_rows or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.held, strict=True)) or [()] * len(self.schema)
        self.held, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)


#: How this worker process forgets what it keeps for later tasks of an operator, by the operator's name.
_KEPT: dict[str, Callable[[], object]] = {}


def returned() -> None:
    """Gives memory that has been freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def task_of(owner: str, forget: Callable[[], object]) -> None:
    """To be called where a task begins: what other operators keep in this worker process goes. ``forget``: clears the caches of this one.

    Workers outlive their tasks, so those of a pipeline would hold the caches of all its stages at once."""
    for other in [k for k in _KEPT if k != owner]:
        _KEPT.pop(other)()
    _KEPT[owner] = forget
    returned()
