"""Batches of texts of like length, so that little of what a model sees is padding."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of a batch, padding included, and rows of it.
MOST_PADDED, MOST_ROWS = 1 << 16, 1024


def by_length(df: DataFrame, length: str, most_padded: int = MOST_PADDED, most_rows: int = MOST_ROWS) -> DataFrame:
    """``df`` with ``batch`` and ``longest``: rows of like ``length`` (a column of whole numbers; null: 0) in batches of which rows times the longest are no more than ``most_padded``.

    Rows are range-partitioned and sorted by length, and each task cuts its stream, of which it holds one batch. A row that is longer than a batch may be is alone in
    its own. Texts are left whole, all rows stay, and a length that very many rows have is spread over partitions by a random number.
    """
    spread = df.withColumn("_length", F.coalesce(F.col(length), F.lit(0)).cast("long")).withColumn("_spread", F.rand(1))
    ordered = spread.repartitionByRange("_length", "_spread").sortWithinPartitions("_length").drop("_spread")
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.StringType()), T.StructField("longest", T.LongType())])

    def each(batches):
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def made(longest: int):
            nonlocal number, held, n
            table = pa.Table.from_batches(held).combine_chunks()
            number, held, n = number + 1, [], 0
            rows = table.num_rows
            more = [pa.array([f"{part}-{number}"] * rows, pa.string()), pa.array([longest] * rows, pa.int64())]
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.drop_columns(["_length"]).columns]
            return pa.RecordBatch.from_arrays([*columns, *more], names=schema.names)

        last = 0
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("_length")).to_pylist()
            start = 0
            for at, size in enumerate(lengths):
                if n and ((n + 1) * size > most_padded or n == most_rows):
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    yield made(last)
                    start = at
                n, last = n + 1, size
            if len(lengths) > start:
                held.append(batch.slice(start))
        if n:
            yield made(last)

    return ordered.mapInArrow(each, schema)


def padding_share(batched: DataFrame, length: str) -> DataFrame:
    """``share``: how much of all batches is padding, 0 without any units."""
    n = batched.agg(F.sum(F.coalesce(F.col(length), F.lit(0))).alias("used"), F.sum("longest").alias("all"))
    return n.select(F.coalesce(1 - F.col("used") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("share"))
