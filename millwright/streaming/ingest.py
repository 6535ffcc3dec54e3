"""An extension: work orders that arrive as files are cleaned, and inputs that the cache does not hold yet are passed on.

Each micro-batch writes a folder of its own, by its number, in the output and in the cache. A batch that fails between the two, or before its number is noted as done, is repeated by
Spark under the same number and replaces what it has left; what it wrote to the cache itself is no reason to skip an input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millwright.functions import text
from millwright.sources import cache as cached
from millwright.sources.sinks import stage

SCHEMA = T.StructType([T.StructField("input", T.StringType())])


def handle(df: DataFrame, number: int, cache: str, out: str) -> None:
    """One micro-batch: ``input``."""
    run, inputs = f"batch-{number}", stage(df.distinct())
    known = cached.probe(cache, inputs, SCHEMA, without=run)
    new = stage(inputs.join(known, "input", "left_anti"))
    new.write.mode("overwrite").parquet(f"{out}/batch={number}")
    cached.append(cache, new, run)


def start(spark: SparkSession, source: str, cache: str, out: str, state: str) -> StreamingQuery:
    """Handles what is there and ends; called again, it goes on from ``state``."""
    orders = spark.readStream.schema("id long, text string").json(source)
    cleaned = orders.filter("text is not null").select(text.clean(F.col("text")).alias("input"))
    return cleaned.writeStream.foreachBatch(lambda df, number: handle(df, number, cache, out)).option("checkpointLocation", state).trigger(availableNow=True).start()
