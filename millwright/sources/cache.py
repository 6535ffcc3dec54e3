"""A cache of results by their input: runs append to it, and probes read only the folders that their inputs can be in.

Layout: ``run=<name>/prefix=<hex digits>``. A row lies below the first ``PREFIX`` hex digits of its input's SHA-256 digest. Each run writes a folder of its own as one job, which becomes visible with the job's
mark of success; a run of one name replaces itself, so a run that is repeated leaves nothing twice. Runs at the same time may bring one input each: the row of
the run whose name comes first counts, and compaction drops the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.sources.sinks import exists, remove, stage, written_folders

#: Hex digits of a folder's name: 256 folders.
PREFIX = 2


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def prefix(c: Column) -> Column:
    return F.substring(digest(c), 1, PREFIX)


def runs(spark: SparkSession, path: str) -> list[str]:
    """The runs that are complete, by name."""
    return sorted(f.rsplit("run=", 1)[1] for f in written_folders(spark, path) if "/run=" in f and exists(spark, f"{f}/_SUCCESS"))


def append(path: str, rows: DataFrame, run: str | None = None) -> str:
    """Writes rows, which have a column ``input``, as a run, and gives its name. Rows of one folder go to one task, so that a run has one file in each."""
    run = run or uuid.uuid4().hex
    rows.withColumn("prefix", prefix(F.col("input"))).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/run={run}")
    return run


def read(spark: SparkSession, path: str, schema: T.StructType, without: str | None = None) -> DataFrame:
    """All rows of complete runs, with ``run`` and ``prefix``; ``without``: a run that is left out."""
    found = [r for r in runs(spark, path) if r != without]
    fields = T.StructType([f for f in schema.fields if f.name not in ("run", "prefix")] + [T.StructField("run", T.StringType()), T.StructField("prefix", T.StringType())])
    if not found:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("basePath", path).parquet(*(f"{path}/run={r}" for r in found))


def _first_run(rows: DataFrame) -> DataFrame:
    """One row for each input: that of the first run."""
    rest = [c for c in rows.columns if c not in ("input", "run", "prefix")]
    return rows.groupBy("input").agg(F.min_by(F.struct("prefix", *rest), "run").alias("_r")).select("input", "_r.*")


def probe(path: str, inputs: DataFrame, schema: T.StructType, without: str | None = None) -> DataFrame:
    """The cached rows of the inputs, one for each. ``inputs``: distinct ones in a column ``input``. The prefixes that occur, as many as there are folders at most, prune the scan."""
    spark = inputs.sparkSession
    asked = [r.prefix for r in inputs.select(prefix(F.col("input")).alias("prefix")).distinct().collect() if r.prefix]
    rows = read(spark, path, schema, without).filter(F.col("prefix").isin(asked))
    return _first_run(rows.join(inputs.select("input"), "input", "left_semi")).drop("prefix")


def compact(spark: SparkSession, path: str, schema: T.StructType) -> str:
    """All complete runs as one, each input once. The new run is complete before the old ones go, so a run that ends in between loses nothing."""
    old = runs(spark, path)
    rows = stage(_first_run(read(spark, path, schema)).drop("prefix"))
    new = append(path, rows)
    for r in old:
        remove(spark, f"{path}/run={r}", path)
    return new
