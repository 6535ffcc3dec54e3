"""Sinks: CSV, JSON, reports, an append-only cache."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a report at most.
MOST_REPORTED = 1000


def new_path(spark: SparkSession) -> str:
    """Below the folder that the executors share; on one machine without such a setting, below a temporary one. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    hadoop, system = _hadoop(spark, path)
    system.deleteOnExit(hadoop)
    return path


def _hadoop(spark: SparkSession, path: str):
    """A path and the file system that it is on, whichever that is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _hadoop(spark, path)
    return bool(system.exists(hadoop))


def _listed(spark: SparkSession, path: str) -> list:
    hadoop, system = _hadoop(spark, path)
    return list(system.listStatus(hadoop)) if system.exists(hadoop) else []


def written_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of a table's partitions."""
    return sorted(str(s.getPath()) for s in _listed(spark, path) if s.isDirectory() and "=" in s.getPath().getName())


def files_of(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """The data files below a folder (or the file itself), their sizes and when they were changed."""
    return {str(s.getPath()): (s.getLen(), s.getModificationTime()) for s in _listed(spark, path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}


def write_csv(df: DataFrame, path: str | None = None) -> str:
    path = path or new_path(df.sparkSession)
    df.write.csv(path, header=True, escape='"')
    return path


def write_json(df: DataFrame, path: str | None = None) -> str:
    path = path or new_path(df.sparkSession)
    df.write.json(path)
    return path


def report(df: DataFrame) -> str:
    """A summary as JSON text with sorted keys, for the driver: more rows than a summary has (MOST_REPORTED) raise, none are left out."""
    import json

    rows = [json.loads(x) for x in df.toJSON().take(MOST_REPORTED + 1)]
    if len(rows) > MOST_REPORTED:
        raise ValueError(f"more than {MOST_REPORTED} rows are no summary; write them with write_json")
    return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, sort_keys=True)


_MADE: dict[tuple[str, ...], str] = {}


def once(spark: SparkSession, key: tuple[str, ...], make: Callable[[str], None], mark: str) -> str:
    """The path below which ``make`` has written, once in an application for each key, and again if it is gone. ``mark``: what is there when it is complete."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE or not exists(spark, f"{_MADE[key]}/{mark}"):
        path = new_path(spark)
        make(path)
        _MADE[key] = path
    return _MADE[key]


def write_groups(df: DataFrame, by: str, order: list[str], path: str | None = None, rows_per_file: int = 1_000_000) -> str:
    """The rows of each group as a sorted stream: a folder for each value of ``by``, whose files, read by the numbers in their names, hold its rows in order.

    Ranges are of the group and the order together, so a group of very many rows is spread over tasks and files, and no task holds more than the row that it writes.
    """
    path = path or new_path(df.sparkSession)
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)
    return path


def read_groups(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``write_groups`` wrote, with ``file`` and ``at``, by which the rows of a group are ordered. ``like``: a table of the same columns.

    ``file`` is the task and the number among its files, which a name has (``part-00003-...c1000...``) without zeros before it, so that names would put c1000 before c999."""
    df = spark.read.schema(like.schema).parquet(path)
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    file = F.struct(number(r"^part-(\d+)").alias("task"), number(r"[.-]c(\d+)\.").alias("number"))
    return df.select(*like.columns, file.alias("file"), F.col("_metadata.row_index").alias("at"))


def stage(df: DataFrame) -> DataFrame:
    """The rows of a stage that several later ones read, written once as Parquet: not computed again, and not lost with an executor."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str, below: str) -> bool:
    """Deletes an output folder. It must lie below ``below``, so that a wrong path deletes nothing else; false if there was none."""
    if not path.startswith(below.rstrip("/") + "/") or ".." in path.split("/"):
        raise ValueError(f"{path} does not lie below {below}")
    hadoop, system = _hadoop(spark, path)
    return bool(system.delete(hadoop, True))
