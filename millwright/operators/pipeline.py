"""From a CSV file and settings to a saved graph, in stages that a later run takes up where something changed.

A stage's tables lie in a folder named by a digest of what they follow from: the stage before it, the settings that it reads, and for the first one the names, sizes and times of
the input files. Its manifest, written last, says so in words and has the tables' schemas. A run that finds a complete folder of a stage reads it; else it makes the
stage and all after it. So a run that failed goes on with the stage that it failed in, a changed threshold runs the scoring and what follows only, and
settings that were there before find their tables again.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators import extract, graph, refine, score, setup
from millwright.sources.settings import Settings
from millwright.sources.sinks import exists, files_of, remove, stage, written_folders
from millwright.sources.tables import read_gazetteer

#: Changes when a stage's rows would for equal settings.
VERSION = 1

Tables = dict[str, DataFrame]


class Stage(NamedTuple):
    name: str
    #: the settings that its rows depend on, as group and name
    settings: tuple[tuple[str, str], ...]
    make: Callable[[SparkSession, Settings, Tables], Tables]
    #: what else its rows depend on, in words
    more: str = ""


def resume(spark: SparkSession, folder: str, stages: list[Stage], settings: Settings, source: str) -> tuple[Tables, list[str]]:
    """The tables of all stages, and the names of those that were made now. ``source``: what the first stage reads, in words that change with it."""
    tables, made, before = {}, [], source
    for s in stages:
        seen = {f"{group}.{name}": getattr(getattr(settings, group), name) for group, name in s.settings}
        digest = hashlib.sha256(json.dumps([VERSION, s.name, s.more, before, seen], sort_keys=True, default=str).encode()).hexdigest()
        path = f"{folder}/{s.name}/digest={digest[:32]}"
        if not exists(spark, f"{path}/manifest/_SUCCESS"):
            found = s.make(spark, settings, tables)
            for name, df in found.items():
                df.write.mode("overwrite").parquet(f"{path}/{name}")
            told = {"stage": s.name, "digest": digest, "before": before, "settings": seen, "schemas": {n: df.schema.jsonValue() for n, df in found.items()}}
            spark.createDataFrame([(json.dumps(told, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
            made.append(s.name)
        manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
        tables |= {n: spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/{n}") for n, schema in manifest["schemas"].items()}
        before = digest
    return tables, made


def forget(spark: SparkSession, folder: str, stages: list[Stage], keep: Tables) -> int:
    """Deletes the folders of stages that none of the tables in use comes from, and gives their number."""
    used = {f.rsplit("/", 2)[0].split("digest=")[1].split("/")[0] for df in keep.values() for f in df.inputFiles()}
    gone = [f for s in stages for f in written_folders(spark, f"{folder}/{s.name}") if f.split("digest=")[1] not in used]
    for f in gone:
        remove(spark, f, f.rsplit("/", 1)[0])
    return len(gone)


def source_of(spark: SparkSession, path: str) -> str:
    """The files of an input by name, size and time: cheap to ask for, and other ones after each change."""
    return json.dumps(sorted((f, *told) for f, told in files_of(spark, path).items()))


def stages(model, model_name: str, gazetteer: dict[str, list[list[str]]]) -> list[Stage]:
    """The stages of a run with an extractor (or what loads one), whose results are kept under a name, and a gazetteer."""

    def set_up(spark: SparkSession, settings: Settings, _: Tables) -> Tables:
        loaded = setup.load(spark, settings)
        return {"orders": setup.select(loaded.orders, settings), "rejected": loaded.rejected}

    def extraction(spark: SparkSession, settings: Settings, t: Tables) -> Tables:
        found, _, _ = extract.run(t["orders"].select("id", "input"), model, f"{settings.folders.path('cache')}/predictions-{model_name}")
        relations = found.select(F.col("id").alias("record_id"), F.explode("relations").alias("r"))
        return {"raw": relations.select("record_id", "r.head", "r.head_type", "r.tail", "r.tail_type", "r.relation"), "extracted": found.select("id", "predicted", "norms", "entities")}

    def refinement(spark: SparkSession, settings: Settings, t: Tables) -> Tables:
        return {"triples": refine.refined(t["raw"], read_gazetteer(spark, gazetteer), settings.processing.remove_subsumption)}

    def scoring(spark: SparkSession, settings: Settings, t: Tables) -> Tables:
        stats = score.scored(t["triples"])
        if not settings.processing.remove_rare_outliers:
            return {"stats": stats, "surviving": t["triples"].join(stats, ["head", "relation", "tail"])}
        stats = stage(stats)
        return {"stats": stats, "surviving": score.without_rare_outliers(t["triples"], stats, score.thresholds(stats))}

    def build(spark: SparkSession, settings: Settings, t: Tables) -> Tables:
        g = graph.build(t["orders"], t["surviving"])
        return {name: getattr(g, name) for name in graph.STORED}

    own = lambda group, *names: tuple((group, n) for n in names)
    processing = own("processing", "site_codes", "systems", "unplanned_only", "add_dummy_cols", "limit")
    return [
        Stage("setup", own("input", *(f.name for f in dataclasses.fields(Settings().input))) + processing, set_up),
        Stage("extraction", (), extraction, model_name),
        Stage("refinement", own("processing", "remove_subsumption"), refinement, json.dumps(gazetteer, sort_keys=True)),
        Stage("scoring", own("processing", "remove_rare_outliers"), scoring),
        Stage("graph", (), build),
    ]


def run(spark: SparkSession, settings: Settings, model, model_name: str, gazetteer: dict[str, list[list[str]]]) -> tuple[graph.Graph, Tables, list[str]]:
    """The graph of a CSV file, with the tables of all stages and the names of those that were made now; all of it lies in the output folder."""
    name = settings.input.csv_filename
    path = name if name.startswith("/") or "://" in name else f"{settings.folders.path('input')}/{name}"
    tables, made = resume(spark, f"{settings.folders.path('output')}/stages", stages(model, model_name, gazetteer), settings, source_of(spark, path))
    return graph.Graph(tables["records"], tables["record_edges"]), tables, made
