"""Extraction: a pluggable model over distinct inputs, loaded once by each worker and applied to batches of like length."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.parse import structured
from millwright.operators.batches import MOST_PADDED, by_length
from millwright.sources import cache as cached
from millwright.sources import sinks


class Extractor(Protocol):
    """What a model must offer: the tagged string for each input."""

    def outputs(self, inputs: list[str]) -> list[str]: ...


class DictionaryExtractor:
    """Tags known words; stands in for a trained model, whose weights are not part of this engine."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def outputs(self, inputs: list[str]) -> list[str]:
        return [" ".join(f"<entity> {w} <{self.known[w]}>" for w in x.split() if w in self.known) for x in inputs]


def each_output(model: Extractor, inputs: list[str]) -> list[str | None]:
    """The model's outputs; where a batch fails, or has another number of them, its inputs are tried one by one, and null stands for those that fail."""
    try:
        found = model.outputs(inputs)
        if len(found) == len(inputs):
            return list(found)
    except Exception:  # noqa: BLE001  whatever the model raises
        pass
    if len(inputs) == 1:
        return [None]
    return [y for x in inputs for y in each_output(model, [x])]


#: Models that this worker has loaded, by the call that asked for them; Spark uses a worker for many tasks.
_LOADED: dict[str, Extractor] = {}


def loaded(call: str, model: Extractor | Callable[[], Extractor]) -> Extractor:
    """The model itself, or what a function gives that loads one: once in each worker process, not in each task. Only the latest call's model stays."""
    if hasattr(model, "outputs") and not isinstance(model, type):
        return model
    if call not in _LOADED:
        _LOADED.clear()
        _LOADED[call] = model()
    return _LOADED[call]


def predictions(inputs: DataFrame, model: Extractor | Callable[[], Extractor], cache: DataFrame | None = None, most_padded: int = MOST_PADDED) -> DataFrame:
    """``input, gen_output`` and the structured output for each distinct input that the cache does not hold.

    ``model``: an extractor, or a function that loads one, which each worker calls once. It is given inputs of like length together, of ``most_padded`` bytes at most with the shorter ones padded. An input whose prediction failed has a null output, empty
    arrays, and ``passed`` false.
    """
    todo = inputs.select("input").filter("input is not null").distinct()
    if cache is not None:
        todo = todo.join(cache.select("input"), "input", "left_anti")

    call = uuid.uuid4().hex

    def each(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, batch in frame.groupby("batch", sort=False):
                yield batch[["input"]].assign(gen_output=each_output(loaded(call, model), batch["input"].tolist()))

    batched = by_length(todo.withColumn("n", F.octet_length("input")), "n", most_padded)
    raw = batched.select("input", "batch").mapInPandas(each, "input string, gen_output string")
    found = raw.withColumn("_r", structured(F.col("input"), F.coalesce("gen_output", F.lit(""))))
    return found.select("input", "gen_output", "_r.norms", "_r.entities", "_r.relations", "_r.issues", (F.col("_r.passed") & F.col("gen_output").isNotNull()).alias("passed"))


def with_predictions(records: DataFrame, predicted: DataFrame) -> DataFrame:
    """All records with their input's prediction; ``predicted`` is false, and arrays are empty, where there is none that passed."""
    passed = predicted.filter("passed").select("input", "gen_output", "norms", "entities", "relations", F.lit(True).alias("predicted"))
    none = lambda c: F.coalesce(c, F.array().cast(predicted.schema[c].dataType)).alias(c)
    joined = records.join(passed, "input", "left")
    return joined.select(*records.columns, "gen_output", none("norms"), none("entities"), none("relations"), F.coalesce("predicted", F.lit(False)).alias("predicted"))


def run(records: DataFrame, model: Extractor | Callable[[], Extractor], cache: str | None) -> tuple[DataFrame, str, str]:
    """Records with predictions, the cache to which new results that passed were added, and the path of a report of failed inputs. ``cache``: the path of
    one that an earlier run has returned, or none."""
    spark = records.sparkSession
    cache = cache or sinks.new_path(spark)
    inputs = sinks.stage(records.select("input").filter("input is not null").distinct())
    schema = predictions(inputs.limit(0), DictionaryExtractor({})).schema
    known = sinks.stage(cached.probe(cache, inputs, schema))
    new = sinks.stage(predictions(inputs, model, known))
    cached.append(cache, new.filter("passed"))
    failed = sinks.write_json(new.filter("not passed").select("input", "gen_output"))
    return with_predictions(records, known.unionByName(new)), cache, failed
