"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Edge cases: a null or empty text has no words, and so fails the base rule of least words; ratios over nothing are 0;
rows are judged one by one, so repeated rows give repeated results and an empty table gives an empty one; other columns are kept
by ``keep`` and ignored by ``judge``. Windows are compared as whole strings, in time n log n of the number of words.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import SPACE_CLASS, narrow

#: Common words of the languages that the corpus is written in.
STOP_WORDS = (
    "the be to of and that have with is was in a by for it as are this from at".split()
    + "der die und das in von ist mit den nicht ein eine im für auf zu sich des dem als auch".split()
    + "de la le et les des en un une du est que pour dans qui sur par au pas il elle".split()
    + "el los y que se las por con no una su para es al lo como más o del".split()
)


class Threshold(NamedTuple):
    """A measure must lie within bounds; null: no bound."""

    measure: str
    least: float | None
    most: float | None


TABLE = (
    Threshold("mean_word_chars", 2.0, 15.0),
    Threshold("symbol_ratio", None, 0.1),
    Threshold("stop_words", 2, None),
    Threshold("dup_line_ratio", None, 0.3),
    Threshold("upper_ratio", None, 0.5),
    Threshold("bullet_line_ratio", None, 0.9),
    Threshold("ellipsis_line_ratio", None, 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def measures(texts: DataFrame) -> DataFrame:
    """``texts`` with the counts and ratios of its column ``text``. Arrays that are used more than once get a projection of their own."""
    text = F.coalesce("text", F.lit(""))
    kept = texts.columns
    held = texts.withColumns({
        "_words": F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "_upper": F.length(F.regexp_replace(text, r"[^A-Z]+", "")),
    })
    n = F.size("_words")
    words = F.col("_words")
    window = lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    held = held.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.sort_array(F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), window)),
        "_n_lines": F.size("_lines"),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]"))),
        "_ellipses": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    })
    windows = F.col("_windows")
    twice = F.filter("_windows", lambda x, k: (x["w"] == F.get(windows, k - 1)["w"]) | (x["w"] == F.get(windows, k + 1)["w"]))
    held = held.withColumn("_at", F.transform(twice, lambda x: x["i"]))
    later = lambda by: F.transform("_at", lambda i: i + by)
    return held.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.size(F.array_union(F.array_union("_at", later(1)), later(2))).cast("long").alias("n_repeat_words"),
        "stop_words",
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("_upper"), F.col("word_chars")).alias("upper_ratio"),
        _ratio(F.col("_bullets"), F.col("_n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("_ellipses"), F.col("_n_lines")).alias("ellipsis_line_ratio"),
    )


def passes(table: tuple[Threshold, ...] = TABLE) -> Column:
    """The conjunction of a table's bounds."""
    bounds = [F.col(t.measure) >= t.least for t in table if t.least is not None] + [F.col(t.measure) <= t.most for t in table if t.most is not None]
    return reduce(and_, bounds, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, table: tuple[Threshold, ...] = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``op3_quality_rules``: the counts, whether the base rule fails, and the verdict."""
    judged = measures(narrow(docs, id_col, text_col)).withColumn("base_failed", base_failed())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passes(table)).alias("kept"))


def keep(docs: DataFrame, table: tuple[Threshold, ...] = TABLE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the base rule and the table let pass."""
    plain = docs.select(F.struct(*(F.col(f"`{c.replace("`", "``")}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("text"))
    # The row number makes the verdict nondeterministic for the optimizer. Else it pushes the filter below the projections and copies
    # their nested expressions into it once for each use, which multiplies with every projection.
    verdict = ~base_failed() & passes(table) & (F.monotonically_increasing_id() >= 0)
    return measures(plain).select("_row", verdict.alias("_kept")).filter("_kept").select("_row.*")
