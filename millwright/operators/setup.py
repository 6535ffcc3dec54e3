"""Set-up: work orders from a CSV file, typed, filtered and cleaned as the settings say."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions import text
from millwright.operators import sampling, summary
from millwright.sources.settings import Settings
from millwright.sources.tables import BROKEN, read_csv

#: Seed of generated columns.
SEED = 7


class Loaded(NamedTuple):
    #: id, type, text, floc and, where there are any, start_date, cost and time
    orders: DataFrame
    #: reasons (the columns that can't be read, or ``line``) and the row as it was, as JSON
    rejected: DataFrame


def load(spark: SparkSession, settings: Settings) -> Loaded:
    """The rows of the CSV file by the names that the settings give its columns, and apart from them those that can't be read: lines with another number of fields
    than the header, dates of another format, costs and times that are no numbers, ids that are no whole ones. Nothing is dropped here."""
    s = settings.input
    wanted = {"id": s.id_col, "type": s.type_col, "text": s.text_col, "floc": s.floc_col, "start_date": s.start_date_col, "cost": s.cost_col, "time": s.time_col}
    names = {c: n for n, c in wanted.items() if c}
    if len(names) < sum(map(bool, wanted.values())):
        raise ValueError("two settings name one column")
    path = s.csv_filename if s.csv_filename.startswith("/") or "://" in s.csv_filename else f"{settings.folders.path('input')}/{s.csv_filename}"
    raw = read_csv(spark, path, names)
    read = {"id": F.expr("try_cast(id AS bigint)")}
    if s.start_date_col:
        read["start_date"] = F.try_to_timestamp("start_date", F.lit(text.java_format(s.date_format))).cast("date")
    for c in ("cost", "time"):
        if wanted[c]:
            digits = F.regexp_replace(c, r"[^0-9.]", "")
            read[c] = F.when(digits == "", F.lit(0.0)).otherwise(F.expr(f"try_cast(regexp_replace({c}, '[^0-9.]', '') AS double)"))
    unread = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & value.isNull(), c) for c, value in sorted(read.items()))))
    row = F.to_json(F.struct(*names.values(), F.col(BROKEN).alias("line")))
    marked = raw.withColumn("_reasons", F.when(F.col(BROKEN).isNotNull(), F.array(F.lit("line"))).otherwise(unread))
    rejected = marked.filter(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), row.alias("row"))
    kept = marked.filter(F.size("_reasons") == 0).select(*(read.get(n, F.col(n)).alias(n) for n in names.values()))
    return Loaded(kept, rejected)


def select(orders: DataFrame, settings: Settings) -> DataFrame:
    """The work orders that are worked on, with ``input``, the cleaned text: those with an asset and a text, of the systems, planned ones or not, up to the limit. None left raises."""
    p, s = settings.processing, settings.input
    df = orders.dropna(subset=["floc", "text"])
    if p.add_dummy_cols:
        df = sampling.dummy_columns(df, "id", SEED)
    if p.systems:
        df = df.filter(F.col("floc").rlike("(?i)" + "|".join(p.systems)))
    if p.limit is not None:
        df = sampling.exact_sample(df, "id", p.limit)
    if p.unplanned_only:
        df = df.filter(F.col("type").isin(*s.unplanned_codes))
    return summary.non_empty(df.withColumn("input", text.clean(F.col("text"), p.site_codes)), "the selection")
