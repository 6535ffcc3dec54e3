"""Work orders: sources, row filters, projections, set-up statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions import text
from millwright.operators import sampling, setup, summary
from millwright.plans.oracle import clean, sql
from millwright.plans.registry import query
from millwright.sources import cache, sinks, tables
from millwright.sources.settings import Input, Settings
from millwright.sources.tables import PLANNED, UNPLANNED, table, work_orders

U, P = "('1-URGENT', '2-HIGH')", "('4-NOT SPECIFIED', '5-LOW')"
WO = "id, type, text, floc, start_date, cost, \"time\""


@query("s01_csv_scan", sql(f"SELECT {WO} FROM wo", "wo"))
def s01(spark: SparkSession, d: str) -> DataFrame:
    """A written CSV file, whose columns stand in another order among others, read back by name and typed again."""
    names = [f.name for f in tables.WORK_ORDER]
    path = sinks.write_csv(work_orders(spark, d).select(F.lit("x").alias("remark"), *reversed(names), F.col("id").alias("number")))
    df = tables.read_csv(spark, path, names)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in tables.WORK_ORDER))


#: Every so many orders have a date, a cost or a line that can't be read.
_BAD = (("date", 7, 0), ("cost", 11, 1), ("line", 13, 2))


@query("s01_quarantine", sql("SELECT coalesce(reason, 'loaded') AS reason, count(*) AS n FROM (SELECT unnest(CASE WHEN id % 13 = 2 THEN ['line'] WHEN id % 7 = 0 AND id % 11 = 1 THEN ['cost', 'start_date'] WHEN id % 7 = 0 THEN ['start_date'] WHEN id % 11 = 1 THEN ['cost'] ELSE ['loaded'] END) AS reason FROM wo) GROUP BY 1", "wo"))
def s01_quarantine(spark, d):
    """Both sides of a load: rows, and what could not be read, by reason."""
    bad = {what: F.col("id") % every == rest for what, every, rest in _BAD}
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    date = F.when(bad["date"], "31/02/1995").otherwise(F.date_format("start_date", "dd/MM/yyyy"))
    cost = F.when(bad["cost"], "1.2.3").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", "cost")))
    line = F.concat_ws(",", quoted(F.coalesce("text", F.lit(""))), F.col("id").cast("string"), F.lit("remark"), "type", "floc", date, cost, F.when(~bad["line"], F.coalesce(F.col("time").cast("string"), F.lit(""))))
    path = sinks.new_path(spark)
    # As many files as there are tasks, each with the header as its first line. A line is one field, so nothing in it is quoted again.
    lines = work_orders(spark, d).select(line.alias("text,id,remark,type,floc,start_date,cost,time"))
    lines.write.csv(path, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    loaded = setup.load(spark, Settings(input=Input(csv_filename=path, start_date_col="start_date", cost_col="cost", time_col="time", date_format="%d/%m/%Y")))
    rejected = sinks.stage(loaded.rejected)
    rows = loaded.orders.agg(F.lit("loaded").alias("reason"), F.count("*").alias("n")).select("reason", "n")
    return rows.unionByName(rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))


@query("s03_json_stage", sql("SELECT id, floc, start_date, cost FROM wo", "wo"))
def s03(spark, d):
    """A stage's JSON output read back with its schema."""
    path = sinks.write_json(work_orders(spark, d).select("id", "floc", "start_date", "cost"))
    return spark.read.schema("id long, floc string, start_date date, cost double").json(path)


@query("s04_gazetteer", "SELECT 'Object' AS type, p_name AS name, 'Object/PhysicalObject/' || max_by(p_brand, p_partkey) AS path FROM part GROUP BY p_name")
def s04(spark, d):
    """A gazetteer of {type: [[name, path], ...]}, of which the last path of a name holds; here its lists are made of parts in order."""
    pairs = table(spark, d, "part").select(F.lit("Object").alias("type"), F.col("p_partkey").alias("at"), F.col("p_name").alias("name"), F.concat(F.lit("Object/PhysicalObject/"), "p_brand").alias("path"))
    return tables.gazetteer_of(pairs)


@query("s05_cache_probe", "SELECT DISTINCT text AS input, conv_id % 2 = 0 AS hit FROM (SELECT text, min(conv_id) AS conv_id FROM conversations GROUP BY text)")
def s05(spark, d):
    """Inputs split by a cache of earlier results, of which only the folders are read that an input can be in."""
    inputs = table(spark, d, "conversations").groupBy("text").agg(F.min("conv_id").alias("conv_id")).withColumnRenamed("text", "input")
    path = sinks.new_path(spark)
    cache.append(path, inputs.filter("conv_id % 2 = 0").select("input"))
    hits = cache.probe(path, inputs, T.StructType([T.StructField("input", T.StringType())]))
    return inputs.select("input").join(hits.withColumn("hit", F.lit(True)), "input", "left").fillna(False, ["hit"])


@query("s06_jsonl_corpus", "SELECT text AS input, role AS output FROM conversations")
def s06(spark, d):
    path = sinks.write_json(table(spark, d, "conversations").select(F.col("text").alias("input"), F.col("role").alias("output")))
    return tables.read_jsonl(spark, path)


@query("k03_cache_append", "SELECT DISTINCT text AS input FROM conversations WHERE turn < 2")
def k03(spark, d):
    """Passed results appended to a cache in two runs at once, which bring some inputs twice, then compacted."""
    df = table(spark, d, "conversations").select(F.col("text").alias("input"), (F.col("turn") < 2).alias("passed"), "turn")
    path, schema = sinks.new_path(spark), T.StructType([T.StructField("input", T.StringType())])
    for run in (df.filter("turn = 0"), df):
        cache.append(path, run.filter("passed").select("input").distinct())
    cache.compact(spark, path, schema)
    return cache.read(spark, path, schema).select("input")


@query("k04_failed_report", "SELECT text AS input FROM conversations WHERE turn >= 2")
def k04(spark, d):
    path = sinks.write_json(table(spark, d, "conversations").select(F.col("text").alias("input"), (F.col("turn") < 2).alias("passed")).filter(~F.col("passed")).drop("passed"))
    return spark.read.schema("input string").json(path)


@query("p01_rename", 'SELECT o_orderkey AS id, o_orderpriority AS type, o_totalprice AS cost, o_orderdate::DATE AS start_date FROM orders')
def p01(spark, d):
    df = table(spark, d, "orders").withColumnsRenamed({"o_orderkey": "id", "o_orderpriority": "type", "o_totalprice": "cost", "o_orderdate": "start_date"})
    return df.select("id", "type", "cost", F.col("start_date").cast("date").alias("start_date"))


@query("p02_prune", sql("SELECT id, type, text, floc FROM wo", "wo"))
def p02(spark, d):
    return work_orders(spark, d).select("id", "type", "text", "floc")


@query("p03_p04_drop_missing", sql("SELECT id, nullif(floc, 'NATION_3') AS floc, text FROM wo WHERE nullif(floc, 'NATION_3') IS NOT NULL AND text IS NOT NULL", "wo"))
def p03(spark, d):
    return work_orders(spark, d).select("id", F.nullif("floc", F.lit("NATION_3")).alias("floc"), "text").dropna(subset=["floc"]).filter(F.col("text").isNotNull())


def _u(k: int) -> str:
    return f"((((id + {k} * 7919 + 7) % 2147483648) * 2654435761) % 4294967296)::DOUBLE / 4294967296"


def _skewed(u: str, high: int) -> str:
    return f"trunc(CASE WHEN {u} < 0.05::DOUBLE THEN sqrt({u} * 0.05::DOUBLE) * {high} ELSE {high} - sqrt((1 - {u}) * 0.95::DOUBLE) * {high} END)::DOUBLE"


@query("p05_dummy_columns", f"SELECT id, make_date(2000 + floor(u0 * 21)::BIGINT, 1 + floor(u1 * 12)::BIGINT, 1 + floor(u2 * 28)::BIGINT) AS start_date, {_skewed('u3', 50000)} AS cost, {_skewed('u4', 84)} AS \"time\" FROM (SELECT id, {', '.join(f'{_u(k)} AS u{k}' for k in range(5))} FROM (SELECT o_orderkey AS id FROM orders))")
def p05(spark, d):
    """Dates, costs and times for inputs without them: as if random, skewed to small values, and the same in every run."""
    return sampling.dummy_columns(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", seed=7)


@query("p06_clean_numeric", "SELECT o_orderkey, CASE WHEN k = '' THEN 0.0 ELSE k::DOUBLE END AS cost FROM (SELECT o_orderkey, regexp_replace(CASE o_orderkey % 4 WHEN 0 THEN '-' || o_totalprice::DECIMAL(18, 2) WHEN 1 THEN '$ ' || o_totalprice::DECIMAL(18, 2) WHEN 2 THEN 'abc' END, '[^0-9.]', '', 'g') AS k FROM orders)")
def p06(spark, d):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.when(key % 4 == 0, F.concat(F.lit("-"), price)).when(key % 4 == 1, F.concat(F.lit("$ "), price)).when(key % 4 == 2, "abc")
    return table(spark, d, "orders").select("o_orderkey", text.clean_numeric(raw).alias("cost"))


@query("p07_parse_date", "SELECT o_orderkey, o_orderdate::DATE AS start_date, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def p07(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    parsed = F.to_date("raw", text.java_format("%d/%m/%Y"))
    return df.select("o_orderkey", parsed.alias("start_date"), F.date_format(parsed, "yyyy-MM-dd").alias("iso"))


@query("p08_p11_unplanned", sql(f"SELECT id, type FROM wo WHERE type IN {U}", "wo"))
def p08(spark, d):
    return work_orders(spark, d).filter(F.col("type").isin(*UNPLANNED)).select("id", "type")


@query("p09_system_filter", sql("SELECT id, floc FROM wo WHERE coalesce(regexp_matches(floc, '(?i)tion_1$|n.*_2[0-3]|^nation_7'), false)", "wo"))
def p09(spark, d):
    systems = ["tion_1$", "n.*_2[0-3]", "^nation_7"]
    return work_orders(spark, d).filter(F.coalesce(F.col("floc").rlike("(?i)" + "|".join(systems)), F.lit(False))).select("id", "floc")


@query("p10_exact_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS h FROM orders) ORDER BY h, o_orderkey LIMIT 100")
def p10(spark, d):
    """Exactly n rows, the same in every run: those with the smallest keys of a fixed permutation."""
    return sampling.exact_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("p12_non_empty", sql(f"SELECT id, type FROM wo WHERE type IN {U}", "wo"))
def p12(spark, d):
    """The selected rows; an empty selection is an error."""
    return summary.non_empty(work_orders(spark, d).filter(F.col("type").isin(*UNPLANNED)).select("id", "type"), "the selection")


@query("p13_f01_clean_text", sql(f"SELECT id, {clean('text')} AS input FROM wo", "wo"))
def p13(spark, d):
    return work_orders(spark, d).select("id", text.clean(F.col("text")).alias("input"))


@query("p17_year_range", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def p17(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year")).filter(F.col("year").between(1993, 1995))


@query("p20_last_segment", "SELECT page_id, string_split(url, '/')[-1] AS last FROM pages")
def p20(spark, d):
    return table(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("last"))


@query("p23_distinct_inputs", sql(f"SELECT DISTINCT {clean('text')} AS input FROM wo", "wo"))
def p23(spark, d):
    return work_orders(spark, d).select(text.clean(F.col("text")).alias("input")).distinct()


@query("p25_null_zero_casts", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS d, coalesce(nullif(l_discount, 0), 0) AS z, l_tax IS NULL AS missing, l_quantity::INTEGER AS q, l_quantity::BIGINT::VARCHAR AS s FROM lineitem")
def p25(spark, d):
    zero = F.nullif("l_discount", F.lit(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", zero.alias("d"), F.coalesce(zero, F.lit(0.0)).alias("z"), F.col("l_tax").isNull().alias("missing"), F.col("l_quantity").cast("int").alias("q"), F.col("l_quantity").cast("long").cast("string").alias("s"))


@query("a01_row_counts", sql(f'SELECT count(*) AS "all", count(*) FILTER (type IN {U}) AS unplanned, count(*) FILTER (type IN {P}) AS planned, count(*) - count(*) FILTER (type IN {U}) - count(*) FILTER (type IN {P}) AS other FROM wo', "wo"))
def a01(spark, d):
    t = F.col("type")
    df = work_orders(spark, d).agg(F.count("*").alias("all"), F.count_if(t.isin(*UNPLANNED)).alias("unplanned"), F.count_if(t.isin(*PLANNED)).alias("planned"))
    return df.withColumn("other", F.col("all") - F.col("unplanned") - F.col("planned"))


@query("a02_distinct_assets", sql("SELECT count(DISTINCT floc) AS flocs FROM wo", "wo"))
def a02(spark, d):
    return work_orders(spark, d).agg(F.countDistinct("floc").alias("flocs"))


@query("a03_records_per_asset", sql("SELECT floc, count(*) AS n FROM wo GROUP BY floc", "wo"))
def a03(spark, d):
    return work_orders(spark, d).groupBy("floc").agg(F.count("*").alias("n"))


@query("a04_f63_type_shares", sql(f"SELECT floc, printf('%d (%.2f)', p, p * 100.0 / t) AS planned, printf('%d (%.2f)', u, u * 100.0 / t) AS unplanned, printf('%d (%.2f)', t - u - p, (t - u - p) * 100.0 / t) AS other, t AS total FROM (SELECT floc, count(*) FILTER (type IN {P}) AS p, count(*) FILTER (type IN {U}) AS u, count(*) AS t FROM wo GROUP BY floc)", "wo"))
def a04(spark, d):
    t = F.col("type")
    df = work_orders(spark, d).groupBy("floc").agg(F.count_if(t.isin(*PLANNED)).alias("p"), F.count_if(t.isin(*UNPLANNED)).alias("u"), F.count("*").alias("total"))
    share = lambda n: F.format_string("%d (%.2f)", n, n * 100.0 / F.col("total"))
    return df.select("floc", share(F.col("p")).alias("planned"), share(F.col("u")).alias("unplanned"), share(F.col("total") - F.col("u") - F.col("p")).alias("other"), "total")


@query("a05_date_ranges", sql("SELECT floc, min(start_date)::VARCHAR AS \"min\", max(start_date)::VARCHAR AS \"max\" FROM wo GROUP BY floc", "wo"))
def a05(spark, d):
    return work_orders(spark, d).groupBy("floc").agg(F.min("start_date").cast("string").alias("min"), F.max("start_date").cast("string").alias("max"))


@query("a06_text_statistics", sql(rf"SELECT (SELECT count(*) FROM (SELECT DISTINCT text FROM wo)) AS n_raw, (SELECT avg(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) FROM (SELECT DISTINCT text FROM wo)) AS len_raw, (SELECT count(*) FROM (SELECT DISTINCT {clean('text')} FROM wo)) AS n_clean, (SELECT avg(len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))) FROM (SELECT DISTINCT {clean('text')} AS t FROM wo)) AS len_clean", "wo"))
def a06(spark, d):
    """Both kinds of texts are counted over distinct raw texts: cleaning runs once for each."""
    raw = work_orders(spark, d).select("text").distinct()
    one = raw.agg(F.count("*").alias("n_raw"), F.avg(text.word_count(F.col("text"))).alias("len_raw"))
    two = raw.select(text.clean(F.col("text")).alias("t")).distinct().agg(F.count("*").alias("n_clean"), F.avg(text.word_count(F.col("t"))).alias("len_clean"))
    return one.crossJoin(two)


@query("a27_group_records", sql("SELECT floc, list_sort(list(id)) AS ids FROM wo GROUP BY floc", "wo"))
def a27(spark, d):
    return work_orders(spark, d).groupBy("floc").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("a27_grouped_files", sql("SELECT floc, count(*) AS n, min(id) AS low, max(id) AS high, 0::BIGINT AS descents FROM wo GROUP BY floc", "wo"))
def a27_files(spark, d):
    """The records of each asset as a sorted stream of files, read back in the files' order; no list of them stands anywhere."""
    df = work_orders(spark, d).select("floc", "id")
    back = sinks.read_groups(spark, sinks.write_groups(df, "floc", ["id"], rows_per_file=200), df)
    before = F.lag("id").over(W.partitionBy("floc").orderBy("file", "at"))
    seen = back.withColumn("_down", F.coalesce(F.col("id") < before, F.lit(False)))
    return seen.groupBy("floc").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if("_down").alias("descents"))


@query("w04_last_wins", "SELECT c_mktsegment AS segment, c_custkey AS id, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) AS k FROM customer) WHERE k = 1")
def w04(spark, d):
    """Of rows with one key the last: a partial aggregate, not a sort."""
    last = F.max_by(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "c_custkey")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(last.alias("x")).select("segment", "x.*")


@query("w02_f52_date_gaps", "SELECT user_id, gap FROM (SELECT user_id, datediff('day', lag(ts::DATE) OVER w, ts::DATE)::BIGINT AS gap FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap IS NOT NULL")
def w02(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.col("ts").cast("date")
    df = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.datediff(day, F.lag(day).over(w)).cast("long").alias("gap"))
    return df.filter("gap is not null")


_HASH = "(((o_orderkey + 1337) % 2147483648) * 2654435761) % 4294967296"


@query("o07_seeded_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {_HASH}, o_orderkey) AS place FROM orders")
def o07(spark, d):
    """The order of a shuffle by a seed, the same in every run and however rows are dealt out."""
    return sampling.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=1337)


@query("t01_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= ceil(0.05 * n) THEN 'val' ELSE 'train' END AS part FROM r")
def t01(spark, d):
    """A split of exact sizes."""
    return sampling.split_exact(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.05)
