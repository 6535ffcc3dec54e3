"""Sources: Parquet tables, CSV work orders, JSON lines, parameter tables; and the work orders that the tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that stand for a missing value in CSV files.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

WORK_ORDER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("floc", T.StringType()),
    T.StructField("start_date", T.DateType()), T.StructField("cost", T.DoubleType()), T.StructField("time", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, such as one small file, is dealt out for the costly steps that follow; a larger one stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def missing_to_null(df: DataFrame) -> DataFrame:
    """String columns with the tokens of a missing value as nulls."""
    return df.withColumns({f.name: F.when(~F.col(f.name).isin(*NULL_TOKENS), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


#: Holds a line that is no row of its table.
BROKEN = "_broken"


def read_csv(spark: SparkSession, path: str, columns: list[str] | dict[str, str]) -> DataFrame:
    """The named columns of CSV files with a header, as strings; missing values are null. ``columns``: names in the header, or those with the names that they get.

    Columns are found by their names, wherever they stand among others; one that is missing raises, and so does a file whose header differs from the first one's.
    A line with another number of fields than the header is kept in ``_broken``, with the fields that it has."""
    names = columns if isinstance(columns, dict) else {c: c for c in columns}
    header = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    if missing := [c for c in names if c not in header]:
        raise ValueError(f"{path} has no column {', '.join(map(repr, missing))}; it has {', '.join(map(repr, header))}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BROKEN]])
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=False, columnNameOfCorruptRecord=BROKEN)
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    return missing_to_null(df.select(*(F.col(quoted(c)).alias(n) for c, n in names.items()), BROKEN))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of input and output, one JSON object a line."""
    return spark.read.json(path, schema="input string, output string")


def read_gazetteer(spark: SparkSession, groups: dict[str, list[list[str]]]) -> DataFrame:
    """{type: [[name, path], ...]} as rows; of equal (type, name) the last one holds."""
    return spark.createDataFrame([(t, n, p) for t, pairs in groups.items() for n, p in dict(pairs).items()], "type string, name string, path string")


def gazetteer_of(pairs: DataFrame) -> DataFrame:
    """``type, name, path`` of rows that also have ``at``, their place in the list: of equal (type, name) the last one holds. For gazetteers that are tables."""
    return pairs.groupBy("type", "name").agg(F.max_by("path", "at").alias("path"))


#: The parameter table that gives names their place in the type hierarchy.
GAZETTEER = {
    "State": [["oil leak", "State/UndesirableState/FailedState"], ["leak", "State/UndesirableState/FailedState"], ["no power", "State/UndesirableState/FailedState"], ["will not start", "State/UndesirableState/FailedState"], ["not work", "State/UndesirableState/FailedState"]],
    "Activity": [["replace", "Activity/MaintenanceActivity/Replace"], ["repair", "Activity/MaintenanceActivity/Repair"], ["inspect", "Activity/MaintenanceActivity/Inspect"], ["transport", "Activity/SupportingActivity/Move"], ["isolate", "Activity/SupportingActivity/Isolate"]],
    "Object": [[n, "Object/PhysicalObject/Component"] for n in ("ring", "bolt", "anvil", "widget", "gear", "gizmo")],
}

UNPLANNED, PLANNED = ("1-URGENT", "2-HIGH"), ("4-NOT SPECIFIED", "5-LOW")


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work orders: an asset is the customer's nation, time the sum of quantities, and text follows from the lines.

    Lines are summed per order before any join, so one shuffle on the order key serves both sides; the customer and nation sides are left
    to Spark's size-checked broadcast.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per_order = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("time"), F.min("p_name").alias("p_name"), F.max("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    phrase = F.when(F.col("flag") == "R", " temp sensor (LH) blwn..").when(F.col("flag") == "A", " repl hyd. filter @ cab").otherwise(" c/o & insp #2 pump - 2 way valve!!")
    return orders.join(per_order, F.col("o_orderkey") == F.col("id"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.concat("p_name", phrase).alias("text"), F.col("n_name").alias("floc"),
        F.col("o_orderdate").cast("date").alias("start_date"), F.col("o_totalprice").alias("cost"), F.col("time"),
    )


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples as an extraction model would give them, some of them faulty: all rows of a line item come from one pass."""
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"))
    words = F.split("p_name", " ")  # once for each part, which has many lines
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.element_at(words, -1).alias("component"), F.element_at(words, 1).alias("adjective"))
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    n, flag, quantity = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity")
    component, adjective = F.col("component"), F.col("adjective")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)
    state = pick(("oil leak", "leaky", "no power", "wont start", "not working"))
    activity, support = pick(("replacing", "repairs", "inspect")), pick(("transport", "isolated"))
    head = F.when(flag == "R", state).when(flag == "A", activity).otherwise(support)
    head_type = F.when(flag == "R", "<state>").otherwise("<activity>")
    t = lambda *x: F.struct(*((c if not isinstance(c, str) else F.lit(c)).alias(k) for k, c in zip(("head", "head_type", "tail", "tail_type", "relation"), x, strict=True)))
    leaks = (flag == "R") & (n % 5 <= 1)
    found = [
        t(head, head_type, component, "<object>", "has patient"),
        F.when(leaks, t(head, head_type, F.col("p_brand"), "<object>", "has agent")),
        F.when(n % 2 == 0, t(F.col("p_brand"), "<object>", component, "<object>", "has part")),
        F.when(n % 3 == 0, t(F.col("p_name"), "<object>", component, "<object>", "is a")),
        F.when(n == 5, t(component, "<object>", adjective, "<property>", "has property")),
        F.when(n == 4, t(F.col("p_brand"), "<object>", F.col("p_type"), "<object>", "contains")),
        F.when(n == 6, t(component, "<object>", component, "<object>", "has part")),
        F.when(n == 7, t("", "<object>", component, "<object>", "has part")),
        F.when(quantity >= 49, t(component, "<thing>", F.col("p_brand"), "<object>", "has part")),
        F.when(quantity <= 1, t(component, "<object>", F.col("p_brand"), "<object>", "has participant")),
        F.when(quantity == 10, t(component, "<object>", state, "<state>", "has patient")),
    ]
    exploded = lines.select(F.col("l_orderkey").alias("record_id"), F.explode(F.array(*found)).alias("t")).filter("t is not null")
    return exploded.select("record_id", "t.*")
