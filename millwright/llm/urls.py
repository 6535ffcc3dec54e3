"""URL filters: rules for hosts and paths, found by short hash prefixes of a URL's expressions.

A URL is expanded into expressions: each suffix of its host with as many labels as some rule's host, joined with each prefix of its path whose length
some rule's path has; no other expression can equal a rule, so a host of very many labels costs no more than another. Expressions and rules are joined on the first ``PREFIX_HEX`` hex digits of their SHA-256 digests; full
digests then confirm the matches, and the longest rule wins (of equally long ones, the one with the longer host, then block over
allow). URLs that no rule fits get the default verdict.

All work is done by built-in functions. Pages are regrouped by a row number, so repeated pages stay separate rows, and only the
best match of each page, found before the shuffle by partial aggregation, is moved. The rules are an ordinary side of an
equi-join: Spark broadcasts them if their measured size is below its threshold and shuffles them otherwise.

Edge cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; repeated rows and null ids stay as they are; an empty table,
or one of rules, gives what the others say; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import ascii_lower

PREFIX_HEX = 8


class Rule(NamedTuple):
    action: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def split_url(url):
    """Columns of host and path: what follows the first ``://``."""
    parts = r"://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, parts, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, path_lengths: Sequence[int], host_labels: Sequence[int], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``. ``path_lengths``, ``host_labels``: those of the rules' paths, and the
    numbers of labels of their hosts."""
    host, path = split_url(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    hosts = F.filter(F.array(*(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(set(host_labels)))), lambda h: h.isNotNull()) if host_labels else F.array().cast("array<string>")
    paths = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(path_lengths)))), lambda p: p.isNotNull()) if path_lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    asked = urls.select("row", "page_id", "host", "path", F.explode_outer(pairs).alias("e")).withColumn("digest", digest(F.col("e.h"), F.col("e.p")))
    listed = rules.select(F.col("action"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), digest(F.col("host"), F.col("path")).alias("rule_digest"))
    listed = listed.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    met = asked.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)).join(listed, "prefix", "left")
    fits = F.col("digest") == F.col("rule_digest")
    rank = F.struct(F.length("rule").alias("length"), F.col("host_length"), (F.col("action") == "block").alias("blocks"), F.col("rule"), F.col("action"))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
