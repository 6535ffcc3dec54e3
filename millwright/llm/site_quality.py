"""Quality by documents and their sites: hierarchical empirical Bayes.

A logistic classifier over the measures of the quality rules gives each document a probability of being good. Sums of these per host and per
path below it are shrunk: a path's mean towards its host's posterior, a host's towards the global mean, each by as many pseudo-documents as the method of
moments finds: the variance of documents within a site over that of the true means of hosts, or of paths within hosts, so sites that differ no more than chance
has it are shrunk altogether. A document's own probability is left out of its site's sums. The score adds to the document's log odds what its path's posterior differs from the global
mean, times ``SITE_WEIGHT``, and is at most ``MOST_SHIFT`` away from it, so that a bad site does not reject clean documents.

The classifier is fitted on at most ``MOST_LABELS`` labelled documents, those with the smallest hashes of their ids, each id once; sums cover all
documents. They are grouped aggregates with partial sums, so a site that holds a third of all rows costs no more than others.

Edge cases: null hosts and paths form a site of their own; null and empty texts are judged by their measures, which are zeros; without labels
of both classes all documents get the labels' mean, or 1 without any; repeated rows count as documents; very long texts need nothing special; labels of one hash are chosen by their ids, and equal scores
are judged alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millwright.llm import quality
from millwright.llm.scratch import saved

MOST_LABELS = 6000
SITE_WEIGHT, MOST_SHIFT, LEAST_SCORE = 0.5, 1.0, 0.5
PSEUDO = (1.0, 1e6)


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    short = lambda words: F.greatest(F.lit(0.0), 1 - F.col("n_words") / words)
    return [short(50.0), F.least(F.col("n_repeat_words") / n, F.lit(1.0)), F.least(F.col("symbol_ratio"), F.lit(1.0)), F.col("upper_ratio"), F.col("dup_line_ratio"), F.least(F.col("stop_words") / n, F.lit(1.0)), F.least(F.col("mean_word_chars") / 10, F.lit(3.0)), F.log1p("n_words") / 10]


def fit(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Bias and coefficients of a regularised logistic regression, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(c))
        c = c + 0.7 * np.linalg.solve(h, x.T @ (label - p) - 0.1 * c)
    return c


def _pseudo(rows: Row) -> float:
    """Pseudo-documents for the shrinkage of groups' means, by the moments of a nested analysis of variance: the variance of documents in a
    group over that between the groups' true means, which is what their means vary more than such documents' means would by chance.
    ``rows``: n (documents), groups, parents, within (squares of documents about their group's mean), between (squares of groups' means about their
    parent's, weighted by documents) and same (sum over the groups of their squared documents over their parent's)."""
    if rows.n is None or rows.groups <= rows.parents or rows.n <= rows.groups:
        return PSEUDO[1]
    chance = max(0.0, rows.within) / (rows.n - rows.groups)
    true = (rows.between / (rows.groups - rows.parents) - chance) * (rows.groups - rows.parents) / (rows.n - rows.same)
    return min(PSEUDO[1], max(PSEUDO[0], chance / true)) if true > 0 else PSEUDO[1]


def _moments(groups: DataFrame) -> Row:
    """The sums that ``_pseudo`` needs; ``groups``: parent, n, total, squares."""
    parents = groups.groupBy("parent").agg(F.sum("n").alias("pn"), F.sum("total").alias("pt"))
    n, pn, mean = F.col("n"), F.col("pn"), F.col("total") / F.col("n")
    return groups.join(parents, "parent").agg(
        F.sum(n).alias("n"), F.count("*").alias("groups"), F.countDistinct("parent").alias("parents"), F.sum(F.col("squares") - n * mean * mean).alias("within"),
        F.sum(n * (mean - F.col("pt") / pn) ** 2).alias("between"), F.sum(n * n / pn).alias("same"),
    ).first()


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def judge(docs: DataFrame, labels: DataFrame, host_col: str, path_col: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, doc_score, site_score, score, kept`` for each document."""
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")).alias("path"), F.col(f"`{text_col}`").alias("text"))
    measured = saved(quality.measures(plain).select("doc_id", "host", "path", F.array(*features()).alias("x")))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))  # one row for each id, here and of the documents, else repeated ones would grow the sample
    sample = measured.join(F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    sample.sort()
    y = np.array([r.label for r in sample], float)
    if len(set(y)) == 2:
        c = fit(np.array([r.x for r in sample]), y)
        z = sum((float(w) * F.col("x")[k] for k, w in enumerate(c[1:])), F.lit(float(c[0])))
        p = 1 / (1 + F.exp(-z))
    else:
        p = F.lit(float(y.mean()) if len(y) else 1.0)
    scored = measured.select("doc_id", "host", "path", p.alias("p"))

    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")))
    hosts = saved(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")))
    everything = hosts.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
    mean = everything.t / everything.n if everything.n else 0.5
    k_host, k_path = _pseudo(_moments(hosts.withColumn("parent", F.lit(0)))), _pseudo(_moments(paths.withColumn("parent", F.col("host"))))
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total")), "host").select("host", "path", "n", "total", "host_n", "host_total")
    scored = scored.join(sites, ["host", "path"])
    # A document is no evidence for itself: its site's posterior is that of the other documents.
    scored = scored.withColumn("host_score", (k_host * mean + F.col("host_total") - F.col("p")) / (k_host + F.col("host_n") - 1))
    scored = scored.withColumn("site_score", (k_path * F.col("host_score") + F.col("total") - F.col("p")) / (k_path + F.col("n") - 1))
    shift = SITE_WEIGHT * (_logit(F.col("site_score")) - _logit(F.lit(mean)))
    odds = _logit(F.col("p")) + F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), shift))
    judged = scored.withColumn("score", 1 / (1 + F.exp(-odds)))
    return judged.select("doc_id", F.col("p").alias("doc_score"), "host_score", "site_score", "score", (F.col("score") >= LEAST_SCORE).alias("kept"))
