"""Frequencies, probabilities, pointwise mutual information and its thresholds."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.sources.sinks import stage

#: The driver tests up to this many values; of more, it gets sums over all. Ranks at either end whose normal scores are added one by one.
FEW_VALUES, TAIL = 1000, 1000


def triple_counts(triples: DataFrame) -> DataFrame:
    """One row for each distinct triple of names: the only shuffle over all occurrences."""
    return triples.groupBy("head", "relation", "tail").agg(F.count("*").alias("frequency"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """The counts of several disjoint sets of occurrences as one: counts are partial sums, so those of a new batch are all that is added."""
    return reduce(DataFrame.unionByName, counts).groupBy("head", "relation", "tail").agg(F.sum("frequency").alias("frequency"))


#: What is counted, and the names under which one distinct triple counts there.
COUNTED = {"head": ("head",), "tail": ("tail",), "relation": ("relation",), "triple": (), "node": ("head", "tail")}


def frequencies(counts: DataFrame) -> DataFrame:
    """``kind, head, relation, tail, frequency, probability`` of heads, tails, relations, triples and nodes, in the column that names them (nodes: ``head``), others null.

    A row of ``counts`` becomes six, which are summed before the shuffle; all probabilities are over the number of triples."""
    null = F.lit(None).cast("string")
    row = lambda kind, **own: F.struct(F.lit(kind).alias("kind"), *(own.get(c, null).alias(c) for c in ("head", "relation", "tail")))
    key = {c: F.col(c) for c in ("head", "relation", "tail")}
    rows = [row(kind, **key) if not names else row(kind, **({"head": F.col(n)} if kind == "node" else {n: F.col(n)})) for kind, names in COUNTED.items() for n in (names or ("head",))]
    found = counts.select("frequency", F.explode(F.array(*rows)).alias("k")).groupBy("k.kind", "k.head", "k.relation", "k.tail").agg(F.sum("frequency").alias("frequency"))
    return found.crossJoin(counts.agg(F.sum("frequency").alias("_n"))).select("kind", "head", "relation", "tail", "frequency", (F.col("frequency") / F.col("_n")).alias("probability"))


def node_stats(triples: DataFrame) -> DataFrame:
    """``name, frequency, probability``: a name's occurrences at either end over the number of triples."""
    return node_stats_of(triple_counts(triples))


def node_stats_of(counts: DataFrame) -> DataFrame:
    """The same from counts."""
    ends = counts.select(F.explode(F.array("head", "tail")).alias("name"), "frequency").groupBy("name").agg(F.sum("frequency").alias("frequency"))
    return ends.crossJoin(counts.agg(F.sum("frequency").alias("_n"))).select("name", "frequency", (F.col("frequency") / F.col("_n")).alias("probability"))


def scored(triples: DataFrame) -> DataFrame:
    """``head, relation, tail, frequency, probability, pmi``. Marginals are sums over the distinct triples, not over occurrences."""
    return scored_of(stage(triple_counts(triples)))


def scored_of(counts: DataFrame) -> DataFrame:
    """The same from counts, which are read several times: they should be a written table."""
    total = counts.agg(F.sum("frequency").alias("_n"))
    marginal = lambda c: counts.groupBy(c).agg(F.sum("frequency").alias(f"_{c}"))
    df = counts.join(marginal("head"), "head").join(marginal("relation"), "relation").join(marginal("tail"), "tail").crossJoin(total)
    n = F.col("_n")
    p = F.col("frequency") / n
    pmi = F.log(p / ((F.col("_head") / n) * (F.col("_relation") / n) * (F.col("_tail") / n)))
    return df.select("head", "relation", "tail", "frequency", p.alias("probability"), pmi.alias("pmi"))


def shapiro_wilk(values: list[float]) -> float:
    """The p-value of Royston's approximation (1995) to the Shapiro-Wilk test; below 3 values or without a range it is 0."""
    x, n = sorted(values), len(values)
    if n < 3 or x[-1] == x[0]:
        return 0.0
    m = [_normal_score(i, n) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last, second, root = _weights(n, mm)
        a = [-last, *(v / root for v in m[1:-1]), last] if n <= 5 else [-last, -second, *(v / root for v in m[2:-2]), second, last]
    mean = sum(x) / n
    return _p_value(sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x), n)


def _normal_score(rank: int, n: int) -> float:
    return NormalDist().inv_cdf((rank - 0.375) / (n + 0.25))


def _weights(n: int, mm: float) -> tuple[float, float, float]:
    """The weights of the greatest and second greatest value, and what normal scores are divided by to be those of the others."""
    u, top, next_ = 1 / math.sqrt(n), _normal_score(n, n), _normal_score(n - 1, n)
    last = _poly((top / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
    if n <= 5:
        return last, 0.0, math.sqrt((mm - 2 * top**2) / (1 - 2 * last**2))
    second = _poly((next_ / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
    return last, second, math.sqrt((mm - 2 * top**2 - 2 * next_**2) / (1 - 2 * last**2 - 2 * second**2))


def _poly(coefficients: tuple[float, ...], v: float) -> float:
    return sum(k * v**i for i, k in enumerate(coefficients))


def _p_value(w: float, n: int) -> float:
    w = min(1.0, w)
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = -math.log(gamma - math.log1p(-w)) if gamma > math.log1p(-w) else -math.inf
        mu, sigma = _poly((0.544, -0.39978, 0.025054, -0.0006714), n), math.exp(_poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        y, v = math.log1p(-w), math.log(n)
        mu, sigma = _poly((-1.5861, -0.31082, -0.083751, 0.0038915), v), math.exp(_poly((-0.4803, -0.082676, 0.0030302), v))
    return 1 - NormalDist().cdf((y - mu) / sigma)


def _area(x: float, n: int) -> tuple[float, float]:
    """Up to a rank, the integral of normal scores less a 24th of their slope, and the same of their squares."""
    p = (x - 0.375) / (n + 0.25)
    z = NormalDist().inv_cdf(p)
    density = (n + 0.25) * NormalDist().pdf(z)
    return -density - 1 / (24 * density), (n + 0.25) * p - z * density - z / (12 * density)


def score_sums(lo: int, hi: int, n: int) -> tuple[float, float]:
    """The sums of the normal scores of the ranks ``lo < rank <= hi`` of ``n``, and of their squares: one by one near both ends, and by their integral between, which
    the Euler-Maclaurin formula brings to within 1e-11 of the sum."""
    first, last = min(max(lo, TAIL), hi), max(min(hi, n - TAIL), lo)
    if first >= last:
        m = [_normal_score(i, n) for i in range(lo + 1, hi + 1)]
        return math.fsum(m), math.fsum(v * v for v in m)
    m = [_normal_score(i, n) for i in (*range(lo + 1, first + 1), *range(last + 1, hi + 1))]
    a, b = _area(first + 0.5, n), _area(last + 0.5, n)
    return math.fsum((*m, b[0], -a[0])), math.fsum((*(v * v for v in m), b[1], -a[1]))


def _score_sums(batches):
    """For ranges of ranks ``lo < rank <= hi`` of ``n``, the sums of their normal scores and of the squares."""
    for batch in batches:
        sums = [score_sums(*x) for x in zip(*(c.to_pylist() for c in batch.select(["lo", "hi", "n"]).columns), strict=True)]
        one, two = zip(*sums, strict=True) if sums else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(one, pa.float64()), pa.array(two, pa.float64())], names=["x", "m", "mm"])


def ranked(stats: DataFrame) -> DataFrame:
    """``pmi, w, to``: each distinct score, its occurrences, and the rank of the last of them. Ranks are partitions' offsets and running sums
    within them, so no task sees all scores."""
    distinct = stats.groupBy("pmi").agg(F.sum("frequency").alias("w"))
    placed = stage(distinct.repartitionByRange("pmi").withColumn("part", F.spark_partition_id()))
    offset, offsets = 0, []
    for r in placed.groupBy("part").agg(F.sum("w").alias("w")).orderBy("part").collect():  # as many rows as there are partitions
        offsets.append((r.part, offset))
        offset += r.w
    to = F.col("offset") + F.sum("w").over(W.partitionBy("part").orderBy("pmi").rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(stats.sparkSession.createDataFrame(offsets, "part int, offset long")), "part").select("pmi", "w", to.alias("to"))


def percentiles(ranks: DataFrame, n: int, fractions: list[float]) -> list[float]:
    """The scores at these fractions of the n - 1 steps between the first and the last of n occurrences, interpolated: looked up by their ranks."""
    at = [q * (n - 1) for q in fractions]
    wanted = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    found = ranks.agg(*(F.max(F.when((F.col("to") - F.col("w") <= k) & (F.col("to") > k), F.col("pmi"))) for k in wanted)).first()
    value = dict(zip(wanted, found, strict=True))
    return [value[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * value[math.floor(x)] + (x - math.floor(x)) * value[math.ceil(x)] for x in at]


def shapiro_wilk_of(ranks: DataFrame, n: int, mean: float, squares: float) -> float:
    """The same p-value of more than 5 scores, one for each occurrence, as sums over the ranks of each distinct score; ``squares`` are
    the squared deviations from ``mean``."""
    low, low2, high2, high = (x - mean for x in percentiles(ranks, n, [0.0, 1 / (n - 1), (n - 2) / (n - 1), 1.0]))
    if low == high:
        return 0.0
    pieces = ranks.select((F.col("pmi") - mean).alias("x"), (F.col("to") - F.col("w")).alias("lo"), F.col("to").alias("hi"), F.lit(n).cast("long").alias("n"))
    sums = pieces.mapInArrow(_score_sums, "x double, m double, mm double").agg(F.sum(F.col("x") * F.col("m")), F.sum("mm")).first()
    last, second, root = _weights(n, sums[1])
    inner = sums[0] - _normal_score(n, n) * (high - low) - _normal_score(n - 1, n) * (high2 - low2)
    return _p_value((inner / root + last * (high - low) + second * (high2 - low2)) ** 2 / squares, n)


def thresholds(stats: DataFrame, normal: bool | None = None) -> DataFrame:
    """``median, lower, upper`` of the scores, one for each occurrence: by deviations if they look normal, else by quartiles.

    ``normal``: what the caller knows of the scores; without it the Shapiro-Wilk test decides."""
    w = F.col("frequency")
    row = stats.agg(F.sum(w).alias("n"), F.sum(w * F.col("pmi")).alias("s")).first()
    spark = stats.sparkSession
    schema = "median double, lower double, upper double"
    if not row.n:
        return spark.createDataFrame([], schema)
    mean = row.s / row.n
    squares = stats.agg(F.sum(w * (F.col("pmi") - mean) ** 2)).first()[0]
    sd = math.sqrt(squares / row.n)
    ranks = ranked(stats)
    if normal is None and row.n > FEW_VALUES:
        normal = shapiro_wilk_of(ranks, row.n, mean, squares) > 0.05
    elif normal is None:
        normal = shapiro_wilk([r.pmi for r in ranks.collect() for _ in range(r.w)]) > 0.05
    q1, median, q3 = percentiles(ranks, row.n, [0.25, 0.5, 0.75])
    low, high = (median - 2 * sd, median + 2 * sd) if normal else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return spark.createDataFrame([(median, low, high)], schema)


def box(stats: DataFrame) -> DataFrame:
    """``low, q1, median, q3, high`` of the scores, one for each occurrence."""
    schema = "low double, q1 double, median double, q3 double, high double"
    n = stats.agg(F.sum("frequency")).first()[0]
    return stats.sparkSession.createDataFrame([tuple(percentiles(ranked(stats), n, [0.0, 0.25, 0.5, 0.75, 1.0]))] if n else [], schema)


def without_rare_outliers(triples: DataFrame, stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """Triples with their statistics, but for those that occur once and score outside the bounds."""
    outlier = (F.col("frequency") == 1) & ((F.col("pmi") < F.col("lower")) | (F.col("pmi") > F.col("upper")))
    return triples.join(stats, ["head", "relation", "tail"]).crossJoin(F.broadcast(bounds)).filter(~outlier).drop("median", "lower", "upper")


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``percentage``: of a group's total."""
    return df.withColumn("percentage", F.col(value) * 100.0 / F.sum(value).over(W.partitionBy(*by)))
