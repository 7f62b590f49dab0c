"""Paired statistics as aggregations: exact tests, intervals, rank correlation, jackknife, bootstrap, sweeps."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.arrow import batched
from inkspark.plans.lineage import cut

# The normal quantile of Wilson intervals, the factor of a difference of two runs, and slacks.
Z = 1.959964
PAIR = 2.77
SLACK = 1e-12
HALF = 1e-11  # a value on half of the last place is rounded up, however its sum was ordered


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for X of n fair coins, for any n: a sum of exponentials of log probabilities, each from the one before."""
    upper = n - k  # P(X >= k) = P(X <= n - k)
    start = F.struct((-n.cast("double") * math.log(2)).alias("log"), F.lit(0.0).alias("sum"))

    def step(a, i):
        log = F.when(i == 0, a["log"]).otherwise(a["log"] + F.log((n - i + 1) / i.cast("double")))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    below = F.aggregate(F.when(upper >= 0, F.sequence(F.lit(0).cast("bigint"), upper)).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["sum"])
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), below))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant items; 1 without any."""
    n = (b + c).cast("bigint")
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.greatest(b, c).cast("bigint"), n)))


def sign_test_p(k: Column, n: Column) -> Column:
    """P(X >= max(k, n - k)): one-sided on the larger count."""
    return binomial_tail(F.greatest(k, n - k).cast("bigint"), n.cast("bigint"))


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """95 % Wilson interval; (0, 1) without trials."""
    p, z2 = successes / trials, Z * Z
    centre = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    half = Z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    return F.when(trials > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(trials > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank) of the distinct values: the average rank of the rows that have it, from 1; nulls are left out.

    Values are counted first and dealt into ranges; a range's ranks need the sizes of the ranges before it alone, so no task orders
    all values.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    part = cut(per.repartitionByRange("value").withColumn("p", F.spark_partition_id()))
    before = part.groupBy("p").agg(F.sum("c").alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))  # a row per range
    own = F.sum("c").over(Window.partitionBy("p").orderBy("value")) - F.col("c")
    return part.withColumn("own", own).join(F.broadcast(before), "p").select("value", (F.col("before") + F.col("own") + (F.col("c") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``rho``: Pearson correlation of average ranks, 0 where a side has no spread; rows with a null are left out."""
    d = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    rx, ry = (average_ranks(d, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in "xy")
    r = d.join(rx, "x").join(ry, "y")
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return r.agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))


def holm(df: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """``df`` with ``rejected``: step-down over a family of tests, which is small."""
    order = Window.orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy())
    ok = F.col(p) <= alpha / (m - F.row_number().over(order) + 1)
    return df.withColumn("_ok", ok.cast("int")).withColumn("rejected", F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def design_effect(items: DataFrame, by: list[str], cluster: str, difference: str) -> DataFrame:
    """(by, items, clusters, estimate, ratio, effective_items): variance of the mean by clusters over that by items. Two levels of
    aggregation, so a cluster that holds most items costs no more than others."""
    per = items.groupBy(*by, cluster).agg(F.count("*").alias("n"), F.sum(difference).alias("s"), F.sum(F.col(difference) * F.col(difference)).alias("ss"))
    g = per.groupBy(*by).agg(F.sum("n").alias("items"), F.count("*").alias("clusters"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s")).alias("cc"), F.sum(F.col("s") * F.col("n")).alias("cn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    e = F.col("s") / F.col("items")
    item = F.col("ss") - F.col("items") * e * e
    clustered = F.col("cc") - 2 * e * F.col("cn") + e * e * F.col("nn")
    ratio = F.try_divide(clustered, item)
    return g.select(*by, "items", "clusters", F.round(e + HALF, 6).alias("estimate"), F.round(ratio, 4).alias("ratio"), F.round(F.try_divide(F.col("items"), ratio), 2).alias("effective_items"))


def jackknife(clusters: DataFrame, by: list[str], weighted: str, weight: str) -> DataFrame:
    """(by, clusters, estimate, minimum_without, maximum_without, standard_error) from per-cluster sums of weighted values and weights."""
    whole = clusters.groupBy(*by).agg(F.sum(weighted).alias("_whole"), F.sum(weight).alias("_weight"))
    out = clusters.join(whole, by).withColumn("without", (F.col("_whole") - F.col(weighted)) / (F.col("_weight") - F.col(weight)))
    n = F.count("without")
    se = F.sqrt((n - 1) / n * (F.var_pop("without") * n))
    return out.groupBy(*by).agg(n.alias("clusters"), F.round(F.first("_whole") / F.first("_weight") + HALF, 6).alias("estimate"), F.round(F.min("without"), 6).alias("minimum_without"), F.round(F.max("without"), 6).alias("maximum_without"), F.round(se, 6).alias("standard_error"))


def bootstrap(clusters: DataFrame, by: list[str], cluster: str, weighted: str, weight: str, draws: int = 1000, seed: int = 7, probability: float = 0.95) -> DataFrame:
    """(by, low, high) of the weighted mean when clusters are drawn with replacement.

    Each cluster gets a Poisson(1) count per draw from a seeded hash, the distributed form of drawing with replacement: no
    draw needs all clusters together, counts are made where the cluster lies and only sums per draw are shuffled.
    """
    each = clusters.select(*by, cluster, weighted, weight, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", *by, cluster), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cdf, steps = 0.0, []
    for k in range(9):
        cdf += math.exp(-1) / math.factorial(k)
        steps.append(cdf)
    times = sum(((u > s).cast("int") for s in steps), F.lit(0))
    sums = each.withColumn("times", times).groupBy(*by, "draw").agg(F.sum(F.col(weighted) * F.col("times")).alias("a"), F.sum(F.col(weight) * F.col("times")).alias("b")).where("b > 0")
    tail = (1 - probability) / 2
    return sums.groupBy(*by).agg(F.round(F.percentile(F.col("a") / F.col("b"), F.lit(tail)), 6).alias("low"), F.round(F.percentile(F.col("a") / F.col("b"), F.lit(1 - tail)), 6).alias("high"))


def sign_flip(clusters: DataFrame, value: str, exact: int = 15, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """One row (clusters, p_value, exact): two-sided randomization test over one sign per cluster.

    Up to ``exact`` + 1 clusters every assignment is enumerated, the clusters numbered by one order, as they are few; above, signs
    are drawn by a seeded hash of the column ``cluster``, or of all columns if there is none, so no order is needed. Assignments
    meet the clusters by explosion of each cluster, so the work is spread over the clusters and pre-aggregated per assignment.
    """
    n, total = clusters.agg(F.count("*"), F.sum(value)).first()
    spark = clusters.sparkSession
    if not n:
        return spark.createDataFrame([(0, 1.0, True)], "clusters bigint, p_value double, exact boolean")
    names = ["cluster"] if "cluster" in clusters.columns else clusters.columns
    full = n - 1 <= exact
    m = 1 << (n - 1) if full else draws
    if full:
        c = clusters.select(value, (F.row_number().over(Window.orderBy(value, *names)) - 1).alias("i"))
        flip = F.when(F.col("i") == 0, 0).otherwise(F.expr("shiftright(a, i - 1) & 1"))
    else:
        c = clusters.select(value, F.xxhash64(F.lit(seed), *names).alias("i")).repartition(spark.sparkContext.defaultParallelism, "i")
        flip = F.pmod(F.xxhash64(F.lit(seed), "a", "i"), F.lit(2))
    x = c.select(value, "i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("a"))
    s = x.groupBy("a").agg(F.abs(F.sum(F.when(flip == 1, -F.col(value)).otherwise(F.col(value)))).alias("s"))
    extreme = F.count_if(F.col("s") >= abs(total) - SLACK)
    p = extreme / m if full else (1 + extreme) / (1 + m)
    return s.agg(F.lit(n).cast("bigint").alias("clusters"), F.round(p, 6).alias("p_value"), F.lit(full).alias("exact"))


def classify_sweep(arms: DataFrame, share: str, value: str, margin: float) -> DataFrame:
    """One row (outcome, best_share, within_margin): interior_optimum, boundary_optimum or unresolved; lower is better."""
    one = arms.agg(F.min(share).alias("low"), F.max(share).alias("high"), F.min(F.struct(value, share)).alias("best"), F.collect_list(F.struct(F.col(share).alias("s"), F.col(value).alias("v"))).alias("all"))
    best_s, best_v = F.col(f"best.{share}"), F.col(f"best.{value}")
    beats = lambda which: F.forall("all", lambda a: ~which(a) | (a["v"] - best_v > margin + SLACK))
    edge = (best_s == F.col("low")) | (best_s == F.col("high"))
    interior = ~edge & beats(lambda a: (a["s"] == F.col("low")) | (a["s"] == F.col("high")))
    boundary = edge & beats(lambda a: a["s"] != best_s)
    within = F.size(F.filter("all", lambda a: a["v"] - best_v <= margin + SLACK))
    return one.select(F.when(interior, "interior_optimum").when(boundary, "boundary_optimum").otherwise("unresolved").alias("outcome"), best_s.alias("best_share"), within.cast("bigint").alias("within_margin"))


def classify_difference(difference: Column, central: Column, upper: Column) -> Column:
    size = F.abs(difference)
    return F.when(size <= central + SLACK, "tie").when(size <= upper + SLACK, "indeterminate").otherwise("separable")


def _bisect(f, target: float, low: float, high: float) -> float:
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def _gamma_cdf(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * front
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


@functools.lru_cache(4096)
def chi_square_quantile(p: float, degrees: int) -> float:
    return _bisect(lambda x: _gamma_cdf(degrees / 2, x / 2), p, 0.0, 10.0 * degrees + 200)


def _t_cdf(t: float, n: int) -> float:
    """Student's distribution, by Simpson's rule over the angle; exact enough for any n."""
    c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi)
    top = math.atan(t / math.sqrt(n))
    k = 600
    h = top / k
    s = sum((1 if i in (0, k) else 4 if i % 2 else 2) * math.cos(i * h) ** (n - 1) for i in range(k + 1))
    return 0.5 + c * s * h / 3


@functools.lru_cache(4096)
def t_quantile(p: float, degrees: int) -> float:
    return -t_quantile(1 - p, degrees) if p < 0.5 else _bisect(lambda x: _t_cdf(x, degrees), p, 0.0, 1e4)


@batched("double")
def t_quantile_column(p: pd.Series, degrees: pd.Series) -> pd.Series:
    """Quantiles of Student's distribution; null where there are no degrees of freedom."""
    known: dict = {}
    return pd.Series([None if d is None or d != d or d < 1 else known.setdefault((x, d), t_quantile(x, int(d))) for x, d in zip(p, degrees, strict=True)], dtype="float64")


@batched("double")
def chi_square_quantile_column(p: pd.Series, degrees: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([None if d is None or d != d or d < 1 else known.setdefault((x, d), chi_square_quantile(x, int(d))) for x, d in zip(p, degrees, strict=True)], dtype="float64")
