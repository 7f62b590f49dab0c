"""Paired statistics over the losses of two arms, redelivered rows once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.notation import ebook_of
from inkspark.operators import stats as S
from inkspark.operators.stats import HALF
from inkspark.plans.registry import query, table

L = """l AS (SELECT DISTINCT loss_id, experiment, first_arm, second_arm, run_seed, coalesce(nullif(regexp_extract(lower(cluster_name), 'pg0*([0-9]+)', 1), ''), regexp_extract(lower(path), 'pg0*([0-9]+)', 1))::BIGINT AS work, path, n_characters AS n, first_bits AS a, second_bits AS b, difference AS x
 FROM paired_loss WHERE difference IS NOT NULL AND NOT isnan(difference) AND first_bits IS NOT NULL AND NOT isnan(first_bits) AND second_bits IS NOT NULL AND NOT isnan(second_bits) AND n_characters > 0)"""


def losses(spark, d) -> DataFrame:
    """Usable losses, each loss_id once: work from the cluster name however written, else from the path."""
    t = table(spark, d, "paired_loss")
    fine = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("difference", "first_bits", "second_bits")]
    t = t.where(reduce(lambda p, q: p & q, fine) & (F.col("n_characters") > 0))
    return t.select("loss_id", "experiment", "first_arm", "second_arm", "run_seed", F.coalesce(ebook_of(F.col("cluster_name")), ebook_of(F.col("path"))).alias("work"), "path", F.col("n_characters").alias("n"), F.col("first_bits").alias("a"), F.col("second_bits").alias("b"), F.col("difference").alias("x")).dropDuplicates(["loss_id"])


@query(f"WITH {L} SELECT work, count(*) AS items, round(sum(x), 6) AS total FROM l GROUP BY 1")
def agg_cluster_sums(spark, d):
    return losses(spark, d).groupBy("work").agg(F.count("*").alias("items"), F.round(F.sum("x"), 6).alias("total"))


@query(f"WITH {L}, p AS (SELECT experiment, work, count(*) AS n, sum(x) AS s FROM l GROUP BY 1, 2), e AS (SELECT experiment, count(*) AS items, avg(x) AS e FROM l GROUP BY 1), i AS (SELECT l.experiment, sum((x - e) ** 2) AS v FROM l JOIN e USING (experiment) GROUP BY 1), c AS (SELECT p.experiment, count(*) AS clusters, sum((s - n * e) ** 2) AS v FROM p JOIN e USING (experiment) GROUP BY 1) SELECT experiment, items, clusters, round(e + 1e-11, 6) AS estimate, round(c.v / i.v, 4) AS ratio, round(items / (c.v / i.v), 2) AS effective_items FROM e JOIN i USING (experiment) JOIN c USING (experiment)")
def agg_design_effect(spark, d):
    return S.design_effect(losses(spark, d), ["experiment"], "work", "x")


def _works(spark, d, by=("experiment",)):
    return losses(spark, d).groupBy(*by, "work").agg(F.sum(F.col("x") * F.col("n")).alias("sw"), F.sum("n").alias("w"), F.count("*").alias("docs"))


@query(f"WITH {L}, c AS (SELECT experiment, work, sum(x * n) AS sw, sum(n) AS w FROM l GROUP BY 1, 2), t AS (SELECT experiment, sum(sw) AS tsw, sum(w) AS tw FROM c GROUP BY 1), j AS (SELECT experiment, tsw / tw AS e, (tsw - sw) / (tw - w) AS o FROM c JOIN t USING (experiment)) SELECT experiment, count(*) AS clusters, round(any_value(e) + 1e-11, 6) AS estimate, round(min(o), 6) AS minimum_without, round(max(o), 6) AS maximum_without, round(sqrt((count(*) - 1) / count(*) * var_pop(o) * count(*)), 6) AS standard_error FROM j GROUP BY 1")
def agg_jackknife(spark, d):
    c = _works(spark, d).withColumnsRenamed({"sw": "swx", "w": "wx"})
    return S.jackknife(c, ["experiment"], "swx", "wx")


@query()
def agg_bootstrap_ci(spark, d):
    return S.bootstrap(_works(spark, d), ["experiment"], "work", "sw", "w")


@query(f"WITH {L} SELECT experiment, round(quantile_cont(x, 0.025) + 1e-11, 6) AS low, round(quantile_cont(x, 0.5) + 1e-11, 6) AS middle, round(quantile_cont(x, 0.975) + 1e-11, 6) AS high FROM l GROUP BY 1")
def agg_percentile_linear(spark, d):
    return losses(spark, d).groupBy("experiment").agg(*[F.round(F.percentile("x", F.lit(q)) + HALF, 6).alias(k) for k, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


@query("WITH n AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS k FROM documents WHERE n_chars IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{k}' AS name, v AS value FROM n WHERE i = ceil({q} * (k - 1))" for k, q in (("min", 0), ("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p100", 1))))
def agg_length_percentiles(spark, d):
    """The value at index ceil(q (n - 1)) of the sorted lengths, from counts per length: no global sort of the documents."""
    t = table(spark, d, "documents").where("n_chars is not null").groupBy("n_chars").agg(F.count("*").alias("c"))
    upto = t.select(F.col("n_chars").alias("value"), F.sum("c").over(Window.orderBy("n_chars")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("k"))
    qs = [("min", 0.0), ("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p100", 1.0)]
    return upto.agg(*[F.min(F.when(F.col("upto") > F.ceil(F.lit(q) * (F.col("k") - 1)), F.col("value"))).alias(n) for n, q in qs]).unpivot([], [n for n, _ in qs], "name", "value")


def _verdicts(spark, d, by):
    """Items as wins, losses and ties of the first arm: fewer bits win."""
    t = losses(spark, d)
    return t.groupBy(*by).agg(F.count_if(F.col("a") < F.col("b")).alias("b"), F.count_if(F.col("a") > F.col("b")).alias("c"), F.count("*").alias("n"))


_TAIL = "(SELECT sum(exp(lgamma(nn + 1) - lgamma(i + 1) - lgamma(nn - i + 1) - nn * ln(2))) FROM range(0, nn - kk + 1) t(i))"


def tail_sql(k: str, n: str) -> str:
    return f"(SELECT least(1.0, sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2)))) FROM (SELECT unnest(range(0, ({n} - {k} + 1)::BIGINT)) AS i))"


@query(f"WITH {L}, v AS (SELECT experiment, work, count(*) FILTER (a < b) AS b, count(*) FILTER (a > b) AS c, count(*) AS n FROM l GROUP BY 1, 2) SELECT experiment, work, b, c, n, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * {tail_sql('greatest(b, c)', '(b + c)')}) + 1e-11, 6) END AS p FROM v")
def stat_mcnemar(spark, d):
    v = _verdicts(spark, d, ["experiment", "work"])
    return v.select("experiment", "work", "b", "c", "n", F.round(S.mcnemar_p(F.col("b"), F.col("c")) + HALF, 6).alias("p"))


@query(f"WITH {L}, v AS (SELECT experiment, run_seed, count(*) FILTER (x > 0) AS k, count(*) AS n FROM l GROUP BY 1, 2) SELECT experiment, run_seed, k, n, round({tail_sql('greatest(k, n - k)', 'n')} + 1e-11, 6) AS p FROM v")
def stat_sign_test(spark, d):
    v = losses(spark, d).groupBy("experiment", "run_seed").agg(F.count_if(F.col("x") > 0).alias("k"), F.count("*").alias("n"))
    return v.select("experiment", "run_seed", "k", "n", F.round(S.sign_test_p(F.col("k"), F.col("n")) + HALF, 6).alias("p"))


@query(f"WITH {L}, w AS (SELECT work, round(avg(a), 9) AS a, round(avg(b), 9) AS b FROM l GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM w) SELECT round(coalesce(corr(ra, rb), 0), 6) AS rho FROM r")
def stat_spearman(spark, d):
    w = losses(spark, d).groupBy("work").agg(F.round(F.avg("a"), 9).alias("a"), F.round(F.avg("b"), 9).alias("b"))
    return S.spearman(w, "a", "b")


_HOLM = f"v AS (SELECT experiment, count(*) FILTER (a < b) AS b, count(*) FILTER (a > b) AS c FROM l GROUP BY 1), p AS (SELECT experiment, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * {tail_sql('greatest(b, c)', '(b + c)')}), 9) END AS p FROM v WHERE experiment IS NOT NULL)"


@query(f"WITH {L}, {_HOLM}, o AS (SELECT experiment, p, (p <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, experiment) + 1))::INT AS ok FROM p) SELECT experiment, round(p, 6) AS p, min(ok) OVER (ORDER BY p, experiment ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM o")
def stat_holm(spark, d):
    v = _verdicts(spark, d, ["experiment"]).where("experiment is not null").select("experiment", F.round(S.mcnemar_p(F.col("b"), F.col("c")), 9).alias("p"))
    return S.holm(v, "p", "experiment").withColumn("p", F.round("p", 6))


@query(f"WITH {L}, v AS (SELECT experiment, count(*) FILTER (x < 0) AS k, count(*) AS n FROM l GROUP BY 1), w AS (SELECT *, k / n AS p, 1.959964 ** 2 AS z FROM v) SELECT experiment, round(greatest(0, ((p + z / (2 * n)) - 1.959964 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)), 6) AS low, round(least(1, ((p + z / (2 * n)) + 1.959964 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)), 6) AS high FROM w")
def stat_wilson(spark, d):
    v = losses(spark, d).groupBy("experiment").agg(F.count_if(F.col("x") < 0).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return v.select("experiment", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH {L}, s AS (SELECT path, run_seed, sum(sign(x)) AS s FROM l GROUP BY 1, 2), t AS (SELECT path, min(s) AS lo, max(s) AS hi, count(*) AS n FROM s WHERE s <> 0 GROUP BY 1) SELECT round(count(*) FILTER (lo * hi > 0) / count(*), 6) AS agreement, count(*) AS items FROM t WHERE n > 1")
def stat_sign_agreement(spark, d):
    """Share of documents whose runs agree on the sign of the difference, ties left out."""
    s = losses(spark, d).groupBy("path", "run_seed").agg(F.sum(F.signum("x")).alias("s")).where("s <> 0")
    t = s.groupBy("path").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).where("n > 1")
    return t.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("lo") * F.col("hi") > 0), F.count("*")), F.lit(1.0)), 6).alias("agreement"), F.count("*").alias("items"))


@query()
def stat_sign_flip(spark, d):
    """Sign flips of the works over the runs of all experiments, resampled where they are more than 16: SQL can't draw the same signs."""
    c = losses(spark, d).groupBy(F.col("work").alias("cluster")).agg(F.round(F.sum("x"), 9).alias("v"))
    return S.sign_flip(c, "v")


# Quantiles of Student's distribution (0.975) and of chi square (0.975, 0.025) for 1 to 10 degrees of freedom.
T975 = "[12.7062047364, 4.30265272991, 3.18244630528, 2.7764451052, 2.57058183661, 2.44691184879, 2.36462425101, 2.30600413503, 2.26215716274, 2.22813885196]"
C975 = "[5.02388618731, 7.37775890823, 9.34840360450, 11.1432867818, 12.8325019940, 14.4493753354, 16.0127642640, 17.5345461395, 19.0227677986, 20.4831773508]"
C025 = "[0.00098206911718, 0.0506356159686, 0.215795282623, 0.484418557087, 0.831211613486, 1.23734424584, 1.68986918067, 2.17973074725, 2.70038949998, 3.24697278024]"


@query(f"WITH {L}, r AS (SELECT experiment, run_seed, avg(x) AS x FROM l GROUP BY 1, 2), g AS (SELECT experiment, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM r GROUP BY 1), h AS (SELECT *, {T975}[n - 1] * s / sqrt(n) AS half FROM g) SELECT experiment, n, round(m + 1e-11, 6) AS mean, round(m - half, 6) AS low, round(m + half, 6) AS high FROM h")
def stat_t_interval(spark, d):
    """Mean difference of each experiment with its interval over runs."""
    runs = losses(spark, d).groupBy("experiment", "run_seed").agg(F.avg("x").alias("x"))
    g = runs.groupBy("experiment").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    half = S.t_quantile_column(F.lit(0.975), F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return g.select("experiment", "n", F.round(F.col("mean") + HALF, 6).alias("mean"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


@query(f"WITH {L}, r AS (SELECT experiment, run_seed, avg(b) AS v FROM l GROUP BY 1, 2), g AS (SELECT experiment, count(*) AS runs, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS median, min(v) AS min, max(v) AS max FROM r GROUP BY 1) SELECT experiment, runs, round(mean + 1e-11, 6) AS mean, round(sd + 1e-11, 6) AS sd, round(median + 1e-11, 6) AS median, round(min + 1e-11, 6) AS min, round(max + 1e-11, 6) AS max, round(max - min + 1e-11, 6) AS range, round(sd * sqrt((runs - 1) / {C975}[runs - 1]), 6) AS sd_low, round(sd * sqrt((runs - 1) / {C025}[runs - 1]), 6) AS sd_high FROM g")
def agg_seed_metric(spark, d):
    """Runs, mean, deviation with its interval, median and extent of each experiment's loss over its seeds."""
    runs = losses(spark, d).groupBy("experiment", "run_seed").agg(F.avg("b").alias("v"))
    g = runs.groupBy("experiment").agg(F.count("*").alias("runs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))
    edge = lambda p: F.round(F.col("sd") * F.sqrt((F.col("runs") - 1) / S.chi_square_quantile_column(F.lit(p), F.col("runs") - 1)), 6)
    return g.select("experiment", "runs", *[F.round(F.col(c) + HALF, 6).alias(c) for c in ("mean", "sd", "median", "min", "max")], F.round(F.col("max") - F.col("min") + HALF, 6).alias("range"), edge(0.975).alias("sd_low"), edge(0.025).alias("sd_high"))


@query(f"WITH {L}, g AS (SELECT experiment, count(DISTINCT run_seed) - 1 AS degrees FROM l GROUP BY 1) SELECT experiment, degrees, CASE WHEN degrees > 0 THEN round({C975}[degrees], 6) END AS q FROM g")
def stat_chi_square_q(spark, d):
    """Quantiles for the degrees of freedom that the experiments have."""
    g = losses(spark, d).groupBy("experiment").agg((F.count_distinct("run_seed") - 1).alias("degrees"))
    return g.select("experiment", "degrees", F.round(S.chi_square_quantile_column(F.lit(0.975), F.col("degrees")), 6).alias("q"))


_ARMS = "arms AS (SELECT second_arm AS arm, CASE WHEN regexp_extract(lower(path), '([a-z]+)-pg', 1) = '' THEN NULL ELSE regexp_extract(lower(path), '([a-z]+)-pg', 1) END AS register, sum(b * n) / sum(n) AS bits, sum(n) AS w FROM l GROUP BY 1, 2)"


def _arms(spark, d):
    reg = F.nullif(F.regexp_extract(F.lower("path"), "([a-z]+)-pg", 1), F.lit(""))
    return losses(spark, d).groupBy(F.col("second_arm").alias("arm"), reg.alias("register")).agg((F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("bits"), F.sum("n").alias("w"))


@query(f"WITH {L}, {_ARMS}, g AS (SELECT arm, sum(bits * w) / sum(w) AS weighted, avg(bits) AS equal FROM arms WHERE arm IS NOT NULL GROUP BY 1) SELECT g.arm, round(g.weighted, 6) AS weighted, round(g.equal, 6) AS equal, round(g.weighted - r.weighted, 6) AS weighted_difference, round(g.equal - r.equal, 6) AS equal_difference FROM g, (SELECT * FROM g WHERE arm = 'treatment') r")
def agg_weighted_partition(spark, d):
    """Arms by character weight and by equal weight over registers, against the arm treatment."""
    g = _arms(spark, d).where("arm is not null").groupBy("arm").agg((F.sum(F.col("bits") * F.col("w")) / F.sum("w")).alias("weighted"), F.avg("bits").alias("equal"))
    ref = Window.partitionBy()
    diff = lambda c: F.round(F.col(c) - F.max(F.when(F.col("arm") == "treatment", F.col(c))).over(ref), 6).alias(f"{c}_difference")
    return g.select("arm", F.round("weighted", 6).alias("weighted"), F.round("equal", 6).alias("equal"), diff("weighted"), diff("equal"))


@query(f"WITH {L}, {_ARMS} SELECT arm, round(avg(bits), 6) AS equal_weight_mean, count(*) AS partitions FROM arms GROUP BY 1")
def agg_equal_weight_mean(spark, d):
    return _arms(spark, d).groupBy("arm").agg(F.round(F.avg("bits"), 6).alias("equal_weight_mean"), F.count("*").alias("partitions"))


_SWEEP = "sw AS (SELECT CASE second_arm WHEN '10m' THEN 0.1 WHEN '20m' THEN 0.2 WHEN 'treatment' THEN 0.5 WHEN 'exemption' THEN 1.0 END::DOUBLE AS share, round(avg(b), 6) AS v FROM l WHERE second_arm IN ('10m', '20m', 'treatment', 'exemption') GROUP BY 1)"


def _sweep(spark, d):
    share = F.create_map(*[x for k, v in (("10m", 0.1), ("20m", 0.2), ("treatment", 0.5), ("exemption", 1.0)) for x in (F.lit(k), F.lit(v))])
    return losses(spark, d).where(F.col("second_arm").isin("10m", "20m", "treatment", "exemption")).groupBy(F.try_element_at(share, F.col("second_arm")).alias("share")).agg(F.round(F.avg("b"), 6).alias("v"))


@query(f"WITH {L}, {_SWEEP}, b AS (SELECT min(share) AS lo, max(share) AS hi, arg_min(share, v * 1e6 + share) AS bs, min(v) AS bv FROM sw) SELECT CASE WHEN bs NOT IN (lo, hi) AND (SELECT bool_and(v - bv > 0.002 + 1e-12) FROM sw WHERE share IN (lo, hi)) THEN 'interior_optimum' WHEN bs IN (lo, hi) AND (SELECT bool_and(v - bv > 0.002 + 1e-12) FROM sw WHERE share <> bs) THEN 'boundary_optimum' ELSE 'unresolved' END AS outcome, bs AS best_share, (SELECT count(*) FROM sw WHERE v - bv <= 0.002 + 1e-12) AS within_margin FROM b")
def sweep_classify(spark, d):
    """Arms placed on a line of shares; the loss of the second arm decides."""
    return S.classify_sweep(_sweep(spark, d), "share", "v", 0.002)


@query(f"WITH {L}, {_SWEEP}, m AS (SELECT 2.77 * stddev_samp(v) AS s FROM sw) SELECT a.share AS first, b.share AS second, round(b.v - a.v, 6) AS difference, CASE WHEN abs(b.v - a.v) <= 0.1 * s + 1e-12 THEN 'tie' WHEN abs(b.v - a.v) <= 0.5 * s + 1e-12 THEN 'indeterminate' ELSE 'separable' END AS class FROM sw a JOIN sw b ON a.share < b.share CROSS JOIN m")
def sweep_margin(spark, d):
    sw = _sweep(spark, d).withColumn("s", S.PAIR * F.stddev_samp("v").over(Window.partitionBy()))
    a, b = sw.select(F.col("share").alias("first"), F.col("v").alias("va"), "s"), sw.select(F.col("share").alias("second"), F.col("v").alias("vb"))
    x = a.join(b, F.col("first") < F.col("second"))
    return x.select("first", "second", F.round(F.col("vb") - F.col("va"), 6).alias("difference"), S.classify_difference(F.col("vb") - F.col("va"), 0.1 * F.col("s"), 0.5 * F.col("s")).alias("class"))


@query(f"WITH {L}, {_ARMS} SELECT a.arm AS first, b.arm AS second, count(*) AS registers, bool_and(b.bits - a.bits > 0.001) AS dominates FROM arms a JOIN arms b ON a.register = b.register AND a.arm <> b.arm GROUP BY 1, 2")
def sweep_dominance(spark, d):
    """Ordered pairs of arms, and whether the first is separably better on every register that both have."""
    t = _arms(spark, d)
    a, b = t.select(F.col("arm").alias("first"), "register", F.col("bits").alias("x")), t.select(F.col("arm").alias("second"), "register", F.col("bits").alias("y"))
    return a.join(b, "register").where("first <> second").groupBy("first", "second").agg(F.count("*").alias("registers"), F.every(F.col("y") - F.col("x") > 0.001).alias("dominates"))


@query(f"WITH {L} SELECT experiment, count(DISTINCT first_arm) = 1 AND count(DISTINCT second_arm) = 1 AS agrees, count(DISTINCT run_seed) AS seeds FROM l GROUP BY 1")
def agg_protocol_agreement(spark, d):
    return losses(spark, d).groupBy("experiment").agg(((F.count_distinct("first_arm") == 1) & (F.count_distinct("second_arm") == 1)).alias("agrees"), F.count_distinct("run_seed").alias("seeds"))


@query(f"WITH {L}, m AS (SELECT experiment, avg(a) AS first, avg(b) AS second FROM l GROUP BY 1) SELECT experiment, round(second - first + 1e-11, 6) AS delta, abs(second - first) <= 0.002 AS within FROM m")
def agg_reference_compare(spark, d):
    m = losses(spark, d).groupBy("experiment").agg(F.avg("a").alias("first"), F.avg("b").alias("second"))
    return m.select("experiment", F.round(F.col("second") - F.col("first") + HALF, 6).alias("delta"), (F.abs(F.col("second") - F.col("first")) <= 0.002).alias("within"))


@query(f"WITH {L}, m AS (SELECT experiment, avg(a) AS first, avg(b) AS second, stddev_samp(x) AS sd FROM l GROUP BY 1) SELECT experiment, round(second - first + 1e-11, 6) AS delta, CASE WHEN abs(second - first) <= 0.1 * sd THEN 'unchanged' WHEN second < first THEN 'better' ELSE 'worse' END AS direction FROM m")
def compare_results(spark, d):
    m = losses(spark, d).groupBy("experiment").agg(F.avg("a").alias("first"), F.avg("b").alias("second"), F.stddev_samp("x").alias("sd"))
    gap = F.col("second") - F.col("first")
    return m.select("experiment", F.round(gap + HALF, 6).alias("delta"), F.when(F.abs(gap) <= 0.1 * F.col("sd"), "unchanged").when(F.col("second") < F.col("first"), "better").otherwise("worse").alias("direction"))


@query(f"WITH {L} SELECT experiment, count(*) AS documents, sum(n)::BIGINT AS characters, round(sum(a * n * ln(2)) / sum(n), 6) AS nats_per_character, round(exp(sum(a * n * ln(2)) / sum(n)), 4) AS perplexity, round(sum(a * n) / sum(n), 6) AS bits_per_character FROM l GROUP BY 1")
def agg_model_metrics(spark, d):
    bits = F.sum(F.col("a") * F.col("n")) / F.sum("n")
    nats = F.sum(F.col("a") * F.col("n") * F.log(F.lit(2.0))) / F.sum("n")
    return losses(spark, d).groupBy("experiment").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"), F.round(nats, 6).alias("nats_per_character"), F.round(F.exp(nats), 4).alias("perplexity"), F.round(bits, 6).alias("bits_per_character"))


@query(f"WITH {L} SELECT path, count(*) AS runs, round(avg(a), 10) AS first_bits, round(avg(b), 10) AS second_bits, max(n) AS characters FROM l GROUP BY 1")
def agg_document_losses(spark, d):
    return losses(spark, d).groupBy("path").agg(F.count("*").alias("runs"), F.round(F.avg("a"), 10).alias("first_bits"), F.round(F.avg("b"), 10).alias("second_bits"), F.max("n").alias("characters"))


@query(f"WITH {L}, c AS (SELECT CASE WHEN a < 1.8 THEN 'low' WHEN a < 2.1 THEN 'middle' ELSE 'high' END AS expected, CASE WHEN b < 1.8 THEN 'low' WHEN b < 2.1 THEN 'middle' ELSE 'high' END AS predicted FROM l), n AS (SELECT expected, predicted, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT unnest(['low', 'middle', 'high']) AS class) SELECT class, sum(n) FILTER (expected = class)::BIGINT AS support, sum(n) FILTER (expected = class AND predicted = class)::BIGINT AS tp, round(sum(n) FILTER (expected = class AND predicted = class) / sum(n) FILTER (predicted = class), 6) AS precision, round(sum(n) FILTER (expected = class AND predicted = class) / sum(n) FILTER (expected = class), 6) AS recall FROM k, n GROUP BY 1")
def agg_confusion(spark, d):
    """Classes of loss under the first arm (expected) and the second (predicted); null where a denominator is empty."""
    band = lambda c: F.when(F.col(c) < 1.8, "low").when(F.col(c) < 2.1, "middle").otherwise("high")
    n = losses(spark, d).groupBy(band("a").alias("expected"), band("b").alias("predicted")).agg(F.count("*").alias("n"))
    e = n.select(F.explode(F.array(F.lit("low"), F.lit("middle"), F.lit("high"))).alias("class"), "expected", "predicted", "n")
    pick = lambda *c: F.sum(F.when(reduce(lambda p, q: p & q, [F.col(x) == F.col("class") for x in c]), F.col("n")))
    return e.groupBy("class").agg(pick("expected").alias("support"), pick("expected", "predicted").alias("tp"), F.round(pick("expected", "predicted") / pick("predicted"), 6).alias("precision"), F.round(pick("expected", "predicted") / pick("expected"), 6).alias("recall"))


@query(f"WITH {L}, m AS (SELECT experiment, round(avg(x), 9) AS v FROM l WHERE experiment IS NOT NULL GROUP BY 1) SELECT experiment, row_number() OVER (ORDER BY v, experiment) AS position FROM m")
def ordered_models(spark, d):
    m = losses(spark, d).where("experiment is not null").groupBy("experiment").agg(F.round(F.avg("x"), 9).alias("v"))
    return m.select("experiment", F.row_number().over(Window.orderBy("v", "experiment")).cast("bigint").alias("position"))


@query(f"WITH {L}, v AS (SELECT experiment, work, avg(x) AS v FROM l WHERE experiment IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.experiment AS first, b.experiment AS second, count(*) FILTER (a.v < b.v) AS b, count(*) FILTER (a.v > b.v) AS c, count(*) AS n FROM v a JOIN v b ON a.work = b.work AND a.experiment < b.experiment GROUP BY 1, 2) SELECT first, second, b, c, n, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {tail_sql('greatest(b, c)', '(b + c)')}) END + 1e-11, 6) AS p FROM p")
def compare_instruments(spark, d):
    """All pairs of experiments on the works that both scored: discordant works and their exact p."""
    v = losses(spark, d).where("experiment is not null").groupBy("experiment", "work").agg(F.avg("x").alias("v"))
    a, b = v.select(F.col("experiment").alias("first"), "work", F.col("v").alias("va")), v.select(F.col("experiment").alias("second"), "work", F.col("v").alias("vb"))
    p = a.join(b, "work").where("first < second").groupBy("first", "second").agg(F.count_if(F.col("va") < F.col("vb")).alias("b"), F.count_if(F.col("va") > F.col("vb")).alias("c"), F.count("*").alias("n"))
    return p.select("first", "second", "b", "c", "n", F.round(S.mcnemar_p(F.col("b"), F.col("c")) + HALF, 6).alias("p"))


@query("WITH s AS (SELECT register, stddev_samp(treatment) AS s FROM results_characters_per_identifier WHERE treatment IS NOT NULL AND NOT isnan(treatment) GROUP BY 1) SELECT register, round(2.77 * s, 6) AS tie, round(ceil(2.77 * s / 0.005) * 0.005, 6) AS band FROM s")
def margins_by_objective(spark, d):
    s = table(spark, d, "results_characters_per_identifier").where("treatment is not null and not isnan(treatment)").groupBy("register").agg(F.stddev_samp("treatment").alias("s"))
    return s.select("register", F.round(S.PAIR * F.col("s"), 6).alias("tie"), F.round(F.ceil(S.PAIR * F.col("s") / 0.005) * 0.005, 6).alias("band"))
