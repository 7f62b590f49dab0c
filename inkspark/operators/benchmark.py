"""Runs over cases: choices between continuations, answers of an oracle, judges, corrections. Cases are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.operators.rules import decide_answer, decide_claim


def choice(good: Column, bad: Column) -> Column:
    """1 where the good side scores higher, 1/2 for a tie, 0 else."""
    return F.when(good > bad, 1.0).when(good == bad, 0.5).otherwise(0.0)


def readings(items: DataFrame, register: str, kind: str) -> DataFrame:
    """(register, kind, reading, n, ties, accuracy) of choices (true_with, true_without, bad_with, bad_without), by register and for all
    (null): the score given the prefix, that without it, and their difference, which takes each candidate's own likelihood out."""
    pairs = {
        "pmi": (F.col("true_with") - F.col("true_without"), F.col("bad_with") - F.col("bad_without")),
        "conditional": (F.col("true_with"), F.col("bad_with")),
        "blind": (F.col("true_without"), F.col("bad_without")),
    }
    each = F.array(*[F.struct(F.lit(name).alias("reading"), choice(F.round(a, 9), F.round(b, 9)).alias("v")) for name, (a, b) in pairs.items()])
    x = items.select(F.col(register).alias("register"), F.col(kind).alias("kind"), F.explode(each).alias("e")).select("register", "kind", "e.*")
    g = x.groupingSets([["register", "kind", "reading"], ["kind", "reading"]], "register", "kind", "reading")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("v") == 0.5).alias("ties"), F.round(F.avg("v") + 1e-11, 6).alias("accuracy"))


def context_items(docs: DataFrame, id_col: str, words: str, register: str, work: str, prefix: int = 16, length: int = 8, per_register: int = 20, per_work: int = 2) -> DataFrame:
    """(register, work, id, offset, prefix, truth, kind, candidate): passages of ``prefix`` words, the ``length`` words that follow, and four
    others of the same text: the span before the passage, the one after the continuation, the truth reversed and permuted.

    Texts come in the order of a digest, one passage a text, ``per_work`` a work and ``per_register`` a register; the passage begins
    at the slot of the least digest among those with room on both sides. A text in which a candidate equals the truth is left out.
    """
    span = prefix + length
    n = F.size(words)
    slots = F.when(n - span - 2 * length >= 0, F.sequence(F.lit(length), n - span - length, F.lit(span))).otherwise(F.array().cast("array<int>"))
    rank = lambda *parts: F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    t = docs.select(F.col(id_col).alias("id"), F.col(register).alias("register"), F.col(work).alias("work"), F.col(words).alias("w"), slots.alias("slots")).where(F.size("slots") > 0)
    at = F.explode("slots").alias("offset")
    best = t.select("id", at).groupBy("id").agg(F.min_by("offset", rank(F.lit("offset"), F.col("id"), F.col("offset"))).alias("offset"))
    x = t.drop("slots").join(best, "id")
    cut_ = lambda start: F.slice("w", start + 1, F.lit(length))
    truth = cut_(F.col("offset") + prefix)
    keyed = F.transform(F.arrays_zip(F.sequence(F.lit(1), F.lit(length)).alias("i"), truth.alias("t")), lambda z: F.struct(F.sha2(F.concat_ws("|", F.lit("permuted"), F.col("id").cast("string"), F.col("offset").cast("string"), z["i"].cast("string")), 256).alias("k"), z["t"].alias("t")))
    shuffled = F.transform(F.array_sort(keyed), lambda z: z["t"])
    x = x.select("id", "register", "work", "offset", F.slice("w", F.col("offset") + 1, F.lit(prefix)).alias("prefix"), truth.alias("truth"), cut_(F.col("offset") - length).alias("prior_span"), cut_(F.col("offset") + span).alias("next_span"), F.reverse(truth).alias("reversed"), shuffled.alias("permuted"))
    kinds = ["prior_span", "next_span", "reversed", "permuted"]
    for k in kinds:
        x = x.where(F.col(k) != F.col("truth"))
    order = x.withColumn("_k", rank(F.lit("anchor"), F.col("register"), F.col("id")))
    order = order.withColumn("_n", F.row_number().over(Window.partitionBy("register", "work").orderBy("_k"))).where(F.col("_n") <= per_work)
    order = order.withColumn("_n", F.row_number().over(Window.partitionBy("register").orderBy("_k"))).where(F.col("_n") <= per_register)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("candidate")) for k in kinds])).alias("e")
    return order.select("register", "work", "id", "offset", "prefix", "truth", each).select("register", "work", "id", "offset", "prefix", "truth", "e.kind", "e.candidate")


def repeated_words(prefix: Column, words: Column) -> Column:
    """A score that stands in for a model: how many of ``words`` stand in ``prefix``, less a hundredth of their characters."""
    held = F.size(F.filter(words, lambda w: F.array_contains(prefix, w)))
    return held - F.char_length(F.array_join(words, "")) / 100.0


def oracle_answers(cases: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(case, abstained, text, claims, cited) of cases (case, answerable, facts): the facts replayed as claims, each citing the gold
    chunks (case, chunk) that retrieval surfaced, at most a pack of them; an abstention where there is no answer."""
    s = surfaced.groupBy("case").agg(F.array_sort(F.collect_set("chunk")).alias("cited"))
    x = cases.join(s, "case", "left")
    none = F.array().cast(s.schema["cited"].dataType)
    return x.select("case", (~F.col("answerable")).alias("abstained"), F.when(F.col("answerable"), F.array_join("facts", " ")).otherwise("The supplied evidence does not support an answer.").alias("text"), F.when(F.col("answerable"), F.size("facts")).otherwise(0).alias("claims"), F.when(F.col("answerable"), F.coalesce("cited", none)).otherwise(none).alias("cited"))


def ground_supplied(claims: DataFrame, supplied: DataFrame, claim: str = "claim") -> DataFrame:
    """``claims`` with the ``status`` that a caller decided for each; not_evaluated where none did."""
    s = supplied.select(claim, "status").dropDuplicates([claim])
    return claims.join(s, claim, "left").withColumn("status", F.coalesce("status", F.lit("not_evaluated")))


def ground_judged(claims: DataFrame, judgement: Column, conflicting: Column) -> DataFrame:
    """``claims`` with ``status`` and ``conflict``: what a judge said of each, a judge's failure (null) being not_evaluated, and whether a
    contradiction names two chunks or more that disagree."""
    known = F.when(judgement.isin("supported", "contradicted", "uncertain"), judgement).otherwise("not_evaluated")
    return claims.withColumn("status", known).withColumn("conflict", (known == "contradicted") & (F.coalesce(F.size(F.array_distinct(conflicting)), F.lit(0)) >= 2))


def judge_run(cases: DataFrame, predicted: Column) -> DataFrame:
    """(case, expected, predicted, correct, failed) of a judge over all cases."""
    p = F.when(predicted.isin("supported", "contradicted", "uncertain"), predicted).otherwise("not_evaluated")
    return cases.select("case", "expected", p.alias("predicted"), (p == F.col("expected")).alias("correct"), predicted.isNull().alias("failed"))


def correction_run(claims: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, expected, actual, correct, affected) from claims (case, claim, prior, new): each case decided by its claims."""
    c = claims.withColumn("decision", decide_claim(F.col("prior"), F.col("new")))
    actual = decide_answer(c, "case", "decision", "new").withColumnRenamed("decision", "actual")
    affected = c.groupBy("case").agg(F.count_if(~F.col("prior").eqNullSafe(F.col("new"))).alias("affected"))
    return expected.join(actual, "case").join(affected, "case").select("case", "expected", "actual", (F.col("expected") == F.col("actual")).alias("correct"), "affected")


def grounded_run(cases: DataFrame, metrics: DataFrame, sufficiency: DataFrame, answers: DataFrame, prohibited: Column) -> DataFrame:
    """One row per case (case, answerable, facts): what each stage gave, and the stage that failed, if one did.

    Facts and prohibited claims are looked for in the answer without regard to case. A claim of an answerable case needs a citation,
    and only gold can be cited, so it is grounded if something was.
    """
    x = cases.join(metrics.withColumnRenamed("query", "case"), "case").join(sufficiency.select(F.col("query").alias("case"), "sufficient"), "case", "left").join(answers, "case", "left")
    inside = lambda fact: F.contains(F.lower("text"), F.lower(fact))
    facts = F.size(F.filter("facts", inside))
    stage = F.when(F.col("retrieved") == 0, "retrieval").when(F.col("abstained").isNull(), "generation").when(F.col("sufficient").isNull(), "evaluation").otherwise("none")
    return x.select("case", "answerable", "category", "recall", "reciprocal_rank", "hit", "forbidden_hits", "sufficient", "abstained", facts.alias("facts_found"), F.size(F.filter(prohibited, inside)).alias("prohibited_found"), (F.size("cited") > 0).alias("grounded"), (F.col("abstained") != F.col("answerable")).alias("right_disposition"), stage.alias("failed_stage"))
