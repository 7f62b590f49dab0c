"""Decision rules of records as columns: planning, grounding, corrections, declarative outcome rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that ask for information, that continue a topic, and that point back.
INFORMATION = ["according", "compare", "define", "describe", "explain", "find", "how", "list", "lookup", "retrieve", "search", "tell", "what", "when", "where", "which", "who", "why"]
CONTINUATION = ["again", "also", "both", "either", "else", "first", "it", "its", "more", "neither", "second", "than", "that", "these", "they", "them", "this", "those"]


def plan(tokens: Column, message: Column, has_sources: Column, topic: Column) -> Column:
    """follow_up with prior sources and a shared topic word or a word that points back; else retrieve by a cue or a closing
    question mark; else none."""
    cues = lambda ws: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ws]))
    back = has_sources & (cues(CONTINUATION) | F.coalesce(F.arrays_overlap(tokens, topic), F.lit(False)))
    return F.when(back, "follow_up").when(cues(INFORMATION) | F.rtrim(message).endswith("?"), "retrieve").otherwise("none")


def ground(validated: DataFrame, required: Column) -> DataFrame:
    """(claim, status): supported with a valid citation; unsupported if one is required and none is valid; else not_evaluated."""
    g = validated.groupBy("claim").agg(F.max((F.col("status") == "valid").cast("int")).alias("ok"), F.max(required.cast("int")).alias("needs"))
    return g.select("claim", F.when(F.col("ok") == 1, "supported").when(F.col("needs") == 1, "unsupported").otherwise("not_evaluated").alias("status"))


def decide_claim(prior: Column, new: Column) -> Column:
    """correct what is contradicted, qualify what lost its support, retain the rest."""
    return F.when(new == "contradicted", "correct").when((prior == "supported") & (new != "supported"), "qualify").otherwise("retain")


def decide_answer(claims: DataFrame, answer: str, decision: str, status: str) -> DataFrame:
    """(answer, decision) by precedence: correct, needs_review, qualify, abstain, retain."""
    g = claims.groupBy(answer).agg(F.bool_or(F.col(decision) == "correct").alias("c"), F.bool_or(F.col(status) == "needs_review").alias("r"), F.bool_or(F.col(decision) == "qualify").alias("q"), F.every(F.col(status) == "not_evaluated").alias("n"))
    return g.select(answer, F.when(F.col("c"), "correct").when(F.col("r"), "needs_review").when(F.col("q"), "qualify").when(F.col("n"), "abstain").otherwise("retain").alias("decision"))


def rule(tree: dict) -> Column:
    """A declarative predicate as a column: {"fact", "min"?, "max"?}, {"flag"}, {"all_of"}, {"any_of"} or {"always": True}."""
    if "all_of" in tree:
        return reduce(lambda a, b: a & b, [rule(t) for t in tree["all_of"]], F.lit(True))
    if "any_of" in tree:
        return reduce(lambda a, b: a | b, [rule(t) for t in tree["any_of"]], F.lit(False))
    if "flag" in tree:
        return F.coalesce(F.col(tree["flag"]), F.lit(False))
    if tree.get("always"):
        return F.lit(True)
    c = F.col(tree["fact"])
    parts = ([c >= tree["min"]] if "min" in tree else []) + ([c <= tree["max"]] if "max" in tree else [])
    if not parts:
        raise ValueError(f"a rule without bounds: {tree}")
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def outcome(vocabulary: list[tuple[str, dict]], exclusive: bool = False) -> Column:
    """The first outcome whose rule holds; with ``exclusive`` the only one, ``ambiguous`` if several hold; null if none does."""
    if not exclusive:
        return F.coalesce(*[F.when(rule(t), F.lit(n)) for n, t in vocabulary])
    held = F.filter(F.array(*[F.when(rule(t), F.lit(n)) for n, t in vocabulary]), lambda x: x.isNotNull())
    return F.when(F.size(held) > 1, "ambiguous").otherwise(F.try_element_at(held, F.lit(1)))


def history(answers: DataFrame, id_col: str, parent: str, most: int = 10_000) -> DataFrame:
    """(id, root, depth): each answer's first version and how many corrections led to it, by pointer doubling: the number of joins is
    logarithmic in the longest chain. An unknown parent makes a root; a cycle is an error."""
    from inkspark.plans.lineage import cut

    a = answers.select(F.col(id_col).alias("id"), F.col(parent).alias("up"))
    known = a.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    x = cut(a.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("depth")))
    x = x.select("id", F.coalesce("up", "id").alias("root"), "depth")
    for _ in range(max(1, most.bit_length()) + 1):
        y = x.select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        x = cut(x.join(y, "root").select("id", F.col("far").alias("root"), (F.col("depth") + F.when(F.col("far") == F.col("root"), 0).otherwise(F.col("more"))).alias("depth"), (F.col("far") != F.col("root")).alias("moved")))
        if not x.where("moved").limit(1).count():
            return x.select("id", "root", "depth")
        x = x.drop("moved")
    raise ValueError("a cycle of corrections, or a longer chain than allowed")


def append_violations(existing: DataFrame, batch: DataFrame, id_col: str, parent: str, conversation: str) -> DataFrame:
    """(id, violation) of a batch: duplicate, dangling or cross_conversation; rows earlier in the batch count as existing."""
    b = batch.select(F.col(id_col).alias("id"), F.col(parent).alias("up"), F.col(conversation).alias("conv"))
    every = existing.select(F.col(id_col).alias("id"), F.col(conversation).alias("conv"))
    twice = b.groupBy("id").agg(F.count("*").alias("n")).join(every.select("id", F.lit(True).alias("old")).distinct(), "id", "left").where("n > 1 or old").select("id", F.lit("duplicate").alias("violation"))
    up = every.unionByName(b.select("id", "conv")).groupBy(F.col("id").alias("up")).agg(F.min("conv").alias("of"))
    j = b.where("up is not null").join(up, "up", "left")
    return twice.unionByName(j.where("of is null").select("id", F.lit("dangling").alias("violation"))).unionByName(j.where("of <> conv").select("id", F.lit("cross_conversation").alias("violation")))


def last_improvement(curve: Column, min_delta: float, patience: int) -> Column:
    """The step of the best loss of an ordered array of (step, loss), where a step is better by more than ``min_delta``; looking stops
    when more than ``patience`` steps in a row are not. The first step is a candidate."""
    start = F.struct(F.lit(None).cast("bigint").alias("step"), F.lit(None).cast("double").alias("loss"), F.lit(0).alias("stale"), F.lit(False).alias("over"))

    def step(a, c):
        better = a["loss"].isNull() | (c["loss"] < a["loss"] - min_delta)
        on = F.when(better, F.struct(c["step"].cast("bigint").alias("step"), c["loss"].cast("double").alias("loss"), F.lit(0).alias("stale"), F.lit(False).alias("over"))).otherwise(F.struct(a["step"].alias("step"), a["loss"].alias("loss"), (a["stale"] + 1).alias("stale"), (a["stale"] + 1 > patience).alias("over")))
        return F.when(a["over"], a).otherwise(on)

    return F.aggregate(curve, start, step, lambda a: a["step"])
