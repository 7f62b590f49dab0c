"""Ordered selections without an order over all rows: prefix sums in two levels, splits, caps, shares, packing.

A global running total needs no global sort in one task: rows are put into ranges of the order key by a shuffle, totals per range are
a small table, and the running total within a range is a window over that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, *ids: Column) -> Column:
    """A seeded order: the digest of seed and id. Any subset keeps its order, on any cluster."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]), 256)


def prefix_sum(df: DataFrame, key: str, value: Column, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """``df`` with ``before`` (the sum of ``value`` over the rows before) and ``position`` (from 1), in the order of the hexadecimal ``key``.

    Rows are grouped by the first ``digits`` of the key: 16 ** digits ranges of about equal size, as the key is a digest.
    """
    by = by or []
    x = df.withColumn("_range", F.substring(key, 1, digits)).withColumn("_v", value)
    per = x.groupBy(*by, "_range").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*by, "_range", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_b"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_p"))
    own = Window.partitionBy(*by, "_range").orderBy(key)
    x = x.join(base, [*by, "_range"])
    before = F.col("_b") + F.coalesce(F.sum("_v").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("before", before).withColumn("position", F.col("_p") + F.row_number().over(own)).drop("_range", "_v", "_b", "_p")


def split_documents(df: DataFrame, id_col: str, seed: int = 7, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """(id, side): rows in seeded order, first rint(n test) to test, then rint(n validation) to validation, the rest to train."""
    n = df.count()
    t, v = (int(_half_even(n * f)) for f in (test, validation))
    x = prefix_sum(df.select(id_col).withColumn("key", order_key(seed, F.col(id_col))), "key", F.lit(1))
    return x.select(id_col, F.when(F.col("position") <= t, "test").when(F.col("position") <= t + v, "validation").otherwise("train").alias("side"))


def _half_even(x: float) -> float:
    return float(round(x))


def split_works(df: DataFrame, work: str, size: Column, seed: int = 7, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """(work, side): whole works in seeded order; to test while test holds less than its part, then to validation, the rest to train."""
    per = df.where(F.col(work).isNotNull()).groupBy(work).agg(F.sum(size).alias("size"))
    total = per.agg(F.sum("size")).first()[0] or 0
    x = prefix_sum(per.withColumn("key", order_key(seed, F.col(work))), "key", F.col("size"))
    in_test = F.col("before") < test * total
    first = x.where(in_test).agg(F.sum("size")).first()[0] or 0
    return x.select(work, F.when(in_test, "test").when(F.col("before") - first < validation * total, "validation").otherwise("train").alias("side"))


def leakage(df: DataFrame, work: str, side: str) -> DataFrame:
    """(work, sides) of the works that lie on more than one side."""
    return df.groupBy(work).agg(F.count_distinct(side).alias("sides")).where("sides > 1")


def token_cap(df: DataFrame, key: str, tokens: Column, cap: int, by: list[str] | None = None) -> DataFrame:
    """Whole rows in the order of ``key`` while what is taken before is below ``cap``: the row that crosses it is taken."""
    return prefix_sum(df, key, tokens, by).where(F.col("before") < cap)


def stream_offsets(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``df`` with ``before`` as its offset in the stream of all tokens, each row followed by a separator."""
    return prefix_sum(df, key, tokens + 1)


def block_spans(offsets: DataFrame, id_col: str, length: int, tokens: Column) -> DataFrame:
    """(block, id, first, last): which positions of which rows a block of ``length`` + 1 tokens holds; the last, short block is left out.

    Made from offsets alone, so tokens are never ordered together.
    """
    size = length + 1
    end = F.col("before") + tokens + 1
    whole = offsets.select(F.max(end)).first()[0] or 0
    x = offsets.select(id_col, "before", end.alias("end"), F.explode(F.sequence(F.floor(F.col("before") / size), F.floor((end - 1) / size))).alias("block"))
    x = x.where((F.col("block") + 1) * size <= whole)
    return x.select("block", id_col, (F.greatest(F.col("before"), F.col("block") * size) - F.col("before")).alias("first"), (F.least(F.col("end"), (F.col("block") + 1) * size) - 1 - F.col("before")).alias("last"))


def share_select(df: DataFrame, key: str, tokens: Column, is_class: Column, share: float, total: int) -> DataFrame:
    """Rows of two classes in seeded order, each class up to its quota of ``total`` tokens; the crossing row is taken."""
    x = df.withColumn("in_class", F.coalesce(is_class, F.lit(False)))
    x = prefix_sum(x, key, tokens, ["in_class"])
    return x.where(F.col("before") < F.when(F.col("in_class"), share * total).otherwise((1 - share) * total))


def walk_divergence(recorded: DataFrame, planned: DataFrame, by: str, position: str, item: str) -> DataFrame:
    """(by, diverges_at): the first position at which a recorded walk is not the planned one, null where it is its beginning."""
    p = planned.select(by, position, F.col(item).alias("_planned"))
    j = recorded.join(p, [by, position], "left")
    return j.groupBy(by).agg(F.min(F.when(~F.col(item).eqNullSafe(F.col("_planned")), F.col(position))).alias("diverges_at"))


def pick_unique(kinds: list[DataFrame], key: str, most: int, order) -> DataFrame:
    """The first ``most`` rows of each of a few kinds in the given order, leaving out rows whose ``key`` an earlier kind has picked and
    those that differ in nothing from their false form. Ties go by key."""
    taken = None
    for k in kinds:
        k = k.where(F.col("good") != F.col("bad")) if {"good", "bad"} <= set(k.columns) else k
        left = k if taken is None else k.join(taken.select(key), key, "left_anti")
        first = left.withColumn("_o", order(left)).orderBy("_o", key).limit(most).select(*k.columns)
        taken = first if taken is None else taken.unionByName(first)
    return taken
