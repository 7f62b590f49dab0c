"""Joins of many rows with a table of one row a key, where single keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 50_000  # keys that are spread; their list is broadcast


def attach(rows: DataFrame, one: DataFrame, key: str, spread_by: list[str], n: str, total: int, how: str = "inner", salts: int = 16, hot: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row per ``key`` and in ``n`` how many rows have it.

    Rows of a key above ``hot`` rows are dealt over ``salts`` tasks by the hash of ``spread_by``, and its row in ``one`` is repeated for
    each. ``total`` is the number of rows, or more: with it the bound of a hot key is raised so that at most MOST_HOT keys can be
    hot, which is what makes their list safe to broadcast. Below ``hot`` rows in all this is a plain join.
    """
    least = max(hot, total // MOST_HOT)
    if total <= least:
        return rows.join(one, key, how)
    keys = one.where(F.col(n) > least).select(key, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(keys), key, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.when(F.col(n) > least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str, parts: int = 2) -> DataFrame:
    """``df`` dealt by the hash of ``key`` over the cores, if it comes in fewer than ``parts`` parts a core, as a small table in one file does;
    larger ones stay as they lie. For work that costs much more a row than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < parts * cores else df


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows: counted first, so the bound is proven; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
