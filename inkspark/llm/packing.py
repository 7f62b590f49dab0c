"""Filling fixed-capacity containers: vector best fit over tokens, documents and attention cost.

An item longer than a container is cut into full containers and a rest; nothing else is ever cut. Rests and shorter items
are dealt by hash into blocks of bounded size, and each block is packed by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """What a container holds besides its length: items, and attention cost (the sum of squared lengths) as a part of the
    squared capacity. ``weights`` are those of length, items and cost in the score; ``score`` is ``norm`` or ``dot``."""

    documents: int = 512
    attention: float = 1.0
    weights: tuple[float, float, float] = (1.0, 0.02, 0.05)
    score: str = "norm"

    def __post_init__(self):
        if self.documents < 1 or not 0 < self.attention <= 1 or self.score not in ("norm", "dot"):
            raise ValueError(f"no limits: {self}")


def best_fit(sizes: np.ndarray, capacity: int, limits: Limits = Limits()) -> np.ndarray:
    """Container number of each item, items taken in the order given; every size is from 0 to ``capacity``.

    An item goes to the open container that has room in all three dimensions and scores best: by ``norm`` the one whose
    weighted residual vector would be shortest, by ``dot`` the one whose residual has the largest weighted dot product with the
    item. Ties go to the container opened first. Without one that has room, a container is opened. An item of more
    cost than the limit has a container alone.
    """
    n = len(sizes)
    out = np.empty(n, np.int64)
    left = np.empty(n), np.empty(n), np.empty(n)  # residual shares of length, items, attention cost; the first `opened` count
    w = np.asarray(limits.weights, float)
    most_cost = limits.attention * capacity**2
    number = np.empty(n, np.int64)  # of the container in a slot; full ones give up their slot
    opened = slots = 0
    one = 1.0 / limits.documents
    slack = 1e-12
    for i in range(n):
        a, c = sizes[i] / capacity, float(sizes[i]) ** 2 / most_cost
        x, y, z = (v[:slots] for v in left)
        room = np.flatnonzero((x >= a - slack) & (y >= one - slack) & (z >= c - slack))
        if len(room):
            rx, ry, rz = x[room], y[room], z[room]
            if limits.score == "norm":
                score = w[0] * (rx - a) ** 2 + w[1] * (ry - one) ** 2 + w[2] * (rz - c) ** 2
                best = score.min()
            else:
                score = -(w[0] * rx * a + w[1] * ry * one + w[2] * rz * c)
                best = score.min()
            ties = room[score == best]
            s = ties[np.argmin(number[ties])] if len(ties) > 1 else ties[0]
        else:
            s, slots = slots, slots + 1
            number[s], opened = opened, opened + 1
            left[0][s] = left[1][s] = left[2][s] = 1.0
        out[i] = number[s]
        left[0][s] -= a
        left[1][s] -= one
        left[2][s] -= c
        if left[0][s] < 0.5 / capacity or left[1][s] < one / 2 or left[2][s] < -slack:
            slots -= 1
            for v in (*left, number):
                v[s] = v[slots]
    return out


def pack(items: DataFrame, arms: DataFrame, id_col: str = "doc_id", length_col: str = "length", arm_col: str = "arm", capacity_col: str = "capacity_chars", block: int = 4096, limits: Limits = Limits()) -> DataFrame:
    """(arm, capacity, id, piece, start, length, container): where each piece of each item goes in each arm.

    ``container`` is a string, unique within the arm. Arms are few: a repeated arm of one capacity counts once, and arms with a
    null name or capacity, or one below 1, are left out; a name with two capacities is an error. Items of null length are
    left out, those of length 0 get a place like others. Repeated ids count once, with their greatest length. Blocks have
    about ``block`` pieces however many items there are, or share an id.
    """
    rows = arms.select(arm_col, capacity_col).where(f"`{arm_col}` is not null and `{capacity_col}` >= 1").distinct().limit(1001).collect()
    if len(rows) > 1000 or len({r[0] for r in rows}) < len(rows):
        raise ValueError("arms are few, and each has one capacity")
    each = F.array(*[F.struct(F.lit(str(a)).alias("arm"), F.lit(int(c)).cast("bigint").alias("capacity")) for a, c in sorted(map(tuple, rows))])
    kind = items.schema[id_col].dataType.simpleString()
    one = items.select(F.col(id_col).alias("id"), F.col(length_col).cast("bigint").alias("n")).where("id is not null and n is not null").groupBy("id").agg(F.max("n").alias("n"))
    n_items = one.count()
    blocks = max(1, round(n_items / block))
    whole = (F.col("n") / F.col("capacity")).cast("bigint")
    last = F.when(F.expr("n % capacity = 0 and n > 0"), whole - 1).otherwise(whole)
    pieces = (
        one.select("id", "n", F.explode(each).alias("a"))
        .select("a.arm", "a.capacity", "id", "n")
        .select("arm", "capacity", "id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
        .select("arm", "capacity", "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least(F.col("capacity"), F.col("n") - F.col("piece") * F.col("capacity")).alias("length"))
    )
    full = pieces.where("length = capacity").withColumn("container", F.concat(F.lit("f-"), F.col("id").cast("string"), F.lit("-"), F.col("piece").cast("string")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable")
        placed = best_fit(pdf["length"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), limits)
        pdf["container"] = [f"b-{b}-{c}" for b, c in zip(pdf["block"], placed, strict=True)]
        return pdf.drop(columns="block")

    rest = pieces.where("length < capacity").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = rest.groupBy("arm", "block").applyInPandas(run, f"arm string, capacity bigint, id {kind}, piece bigint, start bigint, length bigint, container string")
    return full.unionByName(packed).withColumnRenamed("id", id_col)


def fill(placed: DataFrame) -> DataFrame:
    """(arm, capacity, containers, pieces, used, filled): how full the containers of each arm are."""
    boxes = placed.groupBy("arm", "capacity", "container").agg(F.count("*").alias("n"), F.sum("length").alias("used"))
    return boxes.groupBy("arm", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("used")).withColumn("filled", F.col("used") / (F.col("containers") * F.col("capacity")))
