"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded selection of blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.notation import register_of
from inkspark.llm.bytebpe import BYTE_BPE_50K, count_tokens
from inkspark.plans.lineage import cut


def sainte_lague(votes: dict, seats: int, caps: dict) -> dict:
    """Seats by highest quotients votes / (2 seats + 1), none above its cap; ties go to the key first in order.

    Most seats are given at once from the proportional share, less a margin that the quotients surely exceed, so the time grows
    with the number of keys and not of seats.
    """
    keys = sorted(k for k in votes if votes[k] > 0 and caps[k] > 0)
    out = dict.fromkeys(votes, 0)
    left = min(seats, sum(caps[k] for k in keys))
    free = list(keys)
    while free and left > 0:  # whole shares; a key at its cap frees seats for the others
        total = sum(votes[k] for k in free)
        sure = {k: max(0, int((left + sum(out[j] for j in free)) * votes[k] / total) - len(free)) for k in free}
        capped = [k for k in free if sure[k] >= caps[k]]
        if not capped:
            for k in free:
                out[k] = max(out[k], sure[k])
            break
        for k in capped:
            out[k] = caps[k]
        free = [k for k in free if k not in capped]
        left = min(seats, sum(caps[k] for k in keys)) - sum(out.values())
    left = min(seats, sum(caps[k] for k in keys)) - sum(out.values())
    heap = [(-Fraction(votes[k]) / (2 * out[k] + 1), k) for k in keys if out[k] < caps[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-Fraction(votes[k]) / (2 * out[k] + 1), k))
    return out


def plan_mixture(targets: list[tuple[str, float, int]], supply: dict[str, int], blocks: int = 4096, total: int | None = None) -> tuple[int, dict[str, int]]:
    """(tokens of a block, blocks of each register) for targets (register, share, most repeats).

    The total is the largest at which every register that has documents reaches its share within its repeats, or ``total``. A
    register without documents gets nothing, and the others keep their proportions.
    """
    live = [(r, p, m) for r, p, m in targets if p > 0 and m > 0 and supply.get(r, 0) > 0]
    if not live:
        return 1, {}
    whole = sum(p for _, p, _ in live)
    most = min(m * supply[r] * whole / p for r, p, m in live)
    size = max(1, int((most if total is None else total) / blocks))
    seats = int((most if total is None else total) / size)
    caps = {r: int(m * supply[r] / size) + 1 for r, _, m in live}
    return size, sainte_lague({r: p for r, p, _ in live}, seats, caps)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = BYTE_BPE_50K, per_shard: int = 20_000, blocks: int = 4096, total: int | None = None) -> DataFrame:
    """(mixture, doc_id, register, tokens, repeats): the records of each mixture and how often each is used, once or more.

    Sizes are tokens of a public tokenizer. A register is read in any spelling, and off the path where it is missing; documents of
    an unknown register or without tokens are in no mixture, and repeated doc_ids count as the records that they are.
    Documents are dealt into shards by a seeded hash; each shard of a register gets an integer quota of blocks by Sainte-Laguë, so
    no task holds more than a shard, and the driver only sums per register. Within a shard, documents lie on a line of tokens in
    seeded order, cut into blocks; a quota takes all blocks some times over and the first ones once more. A document
    goes with the block of its middle. Repeats never exceed max_repeats.
    """
    d = count_tokens(documents.select("doc_id", "register", "path", "text").where("text is not null"), ["doc_id", "register", "path"], path=path)
    d = d.select("doc_id", register_of(F.col("register"), F.col("path")).alias("register"), "tokens").where("tokens > 0 and register is not null")
    d = cut(d)
    shards = max(1, -(-d.count() // per_shard))
    order = F.xxhash64(F.lit(seed), "doc_id")
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(shards)).cast("int"))
    t = targets.where("mixture is not null and register is not null and target_share > 0").select("mixture", register_of(F.col("register")).alias("register"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = t.groupBy("mixture", "register").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the targets of mixtures are few")
    wanted = {r["register"] for r in rows}
    sums = d.groupBy("register", "shard").agg(F.sum("tokens").alias("supply"))
    supply = {r[0]: int(r[1]) for r in sums.where(F.col("register").isin(sorted(wanted))).groupBy("register").agg(F.sum("supply")).collect()} if wanted else {}
    plans = []
    for name in sorted({r["mixture"] for r in rows}):
        own = sorted((r["register"], float(r["share"]), int(r["most"])) for r in rows if r["mixture"] == name)
        size, quota = plan_mixture(own, supply, blocks, total)
        plans += [(name, r, size, quota[r], m) for r, _, m in own if quota.get(r)]
    spark = documents.sparkSession
    few = spark.createDataFrame(plans, "mixture string, register string, size bigint, seats bigint, most bigint")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        size, seats, most = (int(pdf[c].iloc[0]) for c in ("size", "seats", "most"))
        votes = dict(zip(pdf["shard"].tolist(), pdf["supply"].tolist(), strict=True))
        got = sainte_lague(votes, seats, {s: most * v // size + 1 for s, v in votes.items()})
        return pd.DataFrame([(pdf["mixture"].iloc[0], pdf["register"].iloc[0], s, size, q, votes[s], most) for s, q in got.items()], columns=["mixture", "register", "shard", "size", "quota", "supply", "most"])

    quotas = sums.join(F.broadcast(few), "register").groupBy("mixture", "register").applyInPandas(deal, "mixture string, register string, shard int, size bigint, quota bigint, supply bigint, most bigint")
    line = Window.partitionBy("register", "shard").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = d.withColumn("middle", F.sum("tokens").over(line) - F.col("tokens") / 2)
    full = F.least(F.floor(F.col("quota") * F.col("size") / F.col("supply")), F.col("most"))
    extra = F.round((F.col("quota") * F.col("size") - full * F.col("supply")) / F.col("size"))
    repeats = F.least(full + (F.floor(F.col("middle") / F.col("size")) < extra).cast("bigint"), F.col("most"))
    return placed.join(quotas, ["register", "shard"]).select("mixture", "doc_id", "register", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mixture, register, target_share, reached_share, tokens, records, most_used) with a row for every target; 0 where nothing was got."""
    got = mixed.groupBy("mixture", "register").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_used"))
    t = targets.where("mixture is not null and register is not null").select("mixture", register_of(F.col("register")).alias("register"), "target_share").groupBy("mixture", "register").agg(F.max("target_share").alias("target_share"))
    whole = Window.partitionBy("mixture")
    return t.join(got, ["mixture", "register"], "left").fillna(0, ["tokens", "records", "most_used"]).withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0))).select("mixture", "register", "target_share", "reached_share", "tokens", "records", "most_used")
