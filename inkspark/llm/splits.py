"""Splits that keep related records together.

Works are tied by shared keys (an author, an ingested text). The ties are reduced to connected components, components are
balanced over many equal bins by largest differencing, and whole bins go to the splits by target share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.notation import fold_accents
from inkspark.operators.graph import components
from inkspark.operators.joins import attach, small
from inkspark.plans.lineage import cut

# What stands for no author, as folded words; words before, after and around a name.
PLACEHOLDERS = ["unknown", "unknown author", "anonymous", "anon", "various", "various authors", "author unknown", "not known", "not given", "none", "null", "nil", "na", "n a", "n d", "s n", "sn", "sine nomine", "unbekannt", "anonym", "verschiedene", "diverse", "inconnu", "anonyme", "divers", "auteurs divers", "desconocido", "anonimo", "varios", "sconosciuto", "autori vari", "vari", "aa vv", "v a", "vv aa", "onbekend", "anoniem", "tbd", "to be determined", "unspecified", "untitled", "no author", "author", "x", "xx", "xxx"]
TITLES = ["dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "sir", "rev", "reverend", "hon", "capt", "captain", "col", "colonel", "gen", "maj", "lt", "herr", "frau", "mme", "mlle", "sra", "sig", "signor", "by", "von", "van", "de", "der", "den", "du", "di", "da", "la", "le", "del", "della", "zu", "ter", "ten"]
TITLES_OR_NAMES = ["miss", "dame", "lord", "lady", "fr", "st", "saint", "general", "major", "don", "dona"]
AFTER_NAMES = ["jr", "sr", "jun", "junior", "senior", "esq", "esquire", "ii", "iii", "iv", "phd", "md", "lld", "editor", "eds", "trans", "translator", "transl", "compiler", "illus", "illustrator", "pseud", "attrib", "et al", "others"]
AFTER_OR_NAMES = ["sen", "ma", "ba", "dd", "ed", "al", "et", "tr", "comp"]

BINS = 120  # equal bins, of which splits get whole ones: shares are met to half a bin, but for a component heavier than one


def author_keys(author: Column) -> Column:
    """Keys of the authors that a free-text field names: family name and first letter of the given name, both folded.

    Several names may be parted by ``;``, ``&``, ``+``, ``/``, ``|``, *and*, *und* or *with*; each may be ``Given M. Family`` or
    ``Family, Given``, with brackets, titles, roles, years and any case or marks. A title or suffix is none where it is all there is
    of a name: John Major, Jack Ma and Don Bell keep theirs. An array, empty for null and placeholders.
    """
    text = F.lower(fold_accents(F.coalesce(author, F.lit(""))))
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N},'’-]+", " "), " "), lambda w: F.length(w) > 0)
    plain = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    no_one = lambda c: (plain(c) == "") | plain(c).isin(PLACEHOLDERS)
    people = F.when(no_one(text), F.array().cast("array<string>")).otherwise(F.split(text, r"[;&+/|\n]|\s(?:and|und|with)\s"))

    any_of = lambda words: "(?:" + "|".join(words) + ")"

    def front(s: Column) -> Column:
        """Without titles before a name: what can only be one goes if a word is left, what may be a name if two are."""
        sure, maybe = f"^(?:{any_of(TITLES)} )+", f"^(?:{any_of(TITLES_OR_NAMES)} )+(?=\\S+ \\S)"
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, sure, ""), maybe, ""), sure, "")

    def back(s: Column) -> Column:
        """Without what follows a name, in the same way; the first word always stays."""
        s = F.regexp_replace(s, f"(?: {any_of(AFTER_NAMES)})+$", "")
        return F.regexp_replace(s, f"^(\\S+ \\S+(?: \\S+)*?)(?: {any_of(AFTER_NAMES + AFTER_OR_NAMES)})+$", "$1")

    def key(person: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(person, r"\([^)]*\)|[\[\]{}<>\"“”]", " "), r"\b(?:c|ca|b|d|fl)?\.?\s*[0-9]{3,4}\??(?:\s*[-–—/]\s*(?:[0-9]{2,4}\??)?)?", " ")
        name = F.array_join(words(F.regexp_replace(bare, r"['’]", "")), " ")
        sides = F.filter(F.transform(F.split(name, ","), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
        first = front(back(F.coalesce(F.try_element_at(sides, F.lit(1)), F.lit(""))))
        rest = F.filter(F.slice(sides, 2, 100), lambda s: ~s.isin(AFTER_NAMES + AFTER_OR_NAMES + TITLES))
        second = front(F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("")))
        family = F.substring_index(first, " ", -1)
        given = F.when(second != "", second).when(first.contains(" "), first).otherwise(F.lit(""))
        return F.when((family != "") & ~no_one(bare), F.concat(family, F.lit("|"), F.substring(given, 1, 1)))

    return F.array_distinct(F.filter(F.transform(people, key), lambda k: k.isNotNull()))


def tie_edges(ties: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b): each node with the least node that has the same key. A star per key, so a key of n nodes gives n edges, not n²; a key
    of many nodes is spread over tasks."""
    t = cut(ties.select(F.col(node).alias("a"), F.col(key).alias("k")).where("a is not null and k is not null").distinct())
    least = t.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n"))
    return attach(t, least, "k", ["a"], "n", t.count()).select("a", "b")


def related_works(catalogue: DataFrame) -> DataFrame:
    """(node, component) of the ebook numbers of a catalogue, tied by authors in any listing and by non-null ingested texts."""
    ebook = F.col("ebook_number")
    authors = catalogue.select(ebook.alias("node"), F.explode(author_keys(F.col("author"))).alias("key")).select("node", F.concat(F.lit("a:"), "key").alias("key"))
    text = F.nullif(F.lower(F.trim("ingested_sha256")), F.lit(""))
    texts = catalogue.select(ebook.alias("node"), F.concat(F.lit("t:"), text).alias("key"))
    alone = catalogue.select(ebook.alias("a"), ebook.alias("b"))
    return components(tie_edges(authors.unionByName(texts), "node", "key").unionByName(alone))


def pairs_within(members: DataFrame, large: int = 256, salts: int = 32) -> DataFrame:
    """(a, b), a < b, of each two nodes of one component; the pairs of a large component are made by ``salts`` tasks."""
    size = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    m = members.join(size, "component")
    left = m.select("component", F.col("node").alias("a"), F.when(F.col("n") > large, F.pmod(F.xxhash64("node"), F.lit(salts))).otherwise(F.lit(0)).cast("int").alias("salt"))
    every = F.when(F.col("n") > large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = m.select("component", F.col("node").alias("b"), F.explode(every).alias("salt"))
    return left.join(right, ["component", "salt"]).where("a < b").select("a", "b")


def difference(tuples: list[list[tuple[float, list]]], bins: int) -> list[tuple[float, list]]:
    """Largest differencing over k-tuples of (weight, members): the two tuples of the widest spread are joined, heaviest to
    lightest, until one is left. Members are opaque; ties go by position, so the result is a function of the order given."""
    heap = []
    for i, t in enumerate(tuples):
        t = sorted(t, key=lambda x: -x[0])
        t += [(0.0, [])] * (bins - len(t))
        heap.append((-(t[0][0] - t[-1][0]), i, t))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        t = sorted(((x[0] + y[0], [*x[1], *y[1]] if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (-(t[0][0] - t[-1][0]), n, t))
        n += 1
    return heap[0][2] if heap else [(0.0, [])] * bins


def balanced_bins(weights: DataFrame, bins: int = BINS, block: int = 8_000, fan: int = 64) -> DataFrame:
    """(component, bin): components in ``bins`` bins of near equal weight.

    Blocks of about ``block`` components are differenced each in a task of its own to a tuple of ``bins`` part bins; the tuples
    of ``fan`` blocks are differenced again, and so on until one is left. So no task ever holds more than a block, or
    ``fan * bins`` sums, and the driver none. A component heavier than a bin fills one alone.
    """
    w = cut(weights.select("component", F.coalesce(F.col("weight"), F.lit(0)).cast("double").alias("weight")))
    blocks = max(1, -(-w.count() // block))
    w = w.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"))
    kind = weights.schema["component"].dataType.simpleString()

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
        t = difference([[(float(x), [c])] for c, x in zip(pdf["component"], pdf["weight"], strict=True)], bins)
        return pd.DataFrame([(c, int(pdf["block"].iloc[0]), i) for i, (_, cs) in enumerate(t) for c in cs], columns=["component", "block", "bin"])

    placed = cut(w.groupBy("block").applyInPandas(first, f"component {kind}, block int, bin int"))
    sums = placed.join(w.select("component", "weight"), "component").groupBy("block", "bin").agg(F.sum("weight").alias("weight"))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "bin"])
        tuples = [[(float(x), [(int(b), int(i))]) for b, i, x in zip(g["block"], g["bin"], g["weight"], strict=True)] for _, g in pdf.groupby("block", sort=True)]
        up = int(pdf["up"].iloc[0])
        t = difference(tuples, bins)
        return pd.DataFrame([(b, k, up, i, x) for i, (x, parts) in enumerate(t) for b, k in parts], columns=["block", "bin", "up", "to", "weight"])

    while blocks > 1:
        step = cut(sums.withColumn("up", F.floor(F.col("block") / fan).cast("int")).groupBy("up").applyInPandas(again, "block int, bin int, up int, to int, weight double"))
        placed = placed.join(step, ["block", "bin"]).select("component", F.col("up").alias("block"), F.col("to").alias("bin"))
        sums = step.select(F.col("up").alias("block"), F.col("to").alias("bin"), "weight").distinct()
        blocks = -(-blocks // fan)
    return placed.select("component", "bin")


def allocate_bins(sums: list[tuple[int, float]], shares: dict[str, float], bins: int | None = None) -> dict[int, str]:
    """Whole bins to splits: the heaviest first, each to the split that lacks most; ties to the larger share, then the name. Bins up to
    ``bins`` that hold nothing are given out too."""
    total, wanted = sum(x for _, x in sums), sum(shares.values())
    lack = {s: total * p / wanted for s, p in shares.items()}
    out = {}
    empty = [(i, 0.0) for i in sorted(set(range(bins or 0)) - {i for i, _ in sums})]
    for i, x in sorted([*sums, *empty], key=lambda y: (-y[1], y[0])):
        s = max(lack, key=lambda k: (lack[k], shares[k], k))
        out[i] = s
        lack[s] -= x
    return out


def split_components(weights: DataFrame, plans: dict[str, dict[str, float]], bins: int = BINS) -> DataFrame:
    """(plan_name, component, split_name) for each plan of target shares. Only the sums of the bins come to the driver."""
    spark = weights.sparkSession
    placed = cut(balanced_bins(weights, bins))
    sums = [(r["bin"], float(r["weight"])) for r in placed.join(weights, "component").groupBy("bin").agg(F.sum("weight").alias("weight")).collect()]
    rows = [(plan, i, s) for plan, shares in sorted(plans.items()) for i, s in sorted(allocate_bins(sums, shares).items())]
    names = spark.createDataFrame(rows, "plan_name string, bin int, split_name string")
    return placed.join(F.broadcast(names), "bin").select("plan_name", "component", "split_name")


def works_of(records: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(ebook, component, n, weight) of all works of the records (kind, record_id, ebook) and of the catalogue.

    The weight of a work is the sum of its parts of each kind of record, so documents and losses count alike. A work that the
    catalogue doesn't have is a component of its own.
    """
    per = cut(records.where("ebook is not null").groupBy("ebook", "kind").agg(F.count("*").alias("n")))
    total = small(per.groupBy("kind").agg(F.sum("n").alias("total")))
    size = per.join(total, "kind").groupBy("ebook").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("total")).alias("weight"))
    works = related_works(catalogue).withColumnRenamed("node", "ebook")
    both = works.join(size, "ebook", "full_outer")
    return cut(both.select("ebook", F.coalesce("component", "ebook").alias("component"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight")))


def assign(works: DataFrame, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Works with the bin of their component, (ebook, component, bin, n), and the weights of the bins: components are balanced over
    ``bins`` bins by largest differencing, so works of one component share a bin."""
    placed = cut(balanced_bins(works.groupBy("component").agg(F.sum("weight").alias("weight")), bins))
    out = cut(works.join(placed, "component"))
    return out.select("ebook", "component", "bin", "n"), out.groupBy("bin").agg(F.sum("weight").alias("weight"))


def place(records: DataFrame, works: DataFrame, sums: DataFrame, plans: dict[str, dict[str, float]], bins: int = BINS) -> DataFrame:
    """(kind, record_id, component, plan_name, split_name) of every record in every plan.

    Records meet their works, a work with many spread over tasks. A record without a number belongs to no work: it is a component
    of its own, named by a negative number, and goes to a bin by its hash.
    """
    rows = [(plan, i, s) for plan, shares in sorted(plans.items()) for i, s in sorted(allocate_bins([(r["bin"], float(r["weight"])) for r in sums.collect()], shares, bins).items())]
    names = F.broadcast(records.sparkSession.createDataFrame(rows, "plan_name string, bin int, split_name string"))  # plans times bins
    total = works.agg(F.sum("n")).first()[0] or 0
    known = attach(records.where("ebook is not null"), works, "ebook", ["record_id"], "n", total).select("kind", "record_id", "component", "bin")
    lone = F.xxhash64("kind", "record_id")
    alone = records.where("ebook is null").select("kind", "record_id", (-1 - F.pmod(lone, F.lit(1 << 62))).alias("component"), F.pmod(lone, F.lit(bins)).cast("int").alias("bin"))
    return known.unionByName(alone).join(names, "bin").select("kind", "record_id", "component", "plan_name", "split_name")


def read_plans(split_plan: DataFrame, most: int = 10_000) -> dict[str, dict[str, float]]:
    """The plans of a plan table; rows without a name or a positive share are none, a repeated split counts once."""
    rows = split_plan.where("plan_name is not null and split_name is not null and target_share > 0").groupBy("plan_name", "split_name").agg(F.max("target_share").alias("p")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} splits are no plan")
    return reduce(lambda d, r: d | {r[0]: d.get(r[0], {}) | {r[1]: float(r[2])}}, rows, {})
