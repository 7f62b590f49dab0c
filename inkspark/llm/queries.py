"""The queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions.notation import ebook_of, label_language, part_of
from inkspark.llm import budget, bytebpe, language, leakage, mixing, packing, splits


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (kind, record_id, ebook), works with their bins, and the weights of the bins."""
    docs = _table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("record_id"), F.coalesce(ebook_of(F.col("path")), ebook_of(F.col("source"))).alias("ebook"))
    loss = _table(spark, d, "paired_loss").select(F.lit("loss").alias("kind"), F.col("loss_id").alias("record_id"), F.coalesce(ebook_of(F.col("cluster_name")), ebook_of(F.col("path"))).alias("ebook")).where("record_id is not null")
    records = docs.unionByName(loss.dropDuplicates(["record_id"]))
    return records, *splits.assign(splits.works_of(records, _table(spark, d, "catalogue")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of catalogued works that the assignment keeps together: of one component, and so in one bin and one split."""
    _, works, _ = _p1(spark, d)
    listed = _table(spark, d, "catalogue").select(F.col("ebook_number").alias("ebook")).distinct()
    members = works.join(listed, "ebook", "left_semi").select(F.col("ebook").alias("node"), "component")
    return splits.pairs_within(members).select(F.col("a").alias("ebook_a"), F.col("b").alias("ebook_b"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every document and loss in every plan."""
    return splits.place(*_p1(spark, d), splits.read_plans(_table(spark, d, "split_plan")))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """The records and the share that each split of each plan reaches, by kind."""
    n = p1_splits(spark, d).groupBy("plan_name", "kind", "split_name").agg(F.count("*").alias("records"))
    return n.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy("plan_name", "kind")))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "results_arms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "documents").select("doc_id", F.char_length("text").alias("length"))
    placed = packing.pack(items, _arms(spark, d))
    return placed.groupBy("arm", "doc_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("arm", "doc_id")


def _p2_placed(spark: SparkSession, d: str, limits: packing.Limits = packing.Limits()) -> DataFrame:
    key = [ebook_of(F.col("path")).alias("ebook"), part_of(F.col("path")).alias("part")]
    docs = _table(spark, d, "documents").select(*key, "doc_id", F.char_length("text").alias("length")).where("length is not null")
    listed = _table(spark, d, "corpus_manifest").select(*key).where("ebook is not null and part is not null").distinct()
    return packing.pack(docs.join(listed, ["ebook", "part"], "left_semi").select("doc_id", "length"), _arms(spark, d), limits=limits)


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    whole = Window.partitionBy("arm", "container")
    return _p2_placed(spark, d).withColumn("fill", F.sum("length").over(whole) / F.col("capacity")).drop("capacity")


def p2_fill(spark: SparkSession, d: str) -> DataFrame:
    reported = _arms(spark, d).groupBy("arm").agg(F.max("packed_identifiers").alias("packed_identifiers"))
    return packing.fill(_p2_placed(spark, d)).join(reported, "arm", "left").select("arm", "capacity", "containers", "pieces", "used", "filled", "packed_identifiers")


def _p2_limited(spark: SparkSession, d: str) -> DataFrame:
    """Containers under limits that bind: at most 12 items, and an attention cost of half that of one full item, by either score. An
    item whose cost is above the limit has a container alone."""
    out = []
    for score in ("norm", "dot"):
        limits = packing.Limits(documents=12, attention=0.5, weights=(1.0, 0.5, 0.5), score=score)
        placed = _p2_placed(spark, d, limits)
        cost = F.sum(F.col("length").cast("double") ** 2) / (limits.attention * F.col("capacity").cast("double") ** 2)
        box = placed.groupBy("arm", "capacity", "container").agg(F.count("*").alias("n"), F.sum("length").alias("used"), cost.alias("cost"))
        g = box.groupBy("arm", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("used"), F.max("n").alias("most_items"), F.max("used").alias("most_used"), F.max(F.when(F.col("n") > 1, F.col("cost"))).alias("most_cost"))
        out.append(g.select(F.lit(score).alias("score"), "*"))
    return reduce(DataFrame.unionByName, out)


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether every container held its limits of length, items and attention cost, and whether all was placed."""
    held = (F.col("most_items") <= 12) & (F.col("most_used") <= F.col("capacity")) & (F.coalesce("most_cost", F.lit(0.0)) <= 1 + 1e-9)
    return _p2_limited(spark, d).select("score", "arm", "capacity", "pieces", "used", held.alias("held"))


def p2_limit_use(spark: SparkSession, d: str) -> DataFrame:
    """How far the limits were used: the greatest item count, the greatest part of the cost in a container of several items, the fill."""
    return _p2_limited(spark, d).select("score", "arm", "containers", "most_items", "most_cost", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("filled"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_table(spark, d, "documents"), _table(spark, d, "minimal_pairs")).select("doc_id", "pair_identifier")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which tiles cover four fifths of an item's words in any order: reordered passages beside those in order."""
    return leakage.covered(_table(spark, d, "documents"), _table(spark, d, "minimal_pairs"))


def p3_screen(spark: SparkSession, d: str) -> DataFrame:
    """A screen's report at passages of ngram_words words, as earlier screens give it, for the lengths they used and 12."""
    docs, items = _table(spark, d, "documents"), _table(spark, d, "minimal_pairs")
    rows = []
    for words in (8, 12, 13):
        hit = leakage.leaked(docs, items, words=words)
        rows.append(hit.agg(F.lit(words).cast("bigint").alias("ngram_words"), F.count_distinct("pair_identifier").alias("pairs_flagged"), F.count_distinct("doc_id").alias("documents_flagged")))
    report = reduce(DataFrame.unionByName, rows)
    screened, pairs = docs.where("text is not null").agg(F.count("*").alias("corpus_documents_screened")), items.agg(F.count_distinct("pair_identifier").alias("pairs"))
    return report.join(F.broadcast(screened), F.lit(True)).join(F.broadcast(pairs), F.lit(True)).select("ngram_words", "corpus_documents_screened", "pairs_flagged", (F.col("pairs_flagged") / F.col("pairs")).alias("fraction_flagged"), "documents_flagged")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return budget.entry_budget(_table(spark, d, "corpus_manifest"), _table(spark, d, "documents"), _table(spark, d, "results_characters_per_identifier"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return budget.wrong_counts(_p4(spark, d))


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.budget_cube(_p4(spark, d))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytebpe.encode_corpus(_table(spark, d, "documents"))


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mixture_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _table(spark, d, "mixture_targets")
    return mixing.shares_reached(mixing.mix(_table(spark, d, "documents"), targets), targets)


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return language.languages_of(_table(spark, d, "documents"), _table(spark, d, "lang_samples"), label_col="lang")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    named = label_language(F.col("label"))
    return _p7(spark, d).where(F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(named)).select("doc_id", "lang").distinct()


def p7_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p2_found, p2_containers, p2_fill, p2_limits, p2_limit_use, p3_found, p3_coverage, p3_screen, p4_found, p4_entries, p4_totals, p5_ids, p6_mix, p6_shares, p7_found, p7_stretches)}


_EBOOK = "regexp_extract(lower({0}), 'pg[^0-9a-z]*0*([0-9]+)', 1)"
_PART = "regexp_extract(lower({0}), 'part[^0-9a-z]*0*([0-9]+)', 1)"
_KEYS = f"{_EBOOK} AS ebook, {_PART} AS part"
_ITEMS = f"m AS (SELECT DISTINCT {_KEYS.format('path')} FROM corpus_manifest), dk AS (SELECT length(text) AS n, {_KEYS.format('path')} FROM documents WHERE text IS NOT NULL), it AS (SELECT n FROM dk WHERE ebook <> '' AND part <> '' AND EXISTS (SELECT 1 FROM m WHERE m.ebook = dk.ebook AND m.part = dk.part))"
ORACLES = {
    "p2_limits": f"WITH {_ITEMS}, a AS (SELECT DISTINCT arm, capacity_chars AS capacity FROM results_arms WHERE arm IS NOT NULL AND capacity_chars >= 1) SELECT score, arm, capacity, sum(greatest(1, ceil(n / capacity)))::BIGINT AS pieces, sum(n)::BIGINT AS used, true AS held FROM it, a, (SELECT unnest(['norm', 'dot']) AS score) GROUP BY ALL",
    "p2_found": "SELECT DISTINCT arm, doc_id FROM documents, results_arms WHERE length(text) > capacity_chars AND arm IS NOT NULL",
    "p4_found": f"SELECT m.entry_id FROM (SELECT entry_id, char_count, {_KEYS.format('path')} FROM corpus_manifest) m JOIN (SELECT text, {_KEYS.format('path')} FROM documents WHERE text IS NOT NULL) d ON m.ebook = d.ebook AND m.part = d.part WHERE m.ebook <> '' AND m.part <> '' AND m.char_count IS DISTINCT FROM length(d.text)",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express over whole tables; the others are checked by brute force in the tests."""
    return dict(ORACLES)
