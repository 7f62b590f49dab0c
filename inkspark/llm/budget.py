"""Token budgets: exact and estimated tokens per manifest entry, and totals by source, language and register."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.notation import ebook_of, label_language, part_of, register_of
from inkspark.llm.bytebpe import BYTE_BPE_50K, count_tokens


def rate_table(table: DataFrame, rate_col: str = "treatment", most: int = 10_000) -> tuple[dict, dict, dict, float | None]:
    """Characters per token by (register, language), by register, by language and over all: means weighted by documents.

    The table is small and fixed (registers by languages), at most ``most`` combinations. Nulls, NaN and rates that aren't
    positive are none.
    """
    r = F.col(rate_col)
    t = table.where(r.isNotNull() & ~F.isnan(r) & (r > 0)).select(register_of(F.col("register")).alias("register"), label_language(F.col("lang")).alias("lang"), r.alias("r"), F.greatest(F.coalesce("n_documents", F.lit(1)), F.lit(1)).alias("w"))
    rows = t.groupBy("register", "lang").agg(F.sum(F.col("r") * F.col("w")), F.sum("w")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rates")
    sums: list[dict] = [{}, {}, {}, {}]
    for register, lang, x, w in sorted(rows, key=lambda y: (y[0] or "", y[1] or "")):
        for d, k in zip(sums, ((register, lang), register, lang, ""), strict=True):
            a, b = d.get(k, (0.0, 0))
            d[k] = (a + x, b + w)
    cells, by_register, by_lang, overall = ({k: a / b for k, (a, b) in d.items()} for d in sums)
    return {k: v for k, v in cells.items() if None not in k}, by_register, by_lang, overall.get("")


def with_rate(df: DataFrame, table: DataFrame, rate_col: str = "treatment") -> DataFrame:
    """``df`` (register, lang) with ``rate``: that of its register and language, else of the register, else of the language, else of all."""
    cells, by_register, by_lang, overall = rate_table(table, rate_col)

    def look(d: dict, key) -> F.Column:
        items = [x for k, v in d.items() if k is not None for x in (F.lit("\x1f".join(k) if isinstance(k, tuple) else k), F.lit(float(v)))]
        return F.try_element_at(F.create_map(*items), key) if items else F.lit(None).cast("double")

    register, lang = F.coalesce("register", F.lit("")), F.coalesce("lang", F.lit(""))
    return df.withColumn("rate", F.coalesce(look(cells, F.concat_ws("\x1f", register, lang)), look(by_register, register), look(by_lang, lang), F.lit(overall).cast("double")))


def entry_budget(manifest: DataFrame, documents: DataFrame, rate_rows: DataFrame, path: str = BYTE_BPE_50K) -> DataFrame:
    """A row for each manifest entry whose path, however written, names a document with a text.

    (entry_id, doc_id, source, lang, register, char_count, chars, tokens, rate, estimate, best): the document's exact code points and
    tokens under the tokenizer, and the estimate from the entry's char_count and the rate of its register and language, null
    where char_count is. ``best`` marks the one entry that stands for the document in totals: one whose char_count is right if
    there is one, then the latest, then that of the least entry_id. Entries meet documents on the numbers of ebook and
    part; only counts are shuffled, no text. Entries without a document, or of a null text, are left out.
    """
    d = count_tokens(documents.select("doc_id", "path", "source", "lang", "register", "text").where("text is not null and path is not null"), ["doc_id", "path", "source", "lang", "register"], path=path)
    folder = F.nullif(F.lower(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]*$", 1)), F.lit(""))
    d = d.select("doc_id", F.coalesce("source", folder).alias("source"), label_language(F.col("lang")).alias("lang"), register_of(F.col("register"), F.col("path")).alias("register"), "chars", "tokens", ebook_of(F.col("path")).alias("ebook"), part_of(F.col("path")).alias("part"))
    m = manifest.select("entry_id", "char_count", "ingested_at", ebook_of(F.col("path")).alias("ebook"), part_of(F.col("path")).alias("part")).where("ebook is not null and part is not null")
    e = with_rate(m.join(d, ["ebook", "part"]), rate_rows).withColumn("estimate", F.col("char_count") / F.col("rate"))
    first = Window.partitionBy("doc_id").orderBy(F.col("char_count").eqNullSafe(F.col("chars")).desc(), F.col("ingested_at").desc_nulls_last(), F.col("entry_id"))
    return e.withColumn("best", F.row_number().over(first) == 1).select("entry_id", "doc_id", "source", "lang", "register", "char_count", "chars", "tokens", "rate", "estimate", "best")


def wrong_counts(budget: DataFrame) -> DataFrame:
    """(entry_id) of the entries whose char_count is null or isn't the document's number of code points."""
    return budget.where(~F.col("char_count").eqNullSafe(F.col("chars"))).select("entry_id")


def budget_cube(budget: DataFrame) -> DataFrame:
    """(source, lang, register, level, documents, chars, tokens, estimate): totals over the cube, each document counted once.

    ``level`` is the grouping id: a set bit says that source (4), language (2) or register (1) is summed over, so that a null
    with its bit clear is an unknown value. Estimates use the document's exact length where its entry has no char_count.
    """
    once = budget.where("best").withColumn("est", F.coalesce("estimate", F.col("chars") / F.col("rate")))
    return once.cube("source", "lang", "register").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.sum("est").alias("estimate"))
