"""Ranking of many long queries at once: exact, and done once a query."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.bindings import QUERIES
from inkspark.functions import text as T
from inkspark.operators import retrieval as R

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("blocks", [{}, {"block": 200}, {"most_queries": 3}])
def test_bm25_of_long_queries_with_ties_is_that_of_the_formula(spark, blocks):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(400)], k=r.randrange(0, 120))) for i in range(300)}
    texts |= {i + 300: texts[i % 40] for i in range(120)}  # more copies of a text than places
    df = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(3)
    words = T.words(F.col("text"))
    got = {(x["query"], x["rank"]): (x["chunk"], x["score"], x["matched"]) for x in R.bm25(R.lexical_index(df, "id", words), df.where("id % 30 = 0"), "id", words, **blocks).collect()}
    tf = {i: Counter(t.split()) for i, t in texts.items()}
    n, avg, df_ = len(tf), sum(map(len, tf.values())) / len(tf), Counter(t for c in tf.values() for t in c)
    want = {}
    for q in range(0, 420, 30):
        scores = []
        for i, c in tf.items():
            both = set(tf[q]) & set(c)
            s = sum(math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(c) / avg)) for t in both)
            scores += [(-round(s, 6), i, len(both))] if both else []
        want |= {(q, k + 1): (i, -s, m) for k, (s, i, m) in enumerate(sorted(scores)[:5])}
    assert got.keys() == want.keys()
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert [got[k][1] for k in want] == pytest.approx([v[1] for v in want.values()], abs=2e-6)


def test_bm25_without_queries_or_chunks(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "")], "id int, text string")
    words = T.words(F.col("text"))
    idx = R.lexical_index(df, "id", words)
    assert R.bm25(idx, df.where("id = 2"), "id", words).collect() == []
    assert R.bm25(R.lexical_index(df.limit(0), "id", words), df, "id", words).collect() == []
    assert [tuple(x)[:3] for x in R.bm25(idx, df.where("id = 1"), "id", words).collect()] == [(1, 1, 1)]


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["citations_validate", "ground_structural", "agg_citation_metrics", "reassess", "agg_correction_bench", "refs_unresolved_count"])
def test_documents_are_ranked_once(spark, name):
    """What comes after the ranking reads it from a table, however often."""
    plan = QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "term" not in plan and "documents" not in plan


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
def test_a_record_of_corrections_ranks_once(spark, monkeypatch):
    from inkspark.bindings import rules

    plans, cut = [], rules.cut
    monkeypatch.setattr(rules, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    QUERIES["correction_record"](spark, D)
    assert plans and not any("term" in p or "documents" in p for p in plans)


@pytest.mark.parametrize("name", ["ground_structural", "agg_citation_metrics", "reassess", "agg_correction_bench", "correction_record", "refs_unresolved_count"])
def test_the_queries_of_1_gb_take_one_pass(spark, monkeypatch, name):
    """1.2 million query terms (those of 1 GB of documents are 1.6 million) go to the chunks at once, and nothing is missed."""
    from inkspark.bindings import retrieval

    long = spark.range(100, 400, 100).select(F.col("id").alias("doc_id"), F.expr("concat('same ', array_join(transform(sequence(1, 400000), i -> concat('v', id, '_', i)), ' '))").alias("text"))
    monkeypatch.setattr(retrieval, "_docs", lambda spark, d: long)
    passes, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: passes.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or cut(df))
    df = QUERIES[name](spark, "")
    assert max(passes) == 1 and df.count() > 0


def test_queries_in_groups_have_the_best_chunks_of_all():
    r = np.random.default_rng(5)
    n, rows, v, k = 1500, 700, 300, 5
    topic = lambda size: (r.integers(0, 3, size)[:, None] * 80 + r.integers(0, 120, (size, 20))) % v
    held = [np.unique(np.repeat(np.arange(size), 20) * v + topic(size).reshape(-1)) for size in (n, rows)]
    (query, term), (row, of) = (np.divmod(h, v) for h in held)
    idf, weight = r.uniform(0.1, 6, v), r.uniform(0.3, 2.2, len(row))
    common = np.arange(0, v, 2)
    matrix = np.zeros((n, v))
    matrix[query, term] = idf[term]
    group = R._alike(matrix[:, common].astype(np.float32))
    order = np.argsort(group, kind="stable")
    groups = np.unique(np.r_[np.searchsorted(group[order], np.arange(group.max() + 1)), n])
    assert len(groups) > 2
    best = R._Best(R._Terms(np.argsort(order)[query], term, idf, common, n, groups), k)
    for a, b in ((0, 300), (300, rows)):
        part = (row >= a) & (row < b)
        best.add(np.arange(a, b), row[part] - a, of[part], weight[part])
    q, ids, score, matched = best.best()
    x = np.zeros((rows, v))
    x[row, of] = weight
    want = np.round(matrix @ x.T, 6)
    at = np.lexsort((np.broadcast_to(np.arange(rows), want.shape), -want), axis=1)[:, :k]
    assert {(order[a], b): (c, d) for a, b, c, d in zip(q, ids, score.round(5), matched, strict=True)} == {(a, b): (want[a, b].round(5), ((matrix[a] > 0) & (x[b] > 0)).sum()) for a in range(n) for b in at[a] if want[a, b] > 0}


def test_runs_of_folded_texts_are_their_words(spark):
    """Bytes tell the words that a match a word tells, whatever characters and rows are next to each other."""
    from inkspark.functions.runs import runs, word_characters

    r = random.Random(7)
    odd = ["", " ", "..a", "a..", "𝒜x𝟙 ß ẞ İstanbul ΣΑΣ ſ ﬁ éx _a_ ½ Ⅷ 中文 \0z \U0010ffff� q‍r ét", "é", "é", "\n\na b\r\nc", "中", "", "𝟙"]
    odd += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in odd], "text string").select(T.folded(F.col("text")).alias("f"), T.words(F.col("text")).alias("w")).toArrow()
    table = np.unpackbits(word_characters(spark)).astype(bool)
    for part in (df, df.slice(3), df.slice(5, 0)):
        part = part.combine_chunks()
        n, words = runs(part.column(0).combine_chunks(), table)
        want = part.column(1).to_pylist()
        assert n.tolist() == [len(w) for w in want] and words.to_pylist() == [t for w in want for t in w]


def test_the_index_of_texts_is_that_of_their_words_and_reads_them_once(spark, monkeypatch):
    texts = [(1, "Red fox, red dog"), (2, ""), (3, None), (4, "Straße é 𝟙 straße"), (None, "lost"), (5, "red")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda x: plans.append(x._jdf.queryExecution().optimizedPlan().toString()) or cut(x))
    a = R.lexical_index(df, "id", T.folded(F.col("text")))
    assert sum("LogicalRDD" in p or "text" in p for p in plans) == 1  # the texts are read by the first table only
    b = R.lexical_index(df, "id", T.words(F.col("text")))
    rows = lambda i: (sorted((r["chunk"], sorted(zip(r["terms"], r["tf"], strict=True))) for r in i.chunks.collect()), sorted(map(tuple, i.terms.collect())), tuple(i.size.first()))
    assert rows(a) == rows(b)
    assert rows(a) == ([(1, [("dog", 1), ("fox", 1), ("red", 2)]), (2, []), (3, []), (4, [("strasse", 2), ("é", 1), ("𝟙", 1)]), (5, [("red", 1)])], [("dog", 1), ("fox", 1), ("red", 2), ("strasse", 1), ("é", 1), ("𝟙", 1)], (5, 7 / 5))


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["agg_citation_metrics", "reassess", "agg_correction_bench", "correction_record", "refs_unresolved_count"])
def test_documents_are_indexed_without_a_match_a_word(spark, monkeypatch, name):
    """Words of all documents are told from bytes, in the pass that counts them; lists of words are made for the queries alone."""
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    QUERIES[name](spark, D)
    assert len(plans) >= 3 and "regexp_extract_all" not in plans[0] and "array_distinct" not in plans[1]


def test_the_index_is_packed_in_blocks_and_gives_back_every_chunk(spark):
    """No row of its table holds a word of a text; counts above 255, more than 65,536 terms and ids of text are kept."""
    texts = {f"c{i}": " ".join(f"w{i}_{j % (10 + i)}" for j in range(i % 7)) for i in range(2500)} | {"many": " ".join(f"v{j}" for j in range(70_000)), "often": "red " * 300 + "fox", "none": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(2)
    idx = R.lexical_index(df, "id", T.folded(F.col("text")))
    assert [f.dataType.simpleString() for f in idx.packed.schema] == ["binary"] and idx.packed.count() < 10
    got = {r["chunk"]: dict(zip(r["terms"], r["tf"], strict=True)) for r in idx.chunks.collect()}
    assert got == {k: dict(Counter(t.split())) for k, t in texts.items()}
    assert sorted(r["chunk"] for r in idx.where(lambda ids: np.isin(ids.to_pylist(), ["often", "none"])).collect()) == ["none", "often"]
    some = df.where("id in ('often', 'c6')")
    for sources in (None, df.select(F.col("id").alias("chunk")).where("id <> 'c13'")):
        best = R.bm25(idx, some, "id", T.words(F.col("text")), sources=sources).collect()
        assert [(r["query"], r["chunk"], r["matched"]) for r in sorted(best)] == [("c6", "c6", 6), ("often", "often", 2)]


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["reassess", "agg_correction_bench", "correction_record", "refs_unresolved_count"])
def test_documents_are_read_once_for_index_and_queries(spark, monkeypatch, name):
    """The queries' terms are those of the index, and the ranking reads its blocks in a few tasks, which keep their floors."""
    plans, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    QUERIES[name](spark, D)
    assert [("text#" in p, "regexp_extract_all" in p) for p in plans] == [(True, False)] + [(False, False)] * (len(plans) - 1)
    assert "held#" in plans[-1] and "terms#" not in plans[-1]
