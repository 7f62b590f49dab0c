import random
from collections import defaultdict
from fractions import Fraction

import pytest

from inkspark.llm import budget as B
from inkspark.llm import mixing as M


def test_seats_are_those_of_the_plain_rule():
    rng = random.Random(1)
    for _ in range(60):
        votes = {f"k{i}": rng.choice([rng.random(), rng.randint(1, 9), 0]) for i in range(rng.randint(1, 7))}
        caps = {k: rng.choice([0, 1, 5, 30, 1000]) for k in votes}
        seats = rng.choice([0, 1, 7, 40, 300])
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            open_ = [k for k in sorted(votes) if votes[k] > 0 and want[k] < caps[k]]
            if not open_:
                break
            want[max(open_, key=lambda k: (Fraction(votes[k]) / (2 * want[k] + 1), [-ord(c) for c in k]))] += 1
        assert M.sainte_lague(votes, seats, caps) == want


def docs(spark, rows):
    return spark.createDataFrame([(i, t, r, p, 0) for i, t, r, p in rows], "doc_id bigint, text string, register string, path string, tokens int")


def test_shares_are_reached_within_the_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(5, 60), "prose", f"prose-pg1/part-{i}.md") for i in range(600)]
    rows += [(1000 + i, "word " * rng.randint(5, 60), rng.choice([" VERSE", "verse", None]), f"verse-pg2/part-{i}.md") for i in range(120)]
    rows += [(5000, None, "prose", "prose-pg1/a"), (5001, "", "prose", "prose-pg1/b"), (5002, "words", None, "nowhere")]
    t = spark.createDataFrame([("m", "prose", 0.5, 2), ("m", "verse", 0.4, 3), ("m", "drama", 0.1, 3), ("n", "verse", 1.0, 4), (None, "verse", 1.0, 1), ("m", "letters", None, 1)], "mixture string, register string, target_share double, max_repeats bigint")
    mixed = M.mix(docs(spark, rows), t, per_shard=100).cache()
    caps = {("m", "prose"): 2, ("m", "verse"): 3, ("n", "verse"): 4}
    for r in mixed.collect():
        assert 1 <= r["repeats"] <= caps[r["mixture"], r["register"]] and r["doc_id"] < 5000
    got = {(r["mixture"], r["register"]): r for r in M.shares_reached(mixed, t).collect()}
    assert abs(got["m", "prose"]["reached_share"] - 5 / 9) < 0.02 and abs(got["m", "verse"]["reached_share"] - 4 / 9) < 0.02
    assert got["m", "drama"]["tokens"] == 0 and got["n", "verse"]["reached_share"] == 1
    again = {tuple(r) for r in M.mix(docs(spark, rows), t, per_shard=100).collect()}
    assert again == {tuple(r) for r in mixed.collect()}
    assert {tuple(r) for r in M.mix(docs(spark, rows), t, seed=8, per_shard=100).collect()} != again


def test_empty_mixtures(spark):
    t = spark.createDataFrame([("m", "prose", 0.5, 2)], "mixture string, register string, target_share double, max_repeats bigint")
    assert M.mix(docs(spark, []), t).collect() == []
    assert M.mix(docs(spark, [(1, "a b", "prose", "prose-pg1/part-1.md")]), t.limit(0)).collect() == []


def test_entries_meet_documents_however_written(spark):
    d = spark.createDataFrame(
        [(1, "prose-pg12/part-0003.md", "prose-pg12", "en", "prose", "Hello world", 9), (2, "verse-pg7/part-10000.md", None, "de-AT", None, "é" * 4, 9), (3, "prose-pg12/part-0004.md", "prose-pg12", "en", "prose", None, 9)],
        "doc_id bigint, path string, source string, lang string, register string, text string, tokens int",
    )
    m = spark.createDataFrame(
        [(1, "data/x-v3/prose-pg12/part-0003.md", 11), (2, "PROSE-PG12\\PART-0003.MD", None), (3, "./pg12/part-0003.md", 12), (4, "pg7/part-10000.md", 4), (5, "prose-pg12/part-0004.md", 3), (6, "prose-pg99/part-0001.md", 3), (7, None, 3), (7, "pg12/part-3.md", 11)],
        "entry_id bigint, path string, char_count bigint",
    ).selectExpr("*", "timestamp '2026-01-01' as ingested_at", "'x' as lang")
    rates = spark.createDataFrame([("prose", "en", 2.0, 10), ("prose", "de", 3.0, None), ("verse", "de", None, 5), (None, None, float("nan"), 5)], "register string, lang string, treatment double, n_documents bigint")
    b = B.entry_budget(m, d, rates)
    rows = b.collect()
    assert sorted(r["entry_id"] for r in rows) == [1, 2, 3, 4, 7]
    by = {r["entry_id"]: r for r in rows}
    assert by[1]["tokens"] == 2 and by[1]["estimate"] == 5.5 and by[2]["estimate"] is None
    assert by[4]["chars"] == 4 and by[4]["rate"] == 3.0 and by[4]["source"] == "verse-pg7" and by[4]["register"] == "verse"
    assert {r["entry_id"] for r in rows if r["best"]} == {1, 4}
    assert sorted(r[0] for r in B.wrong_counts(b).collect()) == [2, 3]
    cube = {(r["source"], r["lang"], r["register"], r["level"]): r["documents"] for r in B.budget_cube(b).collect()}
    assert cube[None, None, None, 7] == 2 and cube["prose-pg12", "en", "prose", 0] == 1
    assert B.entry_budget(m.limit(0), d, rates).collect() == []
    none = B.entry_budget(m, d, rates.limit(0)).collect()
    assert none and all(r["estimate"] is None for r in none)


@pytest.mark.parametrize("label,lang", [("en", "en"), (" EN ", "en"), ("en_US", "en"), ("fr-CA", "fr"), ("français", "fr"), ("Deutsch", "de"), ("ger", "de"), ("nl-BE", "nl"), ("español", "es"), ("castellano", "es"), ("it_IT.UTF-8", "it"), ("English (US)", "en"), ("mul", None), ("und", None), ("??", None), ("", None), (None, None), ("en, de", None), ("en/de", None), ("xx", None), ("n/a", None), ("Dutch; Flemish", "nl")])
def test_labels(spark, label, lang):
    from pyspark.sql import functions as F

    from inkspark.functions.notation import label_language

    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(label_language(F.col("l"))).first()[0] == lang
