import random
from collections import defaultdict

import numpy as np
import pytest

from inkspark.llm import packing as P


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_limit_holds_and_little_is_unused(score):
    rng = random.Random(5)
    sizes = np.array(sorted((rng.randint(0, 4000) for _ in range(2000)), reverse=True))
    for limits in (P.Limits(score=score), P.Limits(documents=3, score=score), P.Limits(attention=0.4, score=score)):
        b = P.best_fit(sizes, 4096, limits)
        used, count = np.bincount(b, sizes), np.bincount(b)
        cost = np.bincount(b, sizes.astype(float) ** 2)
        assert used.max() <= 4096 and count.max() <= limits.documents
        assert all(n == 1 for c, n in zip(cost, count, strict=True) if c > limits.attention * 4096**2 * (1 + 1e-9))
        assert sorted(set(b.tolist())) == list(range(b.max() + 1))
    b = P.best_fit(sizes, 4096, P.Limits(score=score))
    assert sizes.sum() / 4096 / (b.max() + 1) > 0.9


def test_best_fit_takes_the_fullest():
    assert P.best_fit(np.array([60, 50, 40, 35]), 100).tolist() == [0, 1, 0, 1]
    assert P.best_fit(np.array([], int), 100).tolist() == []
    assert P.best_fit(np.array([100, 100, 0, 0]), 100).tolist() == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        P.Limits(documents=0)


def test_best_fit_needs_no_more_than_first_fit():
    rng = random.Random(9)
    for _ in range(20):
        sizes = [rng.randint(1, 700) for _ in range(400)]
        first: list[int] = []
        for n in sizes:
            k = next((k for k, used in enumerate(first) if used + n <= 1000), None)
            if k is None:
                first.append(n)
            else:
                first[k] += n
        assert P.best_fit(np.array(sizes), 1000).max() + 1 <= len(first) + 1
        assert P.best_fit(np.array(sorted(sizes, reverse=True)), 1000).max() + 1 <= len(first)


def pieces(spark, rows, arms, **how):
    items = spark.createDataFrame(rows, "doc_id bigint, length bigint, container string")
    return P.pack(items, spark.createDataFrame(arms, "arm string, capacity_chars bigint, doc_id int"), **how).collect()


def test_pieces_make_the_items_and_only_long_ones_are_cut(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 99, 100, 101, 200, 250, rng.randint(0, 400)]), "x") for i in range(500)] + [(1000, None, "x"), (None, 5, "x"), (3, 7, "dup")]
    arms = [("s", 100, 0), ("s", 100, 1), ("l", 250, 0), (None, 100, 0), ("z", None, 0)]
    got = pieces(spark, rows, arms, block=64)
    want = {}
    for i, n, _ in rows:
        if i is not None and n is not None:
            want[i] = max(n, want.get(i, 0))
    for arm, cap in (("s", 100), ("l", 250)):
        own = [r for r in got if r["arm"] == arm]
        per, fill = defaultdict(list), defaultdict(int)
        for r in own:
            per[r["doc_id"]].append((r["start"], r["length"]))
            fill[r["container"]] += r["length"]
        assert set(per) == set(want)
        for i, ps in per.items():
            assert sum(n for _, n in ps) == want[i] and (len(ps) == 1) == (want[i] <= cap)
            at = 0
            for s, n in sorted(ps):
                assert s == at
                at += n
        assert max(fill.values()) <= cap
    filled = P.fill(spark.createDataFrame(got)).collect()
    assert {r["arm"] for r in filled} == {"s", "l"} and all(r["filled"] > 0.75 for r in filled)


def test_empty_and_contradicting_tables(spark):
    assert pieces(spark, [], [("s", 100, 0)]) == []
    with pytest.raises(ValueError):
        pieces(spark, [(1, 5, "x")], [("s", 100, 0), ("s", 200, 0)])
