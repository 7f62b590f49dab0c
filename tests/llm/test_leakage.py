import random

import numpy as np
import pytest

from inkspark.llm import cleaning as C
from inkspark.llm import leakage as L

GOOD = "Both the warm surgeon and the fresh ward delayed this plain governess, while neither distant miller opened that heavy door before the second bell"
BAD = GOOD.replace("opened that", "that opened")
OTHER = "Cuando el cajón ajeno dormía en el camino claro, entonces el cuaderno tranquilo medía también el reloj perdido"
W = GOOD.replace(",", "").split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def brute(item, text):
    for i in range(len(item)):
        for n in range(12, len(item) - i + 1):
            for s in (k for k, x in enumerate(text) if x == item[i]):
                for e in (k for k, x in enumerate(text) if k > s and x == item[i + n - 1]):
                    if abs(e - s + 1 - n) <= n // 6 and edits(item[i + 1 : i + n - 1], text[s + 1 : e]) <= n // 6:
                        return True
    return False


def test_passage_check_is_that_of_all_windows():
    rng = random.Random(4)
    seen = set()
    for _ in range(400):
        item = [rng.randrange(12) + 1 for _ in range(rng.randint(8, 34))]
        at = rng.randrange(len(item))
        part = item[at : at + rng.randint(9, 26)]
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(part) + 1)
            part = rng.choice([part[:i] + [99] + part[i:], part[:i] + part[i + 1 :], part[:i] + [98] + part[i + 1 :]])
        text = [rng.randrange(40) + 1 for _ in range(5)] + part + [rng.randrange(40) + 1 for _ in range(5)]
        want = brute(item, text)
        seen.add(want)
        assert L.holds_passage(np.array(item), np.array(text)) == want
    assert seen == {True, False}


def test_tiles_are_common_runs_that_do_not_overlap():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in "ab")
        used_a, used_b = set(), set()
        for i, j, n in L.tiles(a, b):
            assert n >= 2 and a[i : i + n] == b[j : j + n]
            assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
        left_a = [x if i not in used_a else -1 for i, x in enumerate(a)]
        left_b = [x if i not in used_b else -2 for i, x in enumerate(b)]
        assert not {tuple(left_a[i : i + 2]) for i in range(len(a) - 1)} & {tuple(left_b[i : i + 2]) for i in range(len(b) - 1)} - {(-1, -1)}
    swapped = L.tiles([1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3])
    assert sorted(swapped) == [(0, 3, 3), (3, 0, 3)]


def hyphenate(words):
    return " ".join(w[:3] + "-\n" + w[3:] if len(w) > 5 else w for w in words)


CASES = {
    "plain": " ".join(W[3:16]),
    "capitals": GOOD.upper(),
    "hyphens": hyphenate(W[2:18]),
    "soft": " ".join(w[:2] + "­" + w[2:] for w in W[:14]),
    "zero width": " ".join(w[:2] + "​" + w[2:] for w in W[:14]),
    "marked": " ".join(["**%s**", "_%s_", "<i>%s</i>", "`%s`", "%s[3]"][i % 5] % w for i, w in enumerate(W[:16])),
    "quoted": "> " + "\n> ".join(" ".join(W[i : i + 4]) for i in range(0, 16, 4)),
    "scanned": " ".join(w.replace("o", "0").replace("l", "1") for w in W[:16]),
    "page numbers": " ".join([*W[:5], "213", *W[5:10], "| 7 |", *W[10:14]]),
    "two edits": " ".join([*W[:4], "somewhat", *W[4:8], *W[9:13]]),
    "bad text": BAD,
    "dashes": " — ".join(W[:13]),
}
NO_CASES = {
    "eleven words": " ".join(W[:11]),
    "shuffled": " ".join(random.Random(1).sample(W, len(W))),
    "phrases reversed": " ".join(" ".join(W[i : i + 4]) for i in range(20, -1, -4)),
    "three edits in twelve": " ".join([*W[:3], "x", *W[4:6], "y", *W[7:9], "z", *W[10:12]]),
    "mention": "as in item mp-1, see there",
    "empty": "",
}


def test_cases_and_no_cases(spark):
    filler = "The river moved past the mill and nobody there believed that it would ever rest again. "
    texts = [(n, filler + t + ". " + filler) for n, t in (CASES | NO_CASES).items()] + [("null", None), ("spanish", "x " + OTHER.encode().decode("cp1252", "replace").replace("�", "\x8d") + " y"), ("bare spanish", OTHER.replace("ó", "o").replace("í", "i").replace("é", "e")), ("long", filler * 3000 + GOOD + filler * 3000), ("plain", filler + CASES["plain"])]
    docs = spark.createDataFrame([(n, t, "clash") for n, t in texts], "doc_id string, text string, pair_identifier string")
    items = spark.createDataFrame([("a", GOOD, BAD, 0), ("a", GOOD, BAD, 0), ("b", OTHER, None, 0), (None, GOOD, BAD, 0), ("c", "too short", None, 0), ("d", None, None, 0)], "pair_identifier string, good string, bad string, tile_words int")
    got = {(r[0], r[1]) for r in L.leaked(docs, items).collect()}
    assert got == {(n, "a") for n in CASES} | {("long", "a"), ("spanish", "b"), ("bare spanish", "b")}
    assert {(r[0], r[1]) for r in L.leaked(docs, items, block=1).collect()} == got
    assert L.leaked(docs.limit(0), items).collect() == [] and L.leaked(docs, items.limit(0)).collect() == []


def test_letters_are_told_apart():
    assert len({L.fold(w) for w in ("cat", "eat", "car", "ear", "lid", "lld")}) == 6
    assert L.fold("c10ck") == "clock" and L.fold("1914") == "1914" and L.fold("GR0SS5") == "grosss"


def test_numbers_of_an_item_are_its_words():
    item = "in the spring of 1914 the old captain sold his boat and house"
    index = L.Items([("n", [item])])
    texts = [item, item.replace("1914", "1915"), item.replace("1914 ", ""), "x " + item.replace("captain", "captain 88"), " ".join(item.split()[2:])]
    assert [(d, k) for d, k, _ in index.screen(texts)] == [(0, 0), (1, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize(("words", "per"), [(12, 6), (12, 3), (8, 2), (10, 10), (5, 7)])
def test_no_passage_lacks_a_seed(words, per):
    """The screen finds what the check of all windows finds, for any length and rate of edits."""
    rng = random.Random(words * 100 + per)
    names = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    seen = set()
    for _ in range(150):
        item = rng.sample(names, rng.randint(words, words + 14))
        at = rng.randrange(len(item) - words + 1)
        part = item[at : at + rng.randint(words - 1, words + 8)]
        for _ in range(rng.randint(0, len(part) // per + 1)):
            i = rng.randrange(len(part) + 1)
            part = rng.choice([part[:i] + ["other"] + part[i:], part[:i] + part[i + 1 :], part[:i] + ["else"] + part[i + 1 :]])
        text = [*rng.sample(names, 6), *part, *rng.sample(names, 6)]
        index = L.Items([("i", [" ".join(item)])], words, per)
        ids = [index.ids.get(w, 0) for w in text]
        want = L.holds_passage(index.sides[0], np.array(ids), words, per)
        seen.add(want)
        assert bool(index.screen([" ".join(text)])) == want
    assert True in seen


def test_many_items_with_one_seed():
    """A run of words that every item has costs no tiling of every item."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=6))
    rows = [(str(i), ["once upon a time " + " ".join(word() for _ in range(16))]) for i in range(3000)]
    index = L.Items(rows)
    texts = ["so once upon a time there was a " + " ".join(word() for _ in range(30)) for _ in range(20)] + [rows[77][1][0]]
    assert [(d, k) for d, k, _ in index.screen(texts)] == [(20, 77)]


def test_coverage_finds_reordered_passages(spark):
    filler = "The river moved past the mill and nobody there believed that it would ever rest again. "
    reordered = " ".join(" ".join(W[i : i + 4]) for i in range(20, -1, -4))
    texts = {"in order": GOOD, "reordered": reordered, "shuffled": " ".join(random.Random(1).sample(W, len(W))), "half": " ".join(W[: len(W) // 2]), "none": filler}
    docs = spark.createDataFrame([(n, filler + t + " " + filler) for n, t in texts.items()] + [("null", None)], "doc_id string, text string")
    items = spark.createDataFrame([("a", GOOD, None), ("b", OTHER, "short")], "pair_identifier string, good string, bad string")
    got = {r["doc_id"]: (r["pair_identifier"], r["coverage"], r["in_order"]) for r in L.covered(docs, items).collect()}
    assert got == {"in order": ("a", 1.0, True), "reordered": ("a", 1.0, False)}
    assert ("reordered", "a") not in {(r[0], r[1]) for r in L.leaked(docs, items).collect()}
    assert L.covered(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("word", ["Müller", "cœur", "straße", "l’été", "naïve", "¿qué", "über"])
def test_repair_of_wrong_decoding(word):
    broken = "".join(C._high(b) for b in word.encode())
    assert C.repair_encoding("x " + broken + " y") == "x " + word + " y"
    assert C.repair_encoding(word) == word
