import numpy as np
import pytest

from inkspark.llm import language as G

SAMPLES = {
    "en": "the river moved past the old mill and nobody believed that it would ever rest again while the children were sleeping in the house near the wood and waited for their father",
    "de": "der fluss zog an der alten mühle vorbei und niemand glaubte dass er jemals wieder ruhen würde während die kinder im haus nahe dem wald schliefen und auf ihren vater warteten",
    "fr": "la rivière passait devant le vieux moulin et personne ne croyait qu’elle se reposerait jamais pendant que les enfants dormaient dans la maison près du bois et attendaient leur père",
    "es": "el río pasaba delante del viejo molino y nadie creía que volviera a descansar mientras los niños dormían en la casa cerca del bosque y esperaban a su padre con mucha paciencia",
    "it": "il fiume passava davanti al vecchio mulino e nessuno credeva che avrebbe mai riposato mentre i bambini dormivano nella casa vicino al bosco e aspettavano il loro padre con pazienza",
    "nl": "de rivier stroomde langs de oude molen en niemand geloofde dat zij ooit weer zou rusten terwijl de kinderen in het huis bij het bos sliepen en op hun vader wachtten",
}
LANGS = ("en", "de", "fr", "es", "it", "nl")


@pytest.fixture(scope="module")
def model():
    return G.fit([(k, v) for k, v in SAMPLES.items()] * 3, list(LANGS), G.public_pieces(G.PIECES_32K))


def test_forward_sums_all_segmentations():
    m = G.Model(["x"], ["▁a", "▁ab", "a", "b", "ab"], np.log(np.array([[0.4, 0.1, 0.1, 0.3, 0.1]])))
    # ▁ab = ▁ab | ▁a b
    assert np.isclose(np.exp(m.score("ab")[0]), 0.1 + 0.4 * 0.3)
    # ▁abb = ▁ab b | ▁a b b
    assert np.isclose(np.exp(m.score("abb")[0]), 0.1 * 0.3 + 0.4 * 0.3 * 0.3)
    assert np.isfinite(m.score("ж")[0]) and np.isfinite(m.score("a" * 200)[0])


def test_probabilities_sum_to_one(model):
    assert np.allclose(np.exp(model.logp).sum(axis=1), 1)


def test_viterbi_is_that_of_one_text(model):
    r = G.Reader(model)
    rng = np.random.default_rng(0)
    ev = [rng.normal(size=(n, 6)) * 3 for n in (0, 1, 2, 30, 31, 7)]

    def plain(e):
        if not len(e):
            return []
        s, back = e[0].copy(), []
        for x in e[1:]:
            step = s[:, None] - r.change * (1 - np.eye(6))
            back.append(step.argmax(axis=0))
            s = step.max(axis=0) + x
        p = [int(s.argmax())]
        for b in reversed(back):
            p.append(int(b[p[-1]]))
        return p[::-1]

    def value(e, p):
        return sum(e[i][s] for i, s in enumerate(p)) - r.change * sum(a != b for a, b in zip(p[:-1], p[1:], strict=True))

    for e, p in zip(ev, r.paths(ev), strict=True):
        assert len(p) == len(e) and np.isclose(value(e, p.tolist()), value(e, plain(e)))


def test_few_kinds_of_words_at_the_start_hide_no_stretch(model):
    filler = "the house " * 110
    tail = SAMPLES["en"]
    got = G.Reader(model).read([filler + tail, filler])
    assert [(LANGS[s[0]], s[1], s[2]) for s in got[0]] == [("en", 0, 220 + len(tail.split()))] and got[1] == []


def test_numbers_between_words_are_words(model):
    r = G.Reader(model)
    w = SAMPLES["en"].split()[:11]
    inside, edge, listed = [*w[:5], "450,", *w[5:]], [*w, "450"], [*w[:5], "4", "50", *w[5:]]
    got = r.read([" ".join(x) for x in (w, inside, edge, listed)])
    assert [[s[2] for s in x] for x in got] == [[], [12], [], []]
    assert r.read(["7", "", "1 2 3 4 5 6 7 8 9 10 11 12 13", "a 1 " * 20]) == [[], [], [], []]


def test_words_of_any_length_speak(model):
    r = G.Reader(model)
    assert np.abs(r.table[r._row("donaudampfschifffahrtselektrizitätenhauptbetriebswerk")]).max() > 0


def test_short_and_mixed_stretches_are_found(model):
    """Stretches of 12 to 20 words between two of another language; the model is fitted on one sentence each."""
    rng = np.random.default_rng(3)
    found = total = 0
    for _ in range(60):
        a, b = rng.choice(6, 2, replace=False)
        w = SAMPLES[LANGS[b]].split()
        n = int(rng.integers(12, 21))
        at = int(rng.integers(0, len(w) - n + 1))
        text = " ".join([SAMPLES[LANGS[a]], *w[at : at + n], SAMPLES[LANGS[a]]])
        total += 1
        found += [s[0] for s in G.Reader(model).read([text])[0]] == [a, b, a]
    assert found >= 0.9 * total


def test_documents_and_stretches(spark):
    s = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(SAMPLES.items())] + [(7, None, "x"), (8, "en", None)], "sample_id int, lang string, text string")
    rows = [(i, SAMPLES[k], k) for i, k in enumerate(LANGS)]
    rows += [
        (10, None, "en"), (11, "", "en"), (12, "   \n", None), (13, "| 45 | 0.46 |\n" * 40, "en"), (14, "x + y = z\n" * 60, "es"), (15, "the old mill", "en"),
        (16, SAMPLES["en"] + ". " + SAMPLES["de"] + ". " + SAMPLES["en"], "en"),
        (17, SAMPLES["nl"] + " (la casa cerca del bosque) " + SAMPLES["nl"], "nl"),
        (18, SAMPLES["fr"].upper(), "en"), (19, SAMPLES["de"].replace("ü", "u"), None),
        (20, SAMPLES["es"].encode().decode("latin-1"), None), (21, (SAMPLES["it"] + " ") * 400, "it"), (21, SAMPLES["it"], "it"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, confidence string")
    got = G.languages_of(docs, s, label_col="lang").collect()
    per = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["segment"])):
        per.setdefault(r["doc_id"], []).append(r["lang"])
        assert 0 <= r["confidence"] <= 1
    assert [per[i] for i in range(6)] == [[k] for k in LANGS]
    assert all(per[i] == [None] for i in range(10, 16))
    assert per[16] == ["en", "de", "en"]
    assert set(per[17]) == {"nl"} and per[18] == ["fr"] and per[19] == ["de"] and per[20] == ["es"] and per[21] == ["it", "it"]
    assert G.languages_of(docs.limit(0), s).collect() == []


def test_held_out_accuracy(spark):
    """Fitted on every other sample of the given table, right on the rest."""
    from pathlib import Path

    p = Path("/root/testdata/sf0.001/lang_samples.parquet")
    if not p.exists():
        pytest.skip("no samples here")
    t = spark.read.parquet(str(p))
    got = G.languages_of(t.where("sample_id % 2 = 0"), t.where("sample_id % 2 = 1"), id_col="sample_id", label_col="lang").collect()
    right = {r["sample_id"] for r in got if r["lang"] == r["label"]}
    assert len(right) >= 0.99 * len({r["sample_id"] for r in got})
