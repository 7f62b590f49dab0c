"""Hand-derived numbers and brute force on small tables."""

import hashlib
import ipaddress
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from inkspark.bindings import QUERIES, SQL
from inkspark.bindings.statistics import losses
from inkspark.functions import text as T
from inkspark.functions import tokens as K
from inkspark.functions import udfs as U
from inkspark.operators import duplicates as D
from inkspark.operators import digests as I
from inkspark.operators import graph as G
from inkspark.operators import joins as J
from inkspark.operators import retrieval as R
from inkspark.operators import rules as X
from inkspark.operators import selection as S
from inkspark.operators import stats as Z
from inkspark.plans import lineage as L


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_rank_fusion_of_two_first_places(spark):
    r = spark.createDataFrame([(1, 1, 7)], "query int, rank int, chunk int")
    assert R.fuse(r, r).first()["score"] == pytest.approx(2 / 61)


def test_recall_and_precision(spark):
    res = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate("abcd")], "query int, rank int, chunk string")
    gold = spark.createDataFrame([(1, "b"), (1, "x")], "query int, chunk string")
    cases = spark.createDataFrame([(1,), (2,)], "query int")
    for k in (2, 4):
        got = {r["query"]: r for r in R.case_metrics(res, gold, gold.limit(0), cases, k).collect()}
        assert got[1]["recall"] == 0.5 and got[1]["reciprocal_rank"] == 0.5 and got[2]["recall"] == 0.0
    assert got[1]["precision"] == 0.25


def test_bm25_against_the_formula(spark):
    texts = {1: "red fox and dog", 2: "red red cat", 3: "blue", 4: "", 5: "red fox"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    idx = R.lexical_index(df, "id", T.words(F.col("text")))
    q = spark.createDataFrame([(9, "Red fox fox")], "q int, text string")
    got = {r["chunk"]: r["score"] for r in R.bm25(idx, q, "q", T.words(F.col("text")), 10).collect()}
    toks = {i: t.split() for i, t in texts.items()}
    n, avg = len(toks), sum(len(set(t)) for t in toks.values()) / len(toks)
    want = {}
    for i, t in toks.items():
        s = 0.0
        for term in ("red", "fox"):
            df_ = sum(term in x for x in toks.values())
            if tf := t.count(term):
                s += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(set(t)) / avg))
        if s:
            want[i] = round(s, 6)
    assert got == pytest.approx(want)


def test_dense_ranks_by_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<float>")
    got = [(r["chunk"], r["score"]) for r in R.dense(v, v.where("id in (1, 4)"), "id", "v", "id", 3, most_queries=1).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, pytest.approx(0.707107)), (2, 0.0)]


def test_shingles_and_repetition(spark):
    assert len(one(spark, "one two three four five", lambda c: T.shingles(c, 3))) == 3
    assert one(spark, "one two", lambda c: T.shingles(c, 3)) == []
    assert one(spark, "aaaaaaa", lambda c: T.char_repetition(c, 3)) == pytest.approx(0.8)
    assert one(spark, "abc", lambda c: T.char_repetition(c, 3)) is None


@pytest.mark.parametrize("url,want", [("HTTP://Example.COM:80/a/", "http://example.com/a"), ("https://example.com:8443/x#top", "https://example.com:8443/x"), ("https://example.com./?utm_source=a&b=2&a=1&fbclid=z&ref=q", "https://example.com/?a=1&b=2"), ("https://u:p@example.com/", None), ("ftp://example.com", None), ("nothing", None)])
def test_addresses(spark, url, want):
    assert one(spark, url, T.canonical_url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://x.org", "https://x.org/"),
        ("HTTP://[2001:DB8::1]:8443/a//", "http://[2001:db8::1]:8443/a"),
        ("https://x.org/?flag&a-b=1&a=2&A_=3", "https://x.org/?A_=3&a=2&a-b=1&flag="),
        ("https://x.org/é b?q=%C3%A9+x&_GL=1", "https://x.org/%C3%A9%20b?q=é x"),
        ("https://x.org/%41", "https://x.org/%41"),
    ],
)
def test_addresses_of_odd_forms(spark, url, want):
    assert one(spark, url, T.canonical_url) == want


@pytest.mark.parametrize("host,blocked", [("localhost", True), ("127.0.0.1", True), ("10.1.2.3", True), ("172.20.0.1", True), ("169.254.169.254", True), ("8.8.8.8", False), ("example.com", False), ("[::1]", True)])
def test_blocked_hosts(spark, host, blocked):
    assert one(spark, host, T.blocked_host) is blocked


def test_blocked_destinations_of_all_events(spark, tmp_path):
    ids = [*range(300), 172 + 20 * 256, 172 + 32 * 256, 192 + 168 * 256, 169 + 254 * 256, 100 + 64 * 256, 100 + 128 * 256, 8 + 8 * 256 + (8 << 16) + (8 << 24), 198 + 51 * 256 + (100 << 16), 0xFC00, 0xFE80, 0xFF02, 0x2606, 0x2001 + (0xDB8 << 16), 0x2001 + (0x1FF << 16), 0x2001 + (0x200 << 16), 0x2002, *[0x2001 + (g << 16) for g in (1, 2, 3, 4, 0x10, 0x1F, 0x20, 0x3F, 0x40, 0x4860)]]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([("https://shelf.example/a.txt",), (None,)], "url string").write.parquet(str(tmp_path / "catalogue.parquet"))
    rows = QUERIES["url_blocked_destination"](spark, str(tmp_path)).collect()
    names = {r["host"]: r["blocked"] for r in rows if r["event_id"] is None}
    assert names == {"shelf.example": False, "localhost": True, "metadata": True, "metadata.google.internal": True}
    at = [r for r in rows if r["event_id"] is not None]
    assert sorted(r["event_id"] for r in at) == sorted(ids * 2)
    for r in at:
        x = ipaddress.ip_address(r["host"])
        unassigned = x.version == 6 and x not in ipaddress.ip_network("2000::/3")
        assert r["blocked"] is (unassigned or x.is_multicast or not x.is_global), r
    four = {(r["event_id"], r["blocked"]) for r in at if ":" not in r["host"]}
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "", QUERIES["url_blocked_destination"], SQL["url_blocked_destination"]) == ""
    assert {(172 + 20 * 256, True), (172 + 32 * 256, False), (192 + 168 * 256, True), (8 + 8 * 256 + (8 << 16) + (8 << 24), False)} <= four


def test_paragraph_documents_are_never_cut(spark):
    text = "a" * 5 + "\n\n" + "b" * 5 + "\r\n \r\n" + "c" * 30 + "\n\nd"
    assert one(spark, text, lambda c: T.paragraph_documents(c, 12)) == ["aaaaa\n\nbbbbb", "c" * 30, "d"]
    assert one(spark, "", lambda c: T.paragraph_documents(c, 12)) == []


def test_sections_chunks_and_pages():
    assert U.split_sections("# Top\nx\n## Sub\ny\n### Deep\nz\n# Empty\n") == [("Top", "x"), ("Top > Sub", "y"), ("Top > Sub > Deep", "z")]
    assert U.split_sections("# A\n\n### B\nx\n### C\ny")[1][0].endswith("C")
    chunks = U.chunk("# H\n\n" + "\n\n".join("w" * 300 for _ in range(6)))
    assert [len(c) for _, c in chunks] == [602, 602, 602]
    assert all(len(p) <= 50 for p in U.split_oversized("x" * 120 + ". " + "short one. " * 9, 50))
    title, text = U.visible("<title> A  b</title><script>no</script><nav>menu</nav><h2>Head</h2><p>one<br>two<li>item")
    assert title == "A  b" and "## Head" in text and "no" not in text and "menu" in text and "one\n\ntwo\n\nitem" in text
    assert U.visible("<td>a</td><td>b<svg><p>c<title>d</title></svg></td>") == ("", "\n\na\n\n\n\nb\n\n")


def test_loops():
    for _ in range(500):
        t = "".join(random.choices("abé"[: random.randint(1, 3)], k=random.randint(0, 9))) + "".join(random.choices("abé", k=random.randint(1, 6))) * random.randint(1, 4)
        for least, k in ((1, 3), (2, 3), (1, 2), (3, 4)):
            want = next((p for p in range(least, len(t) // k + 1) if t.endswith(t[-p:] * k)), 0)
            assert U.tail_period(t, least, k) == want
    assert U.tail_period("xyabcabcabc") == 3 and U.tail_period("abcd") == 0 and U.tail_period("") == 0
    for _ in range(100):
        s = "".join(random.choices("ab", k=random.randint(2, 14)))
        best = max(((len(s[i:j]), sum(s.startswith(s[i:j], k) for k in range(len(s)))) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if sum(s.startswith(s[i:j], k) for k in range(len(s))) > 1), default=(0, 0))
        assert U.repeated_block(s) == best


def test_extracts_leave_out_long_lists():
    long = list(range(20))
    got = U.compact({"a": {"b": long, "c": [1, [2.5, None]]}, "d": "x"}, 8)
    want = hashlib.sha256(("[" + ",".join(map(str, long)) + "]").encode()).hexdigest()
    assert got == {"a": {"b": {"left_out": 20, "sha256": want}, "c": [1, [2.5, None]]}, "d": "x"}


def test_binomial_tests(spark):
    df = spark.createDataFrame([(5, 3), (0, 0), (8, 0), (1, 1), (700, 650)], "b bigint, c bigint")
    got = [r[0] for r in df.select(Z.mcnemar_p(F.col("b"), F.col("c"))).collect()]
    want = [min(1.0, 2 * sum(math.comb(b + c, i) for i in range(max(b, c), b + c + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in ((5, 3), (0, 0), (8, 0), (1, 1), (700, 650))]
    assert got == pytest.approx(want) and got[0] == pytest.approx(186 / 256)


@pytest.mark.parametrize("ps,want", [([0.001, 0.02, 0.03], "TTT"), ([0.04, 0.045], "FF"), ([0.001, 0.03, 0.045], "TFF"), ([0.05, 0.05], "FF"), ([0.02, 0.02], "TT"), ([0.4, 0.3, 0.001], "FFT")])
def test_holm(spark, ps, want):
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r["i"]: r["rejected"] for r in Z.holm(df, "p", "i").collect()}
    assert "".join("T" if got[i] else "F" for i in range(len(ps))) == want


def test_average_ranks_and_rank_correlation(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(60)) for _ in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "x int, y int").repartition(7)
    ranks = lambda v: {k: sum(a < k for a in v) + (sum(a == k for a in v) + 1) / 2 for k in set(v)}
    xs, ys = zip(*[r for r in rows if r[0] is not None], strict=True)
    assert {r["value"]: r["rank"] for r in Z.average_ranks(df, "x").collect()} == ranks(xs)
    a, b = [ranks(xs)[x] for x in xs], [ranks(ys)[y] for y in ys]
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    rho = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    assert Z.spearman(df, "x", "y").first()["rho"] == pytest.approx(rho, abs=1e-6)
    assert Z.spearman(df.withColumn("x", F.lit(1)), "x", "y").first()["rho"] == 0.0


def test_vocabulary_files_are_checked(tmp_path):
    pairs = [("a", "b"), ("ab", " c")]
    path = str(tmp_path / "v.json")
    digest = K.save_vocabulary(path, pairs)
    assert K.load_vocabulary(path) == pairs and len(digest) == 64
    Path(path).write_text(Path(path).read_text().replace('"ab"', '"ax"'))
    with pytest.raises(ValueError, match="not those"):
        K.load_vocabulary(path)


def test_quantiles():
    assert Z.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5) and Z.t_quantile(0.025, 1) == pytest.approx(-12.7062, abs=1e-3)
    assert Z.chi_square_quantile(0.975, 4) == pytest.approx(11.143287, abs=1e-5) and Z.chi_square_quantile(0.025, 1) == pytest.approx(0.000982, abs=1e-6)


def test_design_effect_jackknife_and_sign_flip(spark):
    rows = [("e", w, x) for w, xs in {"a": [1.0, 1.0], "b": [-1.0], "c": [2.0, 0.5, 0.5]}.items() for x in xs]
    df = spark.createDataFrame(rows, "e string, w string, x double")
    r = Z.design_effect(df, ["e"], "w", "x").first()
    xs = [x for *_, x in rows]
    m = sum(xs) / 6
    item = sum((x - m) ** 2 for x in xs)
    clus = sum((sum(x for _, k, x in rows if k == w) - m * sum(k == w for _, k, _ in rows)) ** 2 for w in "abc")
    assert r["ratio"] == pytest.approx(clus / item, abs=1e-4) and r["clusters"] == 3
    alone = spark.createDataFrame([("e", i, x) for i, x in enumerate(xs)], "e string, w int, x double")
    assert Z.design_effect(alone, ["e"], "w", "x").first()["ratio"] == 1.0
    c = df.groupBy("e", "w").agg(F.sum("x").alias("v"), F.count("*").alias("n"))
    j = Z.jackknife(c, ["e"], "v", "n").first()
    outs = [(4 - s) / (6 - n) for s, n in ((2, 2), (-1, 1), (3, 3))]
    mean = sum(outs) / 3
    assert j["minimum_without"] == pytest.approx(min(outs), abs=1e-6) and j["standard_error"] == pytest.approx(math.sqrt(2 / 3 * sum((o - mean) ** 2 for o in outs)), abs=1e-6)
    vals = [2.0, -1.0, 3.0]
    p = sum(abs(vals[0] + a * vals[1] + b * vals[2]) >= 4 for a in (1, -1) for b in (1, -1)) / 4
    assert Z.sign_flip(c, "v").first()["p_value"] == p


def test_sign_flip_beyond_enumeration(spark):
    rng = random.Random(3)
    vals = [rng.gauss(0.3, 1) for _ in range(18)]
    sums = [0.0]
    for v in vals:
        sums = [s + e for s in sums for e in (v, -v)]
    p = sum(abs(s) >= abs(sum(vals)) - 1e-12 for s in sums) / len(sums)
    df = spark.createDataFrame(list(enumerate(vals)), "cluster int, v double")
    r = Z.sign_flip(df, "v").first()
    assert (r["clusters"], r["exact"]) == (18, False) and abs(r["p_value"] - p) < 0.02
    assert Z.sign_flip(df.repartition(3), "v").first() == r


def test_sign_flip_query_takes_all_works(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables here")
    t = losses(spark, d)
    r = QUERIES["stat_sign_flip"](spark, d).first()
    n = t.select("work").distinct().count()
    assert (r["clusters"], r["exact"]) == (n, n <= 16)
    runs = t.where(F.col("experiment").isin("X301", "X302", "X303")).groupBy(F.concat_ws("-", "experiment", F.coalesce("run_seed", F.lit(0)).cast("string")).alias("cluster")).agg(F.round(F.sum("x"), 9).alias("v"))
    vals = [r["v"] for r in runs.collect()]
    flips = [abs(sum(v if s else -v for v, s in zip(vals, (True, *f), strict=True))) >= abs(sum(vals)) - 1e-12 for f in itertools.product((True, False), repeat=len(vals) - 1)]
    assert tuple(Z.sign_flip(runs, "v").first()) == (len(vals), round(sum(flips) / len(flips), 6), True)


def brute_run(text):
    best = (1, 0, 0)
    for start in range(len(text)):
        for p in range(1, (len(text) - start) // 2 + 1):
            k = 1
            while text[start + k * p : start + (k + 1) * p] == text[start : start + p]:
                k += 1
            if k > 1:
                best = max(best, (k, p, -start))
    return best[0], best[1], -best[2]


def test_periodic_runs_against_brute_force():
    sentence = "The quick brown fox jumps over the lazy dog while nobody in town is there. "
    assert len(sentence.strip()) > 64 and U.periodic_run((sentence * 5).strip()) == (4, len(sentence), 0)
    assert U.periodic_run("a" * 9) == (9, 1, 0) and U.periodic_run("cacabcabcab") == (3, 3, 2) and U.periodic_run("") == (1, 0, 0)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(0, 60)))
        assert U.periodic_run(text) == brute_run(text)
    for _ in range(80):
        letters = [chr(c) for c in range(0x1F600, 0x1F600 + 200)]
        block = rng.sample(letters, rng.randint(40, 110))
        text = "".join(rng.sample(letters, rng.randint(0, 90)) + block * rng.choice((1, 2, 2, 3)) + block[: rng.randint(0, 40)] + rng.sample(letters, rng.randint(0, 60)))
        assert U.periodic_run(text) == brute_run(text)


def test_claims_of_texts_with_control_characters(spark, tmp_path):
    texts = ["One\x07 here. Two.\n Three!\tFour? \x07", "No\x00 mark. Here", "Plain. Text"]
    spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(9, None, "p")], "doc_id bigint, text string, path string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["claims_sentence"](spark, str(tmp_path)).collect()}
    parts = [[c.strip(" \t\n\r") for c in re.split(r"(?<=[.!?])[ \t\n\r]+", t)] for t in texts]
    assert parts[0] == ["One\x07 here.", "Two.", "Three!", "Four?", "\x07"]
    claims = [(i, k, c) for i, p in enumerate(parts) for k, c in enumerate(c for c in p if c)]
    sha = lambda i, k, c: "clm_" + hashlib.sha256(f"{i}\x1f{k}\x1f{c}".encode()).hexdigest()[:16]
    assert got == {(i, k, sha(i, k, c)) for i, k, c in claims}
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "", QUERIES["claims_sentence"], SQL["claims_sentence"]) == ""


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("e", i, rng.gauss(1, 1), 1.0) for i in range(60)], "e string, w int, a double, b double")
    r = Z.bootstrap(df, ["e"], "w", "a", "b", draws=300).first()
    assert r["low"] < 1 < r["high"] and r["high"] - r["low"] < 1


@pytest.mark.parametrize("values,want", [({0.0: 3, 0.5: 1, 1.0: 3}, "interior_optimum"), ({0.0: 1, 0.5: 3, 1.0: 3}, "boundary_optimum"), ({0.0: 1, 0.5: 1.01, 1.0: 3}, "unresolved")])
def test_sweeps(spark, values, want):
    df = spark.createDataFrame([(s, float(v)) for s, v in values.items()], "s double, v double")
    assert Z.classify_sweep(df, "s", "v", 0.1).first()["outcome"] == want


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choices("abcdefghij", k=40)) for _ in range(12)]
    texts = []
    for b in base:
        w = b.split()
        for k in (0, 0, 1, 2, 4):
            v = w[:]
            for _ in range(k):
                v[rng.randrange(len(v))] = "z"
            texts.append(" ".join(v))
    texts += ["", "few words", None, base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in enumerate(texts) if t}
    sets = {i: s for i, s in sets.items() if s}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    group = {i: i for i in range(len(texts))}
    for _ in texts:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    links = defaultdict(set)
    for a, b in linked:
        if sets[a] != sets[b]:
            links[a].add(sets[b])
            links[b].add(sets[a])
    got = {r["id"]: (r["group"], r["links"]) for r in D.near_duplicates(df, "id", T.shingles(F.col("text"), 5)).collect()}
    assert got == {i: (group[i], len(links[i])) for i in group}
    assert D.near_duplicates(df.limit(0), "id", T.shingles(F.col("text"), 5)).collect() == []
    members, reps = D.representatives(df, "id", T.shingles(F.col("text"), 5))
    want = {(a, b) for a, b in linked if sets[a] != sets[b]}
    firsts = {min(j for j in sets if sets[j] == s) for s in sets.values()}
    for crowd in (1, 2, 1000):  # shingles that many prefixes hold go last, and are joined in salted tasks
        assert {(r["a"], r["b"]) for r in D.similar_pairs(reps, crowd=crowd, salts=3).collect()} == {p for p in want if set(p) <= firsts}
    sketches = D.bottom_k(df.where("id in (%s)" % ",".join(map(str, firsts))), "id", T.shingles(F.col("text"), 5))
    found = {(r["a"], r["b"]) for r in D.sketch_pairs(sketches, "id").collect()}
    wanted = {p for p in want if set(p) <= firsts}
    assert len(found & wanted) >= 0.9 * len(wanted) > 0  # recall of the screen against all pairs


def test_similar_sets_beyond_a_crowd(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        g = sorted({*range(30), *(rng.randrange(30, 40) for _ in range(3))})
        rows.append((i, len(g), g))
    sets = spark.createDataFrame(rows, "rep int, n int, g array<bigint>")
    want = {(a, b) for (a, _, x), (b, _, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))}
    for crowd in (5, 50, 1000):
        assert {(r["a"], r["b"]) for r in D.similar_pairs(sets, crowd=crowd, salts=4).collect()} == want


def test_components_of_a_hub(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (5000, 5000), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None and None not in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        if None not in (a, b) and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "a int, b int")
    want = {x: min(y for y in up if find(y) == find(x)) for x in up}
    for hot in (20, 10_000):
        assert {r["node"]: r["component"] for r in G.components(df, hot=hot, salts=4).collect()} == want


def test_rows_of_hot_keys_meet_their_key(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(500)], "k int, v int")
    per = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = J.attach(rows, per, "k", ["v"], "n", 500, hot=100, salts=4)
    assert sorted(map(tuple, got.select("k", "v", "n").collect())) == sorted(map(tuple, rows.join(per, "k").select("k", "v", "n").collect()))


def test_tree_digests_see_every_row(spark):
    base = [(i, f"t{i % 5}") for i in range(300)]
    dig = lambda rows: I.tree_digest(spark.createDataFrame(rows, "id int, t string"), [], F.col("id"), F.col("t")).first()
    want = dig(base)
    assert want["n"] == 300 and dig(base[::-1]) == want
    swapped = [(i, "t9" if i == 7 else t) for i, t in base]
    assert len({dig(x)["digest"] for x in (base, swapped, base[:-1], [*base, base[0]], [*base, (1, None)], [*base, (1, "")])}) == 6
    assert dig(base[:0]) is None


def test_cut_tables_are_removed(spark):
    t = L.cut(spark.range(10).toDF("a"))
    path = Path(t.cut_path.removeprefix("file:"))
    assert t.count() == 10 and path.exists()
    L.drop(t, spark.range(1))
    assert not path.exists()


def test_chain_is_one_group(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert {tuple(r) for r in G.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_prefix_sums_splits_and_packing(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 9), f"w{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, n int, work string").withColumn("key", S.order_key(7, F.col("id")))
    got = S.prefix_sum(df, "key", F.col("n")).orderBy("key").collect()
    at = 0
    for k, r in enumerate(got):
        assert r["before"] == at and r["position"] == k + 1
        at += r["n"]
    sides = Counter(r["side"] for r in S.split_documents(df, "id", validation=0.15, test=0.15).collect())
    assert sides == {"test": 30, "validation": 30, "train": 140}
    works = S.split_works(df, "work", F.col("n")).collect()
    assert {r["work"] for r in works} == {f"w{i}" for i in range(7)} and len(works) == 7
    spans = S.block_spans(S.stream_offsets(df, "key", F.col("n")), "id", 16, F.col("n")).collect()
    total = sum(n + 1 for _, n, _ in rows)
    size = Counter()
    for r in spans:
        size[r["block"]] += r["last"] - r["first"] + 1
    assert set(size.values()) == {17} and len(size) == total // 17


def test_rules(spark):
    df = spark.createDataFrame([(5, True), (1, None), (None, False)], "n int, f boolean")
    v = [("big", {"fact": "n", "min": 3}), ("flagged", {"flag": "f"}), ("rest", {"always": True})]
    assert [r[0] for r in df.select(X.outcome(v)).collect()] == ["big", "rest", "rest"]
    assert [r[0] for r in df.select(X.outcome(v[:2], exclusive=True)).collect()] == ["ambiguous", None, None]
    with pytest.raises(ValueError):
        X.rule({"fact": "n"})
    a = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "id string, up string")
    assert {tuple(r) for r in X.history(a, "id", "up").collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)}
    c = spark.createDataFrame([(1, [(1, 3.0), (2, 2.0), (3, 2.5), (4, 2.4), (5, 1.0)])], "u int, c array<struct<step:bigint,loss:double>>")
    assert c.select(X.last_improvement(F.col("c"), 0.1, 1)).first()[0] == 2 and c.select(X.last_improvement(F.col("c"), 0.1, 5)).first()[0] == 5
