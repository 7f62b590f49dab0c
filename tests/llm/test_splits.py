import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from inkspark.llm import splits as S


def keys(spark, *authors):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(authors)], "i int, author string")
    return [r[0] for r in df.orderBy("i").select(S.author_keys(F.col("author"))).collect()]


def test_one_author_in_many_notations(spark):
    forms = ["Zelda Driderimin", "DRIDERIMIN, Zelda", "Dr. Zelda M. Driderimin", "Driderimin, Z.", "Z. Driderimin.", "[Zelda Driderimin]", "  Zelda   Driderimin", "Driderimin, Zelda, 1844-1928", "zelda m. dríderimin", "Zelda Driderimin (ed.)", "Driderímin, Zelda", "Driderimin, Zelda, Jr.", "by Zelda Driderimin"]
    assert all(k == ["driderimin|z"] for k in keys(spark, *forms))


def test_titles_that_are_names(spark):
    names = ["John Major", "John Lord", "John Saint", "Jack Ma", "Minh Van", "Don Bell"]
    want = [["major|j"], ["lord|j"], ["saint|j"], ["ma|j"], ["van|m"], ["bell|d"]]
    assert keys(spark, *names) == want
    assert keys(spark, "Major, John", "LORD, J.", "Saint, Rev. John", "Ma, Jack", "Van, M.", "D. Bell") == want
    assert keys(spark, "Lord Byron", "Byron, Lord", "Prof. Don Bell Jr.", "van Beethoven, Ludwig", "Ludwig van Beethoven, Esq.") == [["byron|l"], ["byron|l"], ["bell|d"], ["beethoven|l"], ["beethoven|l"]]


def test_several_authors_and_none(spark):
    got = keys(spark, "A. Berg & Zorn, Max; Dr. Eva Klein and B. Berg", None, "", " ", "Unknown", "[s.n.]", "N/A", "ANONYMOUS", "Various", "Unknown and Max Zorn", "Müller, H. / M. Zorn")
    assert sorted(got[0]) == ["berg|a", "berg|b", "klein|e", "zorn|m"]
    assert all(g == [] for g in got[1:9])
    assert got[9] == ["zorn|m"]
    assert sorted(got[10]) == ["muller|h", "zorn|m"]


def brute(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint")
    nodes = {x for e in edges for x in e}
    assert {r[0]: r[1] for r in S.components(df).collect()} == brute(nodes, edges)
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_related_works_and_pairs(spark):
    rows = [(1, "Ann Bell", "t1"), (2, "Bell, A.", None), (3, "Cy Dunn", "t1"), (4, "Unknown", "t9"), (5, None, ""), (6, None, ""), (1, "Eve Fox", None), (7, "FOX, Eve", "t8"), (7, "FOX, Eve", "t8")]
    c = spark.createDataFrame([(*r, 0) for r in rows], "ebook_number bigint, author string, ingested_sha256 string, node int")
    got = {r[0]: r[1] for r in S.related_works(c).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 5, 6: 6}
    pairs = {tuple(r) for r in S.pairs_within(S.related_works(c)).collect()}
    assert pairs == set(itertools.combinations([1, 2, 3, 7], 2))
    assert {tuple(r) for r in S.pairs_within(S.related_works(c), large=2, salts=3).collect()} == pairs
    assert S.pairs_within(S.related_works(c.limit(0))).collect() == []


def test_differencing_balances():
    rng = random.Random(1)
    weights = [rng.paretovariate(1.5) for _ in range(400)]
    t = S.difference([[(w, [i])] for i, w in enumerate(weights)], 10)
    sums = [x for x, _ in t]
    assert sorted(i for _, m in t for i in m) == list(range(400))
    assert max(sums) - min(sums) < 0.02 * sum(sums)
    assert S.difference([], 3) == [(0.0, [])] * 3


def test_blocks_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randint(1, 50))) for i in range(3000)] + [(9999, None)]
    w = spark.createDataFrame(rows, "component bigint, weight double")
    plans = {"p": {"train": 0.8, "validation": 0.1, "test": 0.1}, "q": {"a": 0.7, "b": 0.3}}
    placed = S.balanced_bins(w, bins=20, block=100, fan=4).collect()
    assert len(placed) == 3001
    sums = defaultdict(float)
    for r in placed:
        sums[r["bin"]] += dict(rows)[r["component"]] or 0
    assert max(sums.values()) / min(sums.values()) < 1.01
    got = S.split_components(w, plans, 20).collect()
    assert len(got) == 2 * 3001
    total = sum(x for _, x in rows if x)
    for plan, shares in plans.items():
        for s, p in shares.items():
            reached = sum(dict(rows)[r["component"]] or 0 for r in got if (r["plan_name"], r["split_name"]) == (plan, s)) / total
            assert abs(reached - p) < 0.01


def test_one_component_of_a_third(spark):
    w = spark.createDataFrame([(i, 1.0) for i in range(200)] + [(500, 100.0)], "component bigint, weight double")
    got = S.split_components(w, {"p": {"train": 0.8, "test": 0.2}}, 20).collect()
    assert next(r["split_name"] for r in got if r["component"] == 500) == "train"
    assert abs(sum(1 for r in got if r["split_name"] == "test") - 60) <= 12


def test_records_of_one_component_share_a_split(spark):
    rng = random.Random(5)
    listed = [(w, f"Ann {'ABCDEFGHIJ'[w % 10]}er{'abcdefg'[w % 7]}" if w < 120 else None, None) for w in range(160)]
    catalogue = spark.createDataFrame(listed, "ebook_number bigint, author string, ingested_sha256 string")
    rows = [("document", i, rng.choice([3, rng.randrange(200), rng.randrange(200)])) for i in range(3000)]
    rows += [("loss", i, 3 if i % 3 == 0 else rng.randrange(200)) for i in range(5000)] + [("loss", 9000 + i, None) for i in range(40)]
    records = spark.createDataFrame(rows, "kind string, record_id bigint, ebook bigint")
    plans = {"a": {"train": 0.8, "validation": 0.1, "test": 0.1}, "b": {"x": 0.5, "y": 0.5}, "only": {"all": 1.0}}
    works, sums = S.assign(S.works_of(records, catalogue))
    got = S.place(records, works, sums, plans).collect()
    assert Counter((r["kind"], r["record_id"], r["plan_name"]) for r in got) == Counter((k, i, p) for k, i, _ in rows for p in plans)
    parts = brute(range(200), [(a, b) for (a, x, _), (b, y, _) in itertools.combinations(listed, 2) if x is not None and x.split()[1] == y])
    ids = {(k, i): w for k, i, w in rows}
    by_name = defaultdict(list)
    for w, a, _ in listed:
        if a:
            by_name[a].append(w)
    parts = brute(range(200), [(ws[0], w) for ws in by_name.values() for w in ws])
    for plan, shares in plans.items():
        sides = defaultdict(set)
        for r in got:
            if r["plan_name"] == plan:
                w = ids[r["kind"], r["record_id"]]
                sides[("lone", r["record_id"]) if w is None else parts[w]].add((r["split_name"], r["component"]))
        assert all(len(x) == 1 for x in sides.values())
        size = Counter()
        for k, i, w in rows:
            size[("lone", i) if w is None else parts[w], k] += 1
        for kind, n in (("document", 3000), ("loss", 5040)):
            largest = max(x for (_, k), x in size.items() if k == kind) / n
            for s, p in shares.items():
                reached = sum(r["split_name"] == s and r["plan_name"] == plan and r["kind"] == kind for r in got) / n
                assert abs(reached - p) <= largest
    assert S.place(records.limit(0), *S.assign(S.works_of(records.limit(0), catalogue)), plans).collect() == []


def test_plans_are_read_once(spark):
    p = spark.createDataFrame([("a", "x", 0.5), ("a", "x", 0.5), ("a", "y", 0.5), (None, "z", 0.1), ("b", "w", 0.0)], "plan_name string, split_name string, target_share double")
    assert S.read_plans(p) == {"a": {"x": 0.5, "y": 0.5}}
