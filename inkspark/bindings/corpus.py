"""The corpus as a whole: reports, duplicates, splits, caps, packing, drift, catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.bindings.text import LOWER, TOKENS, WORDS, grams_sql
from inkspark.functions import notation as N
from inkspark.functions import text as T
from inkspark.operators import duplicates as D
from inkspark.operators import digests as G
from inkspark.operators import selection as S
from inkspark.operators.joins import small, spread
from inkspark.plans.registry import query, table
from inkspark.sources import stores as K


def docs(spark, d):
    return table(spark, d, "documents").where("text is not null")


def sized(spark, d):
    """Documents with their words and one separator as tokens, and a seeded order key."""
    t = spread(docs(spark, d), "doc_id").select("doc_id", "source", N.register_of(F.col("register"), F.col("path")).alias("register"), F.char_length("text").cast("bigint").alias("chars"), F.size(T.words(F.col("text"))).cast("bigint").alias("tokens"))
    return t.withColumn("key", S.order_key(7, F.col("doc_id")))


SIZED = f"sized AS (SELECT doc_id, source, CASE WHEN register IS NULL OR trim(register) = '' THEN regexp_extract(path, '^([a-z]+)-pg', 1) ELSE lower(trim(register)) END AS register, length(text) AS chars, len({WORDS}) AS tokens, sha256('7|' || doc_id) AS key FROM documents WHERE text IS NOT NULL), pre AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, row_number() OVER (ORDER BY key) AS position FROM sized)"


@query("SELECT source, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(strlen(text))::BIGINT AS bytes, round(sum(length(text)) / sum(sum(length(text))) OVER (), 6) AS share FROM documents WHERE text IS NOT NULL GROUP BY 1")
def agg_corpus_report(spark, d):
    n = F.char_length("text")
    g = docs(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))
    return g.withColumn("share", F.round(F.col("characters") / F.sum("characters").over(Window.partitionBy()), 6))


@query(f"SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_exact_groups(spark, d):
    return D.exact_groups(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("SELECT doc_id, text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept FROM documents")
def dedup_first_wins(spark, d):
    return D.first_wins(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS g FROM w) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY substr(sha256(g), 1, 16)))::INT AS rank, substr(sha256(g), 1, 16) AS hash FROM g QUALIFY rank <= 64")
def sketch_bottom_k(spark, d):
    return D.bottom_k(docs(spark, d), "doc_id", T.shingles(F.col("text"), 5))


def reissued(spark, d, parts=2):
    """(doc_id, w): the tokens of every text and, under -doc_id - 1, the same without one of them: near duplicates to be found."""
    t = spread(docs(spark, d), "doc_id", parts).select("doc_id", T.blank_tokens(F.col("text")).alias("w"))
    place = F.try_mod("doc_id", F.size("w").cast("bigint")).cast("int")
    copy = t.withColumn("gone", place).select((-F.col("doc_id") - 1).alias("doc_id"), F.concat(F.slice("w", F.lit(1), F.coalesce("gone", F.lit(0))), F.slice("w", F.coalesce("gone", F.lit(0)) + 2, F.greatest(F.size("w"), F.lit(1)))).alias("w"))
    return t.unionByName(copy)


_REISSUED = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, w FROM w UNION ALL SELECT -doc_id - 1, list_filter(w, lambda x, i: i <> doc_id % len(w) + 1) FROM w),
 gs AS (SELECT doc_id, list_sort(list_distinct({grams_sql('w', 5)})) AS g FROM p), reps AS (SELECT min(doc_id) AS rep, g FROM gs WHERE len(g) > 0 GROUP BY g), x AS (SELECT rep, len(g) AS n, unnest(g) AS s FROM reps),
 c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n, any_value(a.n) + any_value(b.n) - count(*) AS u FROM x a JOIN x b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2), pairs AS (SELECT a, b, round(n / u + 1e-11, 6) AS similarity FROM c WHERE n >= 0.8 * u - 1e-9)"""


def _sets(spark, d):
    return D.representatives(reissued(spark, d), "doc_id", T.grams(F.col("w"), 5))


@query(f"WITH {_REISSUED} SELECT a, b, similarity FROM pairs")
def neardup_jaccard(spark, d):
    """Pairs of class representatives among texts and their reissues with Jaccard similarity of five-word shingles of 0.8 or more."""
    return D.similar_pairs(_sets(spark, d)[1])


@query(f"WITH {_REISSUED}, h AS (SELECT rep, substr(sha256(s), 1, 16) AS hash FROM x), sk AS (SELECT rep, hash FROM h QUALIFY row_number() OVER (PARTITION BY rep ORDER BY hash) <= 64), b AS (SELECT hash, count(*) AS n FROM sk GROUP BY 1), cp AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared, min(n) AS rarest FROM sk x JOIN sk y ON x.hash = y.hash AND x.rep < y.rep JOIN b ON b.hash = x.hash GROUP BY 1, 2) SELECT a, b, shared FROM cp WHERE shared >= 4 AND rarest <= 64")
def neardup_candidates(spark, d):
    """Pairs of representatives that share four or more of the 64 least hashes of each, the screen before the whole sets are compared."""
    texts = reissued(spark, d, 1)
    again = D.repeats(texts, "doc_id", T.windows(F.col("w"), 5))
    x = texts.join(small(again.withColumnRenamed("id", "doc_id")), "doc_id", "left_anti")
    sketches = D.bottom_k(x, "doc_id", F.array_distinct(T.grams(F.col("w"), 5)))
    return D.sketch_pairs(sketches, "doc_id")


@query(f"WITH RECURSIVE {_REISSUED}, m AS (SELECT gs.doc_id, reps.rep FROM gs JOIN reps ON reps.g = gs.g), ed AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), re AS (SELECT rep AS node, rep AS c FROM reps UNION SELECT ed.v, re.c FROM re JOIN ed ON ed.u = re.node), cc AS (SELECT node, min(c) AS c FROM re GROUP BY 1), li AS (SELECT u, count(*) AS n FROM ed GROUP BY 1), sc AS (SELECT c, max(similarity) AS score FROM (SELECT c, similarity FROM pairs JOIN cc ON cc.node = pairs.a UNION ALL SELECT c, 1.0 FROM m JOIN cc ON cc.node = m.rep GROUP BY c, m.rep HAVING count(*) > 1) GROUP BY 1) SELECT gs.doc_id, coalesce(cc.c, gs.doc_id) AS group, coalesce(li.n, 0) AS links, sc.score FROM gs LEFT JOIN m ON m.doc_id = gs.doc_id LEFT JOIN cc ON cc.node = m.rep LEFT JOIN li ON li.u = m.rep LEFT JOIN sc ON sc.c = cc.c")
def neardup_groups(spark, d):
    """The class of every text and reissue, its links and the highest similarity in its class."""
    return D.near_duplicates(reissued(spark, d), "doc_id", T.grams(F.col("w"), 5))


_SPLIT = "n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('7|' || doc_id)) AS p FROM documents WHERE text IS NOT NULL), side AS (SELECT doc_id, CASE WHEN p <= round_even(n * 0.15, 0) THEN 'test' WHEN p <= 2 * round_even(n * 0.15, 0) THEN 'validation' ELSE 'train' END AS side FROM o, n)"


@query(f"WITH {_SPLIT} SELECT doc_id, side FROM side")
def split_documents(spark, d):
    return S.split_documents(docs(spark, d), "doc_id")


_WORKS = "w AS (SELECT source, sum(length(text)) AS size, sha256('7|' || source) AS key FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1), t AS (SELECT sum(size) AS total FROM w), b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), f AS (SELECT coalesce(sum(size), 0) AS first FROM b, t WHERE before < 0.15 * total), ws AS (SELECT source, CASE WHEN before < 0.15 * total THEN 'test' WHEN before - first < 0.15 * total THEN 'validation' ELSE 'train' END AS side FROM b, t, f)"


@query(f"WITH {_WORKS} SELECT source, side FROM ws")
def split_whole_works(spark, d):
    return S.split_works(docs(spark, d), "source", F.char_length("text"))


@query(f"WITH {_SPLIT} SELECT source, count(DISTINCT side) AS sides FROM side JOIN documents USING (doc_id) GROUP BY 1 HAVING count(DISTINCT side) > 1")
def split_leakage(spark, d):
    """Works that a split by documents tears apart."""
    x = S.split_documents(docs(spark, d), "doc_id").join(docs(spark, d).select("doc_id", "source"), "doc_id")
    return S.leakage(x, "source", "side")


_KEPT = "ke AS (SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"


@query(f"WITH {_SPLIT}, {_KEPT}, r AS (SELECT side, doc_id FROM side JOIN ke USING (doc_id)), {G.tree_sql('per', 'SELECT side, ' + G.row_sql('doc_id') + ' AS d FROM r', ['side'])} SELECT side, n, digest FROM per UNION ALL SELECT 'all', sum(n)::BIGINT, sha256(string_agg(side || chr(31) || digest, chr(30) ORDER BY side)) FROM per")
def fingerprint_split(spark, d):
    """A digest of the ids of each side, texts that came before left out, and one of all sides in the order of their names."""
    kept = D.first_wins(docs(spark, d), "doc_id", F.col("text")).where("kept").select("doc_id")
    per = G.tree_digest(S.split_documents(docs(spark, d), "doc_id").join(kept, "doc_id"), ["side"], F.col("doc_id"))
    sides = F.array_sort(F.collect_list(F.concat_ws(T.UNIT, "side", "digest")))  # three
    return per.unionByName(per.agg(F.lit("all").alias("side"), F.sum("n").alias("n"), F.sha2(F.array_join(sides, "\x1e"), 256).alias("digest")))


@query(f"WITH {G.tree_sql('per', 'SELECT ' + G.row_sql('path', 'sha256(text)') + ' AS d FROM documents WHERE text IS NOT NULL', [])} SELECT n AS documents, substr(sha256(concat_ws(chr(31), 'corpus-1', n, digest)), 1, 16) AS fingerprint FROM per")
def fingerprint_corpus(spark, d):
    """One digest of the path and text of every document, and their number."""
    x = G.tree_digest(docs(spark, d), [], F.col("path"), F.sha2("text", 256))
    return x.select(F.col("n").alias("documents"), T.short_sha(F.lit("corpus-1"), F.col("n").cast("string"), F.col("digest")).alias("fingerprint"))


@query(f"WITH {SIZED}, s AS (SELECT *, CASE WHEN before < 0.15 * (SELECT sum(tokens) FROM sized) THEN 'held_out' ELSE 'train' END AS side FROM pre) SELECT side, register, count(DISTINCT source) AS works, count(*) AS documents, sum(chars)::BIGINT AS characters, sum(tokens)::BIGINT AS identifiers FROM s GROUP BY CUBE (side, register)")
def agg_pool_by_side_register(spark, d):
    """Works, documents, characters and tokens by side and register, over the cube of both."""
    s = sized(spark, d)
    total = s.agg(F.sum("tokens")).first()[0] or 0
    x = S.prefix_sum(s, "key", F.col("tokens")).withColumn("side", F.when(F.col("before") < 0.15 * total, "held_out").otherwise("train"))
    return x.cube("side", "register").agg(F.count_distinct("source").alias("works"), F.count("*").alias("documents"), F.sum("chars").alias("characters"), F.sum("tokens").alias("identifiers"))


@query(f"WITH {SIZED} SELECT doc_id, tokens, before FROM pre WHERE before < 20000")
def win_token_cap(spark, d):
    return S.token_cap(sized(spark, d), "key", F.col("tokens"), 20_000).select("doc_id", "tokens", "before")


@query(f"WITH {SIZED} SELECT doc_id, (before + position - 1)::BIGINT AS first_offset, (before + position - 1 + tokens)::BIGINT AS last_offset FROM pre")
def win_token_stream(spark, d):
    x = S.stream_offsets(sized(spark, d), "key", F.col("tokens"))
    return x.select("doc_id", F.col("before").alias("first_offset"), (F.col("before") + F.col("tokens")).alias("last_offset"))


@query(f"WITH {SIZED}, o AS (SELECT doc_id, before + position - 1 AS s, before + position + tokens AS e FROM pre), m AS (SELECT max(e) AS whole FROM o), x AS (SELECT doc_id, s, e, unnest(range((s // 65)::BIGINT, ((e - 1) // 65)::BIGINT + 1)) AS block FROM o) SELECT block, doc_id, (greatest(s, block * 65) - s)::BIGINT AS first, (least(e, (block + 1) * 65) - 1 - s)::BIGINT AS last FROM x, m WHERE (block + 1) * 65 <= whole")
def win_pack(spark, d):
    """Blocks of 64 + 1 tokens over the stream of all documents, as spans of the documents; the tail is dropped."""
    return S.block_spans(S.stream_offsets(sized(spark, d), "key", F.col("tokens")), "doc_id", 64, F.col("tokens"))


@query(f"WITH {SIZED}, c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY register = 'prose' ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM sized) SELECT doc_id, register = 'prose' AS in_class, tokens, b AS before FROM c WHERE b < 25000")
def win_share_select(spark, d):
    """Half prose, half the rest, of 50,000 tokens."""
    x = S.share_select(sized(spark, d), "key", F.col("tokens"), F.col("register") == "prose", 0.5, 50_000)
    return x.select("doc_id", "in_class", "tokens", "before")


@query(f"WITH {SIZED}, c AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM sized) SELECT doc_id, chars FROM c WHERE b < 500000")
def win_sampled_units(spark, d):
    """Whole documents in seeded order until 500,000 characters are reached, the crossing one included."""
    return S.token_cap(sized(spark, d), "key", F.col("chars"), 500_000).select("doc_id", "chars")


@query(f"WITH {SIZED}, r AS (SELECT register, count(*) AS available, count(*) FILTER (before < 20000) AS reached, coalesce(sum(tokens) FILTER (before < 20000), 0)::BIGINT AS positions FROM pre GROUP BY 1) SELECT register, available, reached, positions, round(positions / sum(positions) OVER (), 6) AS share FROM r")
def agg_sample_composition(spark, d):
    """What a sample of 20,000 tokens reaches of each register; registers that it misses stay, with 0."""
    x = S.prefix_sum(sized(spark, d), "key", F.col("tokens")).withColumn("in", F.col("before") < 20_000)
    g = x.groupBy("register").agg(F.count("*").alias("available"), F.count_if("in").alias("reached"), F.coalesce(F.sum(F.when(F.col("in"), F.col("tokens"))), F.lit(0)).alias("positions"))
    return g.withColumn("share", F.round(F.col("positions") / F.sum("positions").over(Window.partitionBy()), 6))


@query(f"WITH {SIZED} SELECT sum(tokens + 1)::BIGINT AS identifiers, count(*) AS documents FROM sized")
def agg_token_total(spark, d):
    return sized(spark, d).agg(F.sum(F.col("tokens") + 1).alias("identifiers"), F.count("*").alias("documents"))


@query(f"WITH {SIZED} SELECT doc_id, tokens + 1 AS identifiers FROM sized")
def unit_identifiers(spark, d):
    return sized(spark, d).select("doc_id", (F.col("tokens") + 1).alias("identifiers"))


_UNI = f"{_SPLIT}, u AS (SELECT side, unnest({LOWER}) AS w FROM side JOIN documents USING (doc_id)), c AS (SELECT w, count(*) FILTER (side = 'train') AS n, count(*) FILTER (side = 'test') AS m FROM u GROUP BY 1), k AS (SELECT sum(n) AS total, count(*) AS v FROM c)"


@query(f"WITH {_UNI} SELECT w, n, round(ln((n + 1) / (total + v)), 6) AS logp FROM c, k")
def agg_unigram_fit(spark, d):
    """Add-one unigram log probabilities of words, fitted on train; the vocabulary is that of all sides."""
    return _unigrams(spark, d).select("w", "n", F.round("logp", 6).alias("logp"))


def _unigrams(spark, d):
    side = S.split_documents(docs(spark, d), "doc_id")
    u = docs(spark, d).join(side, "doc_id").select("side", F.explode(T.words_lower(F.col("text"))).alias("w"))
    c = u.groupBy("w").agg(F.count_if(F.col("side") == "train").alias("n"), F.count_if(F.col("side") == "test").alias("m"))
    total, v = c.agg(F.sum("n"), F.count("*")).first()
    return c.withColumn("logp", F.log((F.col("n") + 1) / F.lit(float((total or 0) + v))))


@query(f"WITH {_UNI} SELECT sum(m)::BIGINT AS targets, round(-sum(m * ln((n + 1) / (total + v))) / sum(m), 6) AS nats, round(ln(any_value(v)), 6) AS uniform FROM c, k")
def agg_unigram_xent(spark, d):
    """Cross-entropy of the held-out test side under the unigrams, beside that of a uniform guess."""
    c = _unigrams(spark, d)
    return c.agg(F.sum("m").alias("targets"), F.round(-F.sum(F.col("m") * F.col("logp")) / F.sum("m"), 6).alias("nats"), F.round(F.log(F.count("*")), 6).alias("uniform"))


_DRIFT = "SELECT coalesce(e.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'added' WHEN e.sha256 IS DISTINCT FROM d.sha256 THEN 'changed' ELSE 'same' END AS status"


@query(f"WITH e AS (SELECT path, max(sha256) AS sha256 FROM corpus_manifest GROUP BY 1), d AS (SELECT path, sha256(text) AS sha256 FROM documents) {_DRIFT} FROM e FULL JOIN d ON e.path = d.path")
def verify_corpus_drift(spark, d):
    """Recorded files against present documents by path as written: changed, missing, added or same."""
    e = table(spark, d, "corpus_manifest").groupBy("path").agg(F.max("sha256").alias("recorded"), F.lit(True).alias("listed"))
    x = table(spark, d, "documents").select("path", F.sha2("text", 256).alias("own"), F.lit(True).alias("there"))
    j = e.join(x, "path", "full_outer")
    return j.select("path", F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "added").when(~F.col("recorded").eqNullSafe(F.col("own")), "changed").otherwise("same").alias("status"))


@query("SELECT doc_id, path, sha256(text) AS sha256, strlen(text) AS byte_count, length(text) AS char_count FROM documents WHERE text IS NOT NULL")
def scan_corpus_manifest(spark, d):
    return docs(spark, d).select("doc_id", "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("byte_count"), F.char_length("text").cast("bigint").alias("char_count"))


@query("WITH f AS (SELECT ebook_number, arg_min(sha256, listed_at) AS raw, arg_min(coalesce(ingested_sha256, ''), listed_at) AS ingested FROM catalogue GROUP BY 1) SELECT c.ebook_number, c.listed_at, CASE WHEN c.sha256 = f.raw THEN 'same' WHEN c.ingested_sha256 IS NULL OR f.ingested = '' THEN 'unclassified' WHEN c.ingested_sha256 = f.ingested THEN 'ingested_text_identical' ELSE 'ingested_text_differs' END AS drift FROM catalogue c JOIN f ON f.ebook_number = c.ebook_number")
def catalog_classify_drift(spark, d):
    c = table(spark, d, "catalogue")
    f = c.groupBy("ebook_number").agg(F.min_by("sha256", "listed_at").alias("raw"), F.min_by(F.coalesce("ingested_sha256", F.lit("")), "listed_at").alias("first"))
    drift = F.when(F.col("sha256") == F.col("raw"), "same").when(F.col("ingested_sha256").isNull() | (F.col("first") == ""), "unclassified").when(F.col("ingested_sha256") == F.col("first"), "ingested_text_identical").otherwise("ingested_text_differs")
    return c.join(f, "ebook_number").select("ebook_number", "listed_at", drift.alias("drift"))


@query("WITH latest AS (SELECT DISTINCT sha256 FROM catalogue WHERE listed_at < TIMESTAMP '2026-01-01') SELECT ebook_number, listed_at, sha256 FROM catalogue WHERE sha256 NOT IN (SELECT sha256 FROM latest)")
def catalog_ingest_cached(spark, d):
    """Listings whose raw text was not ingested before 2026: what an incremental run has to do."""
    c = table(spark, d, "catalogue")
    done = c.where("listed_at < timestamp '2026-01-01'").select("sha256").distinct()
    return c.join(done, "sha256", "left_anti").select("ebook_number", "listed_at", "sha256")


@query("SELECT register, slug, rank::INT AS rank FROM (SELECT register, slug, row_number() OVER (PARTITION BY register ORDER BY sha256('rescan|' || slug)) AS rank FROM (SELECT DISTINCT slug, regexp_extract(slug, '^([a-z]+)-pg', 1) AS register FROM catalogue)) WHERE rank <= 5")
def sample_stratified_hash(spark, d):
    """Per register the five works first in a hash order; short registers give all."""
    c = table(spark, d, "catalogue").select("slug", F.regexp_extract("slug", "^([a-z]+)-pg", 1).alias("register")).distinct()
    w = Window.partitionBy("register").orderBy(F.sha2(F.concat(F.lit("rescan|"), "slug"), 256))
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("register", "slug", "rank")


@query("SELECT title, CASE WHEN count(*) FILTER (listed_at = m) = 1 THEN any_value(ebook_number) FILTER (listed_at = m) END AS winner FROM (SELECT *, max(listed_at) OVER (PARTITION BY title) AS m FROM catalogue WHERE title IS NOT NULL) GROUP BY 1")
def most_recent_wins(spark, d):
    """Of the listings of one title the only newest; null where several are."""
    c = table(spark, d, "catalogue").where("title is not null")
    newest = c.groupBy("title").agg(F.max("listed_at").alias("m"))
    j = c.join(newest, "title").groupBy("title").agg(F.count_if(F.col("listed_at") == F.col("m")).alias("n"), F.max(F.when(F.col("listed_at") == F.col("m"), F.col("ebook_number"))).alias("w"))
    return j.select("title", F.when(F.col("n") == 1, F.col("w")).alias("winner"))


@query("SELECT path, snapshot_name, entry_id FROM (SELECT *, max(ingested_at) OVER () AS now FROM corpus_manifest QUALIFY row_number() OVER (PARTITION BY lower(replace(path, chr(92), '/')) ORDER BY ingested_at DESC NULLS LAST, entry_id DESC) = 1) WHERE ingested_at > now - INTERVAL 90 DAY")
def source_fetch_cache(spark, d):
    """The newest entry of each key that was not 90 days old when the last one came: a cache over a log of fetches."""
    m = table(spark, d, "corpus_manifest").withColumn("key", F.lower(F.replace("path", F.lit("\\"), F.lit("/"))))
    now = m.agg(F.max("ingested_at")).first()[0]
    return K.fetch_cache(m, "key", "ingested_at", now, 90 * 86_400, "entry_id").select("path", "snapshot_name", "entry_id")


@query(f"WITH {G.tree_sql('per', 'SELECT phenomenon, lang, ' + G.row_sql('pair_identifier') + ' AS d FROM minimal_pairs', ['phenomenon', 'lang'])} SELECT phenomenon, lang, n AS items, digest FROM per")
def cluster_listing(spark, d):
    """The items of each cluster (phenomenon and language) as a digest."""
    return G.tree_digest(table(spark, d, "minimal_pairs"), ["phenomenon", "lang"], F.col("pair_identifier")).withColumnRenamed("n", "items")


@query("SELECT phenomenon, pair_identifier FROM (SELECT *, row_number() OVER (PARTITION BY phenomenon, lang ORDER BY sha256('7|' || pair_identifier)) AS r1 FROM minimal_pairs) WHERE r1 <= 6 QUALIFY row_number() OVER (PARTITION BY phenomenon ORDER BY sha256('7|' || pair_identifier)) <= 20")
def pick_continuation_items(spark, d):
    """In hash order at most six items of a language and 20 of a phenomenon."""
    key = S.order_key(7, F.col("pair_identifier"))
    x = table(spark, d, "minimal_pairs").withColumn("k", key)
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("phenomenon", "lang").orderBy("k"))).where("r <= 6")
    return x.withColumn("q", F.row_number().over(Window.partitionBy("phenomenon").orderBy("k"))).where("q <= 20").select("phenomenon", "pair_identifier")


@query(f"WITH {G.tree_sql('per', 'SELECT ' + G.row_sql('pair_identifier', 'good', 'bad') + ' AS d FROM minimal_pairs', [])} SELECT n AS items, digest FROM per")
def items_digest(spark, d):
    return G.tree_digest(table(spark, d, "minimal_pairs"), [], F.col("pair_identifier"), F.col("good"), F.col("bad")).withColumnRenamed("n", "items")
