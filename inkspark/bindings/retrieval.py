"""Retrieval over documents and vectors. Queries are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.bindings.text import WORDS
from inkspark.functions import text as T
from inkspark.operators import retrieval as R
from inkspark.operators.joins import spread
from inkspark.plans.registry import query, table

# Function words, which tell no text from another.
STOP = ["a", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "may", "might", "must", "no", "nor", "not", "of", "on", "or", "our", "she", "should", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "too", "us", "was", "we", "were", "what", "when", "where", "which", "who", "whom", "whose", "why", "will", "with", "would", "you", "your"]


def _docs(spark, d):
    return spread(table(spark, d, "documents").where("text is not null"), "doc_id")


def _index(spark, d):
    return R.lexical_index(_docs(spark, d), "doc_id", T.folded(F.col("text")))


def _queries(spark, d):
    return _docs(spark, d).where("doc_id % 100 = 0")


def _lexical(spark, d, k=5):
    """The queries' terms are read from the index, which has them already."""
    idx = _index(spark, d)
    return R.bm25(idx, idx.where(lambda ids: ids.to_numpy() % 100 == 0), "chunk", F.col("terms"), k)


def _by_embedding(spark, d, k=5):
    v = table(spark, d, "embeddings")
    return R.dense(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", k)


INDEX = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, len(list_distinct(w)) AS len FROM w), s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
BM25 = f"""{INDEX}, q AS (SELECT DISTINCT doc_id AS query, unnest(w) AS term FROM w WHERE doc_id % 100 = 0),
 sc AS (SELECT query, tf.doc_id AS chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score, count(*) AS matched FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.doc_id = tf.doc_id CROSS JOIN s GROUP BY 1, 2),
 lex AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank, chunk, score, matched FROM sc QUALIFY rank <= 5)"""


@query(f"WITH {INDEX} SELECT term, df FROM df")
def bm25_index(spark, d):
    return _index(spark, d).terms.select("term", "df")


@query(f"WITH {BM25} SELECT query, rank::INT AS rank, chunk, score, matched FROM lex")
def bm25_retrieve(spark, d):
    """The five best documents for each query document by BM25, itself among the candidates."""
    return _lexical(spark, d)


@query(f"WITH {BM25} SELECT query, rank::INT AS rank, chunk FROM lex")
def win_topk_rank(spark, d):
    return _lexical(spark, d).select("query", "rank", "chunk")


@query(f"WITH {INDEX}, q AS (SELECT DISTINCT doc_id AS query, unnest(w) AS term FROM w WHERE doc_id % 100 = 0), c AS (SELECT doc_id FROM documents WHERE lang = 'en'), sc AS (SELECT query, tf.doc_id AS chunk, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l ON l.doc_id = tf.doc_id JOIN c ON c.doc_id = tf.doc_id CROSS JOIN s GROUP BY 1, 2) SELECT query, (row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk))::INT AS rank, chunk, score FROM sc QUALIFY rank <= 5")
def filter_source_ids(spark, d):
    """Candidates restricted to documents labelled en; the statistics stay those of the whole index."""
    some = _docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("chunk"))
    return R.bm25(_index(spark, d), _queries(spark, d), "doc_id", T.words(F.col("text")), 5, some).select("query", "rank", "chunk", "score")


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v)"
DENSE = f"{_VEC}, ds AS (SELECT q.vec_id AS query, c.vec_id AS chunk, round(list_dot_product(q.e, c.e) / (q.norm * c.norm), 6) AS score FROM u q, u c WHERE q.vec_id % 100 = 0 AND q.norm > 0 AND c.norm > 0), den AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank, chunk, score FROM ds QUALIFY rank <= 5)"


@query(f"WITH {_VEC} SELECT vec_id, len(e) AS dimension, round(norm, 6) AS norm FROM u")
def dense_index(spark, d):
    v = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("vec_id", F.size("embedding").cast("bigint").alias("dimension"), F.round(norm, 6).alias("norm"))


@query(f"WITH {DENSE} SELECT query, rank::INT AS rank, chunk, score FROM den")
def dense_retrieve(spark, d):
    """The five nearest vectors by exact cosine; the query vector stays among the candidates."""
    return _by_embedding(spark, d)


_LETTERS = "list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INT), '')))::DOUBLE)"
_HYB = f"""{BM25}, le AS (SELECT doc_id, {_LETTERS} AS e FROM documents WHERE text IS NOT NULL), lu AS (SELECT doc_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM le WHERE list_dot_product(e, e) > 0),
 near AS (SELECT q.doc_id AS query, d.doc_id AS chunk, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(list_dot_product(q.e, d.e), 6) DESC, d.doc_id) AS rank FROM lu q, lu d WHERE q.doc_id % 100 = 0 QUALIFY rank <= 5),
 fu AS (SELECT coalesce(lex.query, near.query) AS query, coalesce(lex.chunk, near.chunk) AS chunk, lex.rank AS lexical_rank, near.rank AS dense_rank, round(coalesce(1.0::DOUBLE / (60 + lex.rank), 0) + coalesce(1.0::DOUBLE / (60 + near.rank), 0), 12) AS score FROM lex FULL JOIN near ON lex.query = near.query AND lex.chunk = near.chunk),
 hyb AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank, chunk, score, lexical_rank, dense_rank FROM fu QUALIFY rank <= 5)"""


def _by_letters(spark, d, k=5):
    """The nearest documents by their counts of 26 letters, a vector that SQL can make too."""
    low = F.lower("text")
    counts = F.array(*[(F.char_length(low) - F.char_length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)])
    v = _docs(spark, d).select("doc_id", counts.alias("v"))
    return R.dense(v, v.where("doc_id % 100 = 0"), "doc_id", "v", "doc_id", k)


def _hybrid(spark, d):
    return R.fuse(_lexical(spark, d), _by_letters(spark, d))


@query(f"WITH {_HYB} SELECT query, rank::INT AS rank, chunk, round(score, 9) AS score, lexical_rank::INT AS lexical_rank, dense_rank::INT AS dense_rank FROM hyb")
def hybrid_rrf(spark, d):
    """Reciprocal rank fusion of BM25 and a dense ranking of the same documents, by the cosine of their letters."""
    return _hybrid(spark, d).withColumn("score", F.round("score", 9))


@query(f"WITH {BM25} SELECT query, rank::INT AS rank, chunk, score, source, path FROM lex JOIN documents d ON d.doc_id = lex.chunk")
def retrieval_service(spark, d):
    """Results with their sources attached."""
    return _lexical(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "source", "path"), "chunk").select("query", "rank", "chunk", "score", "source", "path")


@query(f"WITH {BM25} SELECT query, count(DISTINCT chunk) AS chunks, count(DISTINCT source) AS sources FROM lex JOIN documents d ON d.doc_id = lex.chunk GROUP BY 1")
def evidence_pack(spark, d):
    """A pack for each query: its chunks and only the sources that they use."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "source")
    return _lexical(spark, d).join(s, "chunk").groupBy("query").agg(F.count_distinct("chunk").alias("chunks"), F.count_distinct("source").alias("sources"))


@query(f"WITH {_HYB}, u AS (SELECT query, chunk, score, 1 AS pack FROM lex UNION ALL SELECT query, chunk, score, 2 FROM hyb) SELECT query, chunk, round(score, 6) AS score, pack FROM u QUALIFY row_number() OVER (PARTITION BY query, chunk ORDER BY pack DESC) = 1")
def pack_merge(spark, d):
    """Packs merged by chunk, the later over the earlier."""
    a = _lexical(spark, d).select("query", "chunk", "score", F.lit(1).alias("pack"))
    b = _hybrid(spark, d).select("query", "chunk", "score", F.lit(2).alias("pack"))
    return a.unionByName(b).groupBy("query", "chunk").agg(F.round(F.max_by("score", "pack"), 6).alias("score"), F.max("pack").alias("pack"))


_REFS = f"""{BM25}, packed AS (SELECT query AS answer, 'chk_' || substr(sha256(chunk::VARCHAR), 1, 16) AS ref FROM lex WHERE rank <= 3), cited AS (SELECT query AS answer, 'chk_' || substr(sha256(chunk::VARCHAR), 1, CASE WHEN rank = 5 THEN 6 ELSE 16 END) AS ref FROM lex WHERE rank >= 2)"""


def _refs(spark, d):
    lex = _lexical(spark, d)
    digest = F.sha2(F.col("chunk").cast("string"), 256)
    packed = lex.where("rank <= 3").select(F.col("query").alias("answer"), F.concat(F.lit("chk_"), F.substring(digest, 1, 16)).alias("ref"))
    cited = lex.where("rank >= 2").select(F.col("query").alias("answer"), F.concat(F.lit("chk_"), F.when(F.col("rank") == 5, F.substring(digest, 1, 6)).otherwise(F.substring(digest, 1, 16))).alias("ref"))
    return cited, packed


@query(f"WITH {_REFS} SELECT c.answer, c.ref, CASE WHEN length(c.ref) <> 20 THEN 'malformed' WHEN p.ref IS NOT NULL THEN 'resolved' ELSE 'unknown' END AS status FROM cited c LEFT JOIN packed p ON c.answer = p.answer AND c.ref = p.ref")
def citations_resolve(spark, d):
    """Answers cite ranks 2 to 5 of a pack that holds ranks 1 to 3; the last citation is cut short."""
    return R.resolve_citations(*_refs(spark, d))


@query(f"WITH {_REFS} SELECT c.answer, count(*) FILTER (length(c.ref) <> 20 OR p.ref IS NULL) AS unresolved FROM cited c LEFT JOIN packed p ON c.answer = p.answer AND c.ref = p.ref GROUP BY 1")
def refs_unresolved_count(spark, d):
    return R.resolve_citations(*_refs(spark, d)).groupBy("answer").agg(F.count_if(F.col("status") != "resolved").alias("unresolved"))


def _claims(spark, d):
    lex = _lexical(spark, d)
    expected = lex.where("rank in (2, 3)").select(F.col("query").alias("claim"), "chunk")
    packed = lex.where("rank <= 3").select("chunk")
    return lex.select(F.col("query").alias("claim"), "chunk"), packed, expected


_VALID = f"{BM25}, packed AS (SELECT DISTINCT chunk FROM lex WHERE rank <= 3), val AS (SELECT query AS claim, lex.chunk, CASE WHEN p.chunk IS NULL THEN 'unknown' WHEN rank IN (2, 3) THEN 'valid' ELSE 'irrelevant' END AS status FROM lex LEFT JOIN packed p ON p.chunk = lex.chunk)"


@query(f"WITH {_VALID} SELECT claim, chunk, status FROM val")
def citations_validate(spark, d):
    return R.validate_citations(*_claims(spark, d))


@query(f"WITH {_VALID} SELECT count(*) AS citations, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'irrelevant') AS irrelevant, (SELECT count(*) FROM lex WHERE rank IN (2, 3)) AS expected, round(coalesce(count(*) FILTER (status = 'valid') / count(*), 1), 6) AS precision, round(coalesce(count(*) FILTER (status = 'valid') / (SELECT count(*) FROM lex WHERE rank IN (2, 3)), 1), 6) AS recall FROM val")
def agg_citation_metrics(spark, d):
    claims, packed, expected = _claims(spark, d)
    return R.citation_metrics(R.validate_citations(claims, packed, expected), expected)


@query(f"WITH {BM25} SELECT query AS claim, chunk FROM lex")
def claim_links(spark, d):
    claims = _lexical(spark, d).groupBy("query").agg(F.collect_list("chunk").alias("cited"))
    return claims.select(F.col("query").alias("claim"), F.explode("cited").alias("chunk"))


_STOPS = "'" + "', '".join("a an and any are as at be been being but by can could did do does for from had has have he her him his how i if in into is it its may might must no nor not of on or our she should so than that the their them then there these they this those to too us was we were what when where which who whom whose why will with would you your".split()) + "'"


@query(f"WITH {BM25}, t AS (SELECT query, term FROM q JOIN df USING (term) CROSS JOIN s WHERE term NOT IN ({_STOPS}) AND df <= 0.25 * n), f AS (SELECT t.query, count(DISTINCT t.term) AS covered FROM t JOIN lex ON lex.query = t.query JOIN tf ON tf.doc_id = lex.chunk AND tf.term = t.term GROUP BY 1), c AS (SELECT query, count(*) AS discriminating FROM t GROUP BY 1) SELECT d.doc_id AS query, coalesce(discriminating, 0) AS discriminating, coalesce(covered, 0) AS covered, coalesce(covered, 0) > 0 AS sufficient FROM documents d LEFT JOIN c ON c.query = d.doc_id LEFT JOIN f ON f.query = d.doc_id WHERE d.doc_id % 100 = 0 AND d.text IS NOT NULL")
def sufficiency(spark, d):
    idx = _index(spark, d)
    qs = _queries(spark, d)
    return R.sufficient(qs, idx, R.bm25(idx, qs, "doc_id", T.words(F.col("text"))), "doc_id", T.words(F.col("text")), STOP)


def _cases(spark, d, results):
    """Gold is what has the query's source: counted per source, and read off the retrieved chunks, so it is never listed."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("of"))
    per = table(spark, d, "documents").where("source is not null").groupBy("source").agg((F.count("*") - 1).alias("gold_size"))
    qs = _queries(spark, d).select(F.col("doc_id").alias("query"), "source")
    r = results.join(docs, "chunk").join(qs, "query")
    itself = F.col("chunk") == F.col("query")
    judged = r.select("query", "chunk", "rank", (~itself & F.coalesce(F.col("of") == F.col("source"), F.lit(False))).alias("good"), itself.alias("bad"))
    return R.judged_metrics(judged, qs.join(per, "source", "left").select("query", "gold_size"))


def _case_sql(rows: str) -> str:
    return f"qs AS (SELECT doc_id AS query, source FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL), gold AS (SELECT query, d.doc_id AS chunk FROM qs JOIN documents d ON d.source = qs.source AND d.doc_id <> qs.query), gs AS (SELECT query, count(*) AS gold_size FROM gold GROUP BY 1), per AS (SELECT r.query, count(*) AS retrieved, count(g.chunk) AS hits, count(*) FILTER (r.chunk = r.query) AS forbidden_hits, min(r.rank) FILTER (g.chunk IS NOT NULL) AS first FROM {rows} r LEFT JOIN gold g ON g.query = r.query AND g.chunk = r.chunk GROUP BY 1), cm AS (SELECT qs.query, coalesce(gold_size, 0) AS gold_size, round(coalesce(hits / gold_size, 0), 6) AS recall, round(coalesce(hits / nullif(retrieved, 0), 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, coalesce(hits, 0) > 0 AS hit, coalesce(forbidden_hits, 0) AS forbidden_hits, coalesce(retrieved, 0) AS retrieved FROM qs LEFT JOIN per USING (query) LEFT JOIN gs USING (query))"


_RUN = "count(*) AS cases, count(*) FILTER (gold_size > 0) AS scored, round(avg(recall) FILTER (gold_size > 0), 6) AS recall, round(avg(precision) FILTER (gold_size > 0), 6) AS precision, round(avg(reciprocal_rank) FILTER (gold_size > 0), 6) AS mrr, round(avg(hit::INT) FILTER (gold_size > 0), 6) AS hit_rate, sum(forbidden_hits)::BIGINT AS forbidden_hits, count(*) FILTER (gold_size = 0 AND retrieved > 0) AS false_retrievals"


@query(f"WITH {BM25}, {_case_sql('lex')} SELECT * FROM cm")
def agg_retrieval_case(spark, d):
    """Gold are the other documents of the query's source; the query itself is forbidden."""
    return _cases(spark, d, _lexical(spark, d))


@query(f"WITH {BM25}, {_case_sql('lex')} SELECT {_RUN} FROM cm")
def agg_retrieval_run(spark, d):
    return R.run_metrics(_cases(spark, d, _lexical(spark, d)))


@query(f"WITH {_HYB}, a AS (WITH {_case_sql('lex')} SELECT {_RUN} FROM cm), b AS (WITH {_case_sql('hyb')} SELECT {_RUN} FROM cm) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(a.{m}, 6) AS baseline, round(b.{m}, 6) AS candidate, round(b.{m} - a.{m}, 6) AS delta, CASE WHEN b.{m} > a.{m} THEN 'better' WHEN b.{m} < a.{m} THEN 'worse' ELSE 'equal' END AS direction FROM a, b" for m in ("recall", "precision", "mrr", "hit_rate")))
def compare_strategies(spark, d):
    """The hybrid ranking against BM25, metric by metric."""
    names = ["recall", "precision", "mrr", "hit_rate"]
    flat = lambda r, v: R.run_metrics(_cases(spark, d, r)).unpivot([], names, "metric", v)
    x = flat(_lexical(spark, d), "baseline").join(flat(_hybrid(spark, d), "candidate"), "metric").withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6))
    return x.withColumn("direction", F.when(F.col("candidate") > F.col("baseline"), "better").when(F.col("candidate") < F.col("baseline"), "worse").otherwise("equal"))


_W8 = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_G = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(list_slice(w, i, i + {0} - 1), ' '))"


@query(f"WITH w AS (SELECT doc_id, coalesce(lang, '') = 'en' AS train, {_W8.format('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, train, unnest(list_distinct({_G.format(8)})) AS g FROM w), seen AS (SELECT DISTINCT g FROM g WHERE train), p AS (SELECT doc_id, count(*) AS windows, count(s.g) AS shared FROM g LEFT JOIN seen s USING (g) WHERE NOT train GROUP BY 1) SELECT w.doc_id, coalesce(windows, 0) AS windows, coalesce(shared, 0) AS shared, round(shared / windows, 6) AS ratio FROM w LEFT JOIN p USING (doc_id) WHERE NOT train")
def overlap_train_heldout(spark, d):
    """Eight-word windows of documents not labelled en (held out) that occur in those that are (training)."""
    docs = _docs(spark, d).withColumn("train", F.coalesce(F.col("lang"), F.lit("")) == "en")
    return R.overlap(docs.where("train"), docs.where("not train"), "doc_id", T.grams(T.words_lower(F.col("text")), 8))


@query(f"WITH w AS (SELECT {_W8.format('text')} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT unnest({_G.format(5)}) AS g FROM w), p AS (SELECT pair_identifier, {_W8.format('good')} AS w FROM minimal_pairs), q AS (SELECT pair_identifier, unnest({_G.format(5)}) AS g FROM p) SELECT DISTINCT pair_identifier FROM q WHERE g IN (SELECT g FROM t)")
def contaminated_pairs(spark, d):
    """Items whose good text shares five words in a row with any document."""
    words = lambda c: T.grams(T.words_lower(F.col(c)), 5)
    return R.contaminated(table(spark, d, "minimal_pairs"), "pair_identifier", words("good"), _docs(spark, d), words("text"))


@query("SELECT ebook_number, title, author FROM catalogue QUALIFY row_number() OVER (PARTITION BY ebook_number ORDER BY listed_at DESC, url, title, author) = 1")
def corpus_lookup(spark, d):
    """The last listing of each work: adding a source again replaces it."""
    from pyspark.sql import Window

    w = Window.partitionBy("ebook_number").orderBy(F.col("listed_at").desc(), F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("author").asc_nulls_last())
    return table(spark, d, "catalogue").withColumn("n", F.row_number().over(w)).where("n = 1").select("ebook_number", "title", "author")
