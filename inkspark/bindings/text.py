"""Text columns over whole documents: normalization, words, n-grams, claims, references, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.functions import notation as N
from inkspark.functions import text as T
from inkspark.functions import udfs as U
from inkspark.operators.joins import spread
from inkspark.plans.registry import query, table

WORDS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')"
LOWER = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
TOKENS = "regexp_extract_all(text, '[^ \\t\\n\\r]+')"
LF = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


def grams_sql(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))"


def docs(spark, d):
    return spread(table(spark, d, "documents").where("text is not null"), "doc_id")


@query(f"SELECT doc_id, sha256({LF}) AS digest, length({LF}) AS n_chars FROM documents WHERE text IS NOT NULL")
def norm_line_endings(spark, d):
    t = T.line_endings(F.col("text"))
    return docs(spark, d).select("doc_id", T.sha(t).alias("digest"), F.char_length(t).cast("bigint").alias("n_chars"))


_NORMAL = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({LF}), '(?m)[ \\t]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\n+|\\n+\\z', '', 'g')"


@query(f"SELECT doc_id, sha256(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, {_NORMAL} AS t FROM documents WHERE text IS NOT NULL)")
def norm_document(spark, d):
    t = docs(spark, d).select("doc_id", T.normal_document(U.nfc("text")).alias("t"))
    return t.select("doc_id", T.sha(F.col("t")).alias("digest"), F.char_length("t").cast("bigint").alias("n_chars"))


@query("SELECT pair_identifier, trim(regexp_replace(trim(regexp_replace(good, '[ \\t\\n\\r]+', ' ', 'g')), '[?!.;:,]+$', '')) AS normal FROM minimal_pairs")
def norm_query(spark, d):
    return table(spark, d, "minimal_pairs").select("pair_identifier", T.normal_query(U.nfc("good")).alias("normal"))


@query(f"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)")
def tok_words(spark, d):
    w = T.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query("SELECT pair_identifier, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(replace(lower(good), 'ß', 'ss'), '[^ \\t\\n\\r]+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')), lambda t: t <> ''))), ' ') AS tokens FROM minimal_pairs")
def tok_planner(spark, d):
    return table(spark, d, "minimal_pairs").select("pair_identifier", F.array_join(F.array_sort(T.planner_tokens(F.col("good"))), " ").alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''’]+')) AS n FROM documents WHERE text IS NOT NULL")
def tok_words_apos(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.words_apostrophe(F.col("text"))).cast("bigint").alias("n"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, list_sort(list_distinct({grams_sql('w', 5)})) AS g FROM t) SELECT doc_id, len(g) AS n, sha256(array_to_string(g, '|')) AS digest FROM s")
def shingle_words(spark, d):
    g = docs(spark, d).select("doc_id", F.array_sort(T.shingles(F.col("text"), 5)).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n"), T.sha(F.array_join("g", "|")).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, {LOWER} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(list_distinct({grams_sql('w', 8)})) AS g FROM t) SELECT doc_id, count(*) AS n, min(substr(sha256(g), 1, 16)) AS least FROM g GROUP BY 1")
def ngram_hash_words(spark, d):
    """Sorted unique hashes of eight-word windows; sha-256 digits stand for the 64-bit hash, so that SQL can check them."""
    g = docs(spark, d).select("doc_id", F.explode(F.array_distinct(T.grams(T.words_lower(F.col("text")), 8))).alias("g"))
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.substring(F.sha2("g", 256), 1, 16)).alias("least"))


@query("WITH g AS (SELECT doc_id, length(text) - 2 AS k, list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) AS g FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN k >= 4 THEN round(1 - len(list_distinct(g)) / k, 6) END AS ratio FROM g")
def ngram_char(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.char_repetition(F.col("text"), 3), 6).alias("ratio"))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_''’]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, " + ", ".join(f"CASE WHEN len(w) >= 8 THEN round(len(list_distinct({grams_sql('w', n)})) / (len(w) - {n} + 1), 6) END AS distinct_{n}" for n in (1, 2, 3)) + " FROM t")
def distinct_n(spark, d):
    t = docs(spark, d).select("doc_id", T.words_apostrophe(F.col("text")).alias("w"))
    return t.select("doc_id", *[F.round(T.distinct_ratio(F.col("w"), n), 6).alias(f"distinct_{n}") for n in (1, 2, 3)])


# a bell character in a text is written as bell 0, so that bell 1 can be the mark
_CLAIMS = "SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(7), chr(7) || '0'), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(7) || '1', 'g'), chr(7) || '1'), lambda s: replace(regexp_replace(s, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), chr(7) || '0', chr(7))), lambda s: s <> '') AS c FROM documents WHERE text IS NOT NULL"


@query(f"WITH c AS ({_CLAIMS}), e AS (SELECT doc_id, unnest(c) AS claim, generate_subscripts(c, 1) - 1 AS position FROM c) SELECT doc_id, position::BIGINT AS position, 'clm_' || substr(sha256(doc_id || chr(31) || position || chr(31) || claim), 1, 16) AS claim_id FROM e")
def claims_sentence(spark, d):
    """Claims of every text."""
    c = docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "claim"))
    return c.select("doc_id", F.col("position").cast("bigint").alias("position"), T.claim_id(F.col("doc_id").cast("string"), F.col("position"), F.col("claim")).alias("claim_id"))


@query("SELECT entry_id, sha256(concat_ws(chr(31), path, sha256)) AS digest, substr(sha256(concat_ws(chr(31), path, sha256)), 1, 16) AS short FROM corpus_manifest")
def hash_sha256(spark, d):
    j = F.concat_ws(T.UNIT, "path", "sha256")
    return table(spark, d, "corpus_manifest").select("entry_id", F.sha2(j, 256).alias("digest"), T.short_sha(F.col("path"), F.col("sha256")).alias("short"))


@query("SELECT doc_id, 'src_' || substr(sha256('file:' || path || chr(31) || sha256(text)), 1, 16) AS source_id FROM documents WHERE text IS NOT NULL")
def id_source(spark, d):
    return docs(spark, d).select("doc_id", T.source_id(F.concat(F.lit("file:"), "path"), F.col("text")).alias("source_id"))


@query("SELECT doc_id, 'chk_' || substr(sha256(path || chr(31) || '0' || chr(31) || text), 1, 16) AS chunk_id FROM documents WHERE text IS NOT NULL")
def id_chunk(spark, d):
    return docs(spark, d).select("doc_id", T.chunk_id(F.col("path"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT pair_identifier, 'clm_' || substr(sha256(pair_identifier || chr(31) || '0' || chr(31) || good), 1, 16) AS claim_id FROM minimal_pairs")
def id_claim(spark, d):
    return table(spark, d, "minimal_pairs").select("pair_identifier", T.claim_id(F.col("pair_identifier"), F.lit(0), F.col("good")).alias("claim_id"))


@query("SELECT entry_id, regexp_full_match('src_' || substr(sha256, 1, 16), 'src_[0-9a-f]{16}') AS valid FROM corpus_manifest WHERE sha256 IS NOT NULL")
def id_validate(spark, d):
    return table(spark, d, "corpus_manifest").where("sha256 is not null").select("entry_id", T.valid_id(F.concat(F.lit("src_"), F.substring("sha256", 1, 16)), "src").alias("valid"))


@query("SELECT e.entry_id, (e.sha256 IS NOT DISTINCT FROM sha256(d.text)) AS matches FROM corpus_manifest e JOIN documents d ON d.path = e.path WHERE d.text IS NOT NULL")
def content_match(spark, d):
    e = table(spark, d, "corpus_manifest").select("entry_id", "path", "sha256")
    x = docs(spark, d).select("path", T.sha(F.col("text")).alias("own"))
    return e.join(x, "path").select("entry_id", F.col("sha256").eqNullSafe(F.col("own")).alias("matches"))


@query("SELECT doc_id, CASE WHEN starts_with(path, './') OR contains(path, '/') THEN 'file' ELSE 'text' END AS kind, 'file:' || path AS reference FROM documents")
def source_reference(spark, d):
    p = F.col("path")
    return table(spark, d, "documents").select("doc_id", F.when(p.startswith("./") | p.contains("/"), "file").otherwise("text").alias("kind"), F.concat(F.lit("file:"), p).alias("reference"))


_PARAMS = ["fbclid", "gclid", "dclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "referrer", "source", "spm", "yclid", "_ga", "_gl", "utm_source", "page", "gbraid"]
_CANON = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"WITH c AS (SELECT ebook_number, listed_at, {_CANON} AS base FROM catalogue WHERE url IS NOT NULL), p AS (SELECT unnest(['fbclid', 'gclid', 'dclid', 'msclkid', 'igshid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'referrer', 'source', 'spm', 'yclid', '_ga', '_gl', 'utm_source', 'page', 'gbraid']) AS name) SELECT ebook_number, listed_at, name, base || '?a=1&b=x y' || CASE name WHEN 'page' THEN '&page=7' WHEN 'gbraid' THEN '&gbraid=7' ELSE '' END AS canonical FROM c, p")
def url_canonicalize(spark, d):
    """Every listed address with each of 18 parameters beside two others, in upper-case scheme, with a slash and a fragment."""
    t = table(spark, d, "catalogue").where("url is not null").select("ebook_number", "listed_at", "url", F.explode(F.array(*map(F.lit, _PARAMS))).alias("name"))
    shown = F.concat(F.replace("url", F.lit("https://"), F.lit("HTTPS://")), F.lit("/?b=x+y&"), F.upper("name"), F.lit("=7&a=1#top"))
    plain = F.concat("url", F.lit("/?b=x%20y&"), "name", F.lit("=7&a=1"))
    return t.select("ebook_number", "listed_at", "name", T.canonical_url(F.when(F.col("name").isin("page", "gbraid"), plain).otherwise(shown)).alias("canonical"))


@query("SELECT lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1)) AS host, count(*) AS n, count(*) FILTER (starts_with(lower(url), 'https://')) AS allowed, 0::BIGINT AS blocked FROM catalogue WHERE url IS NOT NULL GROUP BY 1")
def url_host(spark, d):
    h = table(spark, d, "catalogue").where("url is not null").select(T.url_host(F.col("url")).alias("host"), T.scheme_allowed(F.col("url")).alias("ok"))
    return h.groupBy("host").agg(F.count("*").alias("n"), F.count_if("ok").alias("allowed"), F.count_if(T.blocked_host(F.col("host"))).alias("blocked"))


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{61c}]', '?', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def safe_terminal(spark, d):
    return docs(spark, d).select("doc_id", T.sha(T.safe_terminal(F.col("text"))).alias("digest"))


@query(f"WITH c AS (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS c FROM documents WHERE text IS NOT NULL AND text <> ''), v AS (SELECT DISTINCT c FROM c) SELECT unicode(c)::BIGINT AS code, row_number() OVER (ORDER BY unicode(c)) AS id FROM v")
def vocab_char(spark, d):
    """Distinct characters with ids from 1 in code point order; the vocabulary is bounded by Unicode, so one window serves."""
    from pyspark.sql import Window

    c = docs(spark, d).select(F.explode(F.array_distinct(T.chars(F.col("text")))).alias("c")).distinct().select(F.expr("conv(hex(encode(c, 'UTF-32')), 16, 10)").cast("bigint").alias("code"))
    return c.select("code", F.row_number().over(Window.orderBy("code")).cast("bigint").alias("id"))


@query("WITH w AS (SELECT pair_identifier, unnest(range(1, length(good) + 1)) AS i, good FROM minimal_pairs) SELECT pair_identifier, i AS position, substr('        ' || good, i::BIGINT, 8) AS context, substr(good, i::BIGINT, 1) AS target FROM w")
def char_windows(spark, d):
    """Sliding (context, target) examples of context 8, padded on the left with blanks for the unknown id."""
    t = table(spark, d, "minimal_pairs").select("pair_identifier", "good", F.explode(F.sequence(F.lit(1), F.char_length("good"))).alias("i"))
    return t.select("pair_identifier", F.col("i").cast("bigint").alias("position"), F.substring(F.concat(F.lit(" " * 8), "good"), F.col("i"), F.lit(8)).alias("context"), F.substring("good", F.col("i"), F.lit(1)).alias("target"))


@query("SELECT doc_id, len(regexp_extract_all(text, ' ?[\\p{L}]+| ?[\\p{N}]+| ?[^ \\t\\n\\r\\p{L}\\p{N}]+|[ \\t\\n\\r]+')) AS pieces FROM documents WHERE text IS NOT NULL")
def pretokenize(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"( ?[\p{L}]+| ?[\p{N}]+| ?[^ \t\n\r\p{L}\p{N}]+|[ \t\n\r]+)"), F.lit(1))).cast("bigint").alias("pieces"))


@query("SELECT doc_id, CASE WHEN register IS NULL OR trim(register) = '' THEN regexp_extract(path, '^([a-z]+)-pg', 1) ELSE lower(trim(register)) END AS register FROM documents")
def filter_register_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", N.register_of(F.col("register"), F.col("path")).alias("register"))


@query("SELECT pair_identifier, regexp_extract_all('see src_' || substr(sha256(good), 1, 16) || ' and chk_' || substr(sha256(bad), 1, 8) || '.', '(?:src|chk)_[0-9a-fA-F]{4,}') AS refs FROM minimal_pairs")
def refs_find(spark, d):
    text = F.concat(F.lit("see src_"), F.substring(F.sha2("good", 256), 1, 16), F.lit(" and chk_"), F.substring(F.sha2("bad", 256), 1, 8), F.lit("."))
    return table(spark, d, "minimal_pairs").select("pair_identifier", T.references(text).alias("refs"))


@query("SELECT pair_identifier, CASE WHEN lang = 'en' THEN 'no_target' WHEN lang IN ('de', 'fr') THEN 'explicit' ELSE 'ambiguous' END AS verdict FROM minimal_pairs")
def refs_answer(spark, d):
    one, two = (F.concat(F.lit("ans_"), F.substring(F.sha2(c, 256), 1, 16)) for c in ("good", "bad"))
    message = F.when(F.col("lang") == "en", F.col("good")).when(F.col("lang").isin("de", "fr"), F.concat(F.lit("check "), one, F.lit(", "), one)).otherwise(F.concat_ws(" ", one, two))
    return table(spark, d, "minimal_pairs").select("pair_identifier", T.reassessment(message).alias("verdict"))


@query(None)
def text_stats(spark, d):
    """Words, distinct n-grams, tail loop, periodic runs and longest repeated block of every text."""
    t = docs(spark, d).select("doc_id", "text", T.words_apostrophe(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("bigint").alias("words"), *[F.round(T.distinct_ratio(F.col("w"), n), 6).alias(f"distinct_{n}") for n in (1, 2, 3)], U.loops("text").alias("loops")).select("doc_id", "words", "distinct_1", "distinct_2", "distinct_3", "loops.tail_period", "loops.periodic_repeats", "loops.replacement_chars")


@query(None)
def sections_split(spark, d):
    s = docs(spark, d).select("doc_id", F.posexplode(U.sections("text")).alias("position", "s"))
    return s.select("doc_id", F.col("position").cast("bigint").alias("position"), "s.heading", T.sha(F.col("s.body")).alias("digest"))


@query(None)
def chunk_paragraphs_pack(spark, d):
    """Chunks of 800 characters or so, none above 2,000, none across sections; oversized paragraphs are cut at sentences."""
    s = docs(spark, d).select("doc_id", F.posexplode(U.chunks("text")).alias("position", "c"))
    return s.select("doc_id", F.col("position").cast("bigint").alias("position"), "c.heading", F.char_length("c.body").cast("bigint").alias("n_chars"), T.sha(F.col("c.body")).alias("digest"))


_PAGE = f"""'# ' || coalesce(source, '') || chr(10) || chr(10) || chr(10) || text || chr(10) || chr(10) || 'left' || chr(10) || chr(10) || 'right'"""


@query(f"WITH p AS (SELECT doc_id, trim(coalesce(source, '')) AS title, {_PAGE} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, title, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, title, {_NORMAL} AS t FROM p)")
def html_to_text(spark, d):
    """Every document set as a page with a script and a table, and read back: its title and its visible text, normalized."""
    name = F.coalesce("source", F.lit(""))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>"), name, F.lit("</title><style>p{}</style></head><body><h1>"), name, F.lit("</h1><p>"), escaped, F.lit("</p><script>no()</script><table><tr><td>left</td><td>right</td></tr></table></body></html>"))
    t = docs(spark, d).select("doc_id", U.html_text(page).alias("h")).select("doc_id", "h.title", T.normal_document(U.nfc("h.text")).alias("t"))
    return t.select("doc_id", "title", F.char_length("t").cast("bigint").alias("n_chars"), T.sha(F.col("t")).alias("digest"))


@query(None)
def embed_hash_bow(spark, d):
    return docs(spark, d).select("doc_id", U.hash_embedding("text").alias("embedding"))
