"""Sources and sinks by round trips: tables are written to the shared folder, read back by the connector, and compared with the table.

Documents are files under their paths; raw works are files ``pg<doc_id>.txt`` with a header and markers around the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from inkspark.bindings.corpus import docs
from inkspark.bindings.text import _NORMAL, LF
from inkspark.functions import text as T
from inkspark.functions import udfs as U
from inkspark.operators import digests as G
from inkspark.plans.lineage import cut, shared_folder
from inkspark.plans.registry import query, table
from inkspark.sources import files as L
from inkspark.sources import stores as K


def _room(spark) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _written(spark, df, path="path", content="content") -> str:
    """The rows as files below a new folder."""
    root = _room(spark)
    L.write_files(df, root, path, content).agg(F.sum("bytes")).collect()
    return _local(root)


def _corpus(spark, d) -> str:
    return _written(spark, docs(spark, d).select("path", F.col("text").alias("content")))


def _raw(spark, d):
    """(doc_id, raw): texts as raw works, with a header, markers and end matter."""
    lines = F.concat(F.lit("Title: "), F.coalesce("source", F.lit("")), F.lit("\r\nAuthor: The author of "), F.coalesce("register", F.lit("")), F.lit("\r\nLicence: free\r\n\r\n*** START OF THE TEXT ***\r\n\r\n"), "text", F.lit("\r\n\r\n*** END OF THE TEXT ***\r\nTitle: none\r\n"))
    return docs(spark, d).select("doc_id", "source", lines.alias("raw"))


_CR = "chr(13) || chr(10)"
_RAW = f"rw AS (SELECT doc_id, 'Title: ' || coalesce(source, '') || {_CR} || 'Author: The author of ' || coalesce(register, '') || {_CR} || 'Licence: free' || {_CR} || {_CR} || '*** START OF THE TEXT ***' || {_CR} || {_CR} || text || {_CR} || {_CR} || '*** END OF THE TEXT ***' || {_CR} || 'Title: none' || {_CR} AS raw, source, register FROM documents WHERE text IS NOT NULL), lf AS (SELECT *, regexp_replace(raw, '\\r\\n?', chr(10), 'g') AS t FROM rw), bd AS (SELECT *, regexp_replace(regexp_extract(t, '(?s)(?:^|\\n)\\*\\*\\* ?START OF[^\\n]*\\n(.*?)\\n\\*\\*\\* ?END OF', 1), '\\A\\n+|\\n+\\z', '', 'g') || chr(10) AS body FROM lf)"
_PARAGRAPHS = "list_filter(list_transform(string_split_regex({0}, '\\n[ \\t]*\\n'), lambda p: regexp_replace(p, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')), lambda p: p <> '')"


@query("SELECT path, strlen(text) AS length FROM documents WHERE text IS NOT NULL")
def scan_discover_files(spark, d):
    """The documents as files, found again with their sizes."""
    return L.discover(spark, _corpus(spark, d)).select("path", "length")


@query("SELECT path, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def sink_atomic_write(spark, d):
    """The documents as files, each moved to its place when whole; what is found there afterwards."""
    return L.all_files(spark, _corpus(spark, d)).select("path", F.col("length").alias("bytes"))


_LF_ROWS = f"SELECT path, sha256({LF}) AS sha256, strlen({LF}) AS byte_count, length({LF}) AS char_count FROM documents WHERE text IS NOT NULL"


@query(_LF_ROWS)
def sink_manifest_save(spark, d):
    """The manifest of the files, saved without their texts and loaded."""
    L.save_manifest(L.manifest(spark, _corpus(spark, d)), path := _room(spark))
    return L.load_manifest(spark, path)


@query(_LF_ROWS)
def sink_snapshot_write(spark, d):
    """The files as a snapshot, whose documents are read as plain Parquet."""
    L.write_snapshot(L.manifest(spark, _corpus(spark, d)), path := _room(spark), {"tool": "files"})
    return spark.read.parquet(f"{path}/documents").drop("text")


@query(f"SELECT path, sha256({LF}) AS sha256, length({LF}) AS char_count FROM documents WHERE text IS NOT NULL")
def source_snapshot_read(spark, d):
    """A snapshot of the files, read once every digest is right."""
    L.write_snapshot(L.manifest(spark, _corpus(spark, d)), path := _room(spark))
    return L.read_snapshot(spark, path).select("path", F.sha2("text", 256).alias("sha256"), "char_count")


@query(f"WITH {_RAW} SELECT doc_id, sha256(body) AS digest, length(body) AS n_chars FROM bd")
def source_strip_wrappers(spark, d):
    body = T.strip_wrappers(F.col("raw"))
    return _raw(spark, d).select("doc_id", F.sha2(body, 256).alias("digest"), F.char_length(body).cast("bigint").alias("n_chars"))


@query("SELECT doc_id, trim(coalesce(source, '')) AS title, trim('The author of ' || coalesce(register, '')) AS author, 'free' AS licence, sha256('pg' || doc_id || chr(31) || coalesce(source, '')) AS mark FROM documents WHERE text IS NOT NULL")
def source_header_fields(spark, d):
    """Title, author and licence of the header lines before the start marker."""
    head = F.substring_index(T.line_endings(F.col("raw")), "*** START OF", 1)
    mark = F.sha2(F.concat_ws(T.UNIT, F.concat(F.lit("pg"), F.col("doc_id").cast("string")), F.coalesce("source", F.lit(""))), 256)
    return _raw(spark, d).select("doc_id", *[T.header_field(head, n.capitalize()).alias(n) for n in ("title", "author", "licence")], mark.alias("mark"))


@query(f"WITH {_RAW}, ps AS (SELECT doc_id, {_PARAGRAPHS.format('body')} AS p FROM bd) SELECT 'pg' || doc_id || '/part-0001.md' AS path, sha256(array_to_string(p, chr(10) || chr(10))) AS sha256, length(array_to_string(p, chr(10) || chr(10))) AS char_count FROM ps WHERE len(p) > 0")
def source_build_manifest(spark, d):
    """Raw works to documents of whole paragraphs; the bound is above any text here, so each work is one document."""
    w = _raw(spark, d).select(F.concat(F.lit("pg"), F.col("doc_id").cast("string")).alias("slug"), "raw")
    return L.build_works(w, "slug", "raw", 1 << 30).select("path", "sha256", "char_count")


def _declared(spark, d) -> tuple[str, object]:
    root = _written(spark, _raw(spark, d).select(F.format_string("pg%d.txt", "doc_id").alias("path"), F.col("raw").alias("content")))
    return root, L.declare_folder(spark, root)


@query(f"WITH {_RAW} SELECT 'pg' || doc_id AS slug, doc_id AS ebook_number, sha256(raw) AS sha256, trim(coalesce(source, '')) AS title, trim('The author of ' || coalesce(register, '')) AS author, sha256(body) AS ingested_sha256 FROM bd")
def catalog_declare_dir(spark, d):
    """A catalogue of what a folder of raw works says of itself."""
    return _declared(spark, d)[1]


@query(f"WITH {_RAW}, ps AS (SELECT doc_id, {_PARAGRAPHS.format('body')} AS p FROM bd) SELECT 'pg' || doc_id || '/part-0001.md' AS path, sha256(array_to_string(p, chr(10) || chr(10))) AS sha256 FROM ps WHERE len(p) > 0")
def catalog_pin(spark, d):
    """A declared folder pinned: digests checked, bodies cut into documents, written and read back as a snapshot."""
    root, declared = _declared(spark, d)
    return L.pin(spark, cut(declared), root, _room(spark), most=1 << 30).select("path", "sha256")


@query("SELECT path, sha256, status FROM (SELECT DISTINCT m.path, m.sha256, CASE WHEN d.path IS NULL THEN 'missing' WHEN m.sha256 IS NOT DISTINCT FROM sha256(d.text) THEN 'match' ELSE 'mismatch' END AS status FROM corpus_manifest m LEFT JOIN (SELECT path, text FROM documents WHERE text IS NOT NULL) d ON d.path = m.path)")
def catalog_verify_raw(spark, d):
    """The digests that the manifest records against the bytes of the files."""
    return L.raw_status(table(spark, d, "corpus_manifest"), L.all_files(spark, _corpus(spark, d)))


@query(f"WITH n AS (SELECT path, {_NORMAL} AS t FROM (SELECT path, regexp_replace(text, '^\\x{{feff}}', '') AS text FROM documents WHERE text IS NOT NULL)) SELECT 'src_' || substr(sha256('file:' || path || chr(31) || sha256(t)), 1, 16) AS source_id, 'file:' || path AS reference, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS title, sha256(t) AS content_hash FROM n")
def source_ingest_file(spark, d):
    """The sources of the files; their chunks are those of chunk_paragraphs_pack."""
    return L.ingest(L.discover(spark, _corpus(spark, d)))[0]


_PAGES = "pg AS (SELECT 'https://pages.example/' || doc_id AS url, trim(coalesce(source, '')) AS title, text FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_PAGES}, n AS (SELECT url, title, {_NORMAL} AS t FROM pg) SELECT 'src_' || substr(sha256('web:' || url || chr(31) || sha256(t)), 1, 16) AS source_id, 'web:' || url AS reference, title, sha256(t) AS content_hash FROM n")
def source_ingest_web(spark, d):
    """The sources of the documents as pages, under addresses with tracking parameters."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<title>"), F.coalesce("source", F.lit("")), F.lit("</title><p>"), escaped, F.lit("</p>"))
    pages = docs(spark, d).select(F.concat(F.lit("https://PAGES.example/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x#a")).alias("url"), page.alias("html"))
    return L.ingest_pages(pages)[0]


_SHELF = "sh AS (SELECT slug, ebook_number, coalesce(url, '') AS url, sha256, title, coalesce(author, '') AS author, NULL::VARCHAR AS licence, ingested_sha256 FROM catalogue WHERE slug IS NOT NULL AND title IS NOT NULL AND sha256 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY listed_at, sha256, title) = 1)"


def _shelf(spark, d):
    c = table(spark, d, "catalogue").where("slug is not null and title is not null and sha256 is not null")
    first = c.groupBy("slug").agg(F.min_by(F.struct("ebook_number", "url", "sha256", "title", "author", "ingested_sha256"), F.struct("listed_at", "sha256", "title")).alias("s")).select("slug", "s.*")
    return first.select("slug", "ebook_number", F.coalesce("url", F.lit("")).alias("url"), "sha256", "title", F.coalesce("author", F.lit("")).alias("author"), F.lit(None).cast("string").alias("licence"), "ingested_sha256")


@query(f"WITH {_SHELF} SELECT * FROM sh")
def source_catalog_toml(spark, d):
    """The first listing of each work as a catalogue file, and read. Such a file is one machine's: more than 100,000 works are an error."""
    K.write_catalogue(_shelf(spark, d), path := _local(_room(spark)) + ".toml")
    return K.read_catalogue(spark, path)


@query(f"WITH {_SHELF} SELECT count(*) * 8 - count(*) FILTER (licence IS NULL) - count(*) FILTER (ingested_sha256 IS NULL) AS fields, count(*) AS sources FROM sh")
def sink_catalog_toml(spark, d):
    """The lines of a catalogue file."""
    K.write_catalogue(_shelf(spark, d), path := _local(_room(spark)) + ".toml")
    lines = spark.read.text(path)
    return lines.agg(F.count_if(F.col("value").rlike("^[a-z0-9_]+ = ")).alias("fields"), F.count_if(F.col("value") == "[[source]]").alias("sources"))


def _archive(spark, d) -> str:
    files = docs(spark, d).select("path", F.encode("text", "UTF-8").alias("content"))
    K.write_archive(files, path := _local(_room(spark)) + ".tar.gz")
    return path


@query("SELECT count(*) AS members, sum(strlen(text))::BIGINT AS bytes, true AS same FROM documents WHERE text IS NOT NULL")
def source_archive_write(spark, d):
    """An archive of the documents: its members, and that a second one has the same bytes. An archive is one machine's: above its bound
    of bytes it is an error."""
    first, second = _archive(spark, d), _archive(spark, d)
    same = open(first, "rb").read() == open(second, "rb").read()
    return K.read_archive(spark, first).agg(F.count("*").alias("members"), F.sum(F.length("content")).alias("bytes"), F.lit(same).alias("same"))


@query("SELECT path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def source_archive_extract(spark, d):
    """An archive's members, written out as files and found."""
    root = _written(spark, K.read_archive(spark, _archive(spark, d)))
    return L.discover(spark, root).select("path", F.sha2("content", 256).alias("sha256"))


_FIRST = "fi AS (SELECT path, arg_min(sha256, entry_id) AS sha256 FROM corpus_manifest WHERE sha256 IS NOT NULL GROUP BY 1)"


@query(f"WITH {_FIRST}, dd AS (SELECT path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL) SELECT * FROM (SELECT coalesce(fi.path, dd.path) AS path, CASE WHEN dd.path IS NULL THEN 'absent' WHEN fi.path IS NULL THEN 'undeclared' WHEN fi.sha256 <> dd.sha256 THEN 'differs' END AS problem FROM dd FULL JOIN fi ON dd.path = fi.path) WHERE problem IS NOT NULL")
def source_archive_verify(spark, d):
    """An archive's members against the first digests that the manifest records."""
    declared = table(spark, d, "corpus_manifest").where("sha256 is not null").groupBy("path").agg(F.min_by("sha256", "entry_id").alias("sha256"))
    return K.archive_discrepancies(K.read_archive(spark, _archive(spark, d)), declared)


@query("SELECT pair_identifier AS case_id, phenomenon AS category, good AS query, [bad] AS forbidden_claims FROM minimal_pairs")
def source_benchmark_jsonl(spark, d):
    """The test items as lines of JSON, read with their fields checked."""
    rows = table(spark, d, "minimal_pairs").select(F.col("pair_identifier").alias("case_id"), F.col("phenomenon").alias("category"), F.col("good").alias("query"), F.array("bad").alias("forbidden_claims"))
    rows.write.json(path := _room(spark))
    return K.read_cases(spark, path, rows.schema, ["case_id", "category", "query"], "case_id")


def _store(spark, d) -> K.AnswerStore:
    """Each work's listings as answers, a later one correcting the one before, appended in two batches."""
    from pyspark.sql import Window

    w = Window.partitionBy("ebook_number").orderBy("listed_at", F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("author").asc_nulls_last())
    k = table(spark, d, "catalogue").withColumn("k", F.row_number().over(w))
    e = F.col("ebook_number").cast("string")
    rows = cut(k.select(F.concat_ws("-", e, "k").alias("answer_id"), e.alias("conversation_id"), F.when(F.col("k") > 1, F.concat_ws("-", e, F.col("k") - 1)).alias("correction_of"), F.col("listed_at").alias("created_at"), F.col("k").cast("bigint").alias("seq"), F.to_json(F.struct("title")).alias("document")))
    store = K.AnswerStore(spark, _room(spark))
    store.append(rows.where("seq = 1"))
    store.append(rows.where("seq > 1"))
    return store


_ANSWERS = "an AS (SELECT ebook_number, title, listed_at, row_number() OVER (PARTITION BY ebook_number ORDER BY listed_at, url, title, author) AS k FROM catalogue)"


@query(f"WITH {_ANSWERS} SELECT ebook_number || '-' || k AS answer_id, ebook_number::VARCHAR AS conversation_id, CASE WHEN k > 1 THEN ebook_number || '-' || (k - 1) END AS correction_of, k AS seq FROM an")
def sink_sqlite_answers(spark, d):
    """Answers appended to the store in two batches, the second correcting the first."""
    return _store(spark, d).read().select("answer_id", "conversation_id", "correction_of", "seq")


@query(f"WITH {_ANSWERS} SELECT ebook_number || '-' || k AS answer_id, title FROM an WHERE ebook_number = (SELECT min(ebook_number) FROM an WHERE k > 1) ORDER BY k")
def scan_sqlite_answers(spark, d):
    """The answers of one conversation in their order, their documents decoded."""
    store = _store(spark, d)
    first = store.read().where("seq > 1").agg(F.min(F.col("conversation_id").cast("bigint"))).first()[0]
    rows = K.decode_answers(store.conversation(str(first)), Y.StructType([Y.StructField("title", Y.StringType())]))
    return rows.select("answer_id", F.col("record.title").alias("title"))


@query(f"WITH {_ANSWERS}, w AS (SELECT a.ebook_number, count(*) AS n, count(DISTINCT a.title) AS titles FROM an a GROUP BY 1) SELECT ebook_number || '-' || (n + 1) AS answer_id, ebook_number || '-' || n AS correction_of, (n + 1) AS seq, CASE WHEN titles > 1 THEN 'qualify' ELSE 'retain' END AS decision FROM w")
def reassess_stored(spark, d):
    """The newest answer of every stored conversation assessed anew and recorded as its correction: qualified where the titles that its
    answers gave don't agree. What the store holds afterwards is read back."""
    store = _store(spark, d)
    old = K.decode_answers(store.read(), Y.StructType([Y.StructField("title", Y.StringType())]))
    g = old.groupBy("conversation_id").agg(F.max_by("answer_id", "seq").alias("correction_of"), F.max("seq").alias("last"), F.count_distinct("record.title").alias("titles"))
    decision = F.when(F.col("titles") > 1, "qualify").otherwise("retain")
    new = g.select(F.concat_ws("-", "conversation_id", (F.col("last") + 1).cast("string")).alias("answer_id"), "conversation_id", "correction_of", F.lit(None).cast("timestamp").alias("created_at"), (F.col("last") + 1).alias("seq"), F.to_json(F.struct(decision.alias("decision"))).alias("document"))
    store.append(cut(new))
    return store.read().where("created_at is null").select("answer_id", "correction_of", "seq", F.get_json_object("document", "$.decision").alias("decision"))


_REPORT = "SELECT coalesce(nullif(lower(trim(register)), ''), 'none') AS source, count(*) AS documents, sum(length(text))::BIGINT AS characters, sum(length(text)) / sum(sum(length(text))) OVER () AS share FROM documents WHERE text IS NOT NULL GROUP BY 1"


def _report(spark, d):
    from pyspark.sql import Window

    name = F.coalesce(F.nullif(F.lower(F.trim("register")), F.lit("")), F.lit("none"))
    g = docs(spark, d).groupBy(name.alias("source")).agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters"))
    return g.withColumn("share", F.col("characters") / F.sum("characters").over(Window.partitionBy()))


@query(f"SELECT source, documents, characters, round(share, 6) AS share FROM ({_REPORT})")
def sink_report_json(spark, d):
    """A report written as lines of JSON and read."""
    K.write_report(_report(spark, d), path := _room(spark))
    return spark.read.schema("source string, documents bigint, characters bigint, share double").json(path).withColumn("share", F.round("share", 6))


@query(f"WITH r AS ({_REPORT}), l AS (SELECT row_number() OVER (ORDER BY characters DESC, source) + 3 AS n, '| ' || source || ' | ' || documents || ' | ' || characters || ' | ' || printf('%.4f', share) || ' |' AS line FROM r), m AS (SELECT row_number() OVER (ORDER BY characters DESC, source) + (SELECT count(*) FROM r) + 6 AS n, '- ' || source || ' holds 25% of the characters or more.' AS line FROM r WHERE share >= 0.25) SELECT n::INT AS n, line FROM l UNION ALL SELECT n::INT, line FROM m UNION ALL SELECT 0, '# Corpus' UNION ALL SELECT 2, '| source | documents | characters | share |' UNION ALL SELECT 3, '|-|-|-|-|' UNION ALL SELECT (SELECT count(*) FROM r) + 5, '## Limitations' UNION ALL SELECT (SELECT count(*) FROM r) + 7, '- No source dominates.' WHERE (SELECT max(share) FROM r) < 0.25")
def sink_data_card(spark, d):
    """The lines of a card of the registers."""
    lines = K.data_card(_report(spark, d), "Corpus").splitlines()
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines) if x], "n int, line string")


@query("WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), lambda w: length(w)) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"words\":' || CASE WHEN len(l) > 8 THEN '{\"left_out\":' || len(l) || ',\"sha256\":\"' || sha256(to_json(l)) || '\"}' ELSE to_json(l)::VARCHAR END || '}' AS extract FROM r")
def sink_report_extract(spark, d):
    """A report of each document with the lengths of its words, written, and its extract: long lists by length and digest."""
    r = docs(spark, d).select("doc_id", F.to_json(F.struct("doc_id", F.transform(T.blank_tokens(F.col("text")), lambda w: F.char_length(w)).alias("words"))).alias("report"))
    return r.select("doc_id", U.extract("report").alias("extract"))


@query("WITH r AS (SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL) SELECT n::INT AS n, line FROM (SELECT unnest([0, 1, 3, 4, 5]) AS n, unnest(['Corpus', '======', 'documents: ' || documents, 'characters: ' || characters, 'sources: ' || sources]) AS line FROM r)")
def report_format(spark, d):
    """The totals of the corpus as lines to read."""
    g = docs(spark, d).agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters"), F.count_distinct("source").alias("sources"))
    return spark.createDataFrame([(i, x) for i, x in enumerate(K.format_report(g, "Corpus")) if x], "n int, line string")


@query("SELECT count(*) AS made, count(*) AS different, true AS valid FROM documents")
def ids_random(spark, d):
    """A random identifier for every document: as many different ones, all of the valid form."""
    ids = cut(table(spark, d, "documents").select(F.concat(F.lit("ans_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)).alias("id")))
    return ids.agg(F.count("*").alias("made"), F.count_distinct("id").alias("different"), F.every(T.valid_id(F.col("id"), "ans")).alias("valid"))


_GROUNDED = "gr AS (SELECT pair_identifier AS case_id, lang || '-' || phenomenon AS label, CASE WHEN substr(sha256('7|' || pair_identifier), 1, 1) < '8' THEN 'development' ELSE 'held_out' END AS split FROM minimal_pairs)"


def _grounded(spark, d):
    """Sources and cases of the test items, written as a folder of JSON lines and read with their checks."""
    t = table(spark, d, "minimal_pairs")
    label = F.concat_ws("-", "lang", "phenomenon")
    root = _room(spark)
    t.groupBy(label.alias("label")).agg(F.min("good").alias("text")).write.json(f"{root}/sources")
    split = F.when(F.substring(F.sha2(F.concat(F.lit("7|"), "pair_identifier"), 256), 1, 1) < "8", "development").otherwise("held_out")
    t.select(F.col("pair_identifier").alias("case_id"), split.alias("split"), F.col("good").alias("question"), F.array(label).alias("gold_labels")).write.json(f"{root}/cases")
    return K.read_grounded(spark, root)


@query(f"WITH {_GROUNDED} SELECT case_id, split, label FROM gr")
def source_grounded_dir(spark, d):
    """The cases of a folder of sources and cases, each with its label."""
    _, cases = _grounded(spark, d)
    return cases.select("case_id", "split", F.explode("gold_labels").alias("label"))


@query(f"WITH {_GROUNDED} SELECT label FROM gr GROUP BY 1 HAVING count(DISTINCT split) = 2")
def split_leak_gold(spark, d):
    """Labels whose sources support cases on both splits."""
    return K.gold_leaks(_grounded(spark, d)[1])


@query(f"WITH {G.tree_sql('per', 'SELECT ' + G.row_sql('path', 'sha256(text)') + ' AS d FROM documents WHERE text IS NOT NULL', [])} SELECT path, CASE WHEN substr(sha256('7|' || path), 1, 2) < '26' THEN 'test' WHEN substr(sha256('7|' || path), 1, 2) < '4c' THEN 'validation' ELSE 'train' END AS side, (SELECT digest FROM per) AS fingerprint FROM documents WHERE text IS NOT NULL")
def pin_and_split(spark, d):
    """A corpus that is still what its fingerprint says, split by the digests of its paths: about 15 % each of test and validation."""
    x = cut(docs(spark, d).select("path", F.sha2("text", 256).alias("sha256")))
    expected = G.tree_digest(docs(spark, d), [], F.col("path"), F.sha2("text", 256)).first()["digest"]
    if G.tree_digest(x, [], F.col("path"), F.col("sha256")).first()["digest"] != expected:
        raise ValueError("the corpus is not the one that was pinned")
    key = F.substring(F.sha2(F.concat(F.lit("7|"), "path"), 256), 1, 2)
    return x.select("path", F.when(key < "26", "test").when(key < "4c", "validation").otherwise("train").alias("side"), F.lit(expected).alias("fingerprint"))


