"""Further readings: tokens by class, loops, prompts, fingerprints, protocol checks, contrasts of runs."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.bindings import rules as RB
from inkspark.bindings.connectors import _local, _room
from inkspark.bindings.corpus import _SPLIT, docs
from inkspark.bindings.statistics import T975, L, losses, tail_sql
from inkspark.functions import text as T
from inkspark.functions import tokens as K
from inkspark.functions import udfs as U
from inkspark.operators import digests as G
from inkspark.operators import selection as S
from inkspark.operators import stats as Z
from inkspark.plans.lineage import cut
from inkspark.plans.registry import SQL, query, table


def _encoded(spark, d):
    return docs(spark, d).select("doc_id", "text", K.encode("text").alias("ids"))


@query()
def bpe_encode(spark, d):
    e = _encoded(spark, d)
    return e.select("doc_id", F.size("ids").alias("n"), T.sha(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("digest"))


@query("SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL")
def bpe_decode(spark, d):
    """Every text survives encoding and decoding."""
    return _encoded(spark, d).select("doc_id", (K.decode("ids") == F.col("text")).alias("same"))


@query()
def bpe_token_count(spark, d):
    return _encoded(spark, d).select("doc_id", F.size("ids").alias("tokens"), F.round(F.try_divide(F.char_length("text"), F.size("ids")), 6).alias("characters_per_token"))


@query()
def token_classes(spark, d):
    """Tokens by class of what they stand for: word, space or symbol; ids are counted before any is decoded."""
    n = _encoded(spark, d).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    piece = n.select("n", K.decode(F.array("id")).alias("p"))
    kind = F.when(F.trim("p") == "", "space").when(F.col("p").rlike(r"[\p{L}\p{N}]"), "word").otherwise("symbol")
    g = piece.groupBy(kind.alias("class")).agg(F.sum("n").alias("tokens"))
    return g.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))


def _merges(spark, name):
    """(left, right, place) of the merges of a public vocabulary."""
    pairs = K.merges(os.path.join(os.path.dirname(K.PATH), name))
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "left string, right string, place int")


@query()
def merge_overlap(spark, d):
    """Two public vocabularies: the Jaccard similarity of their merges, the rank correlation of those they share (null below three), and
    how far the first compresses the corpus."""
    a, b = _merges(spark, "byte_bpe_50k.json"), _merges(spark, "word_bpe_49k.json")
    j = cut(a.withColumnRenamed("place", "pa").join(b.withColumnRenamed("place", "pb"), ["left", "right"], "full_outer"))
    both = j.where("pa is not null and pb is not null")
    n = both.count()
    rho = Z.spearman(both, "pa", "pb").first()["rho"] if n > 2 else None
    used = _encoded(spark, d).agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters"), F.sum(F.size("ids")).alias("identifiers"))
    return used.select(F.lit(n).alias("shared"), F.lit(round(n / max(1, j.count()), 6)).alias("jaccard"), F.lit(rho).cast("double").alias("rank_correlation"), "documents", "characters", "identifiers", F.round(F.col("characters") / F.col("identifiers"), 6).alias("characters_per_identifier"))


@query()
def bpe_vocab_io(spark, d):
    """A public vocabulary's merges through a file with their digest, and back."""
    pairs = K.merges()
    path = f"{_local(_room(spark))}.json"
    digest = K.save_vocabulary(path, pairs)
    return spark.createDataFrame([(digest, len(pairs), K.load_vocabulary(path) == pairs)], "digest string, merges int, same boolean")


@query()
def loop_tail(spark, d):
    return docs(spark, d).select("doc_id", U.loops("text").alias("l")).select("doc_id", (F.col("l.tail_period") > 0).alias("loops"), "l.tail_period")


@query()
def periodic_run(spark, d):
    return docs(spark, d).select("doc_id", U.loops("text").alias("l")).select("doc_id", "l.periodic_repeats", T.sha(F.col("l.periodic_block")).alias("block"))


@query()
def repeated_block(spark, d):
    return docs(spark, d).select("doc_id", U.block("text").alias("b")).select("doc_id", "b.length", "b.times")


@query()
def chunk_split_oversized(spark, d):
    """Whole texts as single paragraphs, in pieces of at most 2,000 characters."""
    return docs(spark, d).select("doc_id", F.posexplode(U.piece_lengths("text")).alias("position", "n_chars"))


@query("SELECT scheme, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) IN ('https', 'http') AS scheme FROM catalogue WHERE url IS NOT NULL) GROUP BY 1")
def url_scheme_allowed(spark, d):
    return table(spark, d, "catalogue").where("url is not null").groupBy(T.scheme_allowed(F.col("url"), ("https", "http")).alias("scheme")).agg(F.count("*").alias("n"))


_FOUR = "a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)"
_SIX = "x NOT BETWEEN 8192 AND 16383 OR x = 8194 OR (x = 8193 AND (y = 3512 OR (y < 512 AND y NOT IN (1, 3) AND y NOT BETWEEN 32 AND 63)))"


@query(f"WITH e AS (SELECT event_id, event_id % 256 AS a, (event_id >> 8) % 256 AS b, (event_id >> 16) % 256 AS c, (event_id >> 24) % 256 AS d, event_id % 65536 AS x, (event_id >> 16) % 65536 AS y FROM events WHERE event_id IS NOT NULL), h AS (SELECT DISTINCT lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1)) AS host FROM catalogue WHERE url IS NOT NULL UNION SELECT unnest(['localhost', 'metadata', 'metadata.google.internal'])) SELECT event_id, concat_ws('.', a, b, c, d) AS host, {_FOUR} AS blocked FROM e UNION ALL SELECT event_id, format('{{:x}}:{{:x}}::1', x, y), {_SIX} FROM e UNION ALL SELECT NULL, host, host IN ('localhost', 'metadata', 'metadata.google.internal') FROM h")
def url_blocked_destination(spark, d):
    """Two addresses of every event, of four numbers and of the sixth version, with all their digits from the id, the hosts of the
    catalogue and the names that are refused; hosts that are no event's have no event_id."""
    low = lambda k: F.shiftright("event_id", k)
    four = F.concat_ws(".", *[(low(k) % 256).cast("string") for k in (0, 8, 16, 24)])
    six = F.concat(F.lower(F.concat_ws(":", *[F.hex(low(k) % 65536) for k in (0, 16)])), F.lit("::1"))
    events = table(spark, d, "events").where("event_id is not null").select("event_id", F.explode(F.array(four, six)).alias("host"))
    listed = table(spark, d, "catalogue").where("url is not null").select(T.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in ("localhost", "metadata", "metadata.google.internal")])).alias("host"))
    hosts = events.unionByName(listed.unionByName(names).distinct().select(F.lit(None).cast("bigint").alias("event_id"), "host"))
    return hosts.select("event_id", "host", T.blocked_host(F.col("host")).alias("blocked"))


@query(f"WITH {_SPLIT}, r AS (SELECT side, doc_id, text FROM side JOIN documents USING (doc_id)), {G.tree_sql('per', 'SELECT side, ' + G.row_sql('doc_id', 'sha256(text)') + ' AS d FROM r', ['side'])} SELECT 8 AS context_size, substr(sha256(string_agg(digest, chr(30) ORDER BY side) FILTER (side <> 'test') || chr(30) || '8'), 1, 16) AS fingerprint FROM per")
def fingerprint_dataset(spark, d):
    """One digest of the texts of train and validation and of the context size that examples are cut with."""
    x = docs(spark, d).join(S.split_documents(docs(spark, d), "doc_id"), "doc_id").where("side <> 'test'")
    per = G.tree_digest(x, ["side"], F.col("doc_id"), F.sha2("text", 256)).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "digest"))), lambda s: s["digest"]).alias("l"))
    return per.select(F.lit(8).alias("context_size"), F.substring(F.sha2(F.concat(F.array_join("l", "\x1e"), F.lit("\x1e8")), 256), 1, 16).alias("fingerprint"))


@query("SELECT pair_identifier, i::INT AS position, CASE i WHEN 0 THEN good ELSE bad END AS claim FROM minimal_pairs, range(0, 2) t(i)")
def claims_structured(spark, d):
    return table(spark, d, "minimal_pairs").select("pair_identifier", F.posexplode(F.array("good", "bad")).alias("position", "claim"))


@query("SELECT pair_identifier, phenomenon, lang FROM minimal_pairs")
def answer_codec(spark, d):
    """Records through their JSON document and back."""
    t = table(spark, d, "minimal_pairs").select("pair_identifier", F.to_json(F.struct("lang", "phenomenon")).alias("document"))
    return t.select("pair_identifier", F.from_json("document", "lang string, phenomenon string").alias("r")).select("pair_identifier", "r.phenomenon", "r.lang")


@query("SELECT DISTINCT c.register AS label, d.doc_id FROM (SELECT DISTINCT slug, register FROM catalogue WHERE register IS NOT NULL) c JOIN documents d ON d.source = c.slug")
def labels_resolve(spark, d):
    """Labels (registers of the catalogue) to sources to documents."""
    c = table(spark, d, "catalogue").where("register is not null").select(F.col("slug").alias("source"), F.col("register").alias("label")).distinct()
    return table(spark, d, "documents").join(c, "source").select("label", "doc_id").distinct()


@query(f"WITH {G.tree_sql('per', 'SELECT phenomenon, ' + G.row_sql('good', 'bad') + ' AS d FROM minimal_pairs', ['phenomenon'])} SELECT phenomenon, n AS cases, digest AS version FROM per")
def case_version(spark, d):
    """A version of each case set that the order of its cases doesn't change."""
    return G.tree_digest(table(spark, d, "minimal_pairs"), ["phenomenon"], F.col("good"), F.col("bad")).select("phenomenon", F.col("n").alias("cases"), F.col("digest").alias("version"))


@query("SELECT doc_id, (i - 1)::INT AS line, CASE WHEN substr(sha256('7|' || doc_id || '|' || (i - 1)), 1, 1) < '2' THEN 'held_out' ELSE 'train' END AS side FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE trim(l[i]) <> ''")
def split_lines(spark, d):
    """Lines that aren't blank, an eighth of them held out by digest."""
    x = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.trim("t") != "")
    return x.select("doc_id", "line", F.when(F.substring(S.order_key(7, F.col("doc_id"), F.col("line")), 1, 1) < "2", "held_out").otherwise("train").alias("side"))


@query("SELECT doc_id, substr(text, 1 + ('0x' || substr(sha256('7|' || doc_id), 1, 7))::BIGINT % (length(text) - 199), 200) AS prompt FROM documents WHERE length(text) >= 400")
def pick_prompts(spark, d):
    """A passage of 200 characters of each long document, from a seeded place."""
    at = F.conv(F.substring(S.order_key(7, F.col("doc_id")), 1, 7), 16, 10).cast("bigint") % (F.char_length("text") - 199) + 1
    return docs(spark, d).where(F.char_length("text") >= 400).select("doc_id", F.substring("text", at.cast("int"), F.lit(200)).alias("prompt"))


@query("SELECT experiment, sha256('{\"first_arm\":' || coalesce(to_json(min(first_arm)), 'null') || ',\"second_arm\":' || coalesce(to_json(min(second_arm)), 'null') || '}') AS digest FROM paired_loss WHERE experiment IS NOT NULL AND first_arm IS NOT NULL AND second_arm IS NOT NULL GROUP BY 1")
def protocol_digest(spark, d):
    """The digest of an experiment's arms, without its seeds and times."""
    g = table(spark, d, "paired_loss").where("experiment is not null and first_arm is not null and second_arm is not null").groupBy("experiment").agg(F.min("first_arm").alias("first_arm"), F.min("second_arm").alias("second_arm"))
    return g.select("experiment", F.sha2(F.to_json(F.struct("first_arm", "second_arm")), 256).alias("digest"))


@query(f"WITH {L} SELECT experiment AS model, work AS item, CASE WHEN avg(x) < 0 THEN 1.0 WHEN avg(x) = 0 THEN 0.5 ELSE 0.0 END AS value FROM l GROUP BY 1, 2")
def probe_tables(spark, d):
    v = losses(spark, d).groupBy(F.col("experiment").alias("model"), F.col("work").alias("item")).agg(F.avg("x").alias("m"))
    return v.select("model", "item", F.when(F.col("m") < 0, 1.0).when(F.col("m") == 0, 0.5).otherwise(0.0).alias("value"))


@query(f"WITH {L}, r AS (SELECT experiment, run_seed, avg(b) AS v FROM l WHERE run_seed IS NOT NULL GROUP BY 1, 2), g AS (SELECT experiment, stddev_samp(v) AS s FROM r GROUP BY 1) SELECT experiment, round(2.77 * s, 8) AS central, round(ceil(round(2.77 * s / 0.005, 9)) * 0.005, 6) AS band FROM g")
def band_resolve(spark, d):
    """2.77 standard deviations of an experiment's runs, and that rounded up to the next 0.005."""
    g = losses(spark, d).where("run_seed is not null").groupBy("experiment", "run_seed").agg(F.avg("b").alias("v")).groupBy("experiment").agg(F.stddev_samp("v").alias("s"))
    return g.select("experiment", F.round(Z.PAIR * F.col("s"), 8).alias("central"), F.round(F.ceil(F.round(Z.PAIR * F.col("s") / 0.005, 9)) * 0.005, 6).alias("band"))


@query(f"WITH {L}, m AS (SELECT experiment, run_seed, avg(a) AS a, avg(b) AS b FROM l GROUP BY 1, 2) SELECT experiment, run_seed, CASE WHEN abs(a - b) <= 0.002 THEN 'tie' WHEN abs(a - b) <= 0.01 THEN 'indeterminate' ELSE 'separable' END AS class FROM m")
def cross_machine_read(spark, d):
    m = losses(spark, d).groupBy("experiment", "run_seed").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return m.select("experiment", "run_seed", Z.classify_difference(F.col("a") - F.col("b"), F.lit(0.002), F.lit(0.01)).alias("class"))


@query(f"WITH {L}, m AS (SELECT experiment, run_seed, avg(a) AS a, avg(b) AS b FROM l GROUP BY 1, 2), g AS (SELECT experiment, avg(a) AS t, avg(b) AS h FROM l GROUP BY 1) SELECT m.experiment, run_seed, round((m.b - t) / (h - t), 4) AS fraction FROM m JOIN g ON g.experiment = m.experiment")
def classify_one_pass(spark, d):
    """How far each run's second arm lies on the way from the experiment's first to its second."""
    t = losses(spark, d)
    g = t.groupBy("experiment").agg(F.avg("a").alias("t"), F.avg("b").alias("h"))
    return t.groupBy("experiment", "run_seed").agg(F.avg("b").alias("b")).join(g, "experiment").select("experiment", "run_seed", F.round(F.try_divide(F.col("b") - F.col("t"), F.col("h") - F.col("t")), 4).alias("fraction"))


@query(f"WITH {L}, r AS (SELECT experiment, run_seed, avg(x) AS v FROM l WHERE experiment IS NOT NULL GROUP BY 1, 2), g AS (SELECT experiment, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM r GROUP BY 1), p AS (SELECT a.experiment AS first, b.experiment AS second, a.m - b.m AS gap, {T975}[a.n + b.n - 2] * sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS half FROM g a JOIN g b ON a.experiment < b.experiment) SELECT first, second, round(gap + 1e-11, 6) AS gap, CASE WHEN abs(gap) > half THEN 'ordered' WHEN half <= 0.01 THEN 'tied' ELSE 'unresolved' END AS grade FROM p")
def contrast_grades(spark, d):
    """All pairs of experiments by a pooled-variance interval over their runs: ordered, tied or unresolved."""
    r = losses(spark, d).where("experiment is not null").groupBy("experiment", "run_seed").agg(F.avg("x").alias("v"))
    g = r.groupBy("experiment").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    a, b = (g.select(F.col("experiment").alias(e), F.col("n").alias(f"n_{e}"), F.col("m").alias(f"m_{e}"), F.col("s").alias(f"s_{e}")) for e in ("first", "second"))
    x = a.join(b, F.col("first") < F.col("second"))
    free = F.col("n_first") + F.col("n_second") - 2
    pooled = ((F.col("n_first") - 1) * F.col("s_first") + (F.col("n_second") - 1) * F.col("s_second")) / free
    half = Z.t_quantile_column(F.lit(0.975), free) * F.sqrt(pooled * (1 / F.col("n_first") + 1 / F.col("n_second")))
    gap = F.col("m_first") - F.col("m_second")
    return x.select("first", "second", F.round(gap + Z.HALF, 6).alias("gap"), F.when(F.abs(gap) > half, "ordered").when(half <= 0.01, "tied").otherwise("unresolved").alias("grade"))


@query(f"WITH {L}, r AS (SELECT experiment, run_seed, avg(x) AS v FROM l WHERE run_seed IS NOT NULL GROUP BY 1, 2), g AS (SELECT experiment, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s, count(*) FILTER (v > 0) AS k FROM r GROUP BY 1), h AS (SELECT *, {T975}[n - 1] * s / sqrt(n) AS half FROM g) SELECT experiment, n, round(m - half, 6) AS low, round(m + half, 6) AS high, round({tail_sql('greatest(k, n - k)', 'n')} + 1e-11, 6) AS p, CASE WHEN abs(m) > half THEN 'moved' ELSE 'unmoved' END AS verdict FROM h")
def classify_seed_spread(spark, d):
    """Paired deltas over runs: interval, sign test, verdict."""
    r = losses(spark, d).where("run_seed is not null").groupBy("experiment", "run_seed").agg(F.avg("x").alias("v"))
    g = r.groupBy("experiment").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count_if(F.col("v") > 0).alias("k"))
    half = Z.t_quantile_column(F.lit(0.975), F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return g.select("experiment", "n", F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.round(Z.sign_test_p(F.col("k"), F.col("n")) + Z.HALF, 6).alias("p"), F.when(F.abs("m") > half, "moved").otherwise("unmoved").alias("verdict"))


@query()
def loss_pairs_compare(spark, d):
    """Weighted mean difference of each experiment with the interval over resampled works and the largest influence of one work."""
    c = losses(spark, d).groupBy("experiment", "work").agg(F.sum(F.col("x") * F.col("n")).alias("vx"), F.sum("n").alias("wx"))
    return Z.jackknife(c, ["experiment"], "vx", "wx").join(Z.bootstrap(c, ["experiment"], "work", "vx", "wx"), "experiment")


@query(f"SELECT a.*, b.p, b.rejected FROM ({SQL['agg_design_effect']}) a JOIN ({SQL['stat_holm']}) b ON a.experiment = b.experiment")
def clustered_probe_read(spark, d):
    """Design effect and exact p of each experiment, with the family's step-down rejections."""
    t = losses(spark, d).where("experiment is not null")
    p = t.groupBy("experiment").agg(F.count_if(F.col("a") < F.col("b")).alias("b"), F.count_if(F.col("a") > F.col("b")).alias("c")).select("experiment", Z.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    return Z.design_effect(t, ["experiment"], "work", "x").join(Z.holm(p, "p", "experiment"), "experiment").withColumn("p", F.round("p", 6))


@query("SELECT phenomenon, count(*) AS pairs, count(DISTINCT good) AS distinct_good, count(*) FILTER (good = bad) AS unusable FROM minimal_pairs GROUP BY 1")
def pairs_io(spark, d):
    """Checks of a pair set: each good text once, none equal to its bad one."""
    return table(spark, d, "minimal_pairs").groupBy("phenomenon").agg(F.count("*").alias("pairs"), F.count_distinct("good").alias("distinct_good"), F.count_if(F.col("good") == F.col("bad")).alias("unusable"))


@query("SELECT doc_id, 'src_' || substr(sha256('text:' || doc_id || chr(31) || sha256(text)), 1, 16) AS source_id FROM documents WHERE text IS NOT NULL")
def source_ingest_text(spark, d):
    """Supplied texts as sources under a label of their own."""
    return docs(spark, d).select("doc_id", T.source_id(F.concat(F.lit("text:"), F.col("doc_id").cast("string")), F.col("text")).alias("source_id"))


@query(f"WITH {RB._DECIDE}, an AS (SELECT answer, CASE WHEN bool_or(decision = 'correct') THEN 'correct' WHEN bool_or(decision = 'qualify') THEN 'qualify' WHEN bool_and(new = 'not_evaluated') THEN 'abstain' ELSE 'retain' END AS answer_decision FROM dc GROUP BY 1) SELECT answer, claim, prior, new, decision, answer_decision FROM dc JOIN an USING (answer)")
def reassess(spark, d):
    """Claims grounded anew, decided, and the answers' decisions in one."""
    from inkspark.operators import rules as X

    c = RB._decided(spark, d)
    return c.join(X.decide_answer(c, "answer", "decision", "new").withColumnRenamed("decision", "answer_decision"), "answer")
