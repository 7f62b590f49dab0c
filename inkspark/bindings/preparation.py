"""Preparation of a corpus, selections, turns, and readings of studies, over tables that have the operators' own forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.bindings.corpus import _SPLIT, SIZED, _unigrams, docs, sized
from inkspark.bindings.retrieval import BM25, _lexical
from inkspark.bindings.rules import _CONTINUATION, _INFORMATION, _TOK
from inkspark.bindings.statistics import L, _arms, losses, tail_sql
from inkspark.bindings.text import LF, LOWER
from inkspark.functions import notation as N
from inkspark.functions import text as T
from inkspark.operators import rules as X
from inkspark.operators import selection as S
from inkspark.operators import stats as Z
from inkspark.plans.lineage import cut
from inkspark.plans.registry import query, table

# ---- packs
_SIDES = f"{SIZED}, {_SPLIT}, sd AS (SELECT sized.*, side.side FROM sized JOIN side USING (doc_id))"
_VOCAB = f"lw AS (SELECT doc_id, unnest({LOWER}) AS w FROM documents WHERE text IS NOT NULL), cw AS (SELECT w, count(*) FILTER (side = 'train') AS n FROM lw JOIN side USING (doc_id) GROUP BY 1), kk AS (SELECT sum(n) AS total, count(*) AS v FROM cw)"


def _sides(spark, d):
    return sized(spark, d).join(S.split_documents(docs(spark, d), "doc_id"), "doc_id")


@query(f"WITH {_SIDES}, {_VOCAB}, rg AS (SELECT register, count(*) AS documents, sum(tokens + 1)::BIGINT AS identifiers FROM sd WHERE side = 'test' GROUP BY 1), wx AS (SELECT register, sum(-ln((n + 1) / (total + v))) / count(*) AS nats FROM lw JOIN sd USING (doc_id) JOIN cw USING (w), kk WHERE side = 'test' GROUP BY 1) SELECT rg.register, documents, identifiers, (identifiers // 65)::BIGINT AS blocks, round(nats, 6) AS unigram_nats, round(ln((SELECT v FROM kk)), 6) AS uniform_nats FROM rg LEFT JOIN wx ON wx.register IS NOT DISTINCT FROM rg.register")
def partition_packs(spark, d):
    """A pack of the test side for each register, with the cross-entropy of unigrams fitted on train and of a uniform guess."""
    test = cut(_sides(spark, d).where("side = 'test'").select("doc_id", "register", "tokens"))
    g = test.groupBy("register").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") + 1).alias("identifiers"))
    uni = cut(_unigrams(spark, d).select("w", "logp"))
    words = docs(spark, d).select("doc_id", "text").join(test.select("doc_id", "register"), "doc_id").select("register", F.explode(T.words_lower(F.col("text"))).alias("w")).groupBy("register", "w").agg(F.count("*").alias("c"))
    nats = words.join(uni, "w").groupBy("register").agg((-F.sum(F.col("c") * F.col("logp")) / F.sum("c")).alias("nats"))
    x = g.join(nats.withColumnRenamed("register", "of"), F.col("register").eqNullSafe(F.col("of")), "left")
    return x.select("register", "documents", "identifiers", F.floor(F.col("identifiers") / 65).alias("blocks"), F.round("nats", 6).alias("unigram_nats"), F.round(F.log(F.lit(float(uni.count()))), 6).alias("uniform_nats"))


@query(f"WITH {_SIDES}, {_VOCAB}, cp AS (SELECT doc_id, side, tokens, coalesce(sum(tokens) OVER (PARTITION BY side ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sd), tk AS (SELECT * FROM cp WHERE b < CASE side WHEN 'train' THEN 100000 ELSE 20000 END), un AS (SELECT side, count(*) FILTER (n = 0) / count(*) AS u FROM lw JOIN tk USING (doc_id) JOIN cw USING (w) GROUP BY 1) SELECT side, count(*) AS documents, sum(tokens + 1)::BIGINT AS identifiers, (sum(tokens + 1)::BIGINT // 65)::BIGINT AS blocks, round(any_value(u), 6) AS unknown_fraction FROM tk JOIN un USING (side) GROUP BY 1")
def prepare_corpus(spark, d):
    """The sides as they are packed: split by documents, each sampled in seeded order up to its cap of tokens, in blocks of 64 and one;
    and the share of words that the training side doesn't have."""
    x = S.prefix_sum(_sides(spark, d), "key", F.col("tokens"), ["side"])
    kept = cut(x.where(F.col("before") < F.when(F.col("side") == "train", 100_000).otherwise(20_000)).select("doc_id", "side", "tokens"))
    g = kept.groupBy("side").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") + 1).alias("identifiers"))
    words = docs(spark, d).join(kept.select("doc_id", "side"), "doc_id").select("side", F.explode(T.words_lower(F.col("text"))).alias("w")).groupBy("side", "w").agg(F.count("*").alias("c"))
    unknown = words.join(_unigrams(spark, d).select("w", "n"), "w").groupBy("side").agg((F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("u"))
    return g.join(unknown, "side").select("side", "documents", "identifiers", F.floor(F.col("identifiers") / 65).alias("blocks"), F.round("u", 6).alias("unknown_fraction"))


# the greedy fold over paragraphs, the documents so far parted by code 1; codes 1 and 2 within a text are written as 2 a and 2 b
_ESC = f"replace(replace({LF}, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a')"
_PS = f"list_filter(list_transform(string_split_regex({_ESC}, '\\n[ \\t]*\\n'), lambda p: regexp_replace(p, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')), lambda p: p <> '')"
_BACK = "replace(replace({0}, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))"


@query(f"WITH p AS (SELECT doc_id, {_PS} AS p FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, string_split(list_reduce(p, lambda acc, x: CASE WHEN length({_BACK.format('string_split(acc, chr(1))[-1]')}) + 2 + length({_BACK.format('x')}) <= 4000 THEN acc || chr(10) || chr(10) || x ELSE acc || chr(1) || x END), chr(1)) AS d FROM p WHERE len(p) > 0), e AS (SELECT doc_id, unnest(d) AS piece, generate_subscripts(d, 1) - 1 AS part FROM f) SELECT doc_id, part::BIGINT AS part, length({_BACK.format('piece')}) AS n_chars, sha256({_BACK.format('piece')}) AS digest FROM e")
def source_chunk_paragraphs(spark, d):
    """Documents of whole paragraphs, filled up to 4,000 characters, none cut."""
    c = docs(spark, d).select("doc_id", F.posexplode(T.paragraph_documents(F.col("text"), 4000)).alias("part", "piece"))
    return c.select("doc_id", F.col("part").cast("bigint").alias("part"), F.char_length("piece").cast("bigint").alias("n_chars"), T.sha(F.col("piece")).alias("digest"))


# ---- vocabulary
@query(f"WITH {_SPLIT}, ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), vo AS (SELECT DISTINCT c FROM ch JOIN side USING (doc_id) WHERE side = 'train') SELECT doc_id, count(*) AS n, round(count(*) FILTER (vo.c IS NULL) / count(*), 6) AS unknown_fraction FROM ch LEFT JOIN vo USING (c) GROUP BY 1")
def char_encode(spark, d):
    """Every text under the characters of the training side: its length and the fraction that the vocabulary doesn't have. The vocabulary
    is bounded by Unicode and goes to the texts."""
    side = S.split_documents(docs(spark, d), "doc_id")
    c = docs(spark, d).where("text <> ''").select("doc_id", F.explode(T.chars(F.col("text"))).alias("c")).groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    train = side.where("side = 'train'").select("doc_id")
    vocabulary = docs(spark, d).join(train, "doc_id").select(F.explode(F.array_distinct(T.chars(F.col("text")))).alias("c")).distinct().withColumn("known", F.lit(True))
    x = c.join(F.broadcast(vocabulary), "c", "left")
    return x.groupBy("doc_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unknown_fraction"))


@query(f"WITH {_SPLIT}, {_VOCAB}, pr AS (SELECT pair_identifier AS id, phenomenon, unnest(['good', 'bad']) AS which, unnest([good, bad]) AS text FROM minimal_pairs), pw AS (SELECT id, phenomenon, which, length(text) AS chars, {LOWER} AS ws FROM pr), ps AS (SELECT id, which, sum(ln((coalesce(n, 0) + 1) / (total + v))) AS s FROM (SELECT id, which, unnest(ws) AS w FROM pw) LEFT JOIN cw USING (w), kk GROUP BY 1, 2), j AS (SELECT phenomenon, round(max(s) FILTER (which = 'good'), 9) AS gs, round(max(s) FILTER (which = 'bad'), 9) AS bs, max(chars) FILTER (which = 'good') AS gc, max(chars) FILTER (which = 'bad') AS bc, max(len(ws)) FILTER (which = 'good') AS gt, max(len(ws)) FILTER (which = 'bad') AS bt FROM pw JOIN ps USING (id, which) GROUP BY id, phenomenon), r AS (SELECT phenomenon, unnest(['score', 'length', 'tokens']) AS reading, unnest([CASE WHEN gs > bs THEN 1.0 WHEN gs = bs THEN 0.5 ELSE 0.0 END, CASE WHEN gc < bc THEN 1.0 WHEN gc = bc THEN 0.5 ELSE 0.0 END, CASE WHEN gt < bt THEN 1.0 WHEN gt = bt THEN 0.5 ELSE 0.0 END]) AS x FROM j), a AS (SELECT phenomenon, reading, count(*) AS n, count(*) FILTER (x = 0.5) AS ties, avg(x) AS p FROM r GROUP BY GROUPING SETS ((phenomenon, reading), (reading))), w AS (SELECT *, 1.959964 ** 2 AS z FROM a) SELECT phenomenon, reading, n, ties, round(p + 1e-11, 6) AS accuracy, round(greatest(0, ((p + z / (2 * n)) - 1.959964 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)) + 1e-11, 6) AS low, round(least(1, ((p + z / (2 * n)) + 1.959964 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)) + 1e-11, 6) AS high FROM w")
def score_pairs(spark, d):
    """How often the good text of a pair wins, by the log probability of unigrams fitted on train, and by being shorter in characters or
    words; ties count half; by phenomenon and for all, with 95 % intervals."""
    u = cut(_unigrams(spark, d).select("w", "n", "logp"))
    total, v = u.agg(F.sum("n"), F.count("*")).first()
    t = table(spark, d, "minimal_pairs").select(F.col("pair_identifier").alias("id"), "phenomenon", F.explode(F.create_map(F.lit("good"), F.col("good"), F.lit("bad"), F.col("bad"))).alias("which", "text"))
    t = cut(t.select("id", "phenomenon", "which", F.char_length("text").alias("chars"), T.words_lower(F.col("text")).alias("ws")))
    s = t.select("id", "which", F.explode("ws").alias("w")).join(u, "w", "left").groupBy("id", "which").agg(F.sum(F.coalesce("logp", F.log(F.lit(1.0 / ((total or 0) + v))))).alias("s"))
    of = lambda c, w: F.max(F.when(F.col("which") == w, c))
    j = t.join(s, ["id", "which"]).groupBy("id", "phenomenon").agg(*[of(c, w).alias(n + k) for w, n in (("good", "g"), ("bad", "b")) for c, k in ((F.round("s", 9), "s"), (F.col("chars"), "c"), (F.size("ws"), "t"))])
    won = lambda a, b: F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)
    each = F.array(*[F.struct(F.lit(n).alias("reading"), x.alias("x")) for n, x in (("score", won(F.col("gs"), F.col("bs"))), ("length", won(F.col("bc"), F.col("gc"))), ("tokens", won(F.col("bt"), F.col("gt"))))])
    a = j.select("phenomenon", F.explode(each).alias("e")).select("phenomenon", "e.*").groupingSets([["phenomenon", "reading"], ["reading"]], "phenomenon", "reading").agg(F.count("*").alias("n"), F.count_if(F.col("x") == 0.5).alias("ties"), F.avg("x").alias("p"))
    low, high = Z.wilson(F.col("p") * F.col("n"), F.col("n"))
    return a.select("phenomenon", "reading", "n", "ties", F.round(F.col("p") + Z.HALF, 6).alias("accuracy"), F.round(low + Z.HALF, 6).alias("low"), F.round(high + Z.HALF, 6).alias("high"))


# ---- selections
_FIRST = "sl AS (SELECT slug, regexp_extract(slug, '^([a-z]+)-pg', 1) AS register FROM catalogue WHERE starts_with(url, 'https://') GROUP BY ALL), pl AS (SELECT register, slug, row_number() OVER (PARTITION BY register ORDER BY sha256('7|' || slug)) AS position FROM sl WHERE register <> '')"


def _walk(spark, d, seed=7):
    c = table(spark, d, "catalogue").where(F.col("url").startswith("https://")).select("slug", F.regexp_extract("slug", "^([a-z]+)-pg", 1).alias("register")).where("register <> ''").distinct()
    return c.withColumn("position", F.row_number().over(Window.partitionBy("register").orderBy(S.order_key(seed, F.col("slug")))))


@query(f"WITH {_FIRST} SELECT register, slug, position FROM pl WHERE position <= 8")
def filter_acquire_candidates(spark, d):
    """Works with a secure address, by register in seeded order, four times a quota of two."""
    return _walk(spark, d).where("position <= 8")


@query(f"WITH {_FIRST}, ot AS (SELECT register, slug, row_number() OVER (PARTITION BY register ORDER BY sha256('8|' || slug)) AS position FROM sl WHERE register <> ''), re AS (SELECT register, slug, position FROM pl WHERE position <= 5 AND register < 'p' UNION ALL SELECT register, slug, position FROM ot WHERE position <= 5 AND register >= 'p') SELECT re.register, min(re.position) FILTER (pl.slug IS DISTINCT FROM re.slug) AS diverges_at FROM re LEFT JOIN pl ON pl.register = re.register AND pl.position = re.position GROUP BY 1")
def acquire_verify_selection(spark, d):
    """A recorded walk of five works a register against the planned one: where they first differ, null where they don't. What was recorded
    for registers from p on was drawn with another seed."""
    a, b = _walk(spark, d), _walk(spark, d, 8)
    recorded = a.where("position <= 5 and register < 'p'").unionByName(b.where("position <= 5 and register >= 'p'"))
    return S.walk_divergence(recorded, a, "register", "position", "slug")


# ---- turns
@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def context_turns_limit(spark, d):
    """The last five turns of each conversation; an event is a turn of its user."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 5").select("user_id", "event_id", "event_type", "ts")


@query("WITH t AS (SELECT user_id, ts, event_id, unnest([1, 2]) AS place, unnest([event_type, 'k' || json_extract_string(props, '$.k')]) AS source FROM events), m AS (SELECT user_id, source, max((ts, event_id, -place)) AS last FROM t WHERE source IS NOT NULL GROUP BY 1, 2) SELECT user_id, string_agg(source, ' ' ORDER BY last DESC) AS sources FROM m GROUP BY 1")
def conversation_sources(spark, d):
    """The sources that each user's turns touched, the last touched first, within a turn what is cited (the type) before the evidence (the
    key of its properties). A user has few different sources, whatever the number of turns."""
    e = table(spark, d, "events")
    t = e.select("user_id", "ts", "event_id", F.posexplode(F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k")))).alias("place", "source")).where("source is not null")
    m = t.groupBy("user_id", "source").agg(F.max(F.struct("ts", "event_id", (-F.col("place")).alias("place"))).alias("last"))
    g = m.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("last", "source")), asc=False).alias("l"))
    return g.select("user_id", F.array_join(F.transform("l", lambda s: s["source"]), " ").alias("sources"))


_MODE = f"md AS (SELECT doc_id AS query, CASE WHEN source IS NOT NULL AND (list_has_any(w, [{_CONTINUATION}]) OR list_has_any(w, [regexp_extract(path, '^([a-z]+)-pg', 1)])) THEN 'follow_up' WHEN list_has_any(w, [{_INFORMATION}]) OR ends_with(rtrim(text, ' '), '?') THEN 'retrieve' ELSE 'none' END AS mode FROM (SELECT doc_id, text, source, path, {_TOK} AS w FROM documents WHERE text IS NOT NULL AND doc_id % 100 = 0))"


@query(f"WITH {BM25}, {_MODE}, pk AS (SELECT lex.query, lex.rank, lex.chunk, d.source FROM lex JOIN documents d ON d.doc_id = lex.chunk JOIN documents o ON o.doc_id = lex.query JOIN md ON md.query = lex.query WHERE mode = 'retrieve' OR (mode = 'follow_up' AND d.source = o.source)) SELECT md.query, mode, coalesce(e.evidence, '') AS evidence FROM md LEFT JOIN (SELECT query, string_agg('[' || chunk || '] ' || coalesce(source, ''), chr(10) ORDER BY rank) AS evidence FROM pk GROUP BY 1) e ON e.query = md.query")
def turn_runtime(spark, d):
    """Every query as a turn: planned, retrieved for if its plan says so (a follow-up only within its source), and its evidence rendered."""
    t = table(spark, d, "documents").where("text is not null")
    topic = F.array(F.regexp_extract("path", "^([a-z]+)-pg", 1))
    plan = t.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("source").alias("own"), X.plan(T.planner_tokens(F.col("text")), F.col("text"), F.col("source").isNotNull(), topic).alias("mode"))
    found = _lexical(spark, d).join(t.select(F.col("doc_id").alias("chunk"), "source"), "chunk").join(plan, "query").where("mode = 'retrieve' or (mode = 'follow_up' and source = own)")
    line = F.concat(F.lit("["), F.col("chunk").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")))
    shown = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # at most a pack
    return plan.join(shown, "query", "left").select("query", "mode", F.coalesce(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("")).alias("evidence"))


# ---- texts against a reference
_QUALITY = "qd AS (SELECT CASE WHEN register IS NULL OR trim(register) = '' THEN regexp_extract(path, '^([a-z]+)-pg', 1) ELSE lower(trim(register)) END AS register, " + ", ".join(f"CASE WHEN len(w) >= 8 THEN len(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))) / (len(w) - {n} + 1) END AS d{n}" for n in (1, 2, 3)) + " FROM (SELECT register, path, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''’]+') AS w FROM documents WHERE text IS NOT NULL))"


def _quality(spark, d):
    t = docs(spark, d).select(N.register_of(F.col("register"), F.col("path")).alias("register"), T.words_apostrophe(F.col("text")).alias("w"))
    return t.select("register", *[T.distinct_ratio(F.col("w"), n).alias(f"d{n}") for n in (1, 2, 3)])


@query(f"WITH {_QUALITY} SELECT register, count(*) AS texts, " + ", ".join(f"count(d{n}) AS defined_{n}, round(avg(d{n}), 6) AS mean_{n}, round(stddev_samp(d{n}), 6) AS sd_{n}" for n in (1, 2, 3)) + " FROM qd GROUP BY 1")
def agg_quality_rows(spark, d):
    """Means and deviations of the distinct n-gram ratios of each register's texts, over the texts that have them."""
    q = _quality(spark, d)
    return q.groupBy("register").agg(F.count("*").alias("texts"), *[x for n in (1, 2, 3) for x in (F.count(f"d{n}").alias(f"defined_{n}"), F.round(F.avg(f"d{n}"), 6).alias(f"mean_{n}"), F.round(F.stddev_samp(f"d{n}"), 6).alias(f"sd_{n}"))])


@query(f"WITH {_QUALITY}, g AS (SELECT register, avg(d1) AS d1, avg(d2) AS d2, avg(d3) AS d3 FROM qd GROUP BY 1), r AS (SELECT avg(d1) AS r1, avg(d2) AS r2, avg(d3) AS r3 FROM qd) SELECT register, n AS gate, round(gap, 6) AS gap, abs(gap) <= 0.02 AS passes FROM (SELECT register, unnest([1, 2, 3]) AS n, unnest([d1 - r1, d2 - r2, d3 - r3]) AS gap FROM g, r)")
def agg_quality_gates(spark, d):
    """Each register's means within 0.02 of those of all texts, on either side."""
    q = _quality(spark, d)
    whole = q.agg(*[F.avg(f"d{n}").alias(f"r{n}") for n in (1, 2, 3)]).first()
    g = q.groupBy("register").agg(*[F.avg(f"d{n}").alias(f"d{n}") for n in (1, 2, 3)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), (F.col(f"d{n}") - F.lit(whole[n - 1])).alias("gap")) for n in (1, 2, 3)])).alias("e")
    return g.select("register", each).select("register", "e.gate", F.round("e.gap", 6).alias("gap"), (F.abs("e.gap") <= 0.02).alias("passes"))


# ---- studies
@query(f"WITH {L}, e AS (SELECT DISTINCT experiment, run_seed FROM l WHERE experiment IS NOT NULL AND run_seed IS NOT NULL), s AS (SELECT DISTINCT run_seed FROM e), x AS (SELECT DISTINCT experiment FROM e) SELECT x.experiment, count(e.run_seed) AS runs, count(*) - count(e.run_seed) AS missing, coalesce(string_agg(s.run_seed::VARCHAR, ' ' ORDER BY s.run_seed) FILTER (e.run_seed IS NULL), '') AS missing_seeds FROM x CROSS JOIN s LEFT JOIN e ON e.experiment = x.experiment AND e.run_seed = s.run_seed GROUP BY 1")
def study_collect(spark, d):
    """The runs of each experiment, and which of the seeds that others ran it lacks. Experiments and seeds are few."""
    e = losses(spark, d).where("experiment is not null and run_seed is not null").select("experiment", "run_seed").distinct()
    every = e.agg(F.array_sort(F.collect_set("run_seed")).alias("every"))
    g = e.groupBy("experiment").agg(F.collect_set("run_seed").alias("own")).join(F.broadcast(every), F.lit(True))
    lost = F.array_sort(F.array_except("every", "own"))
    return g.select("experiment", F.size("own").cast("bigint").alias("runs"), F.size(lost).cast("bigint").alias("missing"), F.array_join(F.transform(lost, lambda s: s.cast("string")), " ").alias("missing_seeds"))


_VERDICTS = f"{L}, vi AS (SELECT experiment AS model, path AS item, (avg(x) < 0)::INT AS v, sha256('7|' || path) AS k FROM l WHERE experiment IS NOT NULL AND path IS NOT NULL GROUP BY experiment, path)"


@query(f"WITH {_VERDICTS}, p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY k) - 1 AS i FROM vi) SELECT model, (i // 4096)::BIGINT AS block, count(*) AS items, sum(v)::BIGINT AS ones, sha256(string_agg(v::VARCHAR, '' ORDER BY i)) AS bits, true AS same FROM p GROUP BY 1, 2")
def outcome_codec(spark, d):
    """Verdicts on documents as strings of bits in the order of their keys, 4,096 to a string, with the digest; and whether reading the
    strings gives the verdicts back."""
    v = losses(spark, d).where("experiment is not null and path is not null").groupBy(F.col("experiment").alias("model"), F.col("path").alias("item")).agg((F.avg("x") < 0).cast("int").alias("v"))
    p = cut(S.prefix_sum(v.withColumn("key", S.order_key(7, F.col("item"))), "key", F.lit(1), ["model"]).select("model", "v", (F.col("position") - 1).alias("i")))
    enc = p.groupBy("model", F.floor(F.col("i") / 4096).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"].cast("string")), "").alias("bits"))
    back = enc.select("model", "block", "bits", F.posexplode(F.filter(F.split("bits", ""), lambda b: b != "")).alias("at", "bit"))
    j = back.withColumn("i", F.col("block") * 4096 + F.col("at")).join(p, ["model", "i"], "full_outer")
    return j.groupBy("model", "block").agg(F.count("*").alias("items"), F.sum(F.col("bit").cast("int")).alias("ones"), F.sha2(F.first("bits"), 256).alias("bits"), F.every(F.col("bit").cast("int").eqNullSafe(F.col("v"))).alias("same"))


_POOLS = f"{L}, ra AS (SELECT arm, max(packed_identifiers) AS packed, count(DISTINCT capacity_chars) = 1 AND count(DISTINCT context_length) = 1 AS same FROM results_arms WHERE arm IS NOT NULL GROUP BY 1), bi AS (SELECT arm, avg(b) AS bits FROM (SELECT first_arm AS arm, a AS b FROM l UNION ALL SELECT second_arm, b FROM l) GROUP BY 1), po AS (SELECT ra.arm, packed, same, bits, row_number() OVER (ORDER BY packed NULLS LAST, ra.arm) AS i FROM ra LEFT JOIN bi USING (arm))"


@query(f"WITH {_POOLS} SELECT p.arm AS smaller, q.arm AS larger, p.same AND q.same AS identical, round(q.bits - p.bits + 1e-11, 6) AS difference, CASE WHEN NOT (p.same AND q.same) OR p.bits IS NULL OR q.bits IS NULL THEN 'not_read' WHEN abs(q.bits - p.bits) <= 0.002 THEN 'tie' WHEN abs(q.bits - p.bits) <= 0.01 THEN 'indeterminate' ELSE 'separable' END AS grade FROM po p JOIN po q ON q.i = p.i + 1")
def classify_passes(spark, d):
    """Each arm against the next larger pool: graded by its loss, if each was reported with one capacity and context and has losses."""
    t = table(spark, d, "results_arms").where("arm is not null").groupBy("arm").agg(F.max("packed_identifiers").alias("packed"), ((F.count_distinct("capacity_chars") == 1) & (F.count_distinct("context_length") == 1)).alias("same"))
    x = losses(spark, d)
    bits = x.select(F.col("first_arm").alias("arm"), F.col("a").alias("b")).unionByName(x.select(F.col("second_arm").alias("arm"), "b")).groupBy("arm").agg(F.avg("b").alias("bits"))
    w = Window.orderBy(F.col("packed").asc_nulls_last(), "arm")  # arms are few
    p = t.join(bits, "arm", "left").select("*", F.lead("arm").over(w).alias("larger"), F.lead("same").over(w).alias("also"), F.lead("bits").over(w).alias("more")).where("larger is not null")
    gap, both = F.col("more") - F.col("bits"), F.col("same") & F.col("also")
    grade = F.when(~both | gap.isNull(), "not_read").otherwise(Z.classify_difference(gap, F.lit(0.002), F.lit(0.01)))
    return p.select(F.col("arm").alias("smaller"), "larger", both.alias("identical"), F.round(gap + Z.HALF, 6).alias("difference"), grade.alias("grade"))


_BITS = "rb AS (SELECT experiment, run_seed, CASE WHEN regexp_extract(lower(path), '([a-z]+)-pg', 1) = '' THEN NULL ELSE regexp_extract(lower(path), '([a-z]+)-pg', 1) END AS register, sum(a * n) / sum(n) AS short, sum(b * n) / sum(n) AS long FROM l WHERE experiment IS NOT NULL AND run_seed IS NOT NULL GROUP BY 1, 2, 3), se AS (SELECT experiment, run_seed, avg(short) - avg(long) AS delta FROM rb GROUP BY 1, 2)"


@query(f"WITH {L}, {_BITS}, g AS (SELECT experiment, count(*) AS pairs, avg(delta) AS m, min(delta) AS worst FROM se GROUP BY 1) SELECT experiment, pairs, round(m + 1e-11, 6) AS mean_delta, round(worst + 1e-11, 6) AS worst_delta, CASE WHEN m <= -0.02 THEN 'regression' WHEN m >= 0.02 AND worst > -0.02 THEN 'gain' WHEN m >= 0.02 THEN 'mixed' ELSE 'none' END AS outcome FROM g")
def budget_pair_read(spark, d):
    """The short and the long arm of each run by the mean of its registers, alike in weight; the facts of an experiment decide by rules."""
    reg = F.nullif(F.regexp_extract(F.lower("path"), "([a-z]+)-pg", 1), F.lit(""))
    t = losses(spark, d).where("experiment is not null and run_seed is not null")
    per = t.groupBy("experiment", "run_seed", reg.alias("register")).agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(k) for c, k in (("a", "short"), ("b", "long"))])
    seed = per.groupBy("experiment", "run_seed").agg((F.avg("short") - F.avg("long")).alias("delta"))
    g = seed.groupBy("experiment").agg(F.count("*").alias("pairs"), F.avg("delta").alias("m"), F.min("delta").alias("worst"))
    rules = [("regression", {"fact": "m", "max": -0.02}), ("gain", {"all_of": [{"fact": "m", "min": 0.02}, {"flag": "steady"}]}), ("mixed", {"fact": "m", "min": 0.02}), ("none", {"always": True})]
    g = g.withColumn("steady", F.col("worst") > -0.02)
    return g.select("experiment", "pairs", F.round(F.col("m") + Z.HALF, 6).alias("mean_delta"), F.round(F.col("worst") + Z.HALF, 6).alias("worst_delta"), X.outcome(rules).alias("outcome"))


_PAIRED = f"{L}, cr AS (SELECT experiment, avg(x) AS c FROM l WHERE experiment IS NOT NULL GROUP BY 1 HAVING count(DISTINCT first_arm) <= 1 AND count(DISTINCT second_arm) <= 1), v AS (SELECT experiment, work, avg(x) AS v FROM l WHERE experiment IN (SELECT experiment FROM cr) GROUP BY 1, 2), pp AS (SELECT a.experiment AS first, b.experiment AS second, count(*) FILTER (a.v < b.v) AS b, count(*) FILTER (a.v > b.v) AS c FROM v a JOIN v b ON a.work = b.work AND a.experiment < b.experiment GROUP BY 1, 2), pq AS (SELECT first, second, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {tail_sql('greatest(b, c)', '(b + c)')}) END AS p FROM pp), pr AS (SELECT first, second, abs(f.c - s.c) > 0.005 AS material, p <= 0.05 AS separated, sign(pq.b - pq.c) = -sign(f.c - s.c) AS agrees FROM pq JOIN cr f ON f.experiment = first JOIN cr s ON s.experiment = second)"


@query(f"WITH {_PAIRED}, f AS (SELECT count(*) FILTER (material) AS material_pairs, count(*) FILTER (NOT material) AS inside_band_pairs, count(*) FILTER (material AND separated AND agrees) AS ranked, count(*) FILTER (separated AND NOT agrees) AS contradicted, count(*) FILTER (NOT material AND separated) AS false_positives FROM pr) SELECT *, CASE WHEN contradicted > 0 THEN 'contradicts' WHEN material_pairs > 0 AND ranked = material_pairs THEN 'ranks_all' WHEN ranked > 0 THEN 'ranks_some' ELSE 'silent' END AS outcome FROM f")
def arm_pairs_read(spark, d):
    """Pairs of experiments whose arms are one each: which a criterion (the mean difference) tells apart by more than 0.005, which an exact
    test over works does, whether the two agree, and the outcome of these facts."""
    t = losses(spark, d).where("experiment is not null")
    cr = cut(t.groupBy("experiment").agg(F.avg("x").alias("c"), F.count_distinct("first_arm").alias("n"), F.count_distinct("second_arm").alias("m")).where("n <= 1 and m <= 1").select("experiment", "c"))
    v = t.join(F.broadcast(cr.select("experiment")), "experiment", "left_semi").groupBy("experiment", "work").agg(F.avg("x").alias("v"))
    a, b = v.select(F.col("experiment").alias("first"), "work", F.col("v").alias("va")), v.select(F.col("experiment").alias("second"), "work", F.col("v").alias("vb"))
    p = a.join(b, "work").where("first < second").groupBy("first", "second").agg(F.count_if(F.col("va") < F.col("vb")).alias("b"), F.count_if(F.col("va") > F.col("vb")).alias("c"))
    f, s = cr.select(F.col("experiment").alias("first"), F.col("c").alias("cf")), cr.select(F.col("experiment").alias("second"), F.col("c").alias("cs"))
    x = p.join(f, "first").join(s, "second").select((F.abs(F.col("cf") - F.col("cs")) > 0.005).alias("material"), (Z.mcnemar_p(F.col("b"), F.col("c")) <= 0.05).alias("separated"), (F.signum(F.col("b") - F.col("c")) == -F.signum(F.col("cf") - F.col("cs"))).alias("agrees"))
    n = lambda c: F.count_if(F.expr(c))
    g = x.agg(n("material").alias("material_pairs"), n("not material").alias("inside_band_pairs"), n("material and separated and agrees").alias("ranked"), n("separated and not agrees").alias("contradicted"), n("not material and separated").alias("false_positives"))
    return g.withColumn("outcome", F.when(F.col("contradicted") > 0, "contradicts").when((F.col("material_pairs") > 0) & (F.col("ranked") == F.col("material_pairs")), "ranks_all").when(F.col("ranked") > 0, "ranks_some").otherwise("silent"))


_OBJECTIVES = "ob AS (SELECT second_arm AS arm, coalesce(nullif(regexp_extract(lower(path), '([a-z]+)-pg', 1), ''), 'none') AS objective, round(sum(b * n) / sum(n), 9) AS bits FROM l WHERE second_arm IS NOT NULL GROUP BY 1, 2), oa AS (SELECT * FROM ob UNION ALL SELECT arm, 'macro', round(avg(bits), 9) FROM ob GROUP BY 1), sh AS (SELECT arm, row_number() OVER (ORDER BY arm) / count(*) OVER () AS share FROM (SELECT DISTINCT arm FROM ob)), ss AS (SELECT objective, share, bits FROM oa JOIN sh USING (arm))"


@query(f"WITH {L}, {_OBJECTIVES}, bb AS (SELECT objective, min(share) AS lo, max(share) AS hi, arg_min(share, (bits, share)) AS bs, min(bits) AS bv FROM ss GROUP BY 1) SELECT bb.objective, round(bs, 6) AS best_share, CASE WHEN bs NOT IN (lo, hi) AND bool_and(share NOT IN (lo, hi) OR bits - bv > 0.002 + 1e-12) THEN 'interior_optimum' WHEN bs IN (lo, hi) AND bool_and(share = bs OR bits - bv > 0.002 + 1e-12) THEN 'boundary_optimum' ELSE 'unresolved' END AS outcome, count(*) FILTER (bits - bv <= 0.002 + 1e-12) AS within_margin FROM bb JOIN ss USING (objective) GROUP BY bb.objective, bs, lo, hi, bv")
def sweep_analysis(spark, d):
    """Arms in the order of their names as a sweep of shares, read by every register and by the equal mean of all."""
    ob = _arms(spark, d).where("arm is not null").select("arm", F.coalesce("register", F.lit("none")).alias("objective"), F.round("bits", 9).alias("bits"))
    both = cut(ob.unionByName(ob.groupBy("arm").agg(F.round(F.avg("bits"), 9).alias("bits")).select("arm", F.lit("macro").alias("objective"), "bits")))
    share = both.select("arm").distinct().select("arm", (F.row_number().over(Window.orderBy("arm")) / F.count("*").over(Window.partitionBy())).alias("share"))
    x = both.join(F.broadcast(share), "arm")
    g = x.groupBy("objective").agg(F.min("share").alias("lo"), F.max("share").alias("hi"), F.min(F.struct("bits", "share")).alias("best"), F.collect_list(F.struct("share", "bits")).alias("all"))  # arms are few
    s, v = F.col("best.share"), F.col("best.bits")
    edge = (s == F.col("lo")) | (s == F.col("hi"))
    worse = lambda a: a["bits"] - v > 0.002 + Z.SLACK
    inner = F.forall("all", lambda a: ~((a["share"] == F.col("lo")) | (a["share"] == F.col("hi"))) | worse(a))
    outer = F.forall("all", lambda a: (a["share"] == s) | worse(a))
    return g.select("objective", F.round(s, 6).alias("best_share"), F.when(~edge & inner, "interior_optimum").when(edge & outer, "boundary_optimum").otherwise("unresolved").alias("outcome"), F.size(F.filter("all", lambda a: ~worse(a))).cast("bigint").alias("within_margin"))


# ---- citations of titles
_TITLE_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}]{{3,}}'))"


@query(f"WITH ci AS (SELECT ebook_number AS n, listed_at, title FROM catalogue WHERE title IS NOT NULL), fi AS (SELECT ebook_number AS n, arg_min(title, (listed_at, title)) AS actual FROM catalogue WHERE title IS NOT NULL AND ebook_number % 5 <> 0 GROUP BY 1), j AS (SELECT ci.n, listed_at, title, actual, {_TITLE_WORDS.format('title')} AS w, {_TITLE_WORDS.format('actual')} AS a FROM ci LEFT JOIN fi ON fi.n = ci.n) SELECT n AS ebook_number, listed_at, CASE WHEN actual IS NULL THEN 'unresolved' WHEN len(w) = 0 OR len(list_intersect(w, a)) < 0.6 * len(w) THEN 'title-mismatch' ELSE 'title-ok' END AS verdict FROM j")
def discrepancy_archive_catalog(spark, d):
    """Citations of works by number and title against an archive that lacks every fifth: a title holds if three fifths of its words of
    three letters or more stand in the real one. The citations are read out of sentences."""
    c = table(spark, d, "catalogue").where("title is not null")
    said = F.concat(F.lit("see pg"), F.col("ebook_number").cast("string"), F.lit(' (*'), "title", F.lit("*)"))
    cited = c.select("listed_at", said.alias("s")).select("listed_at", F.regexp_extract("s", r"pg(\d+)", 1).cast("bigint").alias("ebook_number"), F.regexp_extract("s", r"(?s)\(\*(.*)\*\)$", 1).alias("cited"))
    archive = c.where("ebook_number % 5 <> 0").groupBy("ebook_number").agg(F.min_by("title", F.struct("listed_at", "title")).alias("actual"))
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}]{3,})"), F.lit(1)))
    x = cited.join(archive, "ebook_number", "left").withColumn("w", words("cited"))
    short = (F.size("w") == 0) | (F.size(F.array_intersect("w", words("actual"))) < 0.6 * F.size("w"))
    return x.select("ebook_number", "listed_at", F.when(F.col("actual").isNull(), "unresolved").when(short, "title-mismatch").otherwise("title-ok").alias("verdict"))


# ---- pairs from frames
_FRAMES = "fr AS (SELECT ph, a.n_name AS x, b.n_name AS y, v FROM nation a, nation b, (SELECT unnest(['order', 'repeat']) AS ph), (SELECT unnest(['sends', 'sells', 'owes']) AS v) WHERE a.n_nationkey <> b.n_nationkey), fs AS (SELECT ph, lower(x) || ' ' || v || ' grain to ' || lower(y) AS good, CASE ph WHEN 'order' THEN lower(x) || ' grain ' || v || ' to ' || lower(y) ELSE lower(x) || ' ' || v || ' ' || v || ' grain to ' || lower(y) END AS bad FROM fr), fk AS (SELECT *, sha256('7|' || ph || '|' || good) AS k FROM fs WHERE good <> bad)"


@query(f"WITH {_FRAMES}, o AS (SELECT ph, good, bad FROM fk WHERE ph = 'order' QUALIFY row_number() OVER (ORDER BY k, good) <= 60), r AS (SELECT ph, good, bad FROM fk WHERE ph = 'repeat' AND good NOT IN (SELECT good FROM o) QUALIFY row_number() OVER (ORDER BY k, good) <= 60) SELECT ph AS phenomenon, good, bad FROM o UNION ALL SELECT ph, good, bad FROM r")
def pairs_generate(spark, d):
    """Pairs of a good and a false sentence from a small lexicon: for each phenomenon in turn the first 60 frames in seeded order whose good
    sentence no phenomenon before has taken."""
    n = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    verbs = spark.createDataFrame([("sends",), ("sells",), ("owes",)], "v string")
    frames = n.select(F.col("n").alias("x"), F.col("n_nationkey").alias("i")).join(n.select(F.col("n").alias("y"), F.col("n_nationkey").alias("j")), F.col("i") != F.col("j")).join(verbs, F.lit(True))
    good = F.concat_ws(" ", "x", "v", F.lit("grain to"), "y")
    false = {"order": F.concat_ws(" ", "x", F.lit("grain"), "v", F.lit("to"), "y"), "repeat": F.concat_ws(" ", "x", "v", "v", F.lit("grain to"), "y")}
    return S.pick_unique([frames.select(F.lit(ph).alias("phenomenon"), good.alias("good"), bad.alias("bad")) for ph, bad in false.items()], "good", 60, lambda x: S.order_key(7, x["phenomenon"], x["good"]))
