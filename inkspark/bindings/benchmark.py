"""Benchmark runs: cases are the search queries, the test items, and passages of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspark.bindings.corpus import docs
from inkspark.bindings.retrieval import _STOPS, BM25, STOP, _case_sql, _cases, _index, _queries
from inkspark.bindings.text import WORDS
from inkspark.functions import notation as N
from inkspark.functions import text as T
from inkspark.operators import benchmark as B
from inkspark.operators import retrieval as R
from inkspark.plans.lineage import cut
from inkspark.plans.registry import query, table

_REGISTER = "CASE WHEN register IS NULL OR trim(register) = '' THEN regexp_extract(path, '^([a-z]+)-pg', 1) ELSE lower(trim(register)) END"
_SCORE = "(len(list_filter({1}, lambda x: list_contains({0}, x))) - length(array_to_string({1}, '')) / 100.0)"
_READ = "SELECT register, kind, reading, count(*) AS n, count(*) FILTER (v = 0.5) AS ties, round(avg(v) + 1e-11, 6) AS accuracy FROM (SELECT register, kind, unnest(['pmi', 'conditional', 'blind']) AS reading, unnest([CASE WHEN round(tw - tb, 9) > round(bw - bb, 9) THEN 1.0 WHEN round(tw - tb, 9) = round(bw - bb, 9) THEN 0.5 ELSE 0.0 END, CASE WHEN round(tw, 9) > round(bw, 9) THEN 1.0 WHEN round(tw, 9) = round(bw, 9) THEN 0.5 ELSE 0.0 END, CASE WHEN round(tb, 9) > round(bb, 9) THEN 1.0 WHEN round(tb, 9) = round(bb, 9) THEN 0.5 ELSE 0.0 END]) AS v FROM {0}) GROUP BY GROUPING SETS ((register, kind, reading), (kind, reading))"

_CONTEXT = f"""cw AS (SELECT doc_id AS id, source AS work, {_REGISTER} AS register, {WORDS} AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
 cs AS (SELECT id, unnest(range(8, len(w) - 31, 24)) AS o FROM cw WHERE len(w) >= 40), co AS (SELECT id, arg_min(o, sha256('offset|' || id || '|' || o)) AS o FROM cs GROUP BY 1),
 ct AS (SELECT id, work, register, o, w[o + 1:o + 16] AS prefix, w[o + 17:o + 24] AS truth, w[o - 7:o] AS prior_span, w[o + 25:o + 32] AS next_span FROM cw JOIN co USING (id)),
 cp AS (SELECT id, list(truth[i] ORDER BY sha256('permuted|' || id || '|' || o || '|' || i)) AS permuted FROM (SELECT id, o, truth, unnest(range(1, 9)) AS i FROM ct) GROUP BY 1),
 cx AS (SELECT *, list_reverse(truth) AS reversed, sha256('anchor|' || register || '|' || id) AS k FROM ct JOIN cp USING (id) WHERE prior_span <> truth AND next_span <> truth AND list_reverse(truth) <> truth AND permuted <> truth),
 c1 AS (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY register, work ORDER BY k) <= 2), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY register ORDER BY k) <= 20),
 ci AS (SELECT register, work, id, o, prefix, truth, unnest(['prior_span', 'next_span', 'reversed', 'permuted']) AS kind, unnest([prior_span, next_span, reversed, permuted]) AS candidate FROM c2)"""


def _context(spark, d):
    t = docs(spark, d).where("source is not null").select("doc_id", F.col("source").alias("work"), N.register_of(F.col("register"), F.col("path")).alias("register"), T.words(F.col("text")).alias("w"))
    return B.context_items(t, "doc_id", "w", "register", "work")


@query(f"WITH {_CONTEXT} SELECT register, id, o::INT AS offset, kind, array_to_string(truth, ' ') AS truth, array_to_string(candidate, ' ') AS candidate FROM ci")
def pick_context_items(spark, d):
    """Passages with four false continuations from the same text, at most 20 a register and two a work."""
    return _context(spark, d).select("register", "id", "offset", "kind", F.array_join("truth", " ").alias("truth"), F.array_join("candidate", " ").alias("candidate"))


def _scored(items):
    none = F.array().cast("array<string>")
    s = {"true_with": ("prefix", "truth"), "bad_with": ("prefix", "candidate"), "true_without": (None, "truth"), "bad_without": (None, "candidate")}
    return items.select("*", *[B.repeated_words(F.col(p) if p else none, F.col(c)).alias(k) for k, (p, c) in s.items()])


_FOUR = ", ".join(f"{_SCORE.format(p, c)} AS {k}" for k, p, c in (("tw", "prefix", "truth"), ("bw", "prefix", "candidate"), ("tb", "[]::VARCHAR[]", "truth"), ("bb", "[]::VARCHAR[]", "candidate")))


@query(f"WITH {_CONTEXT}, cc AS (SELECT register, kind, {_FOUR} FROM ci) {_READ.format('cc')}")
def score_context_items(spark, d):
    """How often the true continuation beats each kind of false one, given the passage, without it, and by the difference."""
    return B.readings(_scored(_context(spark, d)), "register", "kind")


_ITEM_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_ITEMS = f"iw AS (SELECT pair_identifier AS id, lang AS register, {_ITEM_WORDS.format('good')} AS g, {_ITEM_WORDS.format('bad')} AS b, sha256('7|' || pair_identifier) AS k FROM minimal_pairs), ie AS (SELECT *, coalesce(lead(g[5:]) OVER (PARTITION BY register ORDER BY k), first_value(g[5:]) OVER (PARTITION BY register ORDER BY k)) AS e FROM iw), ii AS (SELECT id, register, g[:4] AS prefix, g[5:] AS truth, unnest(['easy', 'hard']) AS kind, unnest([e, b[5:]]) AS candidate FROM ie)"


def _items(spark, d):
    """Test items as continuations: the first four words, the rest, the rest of the false text (hard) and that of the next item (easy)."""
    from pyspark.sql import Window

    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    w = Window.partitionBy("register").orderBy(F.sha2(F.concat(F.lit("7|"), "id"), 256))
    t = table(spark, d, "minimal_pairs").select(F.col("pair_identifier").alias("id"), F.col("lang").alias("register"), words("good").alias("g"), words("bad").alias("b"))
    rest = lambda c: F.slice(c, F.lit(5), F.greatest(F.size(c), F.lit(0)))
    t = t.withColumn("e", F.coalesce(F.lead(rest("g")).over(w), F.first(rest("g")).over(w)))
    each = F.explode(F.array(F.struct(F.lit("easy").alias("kind"), F.col("e").alias("candidate")), F.struct(F.lit("hard").alias("kind"), rest("b").alias("candidate")))).alias("x")
    return t.select("id", "register", F.slice("g", 1, 4).alias("prefix"), rest("g").alias("truth"), each).select("id", "register", "prefix", "truth", "x.*")


@query(f"WITH {_ITEMS}, cc AS (SELECT register, kind, {_FOUR} FROM ii) {_READ.format('cc')}")
def score_items(spark, d):
    """How often the rest of an item beats the rest of its false text, and that of another item."""
    return B.readings(_scored(_items(spark, d)), "register", "kind")


# a judge by words: the same words in another order contradict, the same text supports, half the words leave it open
_JUDGE = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} = {1} THEN 'supported' WHEN list_sort({0}) = list_sort({1}) THEN 'contradicted' WHEN len(list_intersect({0}, {1})) * 2 >= len(list_distinct({0})) THEN 'uncertain' ELSE 'no' END"


def _judge(claim, evidence):
    return F.when(claim == evidence, "supported").when(F.sort_array(claim) == F.sort_array(evidence), "contradicted").when(F.size(F.array_intersect(claim, evidence)) * 2 >= F.size(F.array_distinct(claim)), "uncertain").when(claim.isNotNull(), "no")


_CLAIMS = f"cl AS (SELECT pair_identifier, position, claim, {_ITEM_WORDS.format('claim')} AS c, {_ITEM_WORDS.format('good')} AS e, lang, phenomenon FROM (SELECT *, unnest([0, 1, 2]) AS position, unnest([good, bad, CASE WHEN phenomenon > 'm' THEN phenomenon END]) AS claim FROM minimal_pairs)), ju AS (SELECT *, {_JUDGE.format('c', 'e')} AS said FROM cl)"


def _claims(spark, d):
    """Three claims of each item, its good and its false text and a word, with the good text as evidence."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    odd = F.when(F.col("phenomenon") > "m", F.col("phenomenon"))
    t = table(spark, d, "minimal_pairs").select("pair_identifier", "lang", "phenomenon", "good", F.posexplode(F.array("good", "bad", odd)).alias("position", "claim"))
    return t.withColumn("c", words("claim")).withColumn("e", words("good")).withColumn("said", _judge(F.col("c"), F.col("e")))


@query("SELECT pair_identifier, position, CASE WHEN position = 0 THEN 'supported' WHEN position = 1 AND lang = 'en' THEN 'contradicted' ELSE 'not_evaluated' END AS status FROM minimal_pairs, (SELECT unnest([0, 1]) AS position)")
def ground_manual(spark, d):
    """Claims with statuses that were decided elsewhere: for every good text, and for the false ones in English."""
    c = _claims(spark, d).where("position < 2").select(F.concat_ws("-", "pair_identifier", "position").alias("claim"), "pair_identifier", "position", "lang")
    supplied = c.where("position = 0 or lang = 'en'").select("claim", F.when(F.col("position") == 0, "supported").otherwise("contradicted").alias("status"))
    return B.ground_supplied(c, supplied).select("pair_identifier", "position", "status")


@query(f"WITH {_CLAIMS} SELECT pair_identifier, position, CASE WHEN said IN ('supported', 'contradicted', 'uncertain') THEN said ELSE 'not_evaluated' END AS status, coalesce(said = 'contradicted', false) AS conflict FROM ju")
def ground_semantic(spark, d):
    """Claims by a judge of words; a claim without text makes the judge fail, and a contradiction names the two texts that disagree."""
    named = F.when(F.col("said") == "contradicted", F.array("good", "claim"))
    return B.ground_judged(_claims(spark, d), F.col("said"), named).select("pair_identifier", "position", "status", "conflict")


@query(f"WITH {_CLAIMS}, jr AS (SELECT CASE position WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'not_evaluated' END AS expected, CASE WHEN said IN ('supported', 'contradicted', 'uncertain') THEN said ELSE 'not_evaluated' END AS predicted, said IS NULL AS failed FROM ju) SELECT expected, predicted, count(*) AS cases, count(*) FILTER (expected = predicted) AS correct, count(*) FILTER (failed) AS failed FROM jr GROUP BY 1, 2")
def semantic_run(spark, d):
    """The judge over all claims against what they were made to be."""
    expected = F.when(F.col("position") == 0, "supported").when(F.col("position") == 1, "contradicted").otherwise("not_evaluated")
    c = _claims(spark, d).select(F.concat_ws("-", "pair_identifier", "position").alias("case"), expected.alias("expected"), "said")
    return B.judge_run(c, F.col("said")).groupBy("expected", "predicted").agg(F.count("*").alias("cases"), F.count_if("correct").alias("correct"), F.count_if("failed").alias("failed"))


_CORRECT = f"{_CLAIMS}, co AS (SELECT pair_identifier AS case_id, CASE WHEN position = 0 THEN 'supported' ELSE 'not_evaluated' END AS prior, CASE WHEN lang = 'en' AND position = 0 THEN 'uncertain' WHEN lang IN ('de', 'fr') AND position = 1 THEN 'not_evaluated' WHEN said IN ('supported', 'contradicted', 'uncertain') THEN said ELSE 'not_evaluated' END AS new, lang FROM ju), cd AS (SELECT *, CASE WHEN new = 'contradicted' THEN 'correct' WHEN prior = 'supported' AND new <> 'supported' THEN 'qualify' ELSE 'retain' END AS decision FROM co)"


def _corrected(spark, d):
    """Cases of three claims each, reassessed by the judge; in English the good text is doubted, in German and French the false one is not
    looked at."""
    said = F.when(F.col("said").isin("supported", "contradicted", "uncertain"), F.col("said")).otherwise("not_evaluated")
    new = F.when((F.col("lang") == "en") & (F.col("position") == 0), "uncertain").when(F.col("lang").isin("de", "fr") & (F.col("position") == 1), "not_evaluated").otherwise(said)
    return _claims(spark, d).select(F.col("pair_identifier").alias("case"), "lang", F.col("position").cast("string").alias("claim"), F.when(F.col("position") == 0, "supported").otherwise("not_evaluated").alias("prior"), new.alias("new"))


@query(f"WITH {_CORRECT}, ac AS (SELECT case_id, any_value(lang) AS lang, CASE WHEN bool_or(decision = 'correct') THEN 'correct' WHEN bool_or(decision = 'qualify') THEN 'qualify' WHEN bool_and(new = 'not_evaluated') THEN 'abstain' ELSE 'retain' END AS actual, count(*) FILTER (prior <> new) AS affected FROM cd GROUP BY 1) SELECT case_id, CASE WHEN lang IN ('de', 'fr') THEN 'retain' ELSE 'correct' END AS expected, actual, actual = CASE WHEN lang IN ('de', 'fr') THEN 'retain' ELSE 'correct' END AS correct, affected FROM ac")
def correction_run(spark, d):
    """Every case decided by its claims, against what was expected of it."""
    c = _corrected(spark, d)
    expected = c.select("case", F.when(F.col("lang").isin("de", "fr"), "retain").otherwise("correct").alias("expected")).distinct()
    return B.correction_run(c, expected).withColumnRenamed("case", "case_id")


# ---- runs over the search queries
_ANSWERABLE = f"{BM25}, {_case_sql('lex')}, gc AS (SELECT doc_id AS query, [coalesce(source, ''), coalesce(path, '')] AS facts, {_REGISTER} AS category, cm.gold_size > 0 AS answerable FROM documents JOIN cm ON cm.query = documents.doc_id), sg AS (SELECT r.query, list_sort(list(r.chunk)) AS cited FROM lex r JOIN gold g ON g.query = r.query AND g.chunk = r.chunk GROUP BY 1), oa AS (SELECT query, NOT answerable AS abstained, CASE WHEN answerable THEN array_to_string(facts, ' ') ELSE 'The supplied evidence does not support an answer.' END AS text, CASE WHEN answerable THEN 2 ELSE 0 END AS claims, CASE WHEN answerable THEN coalesce(cited, []) ELSE [] END AS cited, category, answerable, facts FROM gc LEFT JOIN sg USING (query))"


class _Run:
    """The stages of a run over the queries, each made once."""

    def __init__(self, spark, d):
        words = T.words(F.col("text"))
        self.index, qs = _index(spark, d), _queries(spark, d)
        self.results = cut(R.bm25(self.index, qs, "doc_id", words))
        self.metrics = cut(_cases(spark, d, self.results))
        self.queries, self.words = qs, words
        facts = F.array(F.coalesce("source", F.lit("")), F.coalesce("path", F.lit("")))
        named = qs.select(F.col("doc_id").alias("query"), facts.alias("facts"), N.register_of(F.col("register"), F.col("path")).alias("category"))
        self.cases = named.join(self.metrics.select("query", (F.col("gold_size") > 0).alias("answerable")), "query").withColumnRenamed("query", "case")
        of = table(spark, d, "documents").select("doc_id", "source")
        r = self.results.select("query", "chunk").join(of.select(F.col("doc_id").alias("chunk"), F.col("source").alias("a")), "chunk").join(of.select(F.col("doc_id").alias("query"), F.col("source").alias("b")), "query")
        self.surfaced = r.where("a = b and chunk <> query").select(F.col("query").alias("case"), "chunk")
        self.answers = B.oracle_answers(self.cases, self.surfaced)

    def run(self):
        enough = R.sufficient(self.queries, self.index, self.results, "doc_id", self.words, STOP)
        return B.grounded_run(self.cases, self.metrics, enough, self.answers, F.array(F.lit("Unsupported"), F.lit("does not SUPPORT")))


@query(f"WITH {_ANSWERABLE} SELECT query AS case_id, abstained, text, claims, cited FROM oa")
def oracle_answer(spark, d):
    """The answers of an oracle: source and path of each query as facts, citing what of its source was retrieved."""
    return _Run(spark, d).answers.withColumnRenamed("case", "case_id")


_SUFFICIENT = f"te AS (SELECT query, term FROM q JOIN df USING (term) CROSS JOIN s WHERE term NOT IN ({_STOPS}) AND df <= 0.25 * n), tf2 AS (SELECT te.query, count(DISTINCT te.term) AS covered FROM te JOIN lex ON lex.query = te.query JOIN tf ON tf.doc_id = lex.chunk AND tf.term = te.term GROUP BY 1)"
_GROUNDED = f"{_ANSWERABLE}, {_SUFFICIENT}, gn AS (SELECT oa.query AS case_id, answerable, category, recall, reciprocal_rank, hit, forbidden_hits, coalesce(tf2.covered, 0) > 0 AS sufficient, abstained, len(list_filter(facts, lambda f: contains(lower(text), lower(f)))) AS facts_found, contains(lower(text), 'unsupported')::INT + contains(lower(text), 'does not support')::INT AS prohibited_found, len(cited) > 0 AS grounded, abstained <> answerable AS right_disposition, CASE WHEN retrieved = 0 THEN 'retrieval' ELSE 'none' END AS failed_stage FROM oa JOIN cm ON cm.query = oa.query LEFT JOIN tf2 ON tf2.query = oa.query)"


@query(f"WITH {_GROUNDED} SELECT * FROM gn")
def grounded_run(spark, d):
    """Retrieve, judge sufficiency, answer and evaluate every query as a case."""
    return _Run(spark, d).run().withColumnRenamed("case", "case_id")


@query(f"WITH {_GROUNDED} SELECT failed_stage AS stage, count(*) AS cases FROM gn GROUP BY 1")
def agg_failures(spark, d):
    """Cases by the stage that failed."""
    return _Run(spark, d).run().groupBy(F.col("failed_stage").alias("stage")).agg(F.count("*").alias("cases"))


@query(f"WITH {_GROUNDED} SELECT category, count(*) AS cases, count(*) FILTER (answerable) AS scored, round(avg(recall) FILTER (answerable) + 1e-11, 6) AS recall, sum(forbidden_hits)::BIGINT AS forbidden_hits, count(*) FILTER (failed_stage <> 'none') AS failures FROM gn GROUP BY 1")
def agg_by_category(spark, d):
    """Cases, mean recall, forbidden hits and failures of each register."""
    r = _Run(spark, d).run()
    return r.groupBy("category").agg(F.count("*").alias("cases"), F.count_if("answerable").alias("scored"), F.round(F.avg(F.when(F.col("answerable"), F.col("recall"))) + 1e-11, 6).alias("recall"), F.sum("forbidden_hits").alias("forbidden_hits"), F.count_if(F.col("failed_stage") != "none").alias("failures"))


@query(f"WITH {_GROUNDED} SELECT count(*) AS cases, count(*) FILTER (answerable) AS answerable, round(avg(recall) FILTER (answerable) + 1e-11, 6) AS recall, round(avg(reciprocal_rank) FILTER (answerable) + 1e-11, 6) AS mrr, round(avg(hit::INT) FILTER (answerable) + 1e-11, 6) AS hit_rate, round(avg(grounded::INT) FILTER (answerable) + 1e-11, 6) AS grounded_rate FROM gn")
def agg_grounded_retrieval(spark, d):
    """Rates of retrieval over the answerable cases of a run."""
    r = _Run(spark, d).run()
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), F.col(c).cast("double"))) + 1e-11, 6)
    return r.agg(F.count("*").alias("cases"), F.count_if("answerable").alias("answerable"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("hit").alias("hit_rate"), mean("grounded").alias("grounded_rate"))


@query(f"WITH {_GROUNDED} SELECT count(*) AS cases, round(avg((sufficient = answerable)::INT), 6) AS accuracy, count(*) FILTER (answerable AND NOT sufficient) AS false_abstentions, count(*) FILTER (NOT answerable AND sufficient) AS missed_abstentions FROM gn")
def agg_sufficiency(spark, d):
    """Sufficiency of the queries against whether their source has other documents."""
    x = _Run(spark, d).run()
    return x.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("sufficient") == F.col("answerable")).cast("int")), 6).alias("accuracy"), F.count_if(F.col("answerable") & ~F.col("sufficient")).alias("false_abstentions"), F.count_if(~F.col("answerable") & F.col("sufficient")).alias("missed_abstentions"))
