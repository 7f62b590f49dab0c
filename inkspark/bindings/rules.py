"""Decision rules over claims, turns and corrections that are derived from the tables at hand.

A document that cites comes from retrieval; turns are a user's events in order; a work's later listing corrects the one before.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.bindings.retrieval import _VALID, BM25, _claims, _lexical
from inkspark.functions import text as T
from inkspark.operators import digests as G
from inkspark.operators import retrieval as R
from inkspark.operators import rules as X
from inkspark.plans.lineage import cut
from inkspark.plans.registry import query, table

_INFORMATION = "'according', 'compare', 'define', 'describe', 'explain', 'find', 'how', 'list', 'lookup', 'retrieve', 'search', 'tell', 'what', 'when', 'where', 'which', 'who', 'why'"
_CONTINUATION = "'again', 'also', 'both', 'either', 'else', 'first', 'it', 'its', 'more', 'neither', 'second', 'than', 'that', 'these', 'they', 'them', 'this', 'those'"
_TOK = "list_distinct(list_filter(list_transform(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^ \\t\\n\\r]+'), lambda t: regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')), lambda t: t <> ''))"


@query(f"WITH t AS (SELECT doc_id, text, {_TOK} AS w, source IS NOT NULL AS has, [regexp_extract(path, '^([a-z]+)-pg', 1)] AS topic FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN has AND (list_has_any(w, [{_CONTINUATION}]) OR list_has_any(w, topic)) THEN 'follow_up' WHEN list_has_any(w, [{_INFORMATION}]) OR ends_with(rtrim(text, ' '), '?') THEN 'retrieve' ELSE 'none' END AS mode FROM t")
def plan_query(spark, d):
    """Each document as a message: a source makes prior sources, its register is the topic."""
    t = table(spark, d, "documents").where("text is not null")
    topic = F.array(F.regexp_extract("path", "^([a-z]+)-pg", 1))
    return t.select("doc_id", X.plan(T.planner_tokens(F.col("text")), F.col("text"), F.col("source").isNotNull(), topic).alias("mode"))


def _grounded(spark, d):
    return X.ground(R.validate_citations(*_claims(spark, d)), F.lit(True))


_GROUND = f"{_VALID}, gr AS (SELECT claim, CASE WHEN bool_or(status = 'valid') THEN 'supported' ELSE 'unsupported' END AS status FROM val GROUP BY 1)"


@query(f"WITH {_GROUND} SELECT claim, status FROM gr")
def ground_structural(spark, d):
    return _grounded(spark, d)


_DECIDE = f"{_GROUND}, de AS (SELECT claim, claim % 3 AS answer, CASE WHEN claim % 200 = 0 THEN 'supported' ELSE 'not_evaluated' END AS prior, CASE WHEN claim % 700 = 0 THEN 'contradicted' WHEN claim % 300 = 0 THEN 'not_evaluated' ELSE status END AS new FROM gr), dc AS (SELECT *, CASE WHEN new = 'contradicted' THEN 'correct' WHEN prior = 'supported' AND new <> 'supported' THEN 'qualify' ELSE 'retain' END AS decision FROM de)"


def _decided(spark, d):
    g = _grounded(spark, d)
    prior = F.when(F.col("claim") % 200 == 0, "supported").otherwise("not_evaluated")
    new = F.when(F.col("claim") % 700 == 0, "contradicted").when(F.col("claim") % 300 == 0, "not_evaluated").otherwise(F.col("status"))
    x = g.select("claim", (F.col("claim") % 3).alias("answer"), prior.alias("prior"), new.alias("new"))
    return x.withColumn("decision", X.decide_claim(F.col("prior"), F.col("new")))


@query(f"WITH {_DECIDE} SELECT claim, prior, new, decision FROM dc")
def decide_claim(spark, d):
    return _decided(spark, d).select("claim", "prior", "new", "decision")


@query(f"WITH {_DECIDE} SELECT answer, CASE WHEN bool_or(decision = 'correct') THEN 'correct' WHEN bool_or(decision = 'qualify') THEN 'qualify' WHEN bool_and(new = 'not_evaluated') THEN 'abstain' ELSE 'retain' END AS decision FROM dc GROUP BY 1")
def decide_answer(spark, d):
    return X.decide_answer(_decided(spark, d), "answer", "decision", "new")


@query(f"WITH {_DECIDE} SELECT round(count(*) FILTER (new = 'contradicted' AND decision = 'correct') / nullif(count(*) FILTER (new = 'contradicted'), 0), 6) AS success, round(count(*) FILTER (prior = 'supported' AND new <> 'supported' AND decision = 'retain') / nullif(count(*) FILTER (prior = 'supported' AND new <> 'supported'), 0), 6) AS unjustified_persistence, round(count(*) FILTER (new = 'supported' AND decision <> 'retain') / nullif(count(*) FILTER (new = 'supported'), 0), 6) AS unnecessary_revision FROM dc")
def agg_correction_rates(spark, d):
    c = _decided(spark, d)
    rate = lambda a, b: F.round(F.try_divide(F.count_if(F.expr(a)), F.count_if(F.expr(b))), 6)
    return c.agg(rate("new = 'contradicted' and decision = 'correct'", "new = 'contradicted'").alias("success"), rate("prior = 'supported' and new <> 'supported' and decision = 'retain'", "prior = 'supported' and new <> 'supported'").alias("unjustified_persistence"), rate("new = 'supported' and decision <> 'retain'", "new = 'supported'").alias("unnecessary_revision"))


@query(f"WITH {_DECIDE}, {G.tree_sql('per', 'SELECT answer, ' + G.row_sql('claim', 'decision') + ' AS d FROM dc', ['answer'])} SELECT 'cor_' || substr(digest, 1, 16) AS record, answer, corrected, qualified, retained FROM per JOIN (SELECT answer, count(*) FILTER (decision = 'correct') AS corrected, count(*) FILTER (decision = 'qualify') AS qualified, count(*) FILTER (decision = 'retain') AS retained FROM dc GROUP BY answer) USING (answer)")
def correction_record(spark, d):
    c = cut(_decided(spark, d))
    g = c.groupBy("answer").agg(*[F.count_if(F.col("decision") == v).alias(k) for k, v in (("corrected", "correct"), ("qualified", "qualify"), ("retained", "retain"))])
    return G.tree_digest(c, ["answer"], F.col("claim"), F.col("decision")).join(g, "answer").select(F.concat(F.lit("cor_"), F.substring("digest", 1, 16)).alias("record"), "answer", "corrected", "qualified", "retained")


@query(f"WITH {_DECIDE} SELECT decision, count(*) AS cases, round(count(*) FILTER (new = 'supported') / count(*), 6) AS supported_rate FROM dc GROUP BY 1")
def agg_correction_bench(spark, d):
    return _decided(spark, d).groupBy("decision").agg(F.count("*").alias("cases"), F.round(F.count_if(F.col("new") == "supported") / F.count("*"), 6).alias("supported_rate"))


@query(f"WITH {_DECIDE} SELECT answer, count(*) AS claims, round(count(*) FILTER (new = 'supported') / count(*), 6) AS coverage, bool_and(new = 'supported') AS grounded FROM dc GROUP BY 1")
def agg_answer_evaluation(spark, d):
    return _decided(spark, d).groupBy("answer").agg(F.count("*").alias("claims"), F.round(F.count_if(F.col("new") == "supported") / F.count("*"), 6).alias("coverage"), F.every(F.col("new") == "supported").alias("grounded"))


@query(f"WITH {_VALID} SELECT count(*) AS citations, round(coalesce(count(*) FILTER (status = 'valid') / nullif(count(*), 0), 0), 6) AS citation_validity, round(coalesce(count(DISTINCT claim) FILTER (status = 'valid') / nullif(count(DISTINCT claim), 0), 0), 6) AS grounded_rate FROM val")
def agg_grounded_answer(spark, d):
    v = R.validate_citations(*_claims(spark, d))
    zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return v.agg(F.count("*").alias("citations"), zero(F.count_if(F.col("status") == "valid"), F.count("*")).alias("citation_validity"), zero(F.count_distinct(F.when(F.col("status") == "valid", F.col("claim"))), F.count_distinct("claim")).alias("grounded_rate"))


_RULES = [("long", {"fact": "n_chars", "min": 4000}), ("technical", {"all_of": [{"flag": "technical"}, {"fact": "n_chars", "min": 1000}]}), ("short", {"any_of": [{"fact": "n_chars", "max": 50}, {"flag": "empty"}]}), ("plain", {"always": True})]


@query("SELECT doc_id, CASE WHEN n_chars >= 4000 THEN 'long' WHEN regexp_matches(path, '^(science|technology)') AND n_chars >= 1000 THEN 'technical' WHEN n_chars <= 50 OR text IS NULL THEN 'short' ELSE 'plain' END AS outcome FROM documents")
def outcome_rule_eval(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars", F.col("path").rlike("^(science|technology)").alias("technical"), F.col("text").isNull().alias("empty"))
    return t.select("doc_id", X.outcome(_RULES).alias("outcome"))


_LISTED = "o AS (SELECT ebook_number, listed_at, row_number() OVER (PARTITION BY ebook_number ORDER BY listed_at, url, title, author) AS k FROM catalogue)"


def _listings(spark, d):
    w = Window.partitionBy("ebook_number").orderBy("listed_at", F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("author").asc_nulls_last())
    x = table(spark, d, "catalogue").select("ebook_number", F.row_number().over(w).alias("k"))
    return x.select("ebook_number", F.concat_ws("-", "ebook_number", "k").alias("id"), F.when(F.col("k") > 1, F.concat_ws("-", "ebook_number", F.col("k") - 1)).alias("up"))


@query(f"WITH {_LISTED} SELECT ebook_number || '-' || k AS id, ebook_number || '-1' AS root, (k - 1)::BIGINT AS depth FROM o")
def answer_history(spark, d):
    """A work's later listings as corrections of the one before: the first listing and the depth of each."""
    return X.history(_listings(spark, d), "id", "up")


@query(f"WITH {_LISTED}, m AS (SELECT max(k) AS m FROM o) SELECT ebook_number || '-' || k AS id, 'duplicate' AS violation FROM o WHERE k = 2 UNION ALL SELECT ebook_number || '-' || k, 'dangling' FROM o WHERE k = 1")
def answer_append_check(spark, d):
    """Second listings offered again, and first ones that name a parent that never was."""
    x = _listings(spark, d)
    again = x.where(F.col("id").endswith("-2")).select("id", "up", F.col("ebook_number").alias("conv"))
    odd = x.where(F.col("id").endswith("-1")).select("id", F.concat(F.lit("none-"), "id").alias("up"), F.col("ebook_number").alias("conv"))
    old = x.where(~F.col("id").endswith("-1")).select("id", "up", F.col("ebook_number").alias("conv"))
    return X.append_violations(old, again.unionByName(odd), "id", "up", "conv")


@query("WITH r AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, string_agg(event_type, ' > ' ORDER BY r DESC) AS prompt FROM r WHERE r <= 5 GROUP BY 1")
def render_prompt(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    x = table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 5")
    g = x.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "event_type"))).alias("l"))
    return g.select("user_id", F.array_join(F.transform("l", lambda s: s["event_type"]), " > ").alias("prompt"))


@query(f"WITH {BM25} SELECT query, sha256(string_agg('[' || chunk || '] ' || coalesce(source, '') || chr(10) || text, chr(10) ORDER BY rank)) AS digest FROM lex JOIN documents d ON d.doc_id = lex.chunk GROUP BY 1")
def render_evidence(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit("\n"), "text").alias("body"))
    g = _lexical(spark, d).join(t, "chunk").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("l"))
    return g.select("query", F.sha2(F.array_join(F.transform("l", lambda s: s["body"]), "\n"), 256).alias("digest"))


@query("SELECT doc_id, substr(text, greatest(1, length(text) - 99)) AS tail FROM documents WHERE text IS NOT NULL")
def prompt_truncate(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.substring("text", F.greatest(F.lit(1), F.char_length("text") - 99), F.lit(100)).alias("tail"))


@query()
def interval_series(spark, d):
    """Per user the first of their daily totals that no later one beats, with patience of three days."""
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    a = g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("day").cast("bigint").alias("step"), (-F.col("v")).alias("loss")))).alias("c"))
    return a.select("user_id", X.last_improvement(F.col("c"), 1.0, 3).alias("day"))


@query("WITH c AS (SELECT user_id, ts::DATE AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2) SELECT user_id, arg_min(day, (v, day)) AS best_day, min(v) AS best, round(arg_max(v, day) - min(v), 6) AS final_minus_best FROM c GROUP BY 1")
def curve_reading(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    return g.groupBy("user_id").agg(F.min_by("day", F.struct("v", "day")).alias("best_day"), F.min("v").alias("best"), F.round(F.max_by("v", "day") - F.min("v"), 6).alias("final_minus_best"))


@query("SELECT lang, sha256('{\"bad\":\"' || min(bad) || '\",\"good\":\"' || min(good) || '\"}') AS version FROM minimal_pairs GROUP BY 1")
def content_version_json(spark, d):
    """The digest of a record as JSON with its keys in order."""
    g = table(spark, d, "minimal_pairs").groupBy("lang").agg(F.min("bad").alias("bad"), F.min("good").alias("good"))
    return g.select("lang", F.sha2(F.to_json(F.struct("bad", "good")), 256).alias("version"))


@query("SELECT register, lang, round(control / treatment, 6) AS ratio, CASE WHEN treatment > control * 1.4 THEN 'separable' WHEN treatment > control * 1.36 THEN 'indeterminate' ELSE 'tie' END AS class FROM results_characters_per_identifier WHERE treatment IS NOT NULL AND control IS NOT NULL AND NOT isnan(treatment) AND NOT isnan(control)")
def classify_tokenizer_arm(spark, d):
    t = table(spark, d, "results_characters_per_identifier").where("treatment is not null and control is not null and not isnan(treatment) and not isnan(control)")
    return t.select("register", "lang", F.round(F.col("control") / F.col("treatment"), 6).alias("ratio"), F.when(F.col("treatment") > F.col("control") * 1.4, "separable").when(F.col("treatment") > F.col("control") * 1.36, "indeterminate").otherwise("tie").alias("class"))
