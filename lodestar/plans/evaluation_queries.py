"""Evaluation: truth, retrieval scores, lexical faithfulness, aggregates, regressions, ratings, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text
from lodestar.operators import evaluate, observe, search
from lodestar.operators.answer import overlap
from lodestar.plans import sql
from lodestar.plans.answer_queries import ANSWERED, VARIANTS, indexed, prompts, questions
from lodestar.plans.retrieval_queries import asked, documents_as_items, lexical_hits
from lodestar.session import staged, table


def truth(spark, sf):
    """Documents that hold a benchmark text verbatim.

    The words inside a passage are whole words of such a document too, so an equi-join on the rarest of them finds the candidates, ids
    only, and their texts are fetched for the check. Documents are cut into words once, and only words that some passage has
    inside are kept. A passage of two words has none inside, but a document that holds it has a word that ends with the first; one of
    one word lies within a word. These are found by the ends and the pieces of the documents' different words.
    """
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), text.words(F.col("text")).alias("w"))
    bench = bench.where(F.length("passage") > 0)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    inner = bench.where(F.size("w") > 2).select("query_id", "passage", F.explode(F.array_distinct(F.slice("w", 2, F.size("w") - 2))).alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    short = bench.where(F.size("w").isin(1, 2)).select("query_id", "passage", F.get("w", 0).alias("piece"), (F.size("w") == 2).alias("ends"))
    lengths = sorted(r[0] for r in short.where("not ends").select(F.length("piece")).distinct().collect())
    any_short = bool(lengths) or not short.isEmpty()
    wanted = inner.select("word").distinct()
    if any_short:
        # Few passages are so short, and a language has far fewer different words than its texts have.
        known = staged(words.select("word").distinct(), "truth-words")
        at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
        tails = known.select("word", at).select("word", F.expr("substring(word, at)").alias("piece"), F.lit(True).alias("ends"))
        pieces = known.select("word", at, F.explode(F.array(*[F.lit(n) for n in lengths or [1]])).alias("n"))
        pieces = pieces.where("at + n - 1 <= length(word)").select("word", F.expr("substring(word, at, n)").alias("piece"), F.lit(False).alias("ends"))
        near = staged(tails.unionByName(pieces).join(short, ["piece", "ends"]).select("query_id", "passage", "word").distinct(), "truth-short")
        wanted = wanted.union(near.select("word")).distinct()
    held = staged(words.join(wanted, "word", "left_semi"), "truth-postings")
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # A word that no document has is the rarest, and meets none.
    rarest = inner.join(often, "word", "left").groupBy("query_id", "passage").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r"))
    keyed = rarest.select("query_id", "passage", F.col("r.word").alias("word"))
    if any_short:
        keyed = keyed.unionByName(near)
    met = keyed.join(held, "word").select("query_id", "passage", "doc_id").distinct()
    found = met.join(docs, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    # A passage without any word is white space, which only the texts themselves can tell.
    blank = bench.where(F.size("w") == 0)
    if not blank.isEmpty():
        found = found.unionByName(docs.join(blank, F.contains("text", "passage")).select("query_id", "doc_id"))
    return found.select("query_id", F.col("doc_id").alias("item_id")).distinct()


def golden_truth(spark, sf):
    n = truth(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_doc"))
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return bench.join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_relevant"), "first_doc")


def _ranked(spark, sf):
    return search.bm25_top(asked(spark, sf), documents_as_items(spark, sf), 10)


def context_precision_recall(spark, sf):
    out = evaluate.retrieval_scores(_ranked(spark, sf), truth(spark, sf), 10)
    return out.select("query_id", F.round("context_precision", 6).alias("context_precision"), F.round("context_recall", 6).alias("context_recall"))


def _exchanges(spark, sf):
    """Each assistant turn with the turn before it."""
    turns = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("asked", F.lag("text").over(w)).where("role = 'assistant' and asked is not null")


def faithfulness_overlap(spark, sf):
    score = evaluate.faithfulness(F.col("text"), F.col("asked"), 0.2)
    return _exchanges(spark, sf).select("conv_id", "turn", F.round(score, 6).alias("faithfulness"))


def answer_relevance(spark, sf):
    share = evaluate.relevance(F.col("asked"), F.col("text"))
    return _exchanges(spark, sf).select("conv_id", "turn", F.round(share, 6).alias("answer_relevance"))


def _evaluated(spark, sf):
    """Every benchmark question under every variant, answered from chunks and scored; retrieval by documents."""
    retrieval = evaluate.retrieval_scores(_ranked(spark, sf), truth(spark, sf), 10)
    golden = questions(spark, sf).select("query_id", "question")
    return evaluate.run_eval(golden, VARIANTS, lexical_hits(spark, sf), prompts(spark), indexed(spark, sf), retrieval)


def run_eval_golden(spark, sf):
    means = _evaluated(spark, sf)[1]
    return means.select("variant", "n", *[F.round(F.col("aggregate")[m], 6).alias(m) for m in evaluate.METRICS])


def _scores(spark, sf):
    """Per-question scores of the first variant, where there is truth."""
    return _evaluated(spark, sf)[0].where("variant = 0 and context_recall is not null")


def eval_aggregate(spark, sf):
    out = evaluate.mean_scores(_scores(spark, sf))
    return out.select("n", *[F.round(F.col("aggregate")[m], 6).alias(m) for m in evaluate.METRICS])


def eval_table_sorted(spark, sf):
    s = staged(_scores(spark, sf).select("query_id", "context_precision", "answer_relevance"), "scores")
    a = s.select(F.lit("retrieval").alias("part"), "query_id", F.round("context_precision", 6).alias("context_precision"))
    b = s.select(F.lit("answer").alias("part"), "query_id", F.round("answer_relevance", 6).alias("answer_relevance"))
    return observe.sorted_union([a, b])


def metric_log(spark, sf):
    rows = evaluate.mean_scores(_scores(spark, sf)).select("aggregate.*")
    return observe.metric_rows(rows, evaluate.METRICS).select("name", F.round("value", 6).alias("value"))


def runs_from_events(spark, sf):
    """One run per day and kind of event, its four metrics from that day's values."""
    v = F.col("value")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    grouped = table(spark, sf, "events").groupBy(day.alias("day"), F.col("event_type").alias("dataset"))
    runs = grouped.agg(
        F.round(F.avg(F.least(v / 50, F.lit(1.0))), 6).alias("faithfulness"), F.round(F.avg(F.when(v > 10, 1.0).otherwise(0.0)), 6).alias("answer_relevance"),
        F.round(F.avg(F.when(v > 20, 1.0).otherwise(0.0)), 6).alias("context_precision"), F.round(F.max(F.when(v > 100, v / 1000)), 6).alias("context_recall"),
    )
    version = F.concat(F.lit("v"), F.pmod(F.dayofyear(F.to_date("day")), F.lit(3)).cast("string"))
    return runs.withColumn("file_name", F.concat_ws("-", "day", "dataset")).withColumn("prompt_version", version)


def _rounded(df, *keys):
    return df.select(*keys, "metric", F.round("delta", 6).alias("delta"), "from", "to", "from_prompt", "to_prompt")


def regressions_adjacent(spark, sf):
    return _rounded(evaluate.regressions(runs_from_events(spark, sf)))


def regressions_by_dataset(spark, sf):
    return _rounded(evaluate.regressions(runs_from_events(spark, sf), by="dataset"), "dataset")


def regressions_strict(spark, sf):
    return _rounded(evaluate.regressions(runs_from_events(spark, sf), by="dataset", skip_nulls=True), "dataset")


def per_example_diff(spark, sf):
    """Term overlap of each question with its best document, against the same with the second best."""
    hits = _ranked(spark, sf).join(documents_as_items(spark, sf).withColumnRenamed("terms", "item_terms"), "item_id").join(asked(spark, sf), "query_id")
    scored = hits.select(F.col("query_id").alias("question"), "rank", overlap(F.col("terms"), F.col("item_terms")).alias("score"))
    first, second = scored.where("rank = 1").select("question", "score"), scored.where("rank = 2").select("question", "score")
    out = evaluate.example_diff(first, second, fail=0.9)
    return out.select("question", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"), "dropped", "newly_failing")


def _ratings(spark, sf):
    """Labels as human ratings; every eleventh is out of range, every fifth has an empty provider."""
    rating = F.when(F.col("doc_id") % 11 == 0, 7).otherwise(1 + 3 * F.col("quality") + (1 - F.col("toxic")))
    provider = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 2 == 0, "local").otherwise("openai")
    return table(spark, sf, "labels").select("doc_id", rating.alias("rating"), provider.alias("provider"))


def human_ratings_by_provider(spark, sf):
    return evaluate.valid_ratings(_ratings(spark, sf), None).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rating"), 6).alias("mean"))


def ratings_quarantine(spark, sf):
    rows = _ratings(spark, sf)
    return rows.where(~F.col("rating").between(1, 5)).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def judge_human_kappa(spark, sf):
    """A length-and-symbol judge against the human quality label."""
    docs = table(spark, sf, "documents").select("doc_id", (F.length(F.regexp_replace("text", r"[^#*$%&!|]", "")) * 20 < F.length("text")).cast("int").alias("judge"))
    out = evaluate.kappa(docs.join(table(spark, sf, "labels"), "doc_id"), "judge", "quality")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def stratified_scores(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.avg("n_chars"), 3).alias("mean_chars"))


def toxicity_filter(spark, sf):
    clean = table(spark, sf, "labels").where("toxic = 0").select("doc_id")
    return table(spark, sf, "documents").join(clean, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (
    golden_truth, run_eval_golden, context_precision_recall, faithfulness_overlap, answer_relevance, eval_aggregate, eval_table_sorted, metric_log, regressions_adjacent,
    regressions_by_dataset, regressions_strict, per_example_diff, human_ratings_by_provider, ratings_quarantine, judge_human_kappa, stratified_scores, toxicity_filter,
)}

_TRUTH = "truth AS (SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_TERMS_OF_S = sql.terms("s").replace("lambda x: x", "lambda y: y")
_SCORED = f"""{sql.ITEMS_OF_DOCUMENTS}, {sql.ASKED}, {sql.bm25(10)}, {_TRUTH}, sizes AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY 1),
p AS (SELECT l.query_id, count(*) OVER (PARTITION BY l.query_id ORDER BY rank) / rank::DOUBLE AS p FROM lexical l JOIN truth t ON t.query_id = l.query_id AND t.item_id = l.item_id),
s AS (SELECT query_id, sum(p) AS p, count(*) AS found FROM p GROUP BY query_id),
r AS (SELECT z.query_id, coalesce(p / least(n_true, 10), 0) AS context_precision, coalesce(found, 0) / n_true::DOUBLE AS context_recall FROM sizes z LEFT JOIN s USING (query_id))"""
_HELD = f"len(list_intersect(list_distinct({_TERMS_OF_S}), known)) / greatest(len(list_distinct({_TERMS_OF_S})), 1)::DOUBLE"
_EVALUATED = f"""{_SCORED}, ans AS ({ANSWERED}), c AS (SELECT *, {sql.sentences('answer')} AS claims, {sql.terms('context')} AS known, list_distinct({sql.terms('question')}) AS q, list_distinct({sql.terms('answer')}) AS a FROM ans),
every AS (SELECT query_id, variant, CASE WHEN len(claims) > 0 THEN len(list_filter(claims, lambda s: {_HELD} >= 0.5::DOUBLE)) / len(claims)::DOUBLE END AS faithfulness,
  len(list_intersect(q, a)) / greatest(len(list_distinct(list_concat(q, a))), 1)::DOUBLE AS answer_relevance, context_precision, context_recall FROM c LEFT JOIN r USING (query_id)),
scores AS (SELECT * FROM every WHERE variant = 0 AND context_recall IS NOT NULL)"""
_EXCHANGES = "x AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations) WHERE role = 'assistant' AND asked IS NOT NULL)"
_Q, _A = f"list_distinct({sql.terms('asked')})", f"list_distinct({sql.terms('text')})"
_RUNS = """runs AS (SELECT *, day || '-' || dataset AS file_name, 'v' || (dayofyear(CAST(day AS DATE)) % 3) AS prompt_version FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS dataset, round(avg(least(value / 50, 1.0::DOUBLE)), 6) AS faithfulness,
  round(avg(CASE WHEN value > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS answer_relevance, round(avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS context_precision,
  round(max(CASE WHEN value > 100 THEN value / 1000 END), 6) AS context_recall FROM events GROUP BY 1, 2)),
long AS (SELECT file_name, dataset, prompt_version, unnest(['faithfulness', 'answer_relevance', 'context_precision', 'context_recall']) AS metric, unnest([faithfulness, answer_relevance, context_precision, context_recall]) AS value FROM runs)"""


def _regressions(part: str, keys: str, where: str) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY file_name)"
    return f"""WITH {_RUNS}, d AS (SELECT dataset, metric, coalesce(value, 0) - lag(coalesce(value, 0)) {w} AS delta, lag(file_name) {w} AS "from", file_name AS "to", lag(prompt_version) {w} AS from_prompt, prompt_version AS to_prompt FROM long WHERE {where})
SELECT {keys} metric, round(delta, 6) AS delta, "from", "to", from_prompt, to_prompt FROM d WHERE delta < -0.05::DOUBLE"""


_RATINGS = "r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 7 ELSE 1 + 3 * quality + 1 - toxic END AS rating, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'local' ELSE 'openai' END AS provider FROM labels)"
_OVERLAP = "len(list_intersect(list_distinct(a.terms), i.terms)) / greatest(len(list_distinct(a.terms)), 1)::DOUBLE"
ORACLES = {
    "golden_truth": f"WITH {_TRUTH} SELECT b.item_id AS query_id, count(t.item_id) AS n_relevant, min(t.item_id) AS first_doc FROM benchmark b LEFT JOIN truth t ON t.query_id = b.item_id GROUP BY 1",
    "context_precision_recall": f"WITH {_SCORED} SELECT query_id, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM r",
    "run_eval_golden": f"WITH {_EVALUATED} SELECT CAST(variant AS INTEGER) AS variant, count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM every GROUP BY variant",
    "faithfulness_overlap": f"""WITH {_EXCHANGES}, c AS (SELECT conv_id, turn, {sql.sentences('text')} AS claims, {sql.terms('asked')} AS known FROM x)
SELECT conv_id, turn, CASE WHEN len(claims) > 0 THEN round(len(list_filter(claims, lambda s: len(list_intersect(list_distinct({sql.terms('s').replace('lambda x: x', 'lambda y: y')}), known)) / greatest(len(list_distinct({sql.terms('s').replace('lambda x: x', 'lambda y: y')})), 1)::DOUBLE >= 0.2)) / len(claims)::DOUBLE, 6) END AS faithfulness FROM c""",
    "answer_relevance": f"WITH {_EXCHANGES} SELECT conv_id, turn, round(len(list_intersect({_Q}, {_A})) / greatest(len(list_distinct(list_concat({_Q}, {_A}))), 1)::DOUBLE, 6) AS answer_relevance FROM x",
    "eval_aggregate": f"WITH {_EVALUATED} SELECT count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM scores",
    "eval_table_sorted": f"WITH {_EVALUATED} SELECT NULL::DOUBLE AS answer_relevance, round(context_precision, 6) AS context_precision, 'retrieval' AS part, query_id FROM scores UNION ALL SELECT round(answer_relevance, 6), NULL, 'answer', query_id FROM scores",
    "metric_log": f"WITH {_EVALUATED} SELECT 'eval/faithfulness' AS name, round(avg(faithfulness), 6) AS value FROM scores UNION ALL SELECT 'eval/answer_relevance', round(avg(answer_relevance), 6) FROM scores UNION ALL SELECT 'eval/context_precision', round(avg(context_precision), 6) FROM scores UNION ALL SELECT 'eval/context_recall', round(avg(context_recall), 6) FROM scores",
    "regressions_adjacent": _regressions("metric", "", "true"),
    "regressions_by_dataset": _regressions("metric, dataset", "dataset,", "true"),
    "regressions_strict": _regressions("metric, dataset", "dataset,", "value IS NOT NULL"),
    "per_example_diff": f"""WITH {sql.ITEMS_OF_DOCUMENTS}, {sql.ASKED}, {sql.bm25(10)}, o AS (SELECT query_id, rank, {_OVERLAP} AS score FROM lexical l JOIN items i USING (item_id) JOIN asked a USING (query_id)),
j AS (SELECT coalesce(x.query_id, y.query_id) AS question, x.score AS before, y.score AS after FROM (SELECT * FROM o WHERE rank = 1) x FULL JOIN (SELECT * FROM o WHERE rank = 2) y ON x.query_id = y.query_id)
SELECT question, round(before, 6) AS before, round(after, 6) AS after, round(coalesce(after, 0) - coalesce(before, 0), 6) AS delta, coalesce(after, 0) - coalesce(before, 0) < -0.05::DOUBLE AS dropped, coalesce(before, 0) >= 0.9::DOUBLE AND coalesce(after, 0) < 0.9::DOUBLE AS newly_failing FROM j""",
    "human_ratings_by_provider": f"WITH {_RATINGS} SELECT provider, count(*) AS n, round(avg(rating), 6) AS mean FROM r WHERE rating BETWEEN 1 AND 5 GROUP BY provider",
    "ratings_quarantine": f"WITH {_RATINGS} SELECT provider, count(*) AS n FROM r WHERE NOT rating BETWEEN 1 AND 5 GROUP BY provider",
    "judge_human_kappa": r"""WITH p AS (SELECT CAST(length(regexp_replace(text, '[^#*$%&!|]', '', 'g')) * 20 < length(text) AS INTEGER) AS j, quality AS q FROM documents JOIN labels USING (doc_id)),
k AS (SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE j = q) / count(*)::DOUBLE AS po, (sum(j) * sum(q) + sum(1 - j) * sum(1 - q)) / (count(*)::DOUBLE * count(*)) AS pe FROM p)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM k""",
    "stratified_scores": "SELECT lang, quality, count(*) AS n, round(avg(toxic), 6) AS toxic_rate, round(avg(n_chars), 3) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)",
    "toxicity_filter": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY lang",
}
