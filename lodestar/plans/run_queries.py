"""What is written and read again: golden sets, ratings, traces and runs; answers that judges, pairs and schemas are held against."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import answer, evaluate, observe
from lodestar.plans import evaluation_queries as ev
from lodestar.plans import sql
from lodestar.plans.answer_queries import ANSWERED, VARIANTS, indexed, prompts, questions
from lodestar.plans.retrieval_queries import lexical_hits
from lodestar.session import shared_dir, staged, table
from lodestar.sources import readers, writers


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def golden_roundtrip(spark, sf):
    """The benchmark as a golden set: written as lines of JSON with the documents that hold each text, read back by the reader."""
    sources = ev.truth(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_list(F.lpad(F.col("item_id").cast("string"), 20, "0"))).alias("expected_sources"))
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("ideal_answer"))
    path = _folder(spark, "golden")
    rows.join(sources, "query_id", "left").select("question", "ideal_answer", F.coalesce("expected_sources", F.array().cast("array<string>")).alias("expected_sources")).write.json(path)
    got = readers.golden(spark, path)
    return got.select(F.md5("question").alias("question_md5"), (F.col("question") == F.col("ideal_answer")).alias("same"), F.size("expected_sources").alias("n_sources"), F.get("expected_sources", 0).alias("first_source"))


def ratings_roundtrip(spark, sf):
    """Labels as ratings, appended by the writer, which sets aside what is out of range; read back by provider."""
    path = _folder(spark, "ratings")
    none = F.lit(None).cast("string")
    rows = ev._ratings(spark, sf).select(
        F.col("doc_id").cast("string").alias("question"), F.lit("a").alias("answer"), "rating", none.alias("comment"), "provider", none.alias("model"), none.alias("prompt_version")
    )
    rejected = writers.append_ratings(rows, path)
    valid, broken = readers.ratings(spark, path)
    kept = valid.select("provider", F.lit("valid").alias("state"), "rating", (F.length("id") == 12).alias("has_id"))
    every = kept.unionByName(rejected.select("provider", F.lit("rejected").alias("state"), "rating", (F.length("id") == 12).alias("has_id")))
    every = every.unionByName(broken.select("provider", F.lit("broken").alias("state"), "rating", F.lit(False).alias("has_id")))
    return every.groupBy("provider", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum"), F.min("has_id").alias("has_id"))


def trace_roundtrip(spark, sf):
    """Conversations as stored traces; of those read back, the one with the most characters, looked up by its id."""
    path = _folder(spark, "traces")
    rows = observe.traces(table(spark, sf, "conversations")).select(F.col("conv_id").cast("string").alias("id"), F.lit("ask").alias("name"), "n_events", "chars", "events")
    writers.append_traces(rows, path)
    held = spark.read.parquet(path)
    longest = held.orderBy(F.desc("chars"), F.col("id").cast("long")).first()
    return readers.trace(held, longest["id"] if longest else "").select("id", "n_events", "chars", F.md5("events").alias("events_md5"))


def _evaluated(spark, sf):
    return staged(ev._evaluated(spark, sf)[0].where("context_recall is not null"), "evaluated")


def persisted_regressions(spark, sf):
    """A run of each variant is persisted with its examples, the runs are read back in their order, and what fell between two is told."""
    folder = _folder(spark, "runs")
    rows = _evaluated(spark, sf).withColumn("ideal_answer", F.col("question"))
    score = F.struct(*[F.col(m).alias(m) for m in evaluate.METRICS])
    for n, variant in enumerate(VARIANTS):
        part = rows.where(F.col("variant") == n)
        run = writers.run_document(part.select("question", "answer", "ideal_answer", score.alias("score")), evaluate.mean_scores(part), "benchmark", {"prompt_version": f"v{n}"})
        # Names of one second are numbered in their order.
        writers.persist_run(run, folder, "benchmark", f"v{n}", writers.datetime(2026, 1, 1, n))
    history = readers.runs(spark, folder)
    out = evaluate.regressions(readers.run_metrics(history).drop("dataset"))
    return out.select("metric", F.round("delta", 6).alias("delta"), "from_prompt", "to_prompt", F.substring("from", 1, 16).alias("from_stamp"), F.substring("to", 1, 16).alias("to_stamp"))


def _judge(question: str, said: str, context: str) -> str:
    """An offline judge: the share of the answer's words that the context has; its JSON breaks off where the answer names no chunk."""
    words, known = (said or "").split(), set((context or "").split())
    share = sum(w in known for w in words) / len(words) if words else 0.0
    told = json.dumps({"faithfulness": round(share, 6), "context_recall": 7, "reasoning": f"{len(words)} words"})
    return told if "[" in (said or "") else told[:-3]


def judged_answers(spark, sf):
    """Every answer given to a judge that returns JSON: its metrics, null where they are out of range or unreadable."""
    hits = lexical_hits(spark, sf)
    answered = answer.compare(questions(spark, sf).select("query_id", "question"), VARIANTS, hits, prompts(spark), indexed(spark, sf))
    out = evaluate.judged(answered.select("query_id", "variant", "question", "answer", "context"), _judge)
    return out.select("query_id", "variant", F.round("faithfulness", 6).alias("faithfulness"), "context_recall", "reasoning")


def _closer(question, first, second):
    """The answer with the larger share of the question's terms is preferred, equal ones are not."""
    a, b = (answer.overlap(text.terms(question), text.terms(x)) for x in (first, second))
    return F.when(a > b, 0).when(b > a, 1)


def pairwise_strengths(spark, sf):
    """Every two variants on every question, judged once in an order that the pair's hash decides; strengths fitted to all verdicts."""
    hits = lexical_hits(spark, sf)
    answered = answer.compare(questions(spark, sf).select("query_id", "question"), VARIANTS, hits, prompts(spark), indexed(spark, sf))
    said = staged(answered.select("query_id", "question", "variant", "answer"), "pairwise-answers")
    other = said.select("query_id", F.col("variant").alias("right"), F.col("answer").alias("b"))
    pairs = said.select("query_id", "question", F.col("variant").alias("left"), F.col("answer").alias("a")).join(other, "query_id").where(F.col("left") < F.col("right"))
    pairs = staged(pairs.withColumn("pair_id", F.concat_ws(":", "query_id", "left", "right")), "pairwise")
    verdicts = evaluate.swapped(pairs, _closer).join(pairs.select("pair_id", "left", "right"), "pair_id")
    out = evaluate.strengths(verdicts)
    return out.select(F.col("name").alias("variant"), "wins", "games", F.round("strength", 4).alias("strength"))


def _close(raw: str) -> str:
    """The one repair that is tried: a text that broke off gets its closing marks."""
    return raw if raw.endswith("}") else raw + '"}'


def repaired_answers(spark, sf):
    """Answers as JSON, broken off after 200 characters as by a model's limit; checked against their schema, with one repair."""
    hits = lexical_hits(spark, sf)
    answered = answer.compare(questions(spark, sf).select("query_id", "question"), VARIANTS, hits, prompts(spark), indexed(spark, sf))
    plain = F.regexp_replace("answer", "[^A-Za-z0-9 .:]", "_")
    raw = F.concat(F.lit('{"confidence": '), F.col("confidence").cast("string"), F.lit(', "answer": "'), plain, F.lit('"}'))
    rows = answered.select("query_id", "variant", F.substring(raw, 1, 200).alias("raw"))
    # Confidence has to be in range, and an answer there.
    valid = lambda p: p["confidence"].between(0, 1) & (F.length(p["answer"]) > 0)
    out = answer.repaired(rows, "confidence double, answer string", valid, _close)
    return out.select("query_id", "variant", "state", F.length("parsed.answer").alias("chars"))


QUERIES = {f.__name__: f for f in (golden_roundtrip, ratings_roundtrip, trace_roundtrip, persisted_regressions, judged_answers, pairwise_strengths, repaired_answers)}

_MEANS = ", ".join(f"avg({m}) AS {m}" for m in evaluate.METRICS)
_OVERLAP = f"len(list_intersect(list_distinct({sql.terms('question')}), {sql.terms('answer')})) / greatest(len(list_distinct({sql.terms('question')})), 1)::DOUBLE"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_RATINGS = f"{ev._RATINGS}, s AS (SELECT *, CASE WHEN rating BETWEEN 1 AND 5 THEN 'valid' ELSE 'rejected' END AS state FROM r)"


def _strengths(rounds: int = 20) -> str:
    """The fit, round by round."""
    steps = "".join(
        f", p{n} AS MATERIALIZED (SELECT p.name, p.wins, p.games, p.others, p.wins / sum(m.n / (p.strength + q.strength)) AS strength FROM p{n - 1} p JOIN pairs m ON m.x = p.name JOIN p{n - 1} q ON q.name = m.y GROUP BY p.name, p.wins, p.games, p.others)"
        for n in range(1, rounds + 1)
    )
    return f"""WITH ans AS ({ANSWERED}), o AS (SELECT query_id, variant, {_OVERLAP} AS share FROM ans),
v AS (SELECT a.variant AS x, b.variant AS y, CASE WHEN a.share > b.share THEN 1.0::DOUBLE WHEN a.share < b.share THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS won FROM o a JOIN o b ON a.query_id = b.query_id AND a.variant < b.variant),
w AS (SELECT * FROM v UNION ALL SELECT y, x, 1 - won FROM v),
pairs AS MATERIALIZED (SELECT x, y, sum(won) + 0.5::DOUBLE AS won, count(*) + 1 AS n, count(*) AS games FROM w GROUP BY x, y),
p0 AS MATERIALIZED (SELECT x AS name, sum(won) AS wins, CAST(sum(games) AS BIGINT) AS games, count(*) AS others, 1.0::DOUBLE AS strength FROM pairs GROUP BY x){steps}
SELECT CAST(name AS INTEGER) AS variant, wins - 0.5::DOUBLE * others AS wins, games, round(strength / (SELECT avg(strength) FROM p{rounds}), 4) AS strength FROM p{rounds}"""


ORACLES = {
    "golden_roundtrip": f"WITH {ev._TRUTH}, n AS (SELECT query_id, count(*) AS n, min(lpad(CAST(item_id AS VARCHAR), 20, '0')) AS first FROM truth GROUP BY query_id) SELECT md5(text) AS question_md5, true AS same, CAST(coalesce(n, 0) AS INTEGER) AS n_sources, first AS first_source FROM benchmark LEFT JOIN n ON query_id = item_id",
    "ratings_roundtrip": f"WITH {_RATINGS} SELECT provider, state, count(*) AS n, CAST(sum(rating) AS BIGINT) AS sum, true AS has_id FROM s GROUP BY provider, state",
    "trace_roundtrip": """SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n_events, CAST(sum(length(text)) AS BIGINT) AS chars,
  md5('[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']') AS events_md5 FROM conversations GROUP BY conv_id ORDER BY chars DESC, conv_id LIMIT 1""",
    "persisted_regressions": f"""WITH {ev._EVALUATED}, m AS (SELECT variant, {_MEANS} FROM every WHERE context_recall IS NOT NULL GROUP BY variant),
long AS (SELECT variant, unnest({list(evaluate.METRICS)}) AS metric, unnest([{', '.join(evaluate.METRICS)}]) AS value FROM m),
d AS (SELECT *, coalesce(value, 0) - lag(coalesce(value, 0)) OVER (PARTITION BY metric ORDER BY variant) AS delta FROM long)
SELECT metric, round(delta, 6) AS delta, 'v' || (variant - 1) AS from_prompt, 'v' || variant AS to_prompt, '20260101T0' || (variant - 1) || '0000Z' AS from_stamp, '20260101T0' || variant || '0000Z' AS to_stamp FROM d WHERE delta < -0.05::DOUBLE""",
    "judged_answers": f"""WITH ans AS ({ANSWERED}), w AS (SELECT *, {_SPLIT.format('answer')} AS w, {_SPLIT.format('context')} AS known FROM ans)
SELECT query_id, CAST(variant AS INTEGER) AS variant, CASE WHEN contains(answer, '[') THEN round(len(list_filter(w, lambda x: list_contains(known, x))) / len(w)::DOUBLE, 6) END AS faithfulness, NULL::DOUBLE AS context_recall,
  CASE WHEN contains(answer, '[') THEN len(w) || ' words' END AS reasoning FROM w""",
    "pairwise_strengths": _strengths(),
    "repaired_answers": f"""WITH ans AS ({ANSWERED}), r AS (SELECT query_id, variant, '{{"confidence": ' || CASE WHEN variant = 3 THEN '0.0' ELSE '0.85' END || ', "answer": "' AS head, regexp_replace(answer, '[^A-Za-z0-9 .:]', '_', 'g') AS said FROM ans)
SELECT query_id, CAST(variant AS INTEGER) AS variant, CASE WHEN length(head || said) + 2 <= 200 THEN 'valid' WHEN length(head || said) = 199 THEN 'failed' ELSE 'repaired' END AS state,
  CAST(CASE WHEN length(head || said) + 2 <= 200 THEN length(said) WHEN length(head || said) = 199 THEN NULL ELSE 200 - length(head) END AS INTEGER) AS chars FROM r""",
}
