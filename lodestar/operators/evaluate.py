"""Scores, their aggregates, regressions between runs, human ratings and agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text
from lodestar.operators.answer import compare, overlap
from lodestar.session import staged

METRICS = ("faithfulness", "answer_relevance", "context_precision", "context_recall")
THRESHOLD = 0.05


def retrieval_scores(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, rank) and (query_id, item_id) -> context_precision (average precision at k), context_recall.

    Queries without truth have no score.
    """
    wanted = truth.select("query_id", "item_id").distinct().withColumn("rel", F.lit(1))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    hits = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", "item_id"])
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hits.withColumn("p", F.count(F.lit(1)).over(upto) / F.col("rank")).groupBy("query_id").agg(
        F.sum("p").alias("p"), F.count(F.lit(1)).alias("found")
    )
    joined = sizes.join(sums, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce(F.col("p") / F.least("n_true", F.lit(k)), F.lit(0.0)).alias("context_precision"),
        (F.coalesce("found", F.lit(0)) / F.col("n_true")).alias("context_recall"),
    )


def faithfulness(answer: Column, context: Column, threshold: float = 0.5) -> Column:
    """Share of the answer's sentences whose terms are in the context, to the threshold: a lexical stand-in."""
    known = text.terms(context)
    claims = text.sentences(answer)
    held = F.filter(claims, lambda s: overlap(text.terms(s), known) >= threshold)
    return F.when(F.size(claims) > 0, F.size(held) / F.size(claims))


def relevance(question: Column, answer: Column) -> Column:
    """Jaccard overlap of the terms of question and answer: a lexical stand-in for embedding similarity."""
    q, a = F.array_distinct(text.terms(question)), F.array_distinct(text.terms(answer))
    return F.size(F.array_intersect(q, a)) / F.greatest(F.size(F.array_union(q, a)), F.lit(1))


#: Scorers of an answer by metric, over question, answer, context and ideal_answer; callers register their own.
SCORERS: dict[str, Callable[[], Column]] = {
    "faithfulness": lambda: faithfulness(F.col("answer"), F.coalesce("context", F.lit(""))),
    "answer_relevance": lambda: relevance(F.col("question"), F.col("answer")),
}


def scored(answered: DataFrame, retrieval: DataFrame | None = None) -> DataFrame:
    """Answers with all four metrics: those of SCORERS, and those of retrieval by query (null where it has no truth)."""
    out = answered.withColumns({m: make() for m, make in SCORERS.items()})
    if retrieval is not None:
        rest = [m for m in METRICS if m not in SCORERS]
        out = out.join(retrieval.select("query_id", *rest), "query_id", "left")
    return out.withColumns({m: F.lit(None).cast("double") for m in METRICS if m not in out.columns})


def run_eval(golden: DataFrame, variants: list[dict], hits: DataFrame, prompts: DataFrame, indexed: int, retrieval: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every golden question under every configuration, answered and scored: (per example, mean and n per variant)."""
    per_example = scored(compare(golden, variants, hits, prompts, indexed), retrieval)
    return per_example, mean_scores(per_example, ["variant"])


def judged(answered: DataFrame, judge: Callable[[str, str, str], str]) -> DataFrame:
    """Adds the metrics and reasoning that a judge of (question, answer, context) returns as JSON; unreadable ones are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(judgement=[judge(*row) for row in zip(batch["question"], batch["answer"], batch["context"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in answered.schema.fields)
    form = ", ".join(f"{m} double" for m in METRICS) + ", reasoning string"
    said = answered.mapInPandas(run, f"{fields}, judgement string").withColumn("judgement", F.from_json("judgement", form))
    inside = lambda m: F.when(F.col(f"judgement.{m}").between(0, 1), F.col(f"judgement.{m}")).alias(m)
    return said.select(*answered.columns, *[inside(m) for m in METRICS], "judgement.reasoning")


def pairwise(pairs: DataFrame, prefer: Callable[[str, str, str], int]) -> DataFrame:
    """(query_id, question, a, b) -> verdict a, b or tie: a side wins only if it does in both orders of presentation.

    ``prefer`` gives 0 for the first answer shown, 1 for the second.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ways = [(prefer(q, a, b), prefer(q, b, a)) for q, a, b in zip(batch["question"], batch["a"], batch["b"])]
            yield pd.DataFrame({"query_id": batch["query_id"], "verdict": [{(0, 1): "a", (1, 0): "b"}.get(w, "tie") for w in ways]})

    return pairs.select("query_id", "question", "a", "b").mapInPandas(run, f"query_id {dict(pairs.dtypes)['query_id']}, verdict string")


def swapped(pairs: DataFrame, prefer: Callable[[Column, Column, Column], Column], seed: str = "order") -> DataFrame:
    """(pair_id, question, a, b) -> pair_id, shown_first, verdict a, b or tie: each pair is judged once, in an order that its hash decides.

    ``prefer`` gives 0 for the first answer shown, 1 for the second, null for neither.
    """
    swap = F.pmod(F.crc32(F.concat_ws(":", F.lit(seed), F.col("pair_id").cast("string")).cast("binary")), F.lit(2)) == 1
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    said = prefer(F.col("question"), first, second)
    verdict = F.when(said.isNull(), "tie").when((said == 0) == ~swap, "a").otherwise("b")
    return pairs.select("pair_id", F.when(swap, "b").otherwise("a").alias("shown_first"), verdict.alias("verdict"))


#: Pairs that the driver may hold.
FEW = 50_000


def _fitted(pairs: list[tuple], wins: dict, rounds: int) -> dict:
    p = dict.fromkeys(wins, 1.0)
    for _ in range(rounds):
        rate = dict.fromkeys(wins, 0.0)
        for a, b, n in pairs:
            rate[a] += n / (p[a] + p[b])
        p = {name: wins[name] / rate[name] for name in wins}
    return p


def strengths(verdicts: DataFrame, rounds: int = 20, every: int = 5, few_rows: int = FEW) -> DataFrame:
    """(left, right, verdict) -> name, wins, games, strength: strengths that explain all verdicts best, with a mean of 1.

    The Bradley-Terry model, fitted by minorisation: a strength is its wins over the sum, over its games, of one by the strength of both.
    Ties are half a win for each, and each pair that has met gets one tie more, so that strengths stay finite. Rounds work on the table
    of pairs, which has a row for any two that have met, however often. Up to FEW rows, as of some hundred configurations, are fitted on
    the driver; of more, each round is a join.
    """
    won = F.when(F.col("verdict") == "a", 1.0).when(F.col("verdict") == "b", 0.0).otherwise(0.5)
    met = verdicts.select("left", "right", won.alias("won")).where("left <> right")
    both = met.unionByName(met.select(F.col("right").alias("left"), F.col("left").alias("right"), (1 - F.col("won")).alias("won")))
    pairs = staged(both.groupBy("left", "right").agg((F.sum("won") + 0.5).alias("won"), (F.count(F.lit(1)) + 1).alias("n"), F.count(F.lit(1)).alias("games")), "strength-pairs")
    total = pairs.groupBy(F.col("left").alias("name")).agg(F.sum("won").alias("wins"), F.sum("games").alias("games"))
    met_with = pairs.groupBy(F.col("left").alias("name")).agg(F.count(F.lit(1)).alias("others"))
    few = pairs.limit(few_rows + 1).collect()
    now = total.withColumn("strength", F.lit(1.0))
    if len(few) <= few_rows:
        fit = _fitted([(r["left"], r["right"], r["n"]) for r in few], {r["name"]: r["wins"] for r in total.collect()}, rounds)
        kind = dict(total.dtypes)["name"]
        now = total.join(verdicts.sparkSession.createDataFrame(list(fit.items()), f"name {kind}, strength double"), "name")
        rounds = 0
    now = staged(now, "strengths")
    for turn in range(1, rounds + 1):
        mine = pairs.join(now.select(F.col("name").alias("left"), F.col("strength").alias("p")), "left")
        met = mine.join(now.select(F.col("name").alias("right"), F.col("strength").alias("q")), "right")
        rate = met.groupBy(F.col("left").alias("name")).agg(F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("rate"))
        now = now.join(rate, "name").select("name", "wins", "games", (F.col("wins") / F.col("rate")).alias("strength"))
        # A plan of few rounds at a time.
        if turn % every == 0 or turn == rounds:
            now = staged(now, "strengths")
    mean = now.agg(F.avg("strength")).first()[0]
    return now.join(met_with, "name").select("name", (F.col("wins") - 0.5 * F.col("others")).alias("wins"), "games", (F.col("strength") / F.lit(mean or 1.0)).alias("strength"))


def mean_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted means and n; an empty input has a null aggregate as a whole."""
    means = F.struct(*[F.avg(m).alias(m) for m in METRICS])
    return scores.groupBy(*(by or [])).agg(F.when(F.count(F.lit(1)) > 0, means).alias("aggregate"), F.count(F.lit(1)).alias("n"))


def regressions(runs: DataFrame, threshold: float = THRESHOLD, by: str | None = None, skip_nulls: bool = False) -> DataFrame:
    """(file_name, metrics…) -> metric, delta, from, to where a metric fell by more than the threshold.

    Metrics are unpivoted before the lag, which is taken per metric (and per ``by``). A missing value counts as 0,
    unless skip_nulls; the comparison is strict and on unrounded doubles. With a prompt_version column, from_prompt and to_prompt
    are added: the versions that the two runs used.
    """
    keys, versions = [by] if by else [], ["prompt_version"] if "prompt_version" in runs.columns else []
    long = runs.unpivot(["file_name", *keys, *versions], list(METRICS), "metric", "value")
    if skip_nulls:
        long = long.where("value is not null")
    order = Window.partitionBy("metric", *keys).orderBy("file_name")
    value = F.coalesce("value", F.lit(0.0))
    steps = long.withColumn("delta", value - F.lag(value).over(order)).withColumn("from", F.lag("file_name").over(order))
    out = [F.lag(v).over(order).alias("from_prompt") for v in versions] + [F.col(v).alias("to_prompt") for v in versions]
    every = steps.select(*keys, "metric", "delta", "from", F.col("file_name").alias("to"), *out)
    return every.where(F.col("delta") < -threshold)


def example_diff(before: DataFrame, after: DataFrame, threshold: float = THRESHOLD, fail: float = 0.5) -> DataFrame:
    """(question, score) of two runs -> delta, dropped and newly_failing per question, either side may be absent."""
    joined = before.withColumnRenamed("score", "before").join(after.withColumnRenamed("score", "after"), "question", "full")
    b, a = F.coalesce("before", F.lit(0.0)), F.coalesce("after", F.lit(0.0))
    return joined.select(
        "question", "before", "after", (a - b).alias("delta"), (a - b < -threshold).alias("dropped"), ((b >= fail) & (a < fail)).alias("newly_failing")
    )


def in_range(answers: DataFrame) -> Column:
    """Whether an answer's confidence, and the scores of its sources that have one, lie within 0 to 1."""
    scores = F.coalesce(F.forall("sources", lambda s: F.coalesce(s["score"].between(0, 1), F.lit(True))), F.lit(True))
    return F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) & (scores if "score" in answers.schema["sources"].dataType.elementType.names else F.lit(True))


def valid_ratings(ratings: DataFrame, provider: str | None = None) -> DataFrame:
    """Ratings of 1 to 5; the provider filter is skipped when null or empty."""
    rows = ratings.where(F.col("rating").between(1, 5))
    return rows.where(F.col("provider") == provider) if provider else rows


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns: one row with n, observed, expected and kappa."""
    counts = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("x"))
    right = counts.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "label").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    # Both sides are one row each.
    one = total.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one")
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return one.select("n", po.alias("observed"), pe.alias("expected"), ((po - pe) / (1 - pe)).alias("kappa"))
