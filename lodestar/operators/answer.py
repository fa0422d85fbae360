"""Rerank, compress, assemble prompts, generate and answer, with refusals; A/B comparison of variants."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text

TOP_K, SOURCES, CONFIDENCE = 8, 5, 0.85

# Names of the generators, their default models, and the messages of a refusal.
DEFAULT_PROVIDER = "local"
DEFAULT_MODELS = {"local": "local-model", "openai": "openai-model"}
OTHER_MODEL = "hosted-model"
NO_INDEX = "No documents indexed yet. Upload files in the Ingest tab to start asking questions."
NOTHING_RELEVANT = "I couldn't find anything relevant in the indexed documents."
EMPTY_RESPONSE = "(empty response)"
#: Our own template, with the two marks that are filled in.
DEFAULT_TEMPLATE = "Answer from the context only and cite chunk ids.\n\nQuestion: {question}\n\nContext:\n{context}\n"


def default_model(provider: Column) -> Column:
    """Empty and null providers are the default one."""
    out = F.when(provider == "local", DEFAULT_MODELS["local"]).when(provider == "openai", DEFAULT_MODELS["openai"])
    return out.otherwise(OTHER_MODEL)


def bind_defaults(asked: DataFrame) -> DataFrame:
    """provider, model and prompt_version with defaults for null and '' alike."""
    provider = text.or_default(F.col("provider"), DEFAULT_PROVIDER)
    return asked.withColumn("provider", provider).withColumn(
        "model", text.or_default(F.col("model"), default_model(F.col("provider")))
    ).withColumn("prompt_version", text.or_default(F.col("prompt_version"), "default"))


def with_prompt(asked: DataFrame, prompts: DataFrame) -> DataFrame:
    """Template of the requested version, else the default one with is_fallback true."""
    known = prompts.select(F.col("version").alias("prompt_version"), F.col("template").alias("found"))
    fallback = prompts.where("version = 'default'").select(F.col("template").alias("standard")).first()
    standard = F.lit(fallback["standard"] if fallback else DEFAULT_TEMPLATE)
    joined = asked.join(known, "prompt_version", "left")
    return joined.withColumn("is_fallback", F.col("found").isNull()).withColumn("template", F.coalesce("found", standard)).drop("found")


def overlap(query_terms: Column, item_terms: Column) -> Column:
    """Share of distinct query terms that the item has."""
    q = F.array_distinct(query_terms)
    return F.size(F.array_intersect(q, item_terms)) / F.greatest(F.size(q), F.lit(1))


def rerank(hits: DataFrame, k: int = TOP_K, score: Column | None = None) -> DataFrame:
    """The first k by a score, or in the given order, ranked anew."""
    order = [F.col("rank")] if score is None else [F.desc("rerank_score"), F.col("rank")]
    rows = hits if score is None else hits.withColumn("rerank_score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("new_rank", place).where(F.col("new_rank") <= k)


def compress(hits: DataFrame, budget: int = 2000, least: float = 0.0) -> DataFrame:
    """Sentences of each hit that share a term with the query, until the query's budget of words is spent."""
    rows = hits.select("query_id", "rank", "item_id", "query_terms", F.posexplode(text.sentences(F.col("chunk_text"))).alias("pos", "sentence"))
    rows = rows.withColumn("share", overlap(F.col("query_terms"), text.terms(F.col("sentence")))).where(F.col("share") > least)
    run = Window.partitionBy("query_id").orderBy("rank", "item_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("n", text.word_count(F.col("sentence"))).withColumn("upto", F.sum("n").over(run)).where(F.col("upto") <= budget)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    return kept.groupBy("query_id", "rank", "item_id").agg(F.array_join(ordered, " ").alias("chunk_text"), F.sum("n").cast("int").alias("tokens"))


#: Compressors by name, from (query_id, rank, item_id, query_terms, chunk_text) to the same with less text; callers register their own.
COMPRESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {"none": lambda hits: hits, "sentences": compress}


def narrowed(candidates: DataFrame, k: int = TOP_K, score: Column | None = None, compressor: str = "sentences") -> DataFrame:
    """The answer's context from many candidates with query_terms, item_terms and chunk_text: reranked, k kept, compressed.

    Adds n_candidates, the number a query had before.
    """
    score = overlap(F.col("query_terms"), F.col("item_terms")) if score is None else score
    many = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    kept = rerank(candidates, k, score).select("query_id", F.col("new_rank").alias("rank"), "item_id", "query_terms", "chunk_text")
    return COMPRESSORS[compressor](kept).join(many, "query_id")


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, rank, item_id, chunk_text) -> context block in rank order, sources and their number.

    A query has at most k hits, so its list is small.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").alias("chunk_id"), F.col("chunk_text").alias("body"))))
    block = F.array_join(F.transform("items", lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("]\n"), x["body"])), "\n\n")
    first = lambda n, size: F.transform(F.slice("items", 1, n), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), text.quote(x["body"], size).alias("quote")))
    return hits.groupBy("query_id").agg(items.alias("items")).select(
        "query_id", F.size("items").alias("n_context"), block.alias("context"), first(SOURCES, 280).alias("sources"), first(3, 240).alias("error_sources")
    )


def prompts_of(asked: DataFrame, context: DataFrame) -> DataFrame:
    joined = asked.join(context, "query_id", "left").withColumn("n_context", F.coalesce("n_context", F.lit(0)))
    return joined.withColumn("prompt", text.fill_template(F.col("template"), F.col("question"), F.coalesce("context", F.lit(""))))


def extractive(prompt: str) -> str:
    """The offline generator: the first context chunk, shortened."""
    body = prompt.split("Context:\n", 1)[-1].strip()
    return body.split("\n\n", 1)[0][:280]


class MissingKey(Exception):
    """A hosted generator's key is not set where the call runs."""


def hosted(variable: str, call: Callable[[str, str], str]) -> Callable[[str], str]:
    """A generator that gives ``call`` the key from an environment variable of the worker; without it, a row's error."""

    def run(prompt: str) -> str:
        key = os.environ.get(variable)
        if not key:
            raise MissingKey(f"{variable} is not configured. Add it to .env and restart.")
        return call(key, prompt)

    return run


#: Providers by name; callers register their own functions from prompt to text.
GENERATORS: dict[str, Callable[[str], str]] = {"local": extractive, "openai": extractive, "anthropic": extractive}


def generate(asked: DataFrame) -> DataFrame:
    """Adds generated and error; an unknown provider or a failing call is that row's error and stops no other row."""
    providers = dict(GENERATORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said, errors = [], []
            for provider, prompt, n in zip(batch["provider"], batch["prompt"], batch["n_context"]):
                try:
                    said.append(providers[provider](prompt) if n else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    said.append(None)
                    errors.append(f"unknown provider: {provider}" if isinstance(e, KeyError) else str(e))
            yield batch.assign(generated=said, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{fields}, generated string, error string")


def answers(generated: DataFrame, indexed: int) -> DataFrame:
    """The final answer of each row: generated, a refusal for want of context, or the generator's error."""
    none = F.array(F.struct(F.lit("none").alias("chunk_id"), F.lit("").alias("quote")))
    empty, failed = F.col("n_context") == 0, F.col("error").isNotNull()
    message = F.lit(NO_INDEX if indexed == 0 else NOTHING_RELEVANT)
    refusal = empty | failed
    return generated.withColumn("refusal", refusal).withColumn(
        "answer", F.when(empty, message).when(failed, F.col("error")).otherwise(text.or_default(F.col("generated"), EMPTY_RESPONSE))
    ).withColumn("sources", F.when(empty, none).when(failed, F.col("error_sources")).otherwise(F.col("sources"))).withColumn(
        "confidence", F.when(refusal, F.lit(0.0)).otherwise(F.lit(CONFIDENCE))
    )


def ask(asked: DataFrame, hits: DataFrame, prompts: DataFrame, indexed: int) -> DataFrame:
    """(query_id, question, provider, model, prompt_version) and ranked hits -> one answer per query."""
    ready = prompts_of(with_prompt(bind_defaults(asked), prompts), contexts(hits))
    return answers(generate(ready), indexed)


def compare(asked: DataFrame, variants: list[dict], hits: DataFrame, prompts: DataFrame, indexed: int) -> DataFrame:
    """Every question under every variant, in the order of variants; retrieval is shared by all of them."""
    structs = [F.struct(*[F.lit(v.get(c)).cast("string").alias(c) for c in ("provider", "model", "prompt_version")]) for v in variants]
    rows = asked.select("query_id", "question", F.posexplode(F.array(*structs)).alias("variant", "v")).select("query_id", "question", "variant", "v.*")
    ready = prompts_of(with_prompt(bind_defaults(rows), prompts), contexts(hits))
    return answers(generate(ready), indexed)


def repaired(rows: DataFrame, schema: str, valid: Callable[[Column], Column], repair: Callable[[str], str]) -> DataFrame:
    """(…, raw) -> plus parsed and state: valid as it is, valid after one call of ``repair``, or failed.

    Only rows that fail reach ``repair``; one that raises leaves its row failed.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for raw in batch["raw"]:
                try:
                    said.append(repair(raw))
                except Exception:  # noqa: BLE001
                    said.append(None)
            yield batch.assign(raw=said)

    def check(part: DataFrame) -> DataFrame:
        parsed = part.withColumn("parsed", F.from_json("raw", schema))
        return parsed.withColumn("ok", F.coalesce(valid(F.col("parsed")), F.lit(False)))

    first = check(rows)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    again = check(first.where("not ok").select(*rows.columns).mapInPandas(call, fields))
    state = F.when(F.col("ok"), F.lit("repaired")).otherwise(F.lit("failed"))
    good = first.where("ok").withColumn("state", F.lit("valid"))
    return good.unionByName(again.withColumn("state", state)).withColumn("parsed", F.when(F.col("ok"), F.col("parsed"))).drop("ok")


def refuse_uncited(answered: DataFrame) -> DataFrame:
    """Answers that name no chunk become refusals."""
    none = ~F.col("refusal") & (F.size(cited(F.col("answer"))) == 0)
    return answered.withColumn("answer", F.when(none, NOTHING_RELEVANT).otherwise(F.col("answer"))).withColumn(
        "confidence", F.when(none, F.lit(0.0)).otherwise(F.col("confidence"))
    ).withColumn("refusal", F.col("refusal") | none)


def cited(answer: Column) -> Column:
    """Chunk ids named in brackets."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([0-9A-Za-z_.-]+:[0-9]+)\]"), 1))
