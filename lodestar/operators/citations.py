"""Quotes of answers by their character positions in documents, and whether a cited chunk covers them.

A document's body is its words joined by single spaces, so that chunks of words are ranges of characters in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text

#: A chunk id in brackets, and characters of a document that share a bin.
MARK, BIN = r"\[[0-9A-Za-z_.-]+:[0-9]+\]", 4096


def bodies(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.array_join(text.words(F.col(body)), " ").alias("body"))


def located(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(…, doc_id, sentence) -> plus begin and end, its first place in the document's body, from 0; null where it is not there."""
    begin = F.when(F.col("at") > 0, F.col("at") - 1)
    found = claims.join(held.select("doc_id", "body"), "doc_id", "left").withColumn("at", F.expr("locate(sentence, body)"))
    return found.withColumn("begin", begin).withColumn("end", begin + F.length("sentence")).drop("at", "body")


def chunk_ranges(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, chunk_no, low, high): where the chunks that ``chunk_words`` cuts begin and end in the body."""
    step = max(1, size - overlap)
    rows = docs.select(F.col(key).alias("doc_id"), F.transform(text.words(F.col(body)), lambda w: F.length(w) + 1).alias("n")).where(F.size("n") > 0)
    total = lambda at, words: F.aggregate(F.slice("n", at + 1, F.lit(words)), F.lit(0).cast("long"), lambda a, x: a + x)
    starts = F.sequence(F.lit(0), F.size("n") - 1, F.lit(step))
    each = rows.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.struct(total(i, step).alias("step"), total(i, size).alias("own")))).alias("chunk_no", "s"))
    # A document's chunks are few: its words over the step.
    before = F.sum("s.step").over(Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("s.step")
    return each.select("doc_id", "chunk_no", before.alias("low"), (before + F.col("s.own") - 1).alias("high"))


def covering(quotes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Quotes (…, doc_id, begin, end), each with every range (doc_id, …, low, high) of its document that holds the whole of it.

    A range is known in every bin that it reaches into, a quote in the one where it begins, so a quote meets the ranges around it and not
    all of its document. Quotes without a place, or that no range holds, have no row.
    """
    reach = F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))
    binned = ranges.withColumn("bin", F.explode(reach))
    placed = quotes.where("begin is not null").withColumn("bin", F.floor(F.col("begin") / BIN))
    return placed.join(binned, ["doc_id", "bin"]).where("low <= begin and end <= high").drop("bin")


def checked(claims: DataFrame, docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(claim_id, sentence, chunk_id, doc_id, chunk_no), a row for each chunk that a claim cites -> claim_id, located, supported, elsewhere.

    A claim is located if the document of a cited chunk holds it, supported if a cited chunk itself does, and elsewhere if only
    another chunk of such a document does.
    """
    quotes = located(claims, bodies(docs))
    holds = covering(quotes, chunk_ranges(docs, size, overlap).withColumnRenamed("chunk_no", "holder"))
    told = holds.groupBy("claim_id").agg(F.max((F.col("holder") == F.col("chunk_no")).cast("int")).alias("own"))
    found = quotes.groupBy("claim_id").agg(F.max(F.col("begin").isNotNull()).alias("located"))
    own = F.coalesce(F.col("own"), F.lit(0)) == 1
    return found.join(told, "claim_id", "left").select("claim_id", "located", own.alias("supported"), (F.col("own").isNotNull() & ~own).alias("elsewhere"))
