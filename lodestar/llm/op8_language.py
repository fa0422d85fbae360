"""Language identification by rank-order n-gram profiles.

Texts are lower-cased, every run of non-letters becomes one space, and n-grams of one to three characters are
counted (a space alone is none). A language's profile is its PROFILE most frequent n-grams over all learning
documents, in order; a document's is the same of its whole text. The distance sums how far each of the
document's n-grams is out of place in the language's order, PROFILE if it is absent; the nearest language wins, ties
to the earlier name. Equal counts are ordered by n-gram, so the result does not depend on partitioning.

Counting runs in Arrow batches and is summed per language and n-gram; only PROFILE rows per language reach
the driver. Texts that are null or have no letters give ``und`` with score 0, as does a corpus from
which nothing could be learned. Rows with a null id are never learned from and count as not held out; a null
language is not learned. Very long texts are counted whole; repeated rows count again when learnt from and are judged alike.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import table

PROFILE, LONGEST, UNKNOWN = 300, 3, "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """Sorted codes of all n-grams of a text, 21 bits a character; empty if it has no letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]])
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    parts = [codes[codes != 32]]
    gram = codes
    for n in range(1, LONGEST):
        gram = (gram[:-1] << 21) | codes[n:]
        parts.append(gram)
    return np.sort(np.concatenate(parts))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


def top(grams: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:k]]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def profiles(docs: DataFrame, k: int = PROFILE) -> dict[str, np.ndarray]:
    """language -> its most frequent n-grams, from (text, lang)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, size = [], 0
                for text in texts:
                    parts.append(ngrams(text))
                    size += len(parts[-1])
                    if size > 1 << 21:
                        grams, n = counted(np.sort(np.concatenate(parts)))
                        yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
                        parts, size = [], 0
                if parts:
                    grams, n = counted(np.sort(np.concatenate(parts)))
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    sums = docs.where("lang is not null and text is not null").select("lang", "text").mapInPandas(
        count, "lang string, gram long, n long"
    ).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sums.withColumn("place", place).where(F.col("place") <= k).select("lang", "gram", "place").toPandas()
    rows = rows.sort_values(["lang", "place"])
    return {lang: part["gram"].to_numpy() for lang, part in rows.groupby("lang")}


def places(learned: dict[str, np.ndarray], k: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all profile n-grams sorted, and each one's place per language (-1 if absent)."""
    langs = sorted(learned)
    grams = np.unique(np.concatenate([learned[x] for x in langs])) if langs else np.zeros(0, np.int64)
    place = np.full((len(langs), len(grams)), -1, np.int64)
    for i, lang in enumerate(langs):
        place[i, np.searchsorted(grams, learned[lang])] = np.arange(len(learned[lang]))
    return langs, grams, place


def nearest(text: str | None, langs: list[str], grams: np.ndarray, place: np.ndarray, k: int = PROFILE) -> tuple[str, float]:
    mine = top(*counted(ngrams(text)), k) if isinstance(text, str) else np.zeros(0, np.int64)
    if not len(mine) or not langs:
        return UNKNOWN, 0.0
    at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
    theirs = np.where(grams[at] == mine, place[:, at], -1)
    distance = np.where(theirs < 0, k, np.abs(theirs - np.arange(len(mine)))).sum(1)
    best = int(np.argmin(distance))
    return langs[best], 1.0 - float(distance[best]) / (k * len(mine))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    langs, grams, place = places(learned)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [nearest(t, langs, grams, place) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return identify(docs, profiles(learn))
