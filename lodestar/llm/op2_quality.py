"""Quality rules, and a hashed n-gram log-likelihood ratio between trusted and raw text. DataFrame functions only.

Rules: too few words, or too large a share of words in repeated three-word windows. Method: words and pairs
of successive words are hashed into a fixed number of buckets; two smoothed multinomials over the buckets,
one of trusted documents and one of all documents, give each bucket a log ratio; a document's score is the
mean over its features, and it is kept when the score reaches the threshold.

Trusted documents are all labelled rows of quality 1; raw counts cover every document. The trusted model is shrunk towards the
raw one: a bucket's ratio is its trusted count over what its raw count lets expect, with SHRINK added to both, so a
bucket that is rare in the corpus says little whether trusted documents have it or not. Both models have BUCKETS
entries, however large the corpus, and reach the scoring plan as a scalar subquery; ratios are whole thousandths, so that scores
are sums of integers and come out the same in any order. Texts are cut into features once, and the features staged.

The threshold is the LOSS share of the scores of trusted documents that pass the rules, each scored without its own counts in the
trusted model, as if it were not trusted. All of them are scored, and their percentile is exact. So the threshold moves with
the models, and about that share of documents like the trusted ones is rejected, whatever the size of the trusted set. Without any,
the ratio rejects none.

Nulls and texts without words have no words, fail the base rule and score 0. Rows with a null id are scored
like others and are never trusted. Repeated rows are judged one by one, very long texts whole. An empty table gives no rows.
Input columns travel in a struct where they are kept, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import stage, table

BUCKETS, SHRINK, LOSS = 1 << 16, 1.0, 0.01
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Trusted ids that go to every task, so that texts stay where they are; of more, both sides are shuffled.
SENT = 1 << 22
_SEED = 42  # of Spark's xxhash64, for the brute-force test


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column, size: int = 3) -> Column:
    """Words that lie in a window of ``size`` words which occurs twice or more."""
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)])),
        1,
        F.greatest(F.size(w) - (size - 1), F.lit(0)),
    )

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        starts = bound(
            ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1)), lambda e: e["i"]))
        )
        begin = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(size), p - acc["last"])).alias("n"))
        return F.aggregate(starts, begin, step, lambda acc: acc["n"])

    return bound(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    )


def features(w: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word, then of each pair of successive words."""
    slot = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    single = F.transform(w, lambda x: slot(F.xxhash64(x)))
    double = F.transform(w, lambda x, i: slot(F.xxhash64(x, F.get(w, i + 1))))
    return F.concat(single, F.slice(double, 1, F.greatest(F.size(w) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("trusted_id")).distinct()


def _base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def measured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int, keep_row: bool) -> DataFrame:
    """doc_id, the figures of the rules, base_failed, trusted and f, the buckets of a text's features; staged, so texts are read once."""
    trusted = stage(trusted_ids(labels), "quality-trusted")
    if trusted.count() <= SENT:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.struct("*").alias("row")] * keep_row)
    rows = rows.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    # One struct from one bound array of words, so that each text is split once.
    found = bound(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), features(w, buckets).alias("f")),
    )
    out = rows.withColumn("m", found).select(
        "doc_id",
        "m.n_words",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        "m.n_repeat_words",
        "m.f",
        F.col("trusted_id").isNotNull().alias("trusted"),
        *["row"] * keep_row,
    )
    return stage(out.withColumn("base_failed", _base_failed(F.col("n_words"), F.col("n_repeat_words"))), "quality-features")


def bucket_counts(held: DataFrame) -> DataFrame:
    """bucket, raw, good: features of each bucket in all documents and in the trusted ones."""
    pairs = held.select(F.col("trusted").cast("int").alias("good"), F.explode("f").alias("bucket"))
    return pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))


def bucket_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket in thousandths: the shrunken trusted multinomial over the raw one."""
    expected = raw * (good.sum() / max(raw.sum(), 1))
    return np.rint(1000 * np.log((good + SHRINK) / (expected + SHRINK))).astype(np.int64)


def with_model(rows: DataFrame, kind: str, **arrays: np.ndarray) -> DataFrame:
    """``rows`` with arrays over the buckets as columns, by scalar subqueries, which keeps their values out of the plans' texts."""
    one = rows.sparkSession.createDataFrame([tuple(a.tolist() for a in arrays.values())], ", ".join(f"{n} array<{kind}>" for n in arrays))
    return rows.withColumns({n: one.select(n).scalar() for n in arrays})


def mean_of(total: Column, f: Column) -> Column:
    return total / F.greatest(F.size(f), F.lit(1)) / F.lit(1000.0)


def own_left_out(held: DataFrame, raw: np.ndarray, good: np.ndarray) -> DataFrame:
    """own_score of every trusted document that passes the rules, without its own counts; repeated rows are documents of their own."""
    rows = with_model(held.where("trusted and not base_failed"), "double", counted=good, expected=raw * (good.sum() / max(raw.sum(), 1)))

    def total(f: Column, trusted: Column, expected: Column) -> Column:
        def told(bucket: Column, run: Column) -> Column:
            """What ``run`` occurrences of a bucket in a document add, in thousandths."""
            ratio = F.log((F.get(trusted, bucket) - run + SHRINK) / (F.get(expected, bucket) + SHRINK))
            return F.when(run > 0, run * F.rint(ratio * 1000).cast("long")).otherwise(F.lit(0).cast("long"))

        state = lambda bucket, run, so_far: F.struct(bucket.alias("b"), run.alias("n"), so_far.alias("s"))
        step = lambda a, x: F.when(a["b"] == x, state(a["b"], a["n"] + 1, a["s"])).otherwise(state(x, F.lit(1), a["s"] + told(a["b"], a["n"])))
        return F.aggregate(F.sort_array(f), state(F.lit(-1), F.lit(0), F.lit(0).cast("long")), step, lambda a: a["s"] + told(a["b"], a["n"]))

    own = F.element_at(F.zip_with(F.array("counted"), F.array("expected"), lambda t, e: total(F.col("f"), t, e)), 1)
    return rows.select(mean_of(own, F.col("f")).alias("own_score"))


def percentile(values: DataFrame, share: float) -> float | None:
    """The exact percentile of a staged column, between its two nearest values; None of none.

    Counts of ever narrower cells lead to the values of one cell, so neither the driver nor a task holds all values.
    """
    name = values.columns[0]
    values = values.where(F.col(name).isNotNull())

    def nth(k: int) -> tuple[float | None, int]:
        here, total = values, None
        for cell in (*(F.floor(F.col(name) * 10**d) for d in (3, 6, 9)), F.col(name)):
            found = here.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
            total = sum(r["n"] for r in found) if total is None else total
            if not total:
                return None, 0
            k = int(share * (total - 1)) if k < 0 else k
            for at in found:
                if k < at["n"]:
                    break
                k -= at["n"]
            here = here.where(cell == at["cell"])
        return at["cell"], total

    low, n = nth(-1)
    if not n:
        return None
    place = share * (n - 1)
    beyond = place - int(place)
    return low if not beyond else (1 - beyond) * low + beyond * nth(int(place) + 1)[0]


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_score: float | None = None,
    buckets: int = BUCKETS,
    keep_row: bool = False,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept; the threshold is fitted unless given."""
    held = measured(docs, labels, id_col, text_col, buckets, keep_row)
    counts = bucket_counts(held).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if good.any() and min_score is None:
        min_score = percentile(stage(own_left_out(held, raw, good), "quality-own"), LOSS)
    min_score = float("-inf") if min_score is None else round(min_score, 6)
    add = lambda t: lambda a, b: a + F.get(t, b)
    total = bound(F.col("ratios"), lambda t: F.aggregate(F.col("f"), F.lit(0).cast("long"), add(t)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = with_model(held, "int", ratios=bucket_ratios(raw, good)).select(*names, mean_of(total, F.col("f")).alias("score"), *["row"] * keep_row, "base_failed")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(min_score)))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``."""
    verdict = judge(docs, labels, keep_row=True).select("row", F.struct("n_words", "n_repeat_words", "score", "kept").alias("v"))
    return verdict.where("v.kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
