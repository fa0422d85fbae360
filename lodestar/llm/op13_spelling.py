"""Spelling variants: words at edit distance one, found by intersecting automata with broadcast trie shards.

Words are maximal runs of Latin letters, with A-Z lower-cased, of at least ``least_length`` code points and ``least`` occurrences.
The sorted vocabulary is cut into runs of SHARD words, each packed as a trie: its labels in one string of bytes, level by
level, the first child of each node, and the count of the word that ends there. Shards are broadcast, ROUND bytes at a
time, which bounds what goes through the driver and what a task holds; rounds grow with the vocabulary. In each round,
every word's automaton of distance one is followed through every shard, depth first: its states are a place in the word and
whether the edit is spent, and a state without it walks down a single path. A shard gives a word the number of its near words
and the most frequent; sums and minima over shards are tiny. No pair of words is listed. Each word's form is its most
frequent near word, if frequent enough, and its root is found by jumping along forms, which doubles the reach each time.

A null text has no words, a null id is written as nothing. Repeated rows count; a very long text is cut into words like others.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import crc_sql, discard, stage, table

LEAST_LENGTH, LEAST, TIMES, SLIP = 6, 5, 5, 199
SHARD, ROUND, IN_TASK = 20_000, 32 << 20, 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[a-zÀ-ÿ]+"  # one byte each in Latin-1, in the order of code points


def slipped(doc_id: Column, run: Column, slip: int) -> Column:
    """The run, without one code point where ``slip`` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_length: int, least: int, slip: int) -> DataFrame:
    """word, n."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    runs = F.filter(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0)), lambda r: F.length(r) >= least_length)
    every = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = every.select(slipped(F.col("id"), F.col("run"), slip).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def pack(words: list[bytes], counts: list[int]) -> tuple[bytes, bytes, bytes]:
    """The trie of sorted distinct words: labels and first children of its nodes, level by level, and counts at ends of words."""
    labels, first, ends = bytearray(b"\0"), array("i"), array("q")
    level = [(0, len(words))]
    depth = 0
    while level:
        below = []
        for low, high in level:
            first.append(len(labels))
            if len(words[low]) == depth:
                ends.append(counts[low])
                low += 1
            else:
                ends.append(0)
            while low < high:
                letter, at = words[low][depth], low
                while at < high and words[at][depth] == letter:
                    at += 1
                labels.append(letter)
                below.append((low, at))
                low = at
        level, depth = below, depth + 1
    first.append(len(labels))
    return bytes(labels), first.tobytes(), ends.tobytes()


class Trie:
    """A packed trie, read in place."""

    def __init__(self, labels: bytes, first: bytes, ends: bytes):
        self.labels, self.first, self.ends = labels, array("i"), array("q")
        self.first.frombytes(first)
        self.ends.frombytes(ends)

    def near(self, word: bytes) -> set[int]:
        """Ends of all words that one insertion, deletion or replacement makes of ``word``."""
        labels, first, ends, n = self.labels, self.first, self.ends, len(word)
        found = set()
        node, at = 0, 0
        todo = []
        # Without an edit there is one path; every way to leave it is a state with the edit spent.
        while node >= 0:
            low, high = first[node], first[node + 1]
            if at < n:
                todo.append((node, at + 1))
            letter = word[at] if at < n else -1
            for child in range(low, high):
                todo.append((child, at))
                if at < n and labels[child] != letter:
                    todo.append((child, at + 1))
            while todo:
                v, p = todo.pop()
                while p < n:
                    v = labels.find(word[p], first[v], first[v + 1])
                    if v < 0:
                        break
                    p += 1
                else:
                    if ends[v]:
                        found.add(v)
            node = labels.find(letter, low, high) if at < n else -1
            at += 1
        return found

    def word(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.labels[node])
            # Nodes without children share their first child with the next; the last of equals is the parent.
            node = bisect_right(self.first, node) - 1
        return bytes(reversed(letters)).decode("latin-1")


def shards(words: DataFrame, n_words: int, size: int) -> DataFrame:
    """Tries of at most ``size`` words that follow each other in order."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        counts: list[int] = []

        def packed():
            return pd.DataFrame([pack(held, counts)], columns=["labels", "first", "ends"])

        for batch in batches:
            for word, n in zip(batch["word"], batch["n"]):
                held.append(word.encode("latin-1"))
                counts.append(n)
                if len(held) == size:
                    yield packed()
                    held, counts = [], []
        if held:
            yield packed()

    ordered = words.repartitionByRange(max(1, -(-n_words // size)), "word").sortWithinPartitions("word")
    return ordered.mapInPandas(build, "labels binary, first binary, ends binary")


def hits(words: DataFrame, tries: list[tuple[bytes, bytes, bytes]]) -> DataFrame:
    """word, n_near, best_n, best of every word that has near words in the shards, once for each of them."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = [Trie(*t) for t in shared.value]
        for batch in batches:
            out = []
            for word in batch["word"]:
                raw = word.encode("latin-1")
                for trie in opened:
                    found = trie.near(raw)
                    if found:
                        most = max(trie.ends[v] for v in found)
                        out.append((word, len(found), most, min(trie.word(v) for v in found if trie.ends[v] == most)))
            yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])

    return words.select("word").mapInPandas(search, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, size: int = SHARD, in_round: int = ROUND) -> DataFrame:
    """word, n_near, best_n, best from (word, n): the number of words at distance one and the most frequent, least in order on ties."""
    n_words = words.count()
    tries = stage(shards(words, n_words, size), "spelling-shards")
    sizes = tries.withColumn("shard", F.xxhash64("labels", "first", "ends")).select("shard", F.expr("length(labels) + length(first) + length(ends)").alias("bytes"))
    rounds, room = [[]], in_round
    # A number and a size for each shard; the shards themselves come ROUND bytes at a time.
    for r in sizes.orderBy("shard").collect():
        if r["bytes"] > room and rounds[-1]:
            rounds.append([])
            room = in_round
        rounds[-1].append(r["shard"])
        room -= r["bytes"]
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-n_words // IN_TASK))
    dealt = stage(words.select("word").repartition(tasks, "word"), "spelling-words")
    found = []
    for part in rounds:
        rows = tries.where(F.xxhash64("labels", "first", "ends").between(part[0], part[-1])).collect() if part else []
        found.append(stage(hits(dealt, [tuple(map(bytes, r)) for r in rows]), "spelling-hits"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    out = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last of each word's forms. Counts rise along forms, so they never meet again."""
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots", done=[links])
        links = moved.select("word", "root")
        links.staged_at = moved.staged_at
        if moved.where("moved").isEmpty():
            return links


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least: int = LEAST,
    times: int = TIMES,
    slip: int = SLIP,
    size: int = SHARD,
    in_round: int = ROUND,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; any ``size`` of shards and rounds gives the same rows."""
    words = stage(vocabulary(docs, id_col, text_col, least_length, least, slip), "spelling-vocabulary")
    near = near_words(words, size, in_round)
    enough = F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))
    told = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n")
    )
    told = stage(told, "spelling-forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def spelling_sql(docs: str = "documents") -> str:
    """The same rows by joining words on what is left without one of their letters."""
    return rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM {docs}),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
summed AS (SELECT run, times, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM each),
slipped AS (SELECT CASE WHEN h % {SLIP} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM summed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST}),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT c.word AS x, w.word AS y FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, d.word FROM cut c JOIN cut d ON c.rest = d.rest AND c.i = d.i AND c.word <> d.word),
ranked AS (SELECT x AS word, y, w.n AS y_n, count(*) OVER (PARTITION BY x) AS n_near FROM near JOIN words w ON w.word = y QUALIFY row_number() OVER (PARTITION BY x ORDER BY w.n DESC, y) = 1),
told AS (SELECT word, n, CASE WHEN y_n >= {TIMES} * n THEN y END AS form, CASE WHEN y_n >= {TIMES} * n THEN y_n END AS form_n, coalesce(n_near, 0) AS n_near FROM words LEFT JOIN ranked USING (word)),
up(word, root) AS (SELECT word, word FROM told UNION ALL SELECT u.word, t.form FROM up u JOIN told t ON t.word = u.root WHERE t.form IS NOT NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN (SELECT up.word, up.root FROM up JOIN told t ON t.word = up.root WHERE t.form IS NULL) USING (word)"""
