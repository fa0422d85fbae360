"""Phrase collocations: merged count-min sketches, an exact count of what survives them, scores, subsumption.

Words are runs outside spaces and tabs in pieces between stops and line ends, with A-Z lower-cased. First pass: tasks add the
hashes of all words and of all phrases of up to ``longest`` words in a row to count-min sketches of their own, whose cells
stop at ``least``; they are added up cell by cell, and what is left of them is one bit a cell: whether it reached
``least``. A cell counts all that falls into it, so a phrase of ``least`` occurrences or more has all its bits set and none
is lost. Second pass: occurrences whose bits are set, and those of the parts of the phrase too, are counted exactly, by their
words, and what counts less than ``least`` goes. Sketches are about as wide as the table has words, up to CELLS, and a quarter of
that for single words, so that at most 3 * DEPTH * CELLS bits are broadcast; on larger tables fewer phrases are sieved out, and the counts are exact as ever.

A phrase's score is 1000000 a a / (l r), floored, at the cut into a first and a second part where it is lowest (then the
shortest first part), in decimals that hold it exactly up to counts of 10^12. A phrase goes where a longer one that contains
it has at least ``subsume`` percent of its count. The best ``top`` of each language stay; they are picked in three rounds over ever
fewer hash groups, so that no task sorts a language.

Null texts have no words, null languages count as ``und``. Empty texts and repeated rows are ordinary; a very long text is a
block of its own. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import mix64, prefix_sums, span_hashes, stage, table

LONGEST, LEAST, SUBSUME, TOP = 3, 10, 50, 2000
DEPTH, CELLS, BLOCK, TASK_BYTES = 2, 1 << 24, 1 << 21, 4 << 30
_PART = 1 << 16  # cells of a sketch that travel as one row
_ROUNDS = (256, 16, 1)  # hash groups of the rounds that pick the best

_plain = np.arange(256, dtype=np.uint8)
_plain[ord("A") : ord("Z") + 1] += 32
_plain[ord("\t")] = ord(" ")
_stop = np.zeros(256, bool)
_stop[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


class Block:
    """Words of some texts of a language: their places in one buffer, and how many follow each in its piece."""

    def __init__(self, texts: list[bytes], lang: str, longest: int):
        raw = _plain[np.frombuffer(b"\n".join(texts), np.uint8)]
        gap = raw == ord(" ")
        # Gaps become one space, so that any phrase is a slice of the buffer.
        self.raw = raw = raw[~(gap & np.concatenate(([False], gap[:-1])))] if len(raw) else raw
        stops = _stop[raw]
        inside = ~(stops | (raw == ord(" ")))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(stops, dtype=np.int32)[self.start] if len(raw) else np.zeros(0, np.int32)
        self.whole = [np.ones(len(piece), bool)]
        for n in range(1, longest):
            self.whole.append(piece[: len(piece) - n] == piece[n:] if n < len(piece) else np.zeros(0, bool))
        self.seed = np.uint64(zlib.crc32(lang.encode()) << 8)

    def hashes(self, longest: int, other: bool = False) -> list[np.ndarray]:
        """Of the phrase of 1, 2, ... words from each word on."""
        words = span_hashes(prefix_sums(self.raw, other), self.start, self.end)
        found = [mix64(words + self.seed)]
        for n in range(1, longest):
            if n >= len(words):
                found.append(np.zeros(0, np.uint64))
            else:
                found.append(mix64(found[-1][:-1] * np.uint64(3) + words[n:]))
        return found


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Block]]:
    """(lang, text) batches in blocks of about BLOCK bytes of one language."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text.as_py()
            held.setdefault(lang, []).append(body)
            size[lang] = size.get(lang, 0) + len(body)
            if size[lang] >= BLOCK:
                yield lang, Block(held.pop(lang), lang, longest)
                del size[lang]
        if sum(size.values()) >= 4 * BLOCK:  # very many languages
            for lang in list(held):
                yield lang, Block(held.pop(lang), lang, longest)
            size.clear()
    for lang in list(held):
        yield lang, Block(held.pop(lang), lang, longest)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((hashes >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.uint32)


def _widths(width: int, longest: int) -> list[int]:
    """Cells of each row of the sketches of 1, 2, ... words; there are fewer different words than phrases."""
    return [max(8, width // 4)] * DEPTH + [width] * DEPTH * (longest - 1)


def sketches(docs: DataFrame, width: int, longest: int, least: int) -> dict[int, bytes]:
    """Bits of all cells that reach ``least`` by part, from (lang, text) with text as bytes; parts without any are left out."""
    kind = np.uint8 if least < 256 else np.uint32
    widths, parts = _widths(width, longest), -(-width // _PART)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(w, kind) for w in widths]
        for _, block in _blocks(batches, longest):
            for n, hashes in enumerate(block.hashes(longest)):
                hashes = hashes[block.whole[n]]
                for row in range(DEPTH):
                    line = counts[n * DEPTH + row]
                    cells, times = np.unique(_cells(hashes, row, len(line)), return_counts=True)
                    line[cells] = np.minimum(line[cells].astype(np.int64) + times, least)
        for r, line in enumerate(counts):
            for p in range(-(-len(line) // _PART)):
                piece = line[p * _PART : (p + 1) * _PART]
                if piece.any():
                    data = zlib.compress(piece.tobytes(), 1)
                    yield pa.RecordBatch.from_pydict({"part": pa.array([r * parts + p], pa.int32()), "cells": pa.array([data], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def row():
            bits = np.packbits(total >= least).tobytes()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits], pa.binary())})

        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells = np.frombuffer(zlib.decompress(data.as_py()), kind).astype(np.int64)
                if p != part:
                    if part is not None:
                        yield row()
                    part, total = p, cells
                else:
                    total = np.minimum(total + cells, least)
        if part is not None:
            yield row()

    own = docs.mapInArrow(add, "part int, cells binary")
    merged = own.repartition(min(256, longest * DEPTH * parts), "part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")
    # At most longest * DEPTH * width bits, whatever the table.
    return {r["part"]: r["bits"] for r in merged.collect()}


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of a buffer as strings."""
    sizes = end - start
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw[at]))


def exact_counts(docs: DataFrame, bits: dict[int, bytes], width: int, longest: int, least: int) -> DataFrame:
    """lang, words, phrase, f: of all phrases of ``least`` or more; words 0 is the language's number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    widths, parts = _widths(width, longest), -(-width // _PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = [
            np.frombuffer(b"".join(shared.value.get(r * parts + p, bytes(min(w, _PART) // 8)) for p in range(-(-w // _PART))), np.uint8)
            for r, w in enumerate(widths)
        ]

        def rows(lang: str, words: int, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
            n = len(f)
            return pa.RecordBatch.from_pydict(
                {"lang": pa.repeat(lang, n), "words": pa.array(np.full(n, words, np.int32)), "phrase": phrases, "f": pa.array(f.astype(np.int64))}
            )

        for lang, block in _blocks(batches, longest):
            if not len(block.start):
                continue
            yield rows(lang, 0, pa.array([""]), np.array([len(block.start)]))
            alive = None
            for n, (one, two) in enumerate(zip(block.hashes(longest), block.hashes(longest, other=True))):
                ok = block.whole[n].copy()
                for row in range(DEPTH):
                    cells = _cells(one, row, widths[n * DEPTH + row])
                    ok &= (sieve[n * DEPTH + row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                if n:
                    ok &= alive[:-1] & alive[1:]
                alive = ok
                first = np.flatnonzero(ok)
                if not len(first):
                    continue
                order = first[np.argsort(one[first], kind="stable")]
                new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(order)))
                at = order[head]
                yield rows(lang, n + 1, _strings(block.raw, block.start[at], block.end[at + n]), times)

    found = docs.mapInArrow(count, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def parts_of(phrase: Column, words: Column, first: Column, n: Column) -> Column:
    """``n`` words of a phrase from the ``first`` on, which counts from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every phrase of two words or more, at its lowest cut."""
    cuts = counts.where("words > 1").select(
        "lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    cuts = cuts.withColumn("left", parts_of(F.col("phrase"), F.col("words"), F.lit(1), F.col("k"))).withColumn(
        "right", parts_of(F.col("phrase"), F.col("words"), F.col("k") + 1, F.col("words"))
    )
    known = counts.where("words > 0")
    both = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    both = both.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: f"CAST({c} AS DECIMAL(13, 0))" for c in "alr"}
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})")
    lowest = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def kept(candidates: DataFrame, counts: DataFrame, subsume: int) -> DataFrame:
    """Candidates that no longer phrase takes ``subsume`` percent of."""
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: parts_of(F.col("phrase"), F.col("words"), i, n)),
        )
    )
    within = counts.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
    longer = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = candidates.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < subsume * F.col("a"))).drop("longer")


def best(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their rank."""
    for groups in _ROUNDS:
        # Each number of groups divides the one before, so a round meets what the last one left of its groups.
        group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
        order = Window.partitionBy("lang", group).orderBy(F.desc("score"), F.desc("a"), "phrase")
        phrases = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return phrases


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    subsume: int = SUBSUME,
    top: int = TOP,
    width: int | None = None,
) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score; any ``width`` of the sketches, a power of two of 8 or more, gives the same rows."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    width = width or min(CELLS, max(_PART, 1 << int(n_bytes // 8).bit_length()))
    # A sketch is as large for a small task as for a large one: few tasks, of some gigabytes, make few sketches.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, n_bytes // TASK_BYTES)
    bits = sketches(rows.coalesce(int(tasks)), width, longest, least)
    counts = stage(exact_counts(rows, bits, width, longest, least), "phrase-counts")
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best(kept(scored(counts), counts, subsume), top).join(n, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collocations(table(spark, sf_dir, "documents"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def phrase_sql(docs: str = "documents") -> str:
    """The same rows by counting every phrase of up to three words."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\n\x0b\f\r]')) AS piece FROM {docs}),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
single AS (SELECT lang, w[i] AS phrase, count(*)::HUGEINT AS f FROM spots GROUP BY ALL),
pairs AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*)::HUGEINT AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL),
triples AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*)::HUGEINT AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(f) AS n FROM single GROUP BY lang),
longer AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM triples UNION ALL SELECT lang, y, z, f FROM triples) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, 1 AS k, l.f AS l, r.f AS r FROM pairs p JOIN single l ON l.lang = p.lang AND l.phrase = p.x JOIN single r ON r.lang = p.lang AND r.phrase = p.y
    LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y WHERE p.f >= {LEAST} AND NOT coalesce(100 * g.longer >= {SUBSUME} * p.f, false)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f FROM triples t JOIN single l ON l.lang = t.lang AND l.phrase = t.x JOIN pairs r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f FROM triples t JOIN pairs l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN single r ON r.lang = t.lang AND r.phrase = t.z),
scores AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM cuts),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest QUALIFY rank <= {TOP})
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang)"""
