"""Files to text to chunks to points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from lodestar.functions import ids, text, vectors

CHUNK_WORDS, OVERLAP_WORDS = 600, 80
#: Rows of a batch that are Python objects at a time.
ROWS = 256


@F.arrow_udf(StringType())
def decode_dropping(content: pa.Array) -> pa.Array:
    """UTF-8 with invalid bytes dropped, which no built-in function does."""
    texts = lambda part: pa.array([None if b is None else b.decode("utf-8", "ignore") for b in part.to_pylist()], pa.string())
    return pa.concat_arrays([texts(content.slice(at, ROWS)) for at in range(0, len(content), ROWS)] or [pa.array([], pa.string())])


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """Page texts joined by a blank line; needs pypdf on the workers."""
    import io

    from pypdf import PdfReader

    read = lambda b: "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages)
    return content.map(lambda b: None if b is None else read(b))


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a word-processor file, one a line."""
    import io
    import zipfile
    from xml.etree import ElementTree

    def read(b):
        with zipfile.ZipFile(io.BytesIO(b)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
        space = root.tag.split("}")[0] + "}"
        return "\n".join("".join(t.text or "" for t in p.iter(space + "t")) for p in root.iter(space + "p"))

    return content.map(lambda b: None if b is None else read(b))


#: Loaders by suffix, from (content) to text; callers register their own. Any other suffix is text in UTF-8.
LOADERS = {".pdf": pdf_text, ".docx": docx_text}


def load_text(files: DataFrame) -> DataFrame:
    """(name, content) -> plus text, by suffix: a registered loader, mark-up without its tags, or bytes as UTF-8."""
    kind = text.suffix(F.col("name"))
    rest = files.where(~kind.isin(*LOADERS))
    plain = decode_dropping("content")
    out = rest.withColumn("text", plain).withColumn("text", F.when(kind.isin(".html", ".htm"), text.html_to_text(F.col("text"))).otherwise(F.col("text")))
    for name, loader in LOADERS.items():
        out = out.unionByName(files.where(kind == name).withColumn("text", loader("content")))
    return out


def chunk_words(docs: DataFrame, key: str = "doc_id", body: str = "text", size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, drop_inner_tail: bool = False) -> DataFrame:
    """(key, chunk_no, tokens, chunk_text): windows of ``size`` words every size - overlap words.

    A last window that lies wholly in the one before stays, unless ``drop_inner_tail``.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    step = max(1, size - overlap)
    rows = docs.select(key, text.words(F.col(body)).alias("w")).where(F.size("w") > 0)
    last = F.size("w") - 1
    if drop_inner_tail:
        last = F.greatest(F.lit(0), F.size("w") - 1 - overlap) if overlap < size else last
    starts = F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_no", "start")
    piece = F.slice("w", F.col("start") + 1, F.lit(size))
    return rows.select(key, "w", starts).select(
        key, "chunk_no", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("chunk_text")
    )


def chunk_sentences(docs: DataFrame, key: str = "doc_id", body: str = "text", budget: int = 400) -> DataFrame:
    """(key, chunk_no, tokens, chunk_text): whole sentences, a new chunk each ``budget`` words of running total."""
    rows = docs.select(key, F.posexplode(text.sentences(F.col(body))).alias("pos", "sentence"))
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("n", text.word_count(F.col("sentence"))).where("n > 0")
    placed = counted.withColumn("chunk_no", F.floor((F.sum("n").over(run) - F.col("n")) / F.lit(budget)).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    return placed.groupBy(key, "chunk_no").agg(F.sum("n").cast("int").alias("tokens"), F.array_join(ordered, " ").alias("chunk_text"))


def likeness(before: list[set], after: list[set]) -> int:
    """Share, in millionths, of the smaller side's terms that the other side has too."""
    a, b = set().union(*before), set().union(*after)
    least = min(len(a), len(b))
    return 1_000_000 * len(a & b) // least if least else 0


def topic_starts(sizes: list[int], likes: list[int], least: int, most: int) -> list[int]:
    """First sentences of the best segmentation, by dynamic programming over the last cut.

    ``likes[i]`` is the likeness across the gap before sentence i. No segment has more than ``most`` words, but for a sentence that
    has by itself; as few as can be have less than ``least``, but for the last; of what is left, the sum of likeness over the
    cuts is the least, then the number of cuts.
    """
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    best: list[tuple] = [(0, 0, 0)]
    came = [0]
    for j in range(1, len(sizes) + 1):
        found = None
        for i in range(j - 1, -1, -1):
            words = ends[j] - ends[i]
            if words > most and i < j - 1:
                break
            short, cost, cuts = best[i]
            told = (short + (words < least and j < len(sizes)), cost + (likes[i] if i else 0), cuts + (i > 0))
            if found is None or told <= found:
                found, at = told, i
        best.append(found)
        came.append(at)
    starts, j = [], len(sizes)
    while j:
        starts.append(came[j])
        j = came[j]
    return starts[::-1]


def chunk_topics(docs: DataFrame, key: str = "doc_id", body: str = "text", least: int = 400, most: int = 800, overlap: int = 80, beside: int = 3) -> DataFrame:
    """(key, chunk_no, first_sentence, tokens, overlap, chunk_text): whole sentences, cut where the topic changes most.

    The likeness of a gap is that of the terms of ``beside`` sentences on either side of it; cuts are those of ``topic_starts``. A chunk begins with up
    to ``overlap`` words from before its first sentence, which ``tokens`` does not count. Documents without words have no chunk.
    """
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                row, number, start = [], [], []
                for k in range(len(batch)):
                    sets = [set(t) for t in batch.column("terms")[k].as_py()]
                    likes = [likeness(sets[max(0, i - beside) : i], sets[i : i + beside]) for i in range(len(sets))]
                    starts = topic_starts(batch.column("sizes")[k].as_py(), likes, least, most)
                    row += [k] * len(starts)
                    number += range(len(starts))
                    start += starts
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int32())], [key, "chunk_no", "start"])

    words = F.filter(F.transform(text.sentences(F.col(body)), lambda s: text.words(s)), lambda w: F.size(w) > 0)
    rows = docs.select(F.col(key), words.alias("sentences")).where(F.size("sentences") > 0)
    ready = rows.select(
        F.col(key).alias("key"), F.transform("sentences", lambda w: F.size(w)).alias("sizes"), F.transform("sentences", lambda w: text.terms(F.array_join(w, " "))).alias("terms")
    )
    # One row for each document goes through Python, and comes back as sentence numbers.
    starts = ready.mapInArrow(cut, f"`{key}` {kind}, chunk_no int, start int")
    order = F.array_sort(F.collect_list(F.struct("chunk_no", "start")))
    made = starts.groupBy(key).agg(F.transform(order, lambda x: x["start"]).alias("starts"))
    joined = rows.groupBy(key).agg(F.first("sentences").alias("sentences")).join(made, key).select(key, "sentences", "starts", F.posexplode("starts").alias("chunk_no", "first_sentence"))
    to = F.coalesce(F.get("starts", F.col("chunk_no") + 1), F.size("sentences"))
    own = F.flatten(F.slice("sentences", F.col("first_sentence") + 1, to - F.col("first_sentence")))
    ahead = F.flatten(F.slice("sentences", F.lit(1), F.col("first_sentence")))
    from_ = F.greatest(F.size(ahead) - F.lit(overlap), F.lit(0))
    head = F.slice(ahead, from_ + 1, F.lit(max(overlap, 1))) if overlap else F.array().cast("array<string>")
    return joined.select(key, "chunk_no", "first_sentence", F.size(own).alias("tokens"), F.size(head).alias("overlap"), F.array_join(F.concat(head, own), " ").alias("chunk_text"))


def points(chunks: DataFrame, key: Column) -> DataFrame:
    """Chunks with their chunk_id and 60-bit point_id."""
    return chunks.withColumn("chunk_id", ids.chunk_id(key, F.col("chunk_no"))).withColumn("point_id", ids.point_id(F.col("chunk_id")))


def embedded(points_: DataFrame, body: str = "chunk_text", embedder: str = vectors.HASHED, version: str = "1") -> DataFrame:
    """Points with their embedding and where it comes from; texts without terms get no hashed vector and no row.

    A text is embedded in its row, so points are not dealt out for it.
    """
    found = points_.withColumn("embedding", vectors.embedding(F.col(body), embedder))
    if embedder == vectors.HASHED:
        found = found.where(F.col("embedding").isNotNull())
    return found.withColumn("embedding_model", F.lit(embedder)).withColumn("model_version", F.lit(version))


def upsert(old: DataFrame, new: DataFrame, key: str, by_group: str | None = None) -> DataFrame:
    """Rows of ``new`` over rows of ``old`` with their key; with ``by_group``, whole groups are replaced, tails too."""
    if by_group:
        old = old.join(new.select(by_group).distinct(), by_group, "left_anti")
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    # Within a batch the greatest digest of the whole row stays, so reruns agree.
    whole = F.xxhash64(F.to_json(F.struct(*sorted(new.columns))))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch"), F.desc(whole)))
    return both.withColumn("_place", latest).where("_place = 1").drop("_batch", "_place")


def unchanged_removed(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose content digest is not known yet."""
    return chunks.join(known.select("content_sha").distinct(), "content_sha", "left_anti")
