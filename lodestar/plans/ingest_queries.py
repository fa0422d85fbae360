"""Ingest: tokens, chunks, keys, upserts, duplicates, pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ids, text, vectors
from lodestar.operators import dedupe, ingest
from lodestar.plans import sql
from lodestar.session import shared_dir, table
from lodestar.sources.writers import Collection


def word_tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = text.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).alias("tokens"), F.get(w, 0).alias("first_word"), F.size(F.array_distinct(w)).alias("distinct_tokens"))


def chunk_fixed_window(spark, sf):
    out = ingest.chunk_words(table(spark, sf, "documents"))
    return out.select("doc_id", "chunk_no", "tokens", F.md5("chunk_text").alias("chunk_md5"))


def chunk_no_redundant_tail(spark, sf):
    out = ingest.chunk_words(table(spark, sf, "documents"), drop_inner_tail=True)
    return out.select("doc_id", "chunk_no", "tokens")


def chunk_sentence_budget(spark, sf):
    out = ingest.chunk_sentences(table(spark, sf, "documents"), budget=200)
    return out.select("doc_id", "chunk_no", "tokens", F.md5("chunk_text").alias("chunk_md5"))


def chunk_counts_per_doc(spark, sf):
    docs = table(spark, sf, "documents")
    n = ingest.chunk_words(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id", "source").join(n, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).alias("chunks"))


def doc_and_point_ids(spark, sf):
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, sf, "documents").withColumn("doc_key", ids.doc_key(name, F.octet_length("text")))
    chunks = ingest.points(ingest.chunk_words(docs, key="doc_key"), F.col("doc_key"))
    return chunks.select("doc_key", "chunk_no", "chunk_id", "point_id")


def _points(docs: DataFrame, batch: str) -> DataFrame:
    rows = ingest.points(ingest.chunk_words(docs), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "chunk_id", "tokens", ids.content_sha(F.col("chunk_text")).alias("content_sha"), F.lit(batch).alias("batch"))


def _second_batch(spark, sf):
    """Every document comes again whole; those of even id as a shorter revision, without their words of under four characters."""
    w = text.words(F.col("text"))
    shorter = F.array_join(F.filter(w, lambda x: F.length(x) >= 4), " ")
    return table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, shorter).otherwise(F.col("text")))


def chunk_upsert_latest(spark, sf):
    return ingest.upsert(_points(table(spark, sf, "documents"), "first"), _points(_second_batch(spark, sf), "second"), "chunk_id").select("chunk_id", "tokens", "batch")


def chunk_replace_by_doc(spark, sf):
    return ingest.upsert(_points(table(spark, sf, "documents"), "first"), _points(_second_batch(spark, sf), "second"), "chunk_id", by_group="doc_id").select("chunk_id", "tokens", "batch")


def incremental_new_chunks(spark, sf):
    new, known = _points(_second_batch(spark, sf), "second"), _points(table(spark, sf, "documents"), "first")
    return ingest.unchanged_removed(new, known).select("chunk_id", "content_sha")


def _revised(spark, sf):
    """Every document comes again whole; two of three with a word more at the end, or their middle word replaced."""
    w = text.words(F.col("text"))
    at = F.floor(F.size("w") / 2).cast("int")
    middle = F.concat(F.slice("w", F.lit(1), at), F.array(F.lit("revised")), F.slice("w", at + 2, F.size("w")))
    new = F.when(F.col("doc_id") % 3 == 1, F.concat("w", F.array(F.lit("appended")))).when(F.col("doc_id") % 3 == 2, middle).otherwise(F.col("w"))
    return table(spark, sf, "documents").withColumn("w", w).withColumn("text", F.array_join(new, " ")).drop("w")


def incremental_revised_chunks(spark, sf):
    """incremental_new_chunks with a second batch of all documents, whole and revised."""
    new, known = _points(_revised(spark, sf), "second"), _points(table(spark, sf, "documents"), "first")
    return ingest.unchanged_removed(new, known).select("chunk_id", "content_sha")


def collection_batches(spark, sf):
    """Three batches into a collection: all documents; those with personal data, redacted; those that repeat a line, without the repeats."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    clean = text.redact(F.col("text"))
    lines = F.split("text", "\n")
    once = F.array_join(F.array_distinct(lines), "\n")
    batches = {
        "all": docs,
        "redacted": docs.withColumn("new", clean).where("new <> text").select("doc_id", F.col("new").alias("text")),
        "lines": docs.withColumn("new", once).where("new <> text").select("doc_id", F.col("new").alias("text")),
    }
    held = Collection(spark, f"{shared_dir(spark)}/lodestar/collection-{uuid.uuid4().hex}", vectors.DIMENSION)
    for name, rows in batches.items():
        made = ingest.points(ingest.chunk_words(rows), F.col("doc_id").cast("string")).withColumn("batch", F.lit(name))
        held.upsert(ingest.embedded(made))
    return held.read().select("chunk_id", "tokens", "batch", F.size("embedding").alias("dimension"), F.md5("chunk_text").alias("chunk_md5"))


def exact_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", ids.content_sha(F.col("text")).alias("content_sha"))
    return docs.groupBy("content_sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def index_stats(spark, sf):
    chunks = ingest.chunk_words(table(spark, sf, "documents"))
    return chunks.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("doc_id").alias("docs"), F.sum("tokens").alias("tokens"))


def html_to_text(spark, sf):
    body = text.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(body).alias("chars"), F.md5(body).alias("text_md5"))


def file_suffix_dispatch(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[^:]+://[^/]+", "")
    name = F.element_at(F.split(path, "/"), -1)
    kind = text.suffix(name)
    return table(spark, sf, "pages").groupBy(kind.alias("suffix"), (kind == ".pdf").alias("is_pdf")).agg(F.count(F.lit(1)).alias("n"))


def payload_map_roundtrip(spark, sf):
    """Keys merged with metadata, metadata winning, reserved keys dropped again on reading."""
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("doc_id"), F.lit("shadow"))
    own = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("text"), F.col("text"))
    keep = F.map_filter(own, lambda k, v: ~F.map_contains_key(meta, k))
    payload = F.map_concat(keep, meta)
    rest = F.map_filter("payload", lambda k, v: ~k.isin("doc_id", "text", "chunk_id"))
    rows = table(spark, sf, "documents").select("doc_id", payload.alias("payload"))
    return rows.select("doc_id", F.col("payload")["doc_id"].alias("payload_doc_id"), rest["lang"].alias("lang"), rest["source"].alias("source"), F.size(rest).alias("n_rest"))


def repeated_line_cleaning(spark, sf):
    """Lines found in more than one document of a source are dropped; a document that loses all of them stays, with none."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    n = docs.where("line <> ''").select("source", "line", "doc_id").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    bad = n.where("n > 1").select("source", "line", F.lit(True).alias("bad"))
    line = F.when(F.col("bad").isNull(), F.col("line"))
    marked = docs.join(bad, ["source", "line"], "left").select("doc_id", line.alias("line"))
    return marked.groupBy("doc_id").agg(F.count("line").alias("lines"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))


def loaded_files(spark, sf):
    """Pages and documents written out as files of their kind, read back and turned into text by their suffix."""
    folder = f"{shared_dir(spark)}/lodestar/files-{uuid.uuid4().hex}"
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".HTML"))
    pages = table(spark, sf, "pages").select(name.alias("name"), F.encode("html", "UTF-8").alias("content"))
    # Two bytes at the end that are no UTF-8, which the loader drops.
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFC3")))
    docs = table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), broken.alias("content"))
    pages.unionByName(docs).write.parquet(folder)
    out = ingest.load_text(spark.read.parquet(folder))
    return out.select("name", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def chunk_topics(spark, sf):
    """Chunks of 400 to 800 words, cut between sentences where the topic changes most, each with the 80 words before it."""
    out = ingest.chunk_topics(table(spark, sf, "documents"))
    return out.select("doc_id", "chunk_no", "first_sentence", "tokens", "overlap", F.md5("chunk_text").alias("chunk_md5"))


def near_dup_pairs(spark, sf):
    """Pairs of documents whose sets of five-word shingles are alike to 0.8; of equal sets, the least document stands for all."""
    return dedupe.near_pairs(table(spark, sf, "documents").select("doc_id", text.words(F.col("text")).alias("w")), 5, 0.8)


QUERIES = {f.__name__: f for f in (
    word_tokenize_counts, chunk_fixed_window, chunk_no_redundant_tail, chunk_sentence_budget, chunk_counts_per_doc, doc_and_point_ids, chunk_upsert_latest,
    chunk_replace_by_doc, incremental_new_chunks, incremental_revised_chunks, exact_dedup, near_dup_pairs, index_stats, html_to_text, file_suffix_dispatch, payload_map_roundtrip, repeated_line_cleaning,
    collection_batches, loaded_files, chunk_topics,
)}

_SECOND = f"""second_docs AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_filter({sql.words('text')}, lambda x: length(x) >= 4), ' ') ELSE text END AS text FROM documents)"""


def _chunked(name: str, source: str, batch: str) -> str:
    return f"""{name}_s AS (SELECT doc_id, {sql.words('text')} AS w FROM {source}),
{name}_i AS (SELECT doc_id, w, unnest(range(0, len(w), 520)) AS i FROM {name}_s),
{name} AS (SELECT doc_id, doc_id || ':' || (i // 520) AS chunk_id, CAST(len(w[i + 1:i + 600]) AS INTEGER) AS tokens, sha256(array_to_string(w[i + 1:i + 600], ' ')) AS content_sha, '{batch}' AS batch FROM {name}_i)"""


_BOTH = f"WITH {_SECOND}, {_chunked('a', 'documents', 'first')}, {_chunked('b', 'second_docs', 'second')}"
_REVISED = f"""revised_w AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
revised AS (SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 1 THEN list_append(w, 'appended')
  WHEN 2 THEN list_concat(w[1:len(w) // 2], ['revised'], w[len(w) // 2 + 2:]) ELSE w END, ' ') AS text FROM revised_w)"""
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(text, '{text.EMAIL}', '[email]', 'g'), '{text.ADDRESS}', '[ip]', 'g'), '{text.PHONE}', '[phone]', 'g')"
_MARKUP = text.MARKUP.replace("'", "''")
_BODY = f"regexp_replace(html, '{_MARKUP}', ' ', 'g')"
for _entity, _plain in text.ENTITIES:
    _BODY = f"replace({_BODY}, '{_entity}', chr({ord(_plain)}))"
_BODY = rf"trim(regexp_replace({_BODY}, '[ \t\r\n]+', ' ', 'g'))"

ORACLES = {
    "word_tokenize_counts": f"SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, w[1] AS first_word, CAST(len(list_distinct(w)) AS INTEGER) AS distinct_tokens FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents)",
    "chunk_fixed_window": f"WITH {sql.chunks()} SELECT doc_id, chunk_no, tokens, md5(chunk_text) AS chunk_md5 FROM chunks",
    "chunk_no_redundant_tail": f"WITH {sql.chunks()} SELECT c.doc_id, chunk_no, tokens FROM chunks c JOIN split s USING (doc_id) WHERE chunk_no = 0 OR chunk_no * 520 + 80 < len(w)",
    "chunk_sentence_budget": f"""WITH s AS (SELECT doc_id, unnest({sql.sentences('text')}) AS sentence, generate_subscripts({sql.sentences('text')}, 1) AS pos FROM documents),
n AS (SELECT *, len({sql.words('sentence')}) AS n FROM s),
p AS (SELECT *, CAST((sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n) // 200 AS INTEGER) AS chunk_no FROM n WHERE n > 0)
SELECT doc_id, chunk_no, CAST(sum(n) AS INTEGER) AS tokens, md5(string_agg(sentence, ' ' ORDER BY pos)) AS chunk_md5 FROM p GROUP BY doc_id, chunk_no""",
    "chunk_counts_per_doc": f"WITH {sql.chunks()} SELECT d.doc_id, d.source, count(c.chunk_no) AS chunks FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY ALL",
    "doc_and_point_ids": f"""WITH {sql.chunks()}, k AS (SELECT c.chunk_no, substr(sha256(source || '/' || d.doc_id || '.md' || strlen(text)), 1, 16) AS doc_key FROM chunks c JOIN documents d USING (doc_id))
SELECT doc_key, chunk_no, doc_key || ':' || chunk_no AS chunk_id, CAST('0x' || substr(sha256(doc_key || ':' || chunk_no), 1, 15) AS BIGINT) AS point_id FROM k""",
    "chunk_upsert_latest": f"{_BOTH} SELECT chunk_id, tokens, batch FROM b UNION ALL SELECT chunk_id, tokens, batch FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM b)",
    "chunk_replace_by_doc": f"{_BOTH} SELECT chunk_id, tokens, batch FROM b UNION ALL SELECT chunk_id, tokens, batch FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)",
    "incremental_new_chunks": f"{_BOTH} SELECT chunk_id, content_sha FROM b WHERE content_sha NOT IN (SELECT content_sha FROM a)",
    "incremental_revised_chunks": f"WITH {_REVISED}, {_chunked('a', 'documents', 'first')}, {_chunked('b', 'revised', 'second')} SELECT chunk_id, content_sha FROM b WHERE content_sha NOT IN (SELECT content_sha FROM a)",
    "exact_dedup": "SELECT sha256(text) AS content_sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "near_dup_pairs": f"""WITH w AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
classes AS (SELECT min(doc_id) AS least, g FROM sets GROUP BY g),
s AS (SELECT least AS doc_id, unnest(g) AS g FROM classes),
n AS (SELECT least AS doc_id, len(g) AS n FROM classes),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS similarity FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.8
UNION ALL SELECT least, doc_id, 1.0::DOUBLE FROM sets JOIN classes USING (g) WHERE doc_id > least""",
    "index_stats": f"WITH {sql.chunks()} SELECT count(*) AS points, count(DISTINCT doc_id) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens FROM chunks",
    "html_to_text": f"SELECT page_id, CAST(length(b) AS INTEGER) AS chars, md5(b) AS text_md5 FROM (SELECT page_id, {_BODY} AS b FROM pages)",
    "file_suffix_dispatch": r"""WITH n AS (SELECT string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]+', ''), '/')[-1] AS name FROM pages),
s AS (SELECT CASE WHEN name LIKE '_%.%' THEN coalesce(lower(nullif(regexp_extract(name, '^.*[^.](\.[^.]+)$', 1), '')), '') ELSE '' END AS suffix FROM n)
SELECT suffix, suffix = '.pdf' AS is_pdf, count(*) AS n FROM s GROUP BY ALL""",
    "payload_map_roundtrip": "SELECT doc_id, 'shadow' AS payload_doc_id, lang, source, CAST(2 AS INTEGER) AS n_rest FROM documents",
    "repeated_line_cleaning": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
bad AS (SELECT source, line FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > 1),
kept AS (SELECT doc_id, count(*) AS lines, sum(length(line)) AS chars FROM l WHERE (source, line) NOT IN (SELECT (source, line) FROM bad) GROUP BY doc_id)
SELECT DISTINCT d.doc_id, coalesce(lines, 0) AS lines, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM documents d LEFT JOIN kept USING (doc_id)""",
    "collection_batches": f"""WITH clean AS (SELECT doc_id, text, {_CLEAN} AS redacted, array_to_string(list_distinct_in_order(string_split(text, chr(10))), chr(10)) AS once FROM documents),
last AS (SELECT doc_id, CASE WHEN once <> text THEN once WHEN redacted <> text THEN redacted ELSE text END AS text, CASE WHEN once <> text THEN 'lines' WHEN redacted <> text THEN 'redacted' ELSE 'all' END AS batch FROM clean), {sql.chunks(source='last')}
SELECT c.doc_id || ':' || chunk_no AS chunk_id, tokens, batch, 64::INTEGER AS dimension, md5(chunk_text) AS chunk_md5 FROM chunks c JOIN last USING (doc_id) WHERE len({sql.terms('chunk_text')}) > 0""".replace(
        "list_distinct_in_order(string_split(text, chr(10)))", "list_filter(string_split(text, chr(10)), lambda x, i: list_position(string_split(text, chr(10)), x) = i)"),
    "loaded_files": f"""SELECT 'p' || page_id || '.HTML' AS name, CAST(length(b) AS INTEGER) AS chars, md5(b) AS text_md5 FROM (SELECT page_id, {_BODY} AS b FROM pages)
UNION ALL SELECT 'd' || doc_id || '.md', CAST(length(text) AS INTEGER), md5(text) FROM documents WHERE text IS NOT NULL""",
}
