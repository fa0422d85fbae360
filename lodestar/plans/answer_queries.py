"""Rerank, compress, prompts, answers, refusals, comparison, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import answer, citations, ingest, search
from lodestar.plans import sql
from lodestar.plans.retrieval_queries import asked, chunks_as_items, lexical_hits
from lodestar.session import staged, table

#: Our own prompt table: a default and one more version.
PROMPTS = (("default", answer.DEFAULT_TEMPLATE), ("terse", "Q: {question}\nC: {context}\nA:"))
#: One variant per generator, one with an unknown prompt version, one with an unknown provider.
VARIANTS = [
    {"provider": "local"}, {"provider": "openai", "prompt_version": "terse"},
    {"provider": "anthropic", "model": "", "prompt_version": "missing"}, {"provider": "nowhere", "model": "m"},
]


def prompts(spark):
    return spark.createDataFrame(PROMPTS, "version string, template string")


def questions(spark, sf):
    none = F.lit(None).cast("string")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), none.alias("provider"), none.alias("model"), none.alias("prompt_version")
    )


def rerank_overlap(spark, sf):
    """The 50 best by BM25, reranked by term overlap, 8 kept."""
    items = chunks_as_items(spark, sf)
    best = search.bm25_top(asked(spark, sf), items, search.CANDIDATES)
    hits = best.join(items.select("item_id", F.col("terms").alias("item_terms")), "item_id").join(
        asked(spark, sf).select("query_id", F.col("terms").alias("query_terms")), "query_id"
    )
    out = answer.rerank(hits, score=answer.overlap(F.col("query_terms"), F.col("item_terms")))
    return out.select("query_id", F.col("new_rank").alias("rank"), "item_id", "rerank_score")


def compress_context(spark, sf):
    hits = lexical_hits(spark, sf).join(asked(spark, sf).select("query_id", F.col("terms").alias("query_terms")), "query_id")
    out = answer.compress(hits, budget=500)
    return out.select("query_id", "rank", "item_id", "tokens", F.md5("chunk_text").alias("text_md5"))


def context_block(spark, sf):
    return answer.contexts(lexical_hits(spark, sf)).select("query_id", "n_context", F.md5("context").alias("context_md5"))


def prompt_render(spark, sf):
    rows = questions(spark, sf).withColumn("prompt_version", F.when(F.col("query_id") % 3 == 0, "terse").when(F.col("query_id") % 3 == 1, "missing"))
    ready = answer.with_prompt(answer.bind_defaults(rows), prompts(spark))
    filled = text.fill_template(F.col("template"), F.concat("question", F.lit(" {context}")), F.lit("[c]"))
    return ready.select("query_id", "prompt_version", "is_fallback", filled.alias("prompt"))


def answer_sources(spark, sf):
    src = answer.contexts(lexical_hits(spark, sf)).select("query_id", F.posexplode("sources").alias("pos", "s"))
    return src.select("query_id", "pos", F.col("s.chunk_id").alias("chunk_id"), F.col("s.quote").alias("quote"))


def indexed(spark, sf) -> int:
    """Whether there is anything to search, which tells one refusal from the other; 0 if no document has a chunk."""
    return 0 if ingest.chunk_words(table(spark, sf, "documents")).isEmpty() else 1


def _answers(spark, sf):
    hits = lexical_hits(spark, sf).where("score >= 20")
    return answer.ask(questions(spark, sf), hits, prompts(spark), indexed(spark, sf))


def refusal_flags(spark, sf):
    """A floor on the score leaves some questions without context."""
    return _answers(spark, sf).select("query_id", "refusal", "confidence", "answer", F.col("sources")[0]["chunk_id"].alias("first_source"))


def ask_flagship(spark, sf):
    out = answer.ask(questions(spark, sf), lexical_hits(spark, sf), prompts(spark), indexed(spark, sf))
    return out.select(
        "query_id", "question", "provider", "model", "prompt_version", "n_context", F.md5("prompt").alias("prompt_md5"), "answer", "confidence", "refusal",
        F.to_json("sources").alias("sources"),
    )


def candidates(spark, sf):
    """The 50 best chunks of every question by BM25, with what reranking and compression need."""
    items = chunks_as_items(spark, sf)
    best = search.bm25_top(asked(spark, sf), items, search.CANDIDATES)
    texts = items.select("item_id", "chunk_text", F.col("terms").alias("item_terms"))
    return best.join(texts, "item_id").join(asked(spark, sf).select("query_id", F.col("terms").alias("query_terms")), "query_id")


def ask_reranked(spark, sf):
    """The whole path: 50 candidates, reranked, 8 kept, compressed to sentences that share a term, answered."""
    hits = answer.narrowed(candidates(spark, sf))
    many = hits.groupBy("query_id").agg(F.max("n_candidates").alias("n_candidates"))
    out = answer.ask(questions(spark, sf), hits, prompts(spark), indexed(spark, sf)).join(many, "query_id", "left")
    return out.select("query_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "n_context", F.md5("prompt").alias("prompt_md5"), "refusal", F.md5("answer").alias("answer_md5"))


def compare_variants(spark, sf):
    out = answer.compare(questions(spark, sf).select("query_id", "question"), VARIANTS, lexical_hits(spark, sf), prompts(spark), indexed(spark, sf))
    return out.select("query_id", "variant", "provider", "model", "prompt_version", "is_fallback", "refusal", "confidence", F.md5("answer").alias("answer_md5"))


def provider_default_binding(spark, sf):
    rows = questions(spark, sf).withColumn("provider", F.when(F.col("query_id") % 4 == 0, "openai").when(F.col("query_id") % 4 == 1, "").when(F.col("query_id") % 4 == 2, "other"))
    return answer.bind_defaults(rows.withColumn("model", F.when(F.col("query_id") % 5 == 0, "own"))).select("query_id", "provider", "model", "prompt_version")


def _compared(spark, sf):
    """Every question under every variant, answered; with the ids and texts of the chunks in its context."""
    hits = lexical_hits(spark, sf)
    return hits, answer.compare(questions(spark, sf).select("query_id", "question"), VARIANTS, hits, prompts(spark), indexed(spark, sf))


def citation_check(spark, sf):
    """Chunk ids that the generated answers name, against the chunks of their contexts; answers that name none become refusals."""
    hits, answered = _compared(spark, sf)
    known = hits.groupBy("query_id").agg(F.collect_set("item_id").alias("known"))
    rows = answer.refuse_uncited(answered.withColumn("said", F.col("answer"))).join(known, "query_id", "left")
    named = answer.cited(F.col("said"))
    return rows.select(
        "query_id", "variant", F.size(named).alias("cited"), F.size(F.array_except(named, F.coalesce("known", F.array().cast("array<string>")))).alias("unsupported"), "refusal", F.md5("answer").alias("answer_md5")
    )


def citation_spans(spark, sf):
    """Sentences of the generated answers by their position in the documents of the chunks they name: in such a chunk, in another, in none."""
    _, answered = _compared(spark, sf)
    said = answered.select("query_id", "variant", F.posexplode(text.sentences(F.regexp_replace("answer", citations.MARK, "\n"))).alias("claim", "sentence"), answer.cited(F.col("answer")).alias("ids"))
    claims = said.withColumn("sentence", F.array_join(text.words(F.col("sentence")), " ")).where("sentence <> ''")
    claims = staged(claims.withColumn("claim_id", F.concat_ws(":", "query_id", "variant", "claim")), "claims")
    cited = claims.select("claim_id", "sentence", F.explode("ids").alias("chunk_id"))
    cited = cited.withColumn("doc_id", F.split("chunk_id", ":")[0].cast("long")).withColumn("chunk_no", F.split("chunk_id", ":")[1].cast("int"))
    judged = citations.checked(cited, table(spark, sf, "documents"), ingest.CHUNK_WORDS, ingest.OVERLAP_WORDS)
    many = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return claims.join(judged, "claim_id", "left").groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("claims"), *[many(c) for c in ("located", "supported", "elsewhere")])


def validated_answers(spark, sf):
    """Structured output: props must parse as {"k": int} within 0..80; what fails goes to the repair set."""
    parsed = F.from_json("props", "k INT")["k"]
    ok = F.coalesce(parsed.between(0, 80), F.lit(False))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("repair"), F.sum(F.when(ok, parsed)).alias("sum_k"))


def sweep_grid(spark, sf):
    """Chunk size by top k: how many questions find a chunk of a document that holds their text."""
    out = None
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # The first of eight is the first of one, so each size is searched once.
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    for size, overlap in ((600, 80), (300, 40)):
        hits = lexical_hits(spark, sf, 8, size, overlap).join(bench, "query_id").join(docs, "doc_id")
        found = staged(hits.select("query_id", "rank", F.contains("text", "passage").alias("hit")), "sweep-hits")
        for k in (1, 8):
            row = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.max(F.col("hit").cast("int")).alias("hit")).agg(F.sum("hit").alias("found"))
            row = row.select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(k).alias("top_k"), "found")
            out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (
    rerank_overlap, compress_context, context_block, prompt_render, answer_sources, refusal_flags, ask_flagship, ask_reranked, compare_variants, provider_default_binding,
    citation_check, citation_spans, validated_answers, sweep_grid,
)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CITED = r"\[([0-9A-Za-z_.-]+:[0-9]+)\]"
_PROMPTS = "prompts AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(v)}, {_q(t)})" for v, t in PROMPTS) + ") AS t(version, template))"
_TOP = f"WITH {sql.items_of_chunks()}, {sql.ASKED}, {sql.bm25(8)}, hits AS (SELECT l.*, chunk_text FROM lexical l JOIN items USING (item_id))"
_TOP50 = f"WITH {sql.items_of_chunks()}, {sql.ASKED}, {sql.bm25(50)}"
_CTX = """ctx AS (SELECT query_id, count(*) AS n_context, string_agg('[' || item_id || ']' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY rank) AS context,
  list({'chunk_id': item_id, 'quote': chunk_text[1:280]} ORDER BY rank)[1:5] AS sources, list(item_id ORDER BY rank) AS ids FROM hits GROUP BY query_id)"""
_SHARE = "len(list_intersect(list_distinct({q}), {i})) / greatest(len(list_distinct({q})), 1)::DOUBLE"
_SAY = "substr(split_part(trim(split_part(prompt, 'Context:' || chr(10), 2), ' ' || chr(10)), chr(10) || chr(10), 1), 1, 280)"
_DEFAULT = _q(answer.DEFAULT_TEMPLATE)
_SOURCES_JSON = "'[' || array_to_string(list_transform(sources, lambda s: '{\"chunk_id\":\"' || s.chunk_id || '\",\"quote\":' || CAST(to_json(s.quote) AS VARCHAR) || '}'), ',') || ']'"
_PROMPT = f"replace(replace({_DEFAULT}, '{{question}}', question), '{{context}}', coalesce(context, ''))"


_VARIED = f"""{_TOP}, {_CTX}, v AS (SELECT * FROM (VALUES (0, 'local', 'local-model', 'default', {_q(PROMPTS[0][1])}, false), (1, 'openai', 'openai-model', 'terse', {_q(PROMPTS[1][1])}, false),
  (2, 'anthropic', 'hosted-model', 'missing', {_q(PROMPTS[0][1])}, true), (3, 'nowhere', 'm', 'default', {_q(PROMPTS[0][1])}, false)) AS t(variant, provider, model, prompt_version, template, is_fallback)),
p AS (SELECT query_id, question, context, v.*, replace(replace(template, '{{question}}', question), '{{context}}', context) AS prompt FROM asked JOIN ctx USING (query_id), v),
s AS (SELECT *, substr(split_part(trim(CASE WHEN contains(prompt, 'Context:' || chr(10)) THEN split_part(prompt, 'Context:' || chr(10), 2) ELSE prompt END, ' ' || chr(10)), chr(10) || chr(10), 1), 1, 280) AS said FROM p)"""
#: (query_id, question, variant, context, answer) of every question under every variant.
ANSWERED = f"{_VARIED} SELECT query_id, question, variant, context, CASE WHEN variant = 3 THEN 'unknown provider: nowhere' ELSE said END AS answer FROM s"


def _sweep() -> str:
    parts = []
    for size, overlap in ((600, 80), (300, 40)):
        items = sql.chunks(size, overlap) + f", items AS (SELECT doc_id || ':' || chunk_no AS item_id, doc_id, {sql.terms('chunk_text')} AS terms FROM chunks)"
        for k in (1, 8):
            parts.append(f"""SELECT {size} AS size, {overlap} AS overlap, {k} AS top_k, CAST(sum(hit) AS BIGINT) AS found FROM (
WITH {items}, {sql.ASKED}, {sql.bm25(8)}
SELECT query_id, max(CAST(contains(d.text, a.question) AS INTEGER)) AS hit FROM lexical l JOIN items i USING (item_id) JOIN documents d ON d.doc_id = i.doc_id JOIN asked a USING (query_id) WHERE rank <= {k} GROUP BY query_id)""")
    return "\nUNION ALL\n".join(parts)


ORACLES = {
    "rerank_overlap": f"""{_TOP50}, s AS (SELECT query_id, rank, item_id, round({_SHARE.format(q='a.terms', i='i.terms')}, 6) AS rerank_score FROM lexical l JOIN items i USING (item_id) JOIN asked a USING (query_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS rank, item_id, rerank_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, s.rank) <= 8""",
    "compress_context": f"""{_TOP}, s AS (SELECT query_id, rank, item_id, a.terms AS q, unnest({sql.sentences('chunk_text')}) AS sentence, generate_subscripts({sql.sentences('chunk_text')}, 1) AS pos FROM hits JOIN asked a USING (query_id)),
t AS (SELECT *, len({sql.words('sentence')}) AS n FROM s WHERE {_SHARE.format(q='q', i=sql.terms('sentence'))} > 0),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank, item_id, pos) AS upto FROM t)
SELECT query_id, rank, item_id, CAST(sum(n) AS INTEGER) AS tokens, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text_md5 FROM u WHERE upto <= 500 GROUP BY query_id, rank, item_id""",
    "context_block": f"{_TOP}, {_CTX} SELECT query_id, CAST(n_context AS INTEGER) AS n_context, md5(context) AS context_md5 FROM ctx",
    "prompt_render": f"""WITH {_PROMPTS}, a AS (SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN 'terse' WHEN 1 THEN 'missing' ELSE 'default' END AS prompt_version FROM benchmark)
SELECT query_id, prompt_version, template IS NULL AS is_fallback, replace(replace(coalesce(template, {_DEFAULT}), '{{question}}', text || ' {{context}}'), '{{context}}', '[c]') AS prompt FROM a LEFT JOIN prompts ON version = prompt_version""",
    "answer_sources": f"{_TOP} SELECT query_id, CAST(rank - 1 AS INTEGER) AS pos, item_id AS chunk_id, chunk_text[1:280] AS quote FROM hits WHERE rank <= 5",
    "refusal_flags": f"""{_TOP.replace('SELECT l.*, chunk_text FROM lexical l JOIN items USING (item_id)', 'SELECT l.*, chunk_text FROM lexical l JOIN items USING (item_id) WHERE score >= 20')}, {_CTX},
p AS (SELECT query_id, coalesce(n_context, 0) AS n, sources, {_PROMPT} AS prompt FROM asked LEFT JOIN ctx USING (query_id))
SELECT query_id, n = 0 AS refusal, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence, CASE WHEN n = 0 THEN {_q(answer.NOTHING_RELEVANT)} ELSE {_SAY} END AS answer,
       CASE WHEN n = 0 THEN 'none' ELSE sources[1].chunk_id END AS first_source FROM p""",
    "ask_flagship": f"""{_TOP}, {_CTX}, p AS (SELECT query_id, question, coalesce(n_context, 0) AS n, sources, {_PROMPT} AS prompt FROM asked LEFT JOIN ctx USING (query_id))
SELECT query_id, question, 'local' AS provider, 'local-model' AS model, 'default' AS prompt_version, CAST(n AS INTEGER) AS n_context, md5(prompt) AS prompt_md5, {_SAY} AS answer, 0.85::DOUBLE AS confidence, false AS refusal, {_SOURCES_JSON} AS sources FROM p""",
    "ask_reranked": f"""{_TOP50}, s AS (SELECT query_id, rank AS old, item_id, chunk_text, a.terms AS q, round({_SHARE.format(q='a.terms', i='i.terms')}, 6) AS score FROM lexical l JOIN items i USING (item_id) JOIN asked a USING (query_id)),
many AS (SELECT query_id, count(*) AS n_candidates FROM s GROUP BY query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM s QUALIFY rank <= 8),
t AS (SELECT *, len({sql.words('sentence')}) AS n FROM (SELECT query_id, rank, item_id, q, unnest({sql.sentences('chunk_text')}) AS sentence, generate_subscripts({sql.sentences('chunk_text')}, 1) AS pos FROM r) WHERE {_SHARE.format(q='q', i=sql.terms('sentence'))} > 0),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank, item_id, pos) AS upto FROM t),
hits AS (SELECT query_id, rank, item_id, string_agg(sentence, ' ' ORDER BY pos) AS chunk_text FROM u WHERE upto <= 2000 GROUP BY ALL), {_CTX},
p AS (SELECT query_id, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_context, 0) AS n, {_PROMPT} AS prompt FROM asked LEFT JOIN ctx USING (query_id) LEFT JOIN many USING (query_id))
SELECT query_id, CASE WHEN n = 0 THEN 0 ELSE n_candidates END AS n_candidates, CAST(n AS INTEGER) AS n_context, md5(prompt) AS prompt_md5, n = 0 AS refusal, md5(CASE WHEN n = 0 THEN {_q(answer.NOTHING_RELEVANT)} ELSE {_SAY} END) AS answer_md5 FROM p""",
    "compare_variants": f"{_VARIED}\nSELECT query_id, variant, provider, model, prompt_version, is_fallback, variant = 3 AS refusal, CASE WHEN variant = 3 THEN 0.0::DOUBLE ELSE 0.85::DOUBLE END AS confidence, md5(CASE WHEN variant = 3 THEN 'unknown provider: nowhere' ELSE said END) AS answer_md5 FROM s",
    "provider_default_binding": """WITH a AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'openai' WHEN 2 THEN 'other' ELSE 'local' END AS provider FROM benchmark)
SELECT query_id, provider, CASE WHEN query_id % 5 = 0 THEN 'own' WHEN provider = 'local' THEN 'local-model' WHEN provider = 'openai' THEN 'openai-model' ELSE 'hosted-model' END AS model, 'default' AS prompt_version FROM a""",
    "citation_check": f"""{_VARIED}, a AS (SELECT query_id, variant, CASE WHEN variant = 3 THEN 'unknown provider: nowhere' ELSE said END AS answer FROM s),
n AS (SELECT *, list_distinct(regexp_extract_all(answer, '{_CITED}', 1)) AS named FROM a)
SELECT query_id, CAST(variant AS INTEGER) AS variant, CAST(len(named) AS INTEGER) AS cited, CAST(len(list_filter(named, lambda x: NOT list_contains(ids, x))) AS INTEGER) AS unsupported,
  variant = 3 OR len(named) = 0 AS refusal, md5(CASE WHEN variant <> 3 AND len(named) = 0 THEN {_q(answer.NOTHING_RELEVANT)} ELSE answer END) AS answer_md5 FROM n JOIN ctx USING (query_id)""",
    "citation_spans": f"""{_VARIED}, a AS (SELECT query_id, variant, CASE WHEN variant = 3 THEN 'unknown provider: nowhere' ELSE said END AS answer FROM s),
c AS (SELECT query_id, variant, list_distinct(regexp_extract_all(answer, '{_CITED}', 1)) AS ids, unnest({sql.sentences(f"regexp_replace(answer, '{_CITED}', chr(10), 'g')")}) AS sentence,
  generate_subscripts({sql.sentences(f"regexp_replace(answer, '{_CITED}', chr(10), 'g')")}, 1) AS claim FROM a),
claims AS (SELECT query_id, variant, claim, ids, array_to_string({sql.words('sentence')}, ' ') AS sentence FROM c WHERE len({sql.words('sentence')}) > 0),
named AS (SELECT *, unnest(ids) AS chunk_id FROM claims),
bodies AS (SELECT doc_id, array_to_string(w, ' ') AS body FROM split),
spots AS (SELECT n.*, b.doc_id, position(sentence IN body) AS spot, CAST(split_part(chunk_id, ':', 2) AS INTEGER) AS chunk_no FROM named n JOIN bodies b ON b.doc_id = CAST(split_part(chunk_id, ':', 1) AS BIGINT)),
ranges AS (SELECT doc_id, CAST(i // 520 AS INTEGER) AS chunk_no, CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1:i], ' ')) + 1 END AS low, length(array_to_string(w[1:i + 600], ' ')) AS high FROM starts),
found AS (SELECT query_id, variant, claim, count(*) AS n FROM spots WHERE spot > 0 GROUP BY ALL),
own AS (SELECT query_id, variant, claim, bool_or(s.chunk_no = r.chunk_no) AS own FROM spots s JOIN ranges r ON r.doc_id = s.doc_id AND spot - 1 >= low AND spot - 1 + length(sentence) <= high WHERE spot > 0 GROUP BY ALL)
SELECT query_id, CAST(variant AS INTEGER) AS variant, count(*) AS claims, count(n) AS located, count(*) FILTER (WHERE own) AS supported, count(*) FILTER (WHERE NOT own) AS elsewhere
FROM claims LEFT JOIN found USING (query_id, variant, claim) LEFT JOIN own USING (query_id, variant, claim) GROUP BY ALL""",
    "validated_answers": "WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) FILTER (WHERE k BETWEEN 0 AND 80) AS valid, count(*) FILTER (WHERE NOT coalesce(k BETWEEN 0 AND 80, false)) AS repair, CAST(sum(k) FILTER (WHERE k BETWEEN 0 AND 80) AS BIGINT) AS sum_k FROM k GROUP BY event_type",
    "sweep_grid": _sweep(),
}
