"""Common table expressions that the DuckDB oracles share."""

from __future__ import annotations


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])[ \n]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


def chunks(size: int = 600, overlap: int = 80, source: str = "documents") -> str:
    """split, chunks(doc_id, chunk_no, tokens, chunk_text)."""
    step = max(1, size - overlap)
    return f"""split AS (SELECT doc_id, {words('text')} AS w FROM {source}),
starts AS (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS i FROM split),
chunks AS (SELECT doc_id, CAST(i // {step} AS INTEGER) AS chunk_no, CAST(len(w[i + 1:i + {size}]) AS INTEGER) AS tokens,
                  array_to_string(w[i + 1:i + {size}], ' ') AS chunk_text FROM starts)"""


def items_of_chunks() -> str:
    return chunks() + f""",
items AS (SELECT doc_id || ':' || chunk_no AS item_id, doc_id, chunk_text, {terms('chunk_text')} AS terms FROM chunks)"""


ITEMS_OF_DOCUMENTS = f"items AS (SELECT doc_id AS item_id, text, {terms('text')} AS terms FROM documents)"
ASKED = f"asked AS (SELECT item_id AS query_id, text AS question, {terms('text')} AS terms FROM benchmark)"


def bm25(k: int, k1: float = 1.5, b: float = 0.75) -> str:
    """After ``items`` and ``asked``: lexical(query_id, item_id, score, rank)."""
    return f"""wanted AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM items),
tf AS (SELECT item_id, len AS dl, term, count(*) AS tf FROM (SELECT item_id, len(terms) AS len, unnest(terms) AS term FROM items) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighted AS (SELECT term, item_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {k1 + 1}::DOUBLE / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl)) AS w FROM tf JOIN df USING (term), stats),
scored AS (SELECT query_id, item_id, round(sum(w), 6) AS score FROM wanted JOIN weighted USING (term) GROUP BY ALL),
lexical AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= {k})"""


def embedding(name: str, source: str, key: str) -> str:
    """(key, terms) of ``source`` -> ``name``(key, v): the hashed bag of words."""
    return f"""{name}_sums AS (
  SELECT {key}, CAST('0x' || substr(d, 1, 4) AS INTEGER) % 64 AS bucket, sum(CASE WHEN substr(d, 5, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v
  FROM (SELECT {key}, sha256(term) AS d FROM (SELECT {key}, unnest(terms) AS term FROM {source})) GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(v * v)) AS length, map_from_entries(list((bucket, v))) AS m FROM {name}_sums GROUP BY {key}),
{name} AS (SELECT {key}, list_transform(range(0, 64), lambda i: coalesce(m[i], 0.0::DOUBLE) / length) AS v FROM {name}_norm WHERE length > 0)"""


def dense(queries: str, items: str, k: int) -> str:
    """dense(query_id, item_id, score, rank) from (query_id, v) and (item_id, v)."""
    return f"""pairs AS (SELECT q.query_id, c.item_id, round(list_dot_product(q.v, c.v), 6) + 0.0 AS score FROM {queries} q, {items} c),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= {k})"""
