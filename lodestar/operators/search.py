"""Dense, lexical and fused search of many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestar.session import staged

K1, B, RRF_K, CANDIDATES = 1.5, 0.75, 60, 50
ROWS, ASKED, BROADCAST, LANES, ROWS_COUNTED, ROWS_CODED = 4096, 256, 64 << 20, 64, 512, 2048
#: Of the pruned search: postings of a block, terms of a group of queries (or of all, to be sent to the tasks that count), share of a k-th score that terms left aside may hold together,
#: and what rounding to six places may add.
BLOCK, GROUP, ASIDE, SLACK = 1_000_000, 1_000_000, 0.25, 1e-5


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Rank by rounded score, then id; the window's limit is applied before and after the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col(item))
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(rows: pd.DataFrame, key: str, unit: bool) -> pd.DataFrame:
    """One row per length of vector: its ids in order and the matrix of their vectors, of unit length if asked."""
    size = rows["v"].map(len).to_numpy()
    out = []
    for d in np.unique(size[size > 0]):
        part = rows[size == d].sort_values(key, kind="stable")
        m = np.stack(part["v"]).astype(np.float64)
        if unit:
            norm = np.sqrt((m * m).sum(1, keepdims=True))
            m = m / np.where(norm > 0, norm, 1)
        out.append((int(d), part[key].to_list(), m.tobytes()))
    return pd.DataFrame(out, columns=["d", "ids", "m"])


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, min_score: float | None, own: bool) -> pd.DataFrame:
    """The k best of a block for each query; ``ids`` ascend, so a stable sort gives ties to the smaller."""
    s = np.round(q @ c.T, 6) + 0.0
    lost = np.zeros(s.shape, bool) if own else q_ids[:, None] == ids[None, :]
    if min_score is not None:
        lost |= s < min_score
    s[lost] = -np.inf
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(s, order, 1)
    at, to = np.nonzero(score > -np.inf)
    return pd.DataFrame({"query_id": q_ids[at], "item_id": ids[order[at, to]], "score": score[at, to]})


def dense(queries: DataFrame, corpus: DataFrame, k: int, min_score: float | None = None, own: bool = True, metric: str = "cosine") -> DataFrame:
    """(query_id, v) against (item_id, v), exact: cosine, or inner product by ``metric="dot"``.

    The packed queries go to every task if they take BROADCAST bytes at most, and the corpus stays where it is. Of a larger set
    both sides are dealt over a grid of lanes: a lane has a part of the corpus and meets every block of queries, so no key holds
    all rows, and the corpus moves once. A batch returns at most k rows per query; with
    ``own``, a query may find its own id. Null vectors take no part; only vectors of one length meet.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric is cosine or dot")
    unit, spark = metric == "cosine", queries.sparkSession
    q_type, i_type = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["item_id"]

    def pack(key: str, rows: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), rows):
                    yield _packed(batch.iloc[at : at + rows], key, unit)

        return run

    usable = lambda rows, key: rows.where(F.col("v").isNotNull()).select(key, F.col("v").cast("array<double>").alias("v"))
    asked = staged(usable(queries, "query_id").mapInPandas(pack("query_id", ASKED), f"d int, ids array<{q_type}>, m binary"), "queries")
    held = usable(corpus, "item_id").mapInPandas(pack("item_id", ROWS), f"d int, ids array<{i_type}>, m binary")
    schema = f"query_id {q_type}, item_id {i_type}, score double"
    matrix = lambda raw, d: np.frombuffer(raw).reshape(-1, d)
    if (asked.agg(F.sum(F.length("m"))).first()[0] or 0) <= BROADCAST:
        blocks = spark.sparkContext.broadcast([(r.d, np.array(r.ids), r.m) for r in asked.collect()])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    c, ids = matrix(row.m, row.d), np.array(row.ids)
                    for d, q_ids, raw in blocks.value:
                        if d == row.d:
                            yield _best(q_ids, matrix(raw, d), ids, c, k, min_score, own)

        return top_k(held.mapInPandas(score, schema), k)
    lanes = max(LANES, spark.sparkContext.defaultParallelism)
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    numbered = asked.select("d", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), every)
    dealt = held.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield _best(np.array(row.q_ids), matrix(row.q_m, row.d), np.array(row.ids), matrix(row.m, row.d), k, min_score, own)

    return top_k(dealt.join(numbered, ["d", "lane"]).mapInPandas(meet, schema), k)


def _counted(batches: Iterator[pa.RecordBatch], asked: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """(item_id, terms) -> (term, item_id, length, tf): a row for each distinct term of an item, of those asked if given, and one of the empty term."""
    only = None if asked is None else pa.array(asked, pa.string())
    for whole in batches:
        for at in range(0, len(whole), ROWS_COUNTED):
            batch = whole.slice(at, ROWS_COUNTED)
            lists = batch.column("terms")
            length = lists.value_lengths().to_numpy()
            words = lists.flatten().dictionary_encode()
            names = pa.concat_arrays([words.dictionary, pa.array([""], words.dictionary.type)])
            many = len(names)
            every = np.arange(len(batch))
            row, code = np.repeat(every, length), words.indices.to_numpy(zero_copy_only=False)
            if only is not None:
                mine = pc.is_in(words.dictionary, value_set=only).to_numpy(zero_copy_only=False)[code]
                row, code = row[mine], code[mine]
            here = np.concatenate([row * many + code, every * many + many - 1]).astype(np.int64)
            pairs, tf = np.unique(here, return_counts=True)
            row = pairs // many
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(pairs % many)), batch.column("item_id").take(pa.array(row)), pa.array(length[row].astype(np.int32)), pa.array(tf.astype(np.int64))],
                ["term", "item_id", "length", "tf"],
            )


def postings(queries: DataFrame, items: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(term, item_id, w) of every term that is asked and every item that has it; w is its BM25 weight there.

    An item's terms are counted in its row, so occurrences are not dealt out; what is left is cut to the terms asked, and staged,
    so texts are cut into terms once.
    """
    wanted = queries.select(F.explode(F.array_distinct("terms")).alias("term"))
    # No term is empty, so the empty one stands for the item itself: one pass gives postings, items and lengths.
    # Staged, the terms asked and their counts have a known size, so that Spark broadcasts them while they are few.
    wanted = staged(wanted.unionByName(queries.sparkSession.createDataFrame([("",)], "term string")).distinct(), "terms-asked")
    kind = dict(items.dtypes)["item_id"]
    listed = items.select("item_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    schema = f"term string, item_id {kind}, length int, tf long"
    if wanted.count() <= GROUP:
        few = queries.sparkSession.sparkContext.broadcast([r["term"] for r in wanted.collect()])
        tf = staged(listed.mapInArrow(lambda batches: _counted(batches, few.value), schema), "postings")
    else:
        tf = staged(listed.mapInArrow(_counted, schema).join(wanted, "term", "left_semi"), "postings")
    if not tf.where("term = ''").groupBy("item_id").count().where("count > 1").isEmpty():
        # Items of one id and length count as one.
        tf = staged(tf.groupBy("term", "item_id", "length").agg(F.sum("tf").alias("tf")), "postings")
    stats = tf.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("avg")).first()
    n, avg = float(stats["n"] or 0), float(stats["avg"] or 1.0)
    tf = tf.where("term <> ''")
    df = staged(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms-df")
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    size = F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.lit(avg)
    weight = idf * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.lit(k1) * size)
    return tf.join(df, "term").select("term", "item_id", weight.alias("w"))


def bm25(queries: DataFrame, items: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, terms) against (item_id, terms) -> query_id, item_id, score of all pairs that share a term."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    return asked.join(postings(queries, items, k1, b), "term").groupBy("query_id", "item_id").agg(F.sum("w").alias("score"))


def _coded(batches: Iterator[pa.RecordBatch], asked: list[str]) -> Iterator[pa.RecordBatch]:
    """(item_id, terms) -> (item_id, length, codes, tf): the places in ``asked`` of the terms asked that an item has, and how often it has them."""
    known = pa.array(asked, pa.string())
    for whole in batches:
        for at in range(0, len(whole), ROWS_CODED):
            batch = whole.slice(at, ROWS_CODED)
            lists = batch.column("terms")
            length = lists.value_lengths().to_numpy()
            words = lists.flatten().dictionary_encode()
            place = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            code = place[words.indices.to_numpy(zero_copy_only=False)]
            here = np.repeat(np.arange(len(batch)), length) * len(known) + code
            pairs, tf = np.unique(here[code >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(batch) + 1) * len(known)).astype(np.int32))
            listed = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(length.astype(np.int32)), *listed], ["item_id", "length", "codes", "tf"])


class BestOf:
    """The k best items of each query over blocks of items that come one after another.

    A block has its postings by term, in order of items, and the greatest weight of each term in it. A query whose greatest
    weights together stay below its k-th score so far has nothing in the block. Otherwise terms of least greatest weight are left
    aside while theirs together stay below ASIDE of that score; items are scored by the others, all postings of a query at once, and
    only those that the terms left aside could lift to the k-th score, of before or of this block, are scored in full.
    """

    def __init__(self, queries: list[tuple[object, np.ndarray]], k: int):
        self.queries, self.k = queries, k
        self.ids = [np.zeros(0, np.int64) for _ in queries]
        self.scores = [np.zeros(0) for _ in queries]
        self.floor = np.zeros(len(queries))
        self.terms = 1 + max((int(t.max()) for _, t in queries if len(t)), default=-1)
        self.n_items, self.full = 0, 0

    def add(self, item: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """A block: (item number, term number, weight) of each posting, in order of items; items are numbered in their order."""
        new = np.concatenate([[True], item[1:] != item[:-1]])
        names, order = item[new], np.argsort(term, kind="stable")
        at, term, w = (np.cumsum(new) - 1)[order], term[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        last = np.append(first[1:], len(term))
        where = np.full(max(self.terms, int(term[-1]) + 1), -1)
        where[term[first]] = np.arange(len(first))
        most = np.maximum.reduceat(w, first)
        for q, (_, terms) in enumerate(self.queries):
            mine = where[terms]
            mine = mine[mine >= 0]
            greatest = most[mine]
            if not len(mine) or greatest.sum() < self.floor[q] - SLACK:
                continue
            by = np.argsort(greatest, kind="stable")
            mine, upto = mine[by], np.cumsum(greatest[by])
            n = int(np.searchsorted(upto, ASIDE * self.floor[q]))
            spans = [slice(a, z) for a, z in zip(first[mine[n:]].tolist(), last[mine[n:]].tolist())]
            score = np.bincount(np.concatenate([at[x] for x in spans]), np.concatenate([w[x] for x in spans]), len(names))
            lift = upto[n - 1] if n else 0.0
            least = self.floor[q] - SLACK - lift
            found = np.flatnonzero(score >= least if least > 0 else score > 0)
            if len(found) > 2 * self.k:
                # The k-th of these sums is no more than the k-th score.
                sums = score[found]
                found = found[sums >= np.partition(sums, len(sums) - self.k)[len(sums) - self.k] - SLACK - lift]
            if not len(found):
                continue
            self.full += len(found)
            sums = score[found]
            for i in mine[:n]:
                held = at[first[i] : last[i]]
                to = np.minimum(np.searchsorted(held, found), len(held) - 1)
                sums += np.where(held[to] == found, w[first[i] + to], 0.0)
            self._keep(q, names[found], np.round(sums, 6))

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = scores[order[-1]]

    def rows(self) -> pd.DataFrame:
        """query_id, item (its number), score."""
        many = [len(x) for x in self.ids]
        names = np.array([q for q, _ in self.queries], dtype=object)
        return pd.DataFrame({"query_id": np.repeat(names, many), "item": np.concatenate([*self.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*self.scores, np.zeros(0)])})


def _blocks_of_items(batches: Iterator[pa.RecordBatch], used: np.ndarray, idf: np.ndarray, avg: float, k1: float, b: float) -> Iterator[tuple]:
    """(item_id, length, codes, tf) -> blocks of (ids, item, term, weight) with the terms that are ``used``."""
    waiting, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), ROWS_CODED):
            part = batch.slice(at, ROWS_CODED)
            lists = part.column("codes")
            row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            term, tf = (part.column(c).flatten().to_numpy() for c in ("codes", "tf"))
            mine = used[term]
            row, term, tf = row[mine], term[mine], tf[mine]
            length = (1.0 - b) + b * part.column("length").to_numpy() / avg
            waiting.append((part.column("item_id"), row, term, idf[term] * tf * (k1 + 1.0) / (tf + k1 * length[row])))
            size += len(row)
            if size >= BLOCK:
                yield from _block(waiting)
                waiting, size = [], 0
    yield from _block(waiting)


def _block(parts: list[tuple]) -> Iterator[tuple]:
    if sum(len(x[1]) for x in parts):
        before = np.cumsum([0, *(len(x[0]) for x in parts)])
        item = np.concatenate([x[1] + n for x, n in zip(parts, before)])
        yield pa.concat_arrays([x[0] for x in parts]), item, np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])


def _blocks_of_postings(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[tuple]:
    """(item_id, term, w) in order of items -> blocks of (ids, item, term, weight) with the terms that have a number."""
    waiting, size = [], 0

    def block(last: bool) -> Iterator[tuple]:
        """What waits, but for the last item, of which more may come unless it is the ``last`` block; that is left."""
        items, terms, w = pa.concat_arrays([x[0] for x in waiting]), *(np.concatenate([x[n] for x in waiting]) for n in (1, 2))
        coded = items.dictionary_encode(null_encoding="encode")
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.full(len(at), True) if last else at != at[-1]
        if whole.any():
            # An id that comes twice may have a term twice.
            pairs, here = np.unique(at[whole] * len(number) + terms[whole], return_inverse=True)
            yield coded.dictionary if last else coded.dictionary[:-1], pairs // len(number), pairs % len(number), np.bincount(here, w[whole])
        waiting[:] = [(items.filter(pa.array(~whole)), terms[~whole], w[~whole])]

    for batch in batches:
        term = batch.column("term").dictionary_encode()
        known = np.array([number.get(t, -1) for t in term.dictionary.to_pylist()], np.int64)
        code = known[term.indices.to_numpy(zero_copy_only=False)]
        mine = code >= 0
        waiting.append((batch.column("item_id").filter(pa.array(mine)), code[mine], batch.column("w").to_numpy(zero_copy_only=False)[mine]))
        size += len(waiting[-1][1])
        if size >= BLOCK:
            yield from block(False)
            size = len(waiting[0][1])
    if size:
        yield from block(True)


def _searched(blocks: Iterator[tuple], group: list[tuple[object, np.ndarray]], k: int, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The k best of all blocks for each query of the group."""
    best, names, many = BestOf(group, k), [pa.array([], types[1])], 0
    for ids, item, term, w in blocks:
        best.add(item + many, term, w)
        names.append(ids.cast(types[1]))
        many += len(ids)
    rows = best.rows()
    found = pa.chunked_array(names).take(pa.array(rows["item"].to_numpy())).combine_chunks()
    yield pa.RecordBatch.from_arrays([pa.array(list(rows["query_id"]), types[0]), found, pa.array(rows["score"].to_numpy())], ["query_id", "item_id", "score"])


def _items_coded(items: DataFrame, asked: list[str]) -> DataFrame | None:
    """A row for each item with the terms asked that it has, staged; None if an id comes twice, for then its rows count together."""
    kind, shared = dict(items.dtypes)["item_id"], items.sparkSession.sparkContext.broadcast(asked)
    listed = items.select("item_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    schema = f"item_id {kind}, length int, codes array<int>, tf array<int>"
    rows = staged(listed.mapInArrow(lambda batches: _coded(batches, shared.value), schema), "items-coded")
    return rows if rows.groupBy("item_id").count().where("count > 1").isEmpty() else None


def bm25_top(queries: DataFrame, items: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best items of each query, as top_k(bm25(...), k) gives them, without a row for each pair that shares a term.

    An item's terms stay in its row, as numbers, and rows meet all queries in blocks where they are; a task returns at most k rows for each of
    them. Only if an id comes twice, or more than GROUP terms are asked, are postings dealt by item. Queries
    come in groups of at most GROUP terms, which bounds what is broadcast and what a task holds; a pass over the items serves a group.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    q_type, i_type = dict(queries.dtypes)["query_id"], dict(items.dtypes)["item_id"]
    types = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(items.schema["item_id"].dataType)
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).where(F.size("terms") > 0)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    grouped = staged(asked.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(-(-total // GROUP) or 1))), "bm25-queries")
    many = [r["g"] for r in grouped.select("g").distinct().orderBy("g").collect()]
    wanted = grouped.select(F.explode("terms").alias("term")).distinct()
    every = [r["term"] for r in wanted.collect()] if total <= GROUP or wanted.count() <= GROUP else None
    rows = None if every is None else _items_coded(items, every)
    if rows is not None:
        number = {t: i for i, t in enumerate(every)}
        n, words = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
        avg, df = float((words or 0) / n if n else 1.0), np.zeros(len(every))
        counts = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[counts["code"].to_numpy()] = counts["df"].to_numpy()
        weights = spark.sparkContext.broadcast(np.log(1.0 + (n - df + 0.5) / (df + 0.5)))
        # In order of items within a partition, so that ties go to the lesser item.
        dealt = rows.sortWithinPartitions("item_id")
    else:
        # The same, and an item's postings lie together.
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = postings(queries, items, k1, b).repartition(parts, "item_id").sortWithinPartitions("item_id").select("item_id", "term", "w")
        if len(many) > 1:
            dealt = staged(dealt, "bm25-index")
    out = None
    for g in many or [0]:
        known = {} if rows is None else number
        group = [(r["query_id"], np.array([known.setdefault(t, len(known)) for t in r["terms"]], np.int64)) for r in grouped.where(F.col("g") == g).collect()]
        if rows is None:
            shared = spark.sparkContext.broadcast((group, known))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                group, number = shared.value
                yield from _searched(_blocks_of_postings(batches, number), group, k, types)
        else:
            used = np.zeros(len(every), bool)
            for _, terms in group:
                used[terms] = True
            shared = spark.sparkContext.broadcast((group, used))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                group, used = shared.value
                yield from _searched(_blocks_of_items(batches, used, weights.value, avg, k1, b), group, k, types)

        found = dealt.mapInArrow(search, f"query_id {q_type}, item_id {i_type}, score double")
        out = found if out is None else out.unionByName(found)
    # Staged, its size is known, so that Spark brings it to the items' texts, and it is found once however often it is read.
    return staged(top_k(out, k), "bm25-top")


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings (query_id, item_id, rank)."""
    every = rankings[0].select("query_id", "item_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "item_id", "rank"))
    return every.groupBy("query_id", "item_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))
