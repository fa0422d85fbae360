"""Approximate nearest neighbours by learned partitions.

Fit, on a sample of distinct vectors in hash order: the sample's neighbour graph, a balanced partitioning of it (median splits, refined by
moving vectors to the part that holds most of their neighbours while parts stay within SLACK of equal size), and a
small classifier (one hidden layer, numpy) that predicts the part of a vector's neighbours. The number of probes is
the least that reaches TARGET recall on sample vectors left out of the fit. Parts grow with the table, one for PART
distinct vectors up to MOST_PARTS, and the sample with them, PER_PART for each and SAMPLE at least: 32,768 vectors at most.

Search: equal vectors are one candidate, which lists its k + 1 least ids, so a very common vector costs no more than
another. A candidate is indexed under its most probable part. A query vector goes to its most probable parts, the number
of probes and on until they hold k + 1 rows together, so no query is left short. Parts are cut into blocks of bounded
size; a block of candidates and one of queries of its part meet in one task, which yields at most k + 1 rows per query,
and a window keeps the best. A part of one block sends each of its vectors once. Scores are inner products in double precision,
summed in one fixed order, so equal vectors score equally and ties go to the smaller vec_id.

Vectors that are null, empty, all zero, or hold null or non-finite components, and vectors whose length differs
from the most common one, take no part, as rows or as queries; nor do rows with a null id. Repeated ids are
rows of their own: a query leaves out only its own row and has its own k, though rows that repeat id and vector may
stand for one another. With k candidates or fewer a query gets all of them; an empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import stage, table

SAMPLE, PER_PART, PART, MOST_PARTS, NEIGHBOURS, SLACK, HIDDEN, EPOCHS = 8192, 64, 2048, 512, 10, 1.05, 64, 40
TARGET, BLOCK, QUERY_BLOCK, EVERY, K = 0.95, 4096, 1024, 20, 20


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "id is not null and size(v) > 0"
    )
    fine = rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def knn(a: np.ndarray, b: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of b nearest to each row of a by inner product; ``own`` is each a's row in b, to leave out."""
    out = []
    for at in range(0, len(a), 1024):
        s = a[at : at + 1024] @ b.T
        if own is not None:
            s[np.arange(len(s)), own[at : at + 1024]] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 8) -> np.ndarray:
    """A part for each row: median splits along leading directions, then capped moves over the graph."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        new = part * 2
        for p in range(made):
            mine = np.flatnonzero(part == p)
            if len(mine) < 2:
                continue
            y = x[mine] - x[mine].mean(0)
            d = np.linalg.eigh(y.T @ y)[1][:, -1]
            new[mine[np.argsort(y @ d, kind="stable")[len(mine) // 2 :]]] += 1
        part, made = new, made * 2
    cap = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < cap:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier from vectors to parts: one hidden layer, trained by Adam on neighbours' parts."""

    def __init__(self, weights: tuple[np.ndarray, ...]):
        self.weights = weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    @staticmethod
    def train(x: np.ndarray, goal: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        w = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
            rng.normal(0, 1 / np.sqrt(hidden), (hidden, goal.shape[1])), np.zeros(goal.shape[1]),
        ]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                dz = (p / p.sum(1, keepdims=True) - goal[rows]) / len(rows)
                dh = (dz @ w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] -= 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return Router(tuple(w))


def fit(x: np.ndarray, parts: int, target: float = TARGET, k: int = K) -> tuple[Router, int]:
    """The router and its number of probes, from the sample."""
    cut = max(1, len(x) // 8)
    held, learn = x[:cut], x[cut:]
    if len(learn) < 4 * parts:
        zero = np.zeros
        return Router((zero((x.shape[1], 1)), zero(1), zero((1, 1)), zero(1))), 1
    near = knn(learn, learn, min(NEIGHBOURS, len(learn) - 1), np.arange(len(learn)))
    part = balanced_parts(learn, near, parts)
    goal = np.zeros((len(learn), parts))
    np.add.at(goal, (np.repeat(np.arange(len(learn)), near.shape[1]), part[near].ravel()), 1.0 / near.shape[1])
    goal = 0.5 * goal
    goal[np.arange(len(learn)), part] += 0.5
    router = Router.train(learn, goal)
    where = router.scores(learn).argmax(1)
    truth = where[knn(held, learn, min(k, len(learn)))]
    order = np.argsort(-router.scores(held), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    reached = np.take_along_axis(rank, truth, 1)
    for probes in range(1, parts + 1):
        if (reached < probes).mean() >= target:
            break
    return router, probes


def parts_for(n: int, per_part: int = PART) -> int:
    """A power of two: one part for ``per_part`` vectors, within limits."""
    return 1 << max(0, min(MOST_PARTS, n // per_part).bit_length() - 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def best_of(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """The k best candidates of each query in one block pair, exactly scored: query position, candidate position, score."""
    rough = q @ c.T
    kth = min(k, len(c)) - 1
    # What rounding may do to a sum of products, so that no tie is lost before the exact scores.
    slack = 1e-14 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    floor = -np.partition(-rough, kth, axis=1)[:, kth] - slack
    at, to = np.nonzero(rough >= floor[:, None])
    exact = np.concatenate([(q[at[i : i + 65536]] * c[to[i : i + 65536]]).sum(1) for i in range(0, len(at), 65536)] or [np.zeros(0)])
    order = np.lexsort((c_ids[to], -exact, at))
    at, to, exact = at[order], to[order], exact[order]
    top = np.arange(len(at)) - np.searchsorted(at, np.arange(len(q)))[at] < k
    return at[top], to[top], exact[top]


def probed(order: np.ndarray, held: np.ndarray, probes: int, need: int) -> list[np.ndarray]:
    """For each row of parts in order of probability, the first ``probes`` and on until they hold ``need`` rows."""
    reach = np.cumsum(held[order], axis=1)
    enough = np.maximum(probes, 1 + (reach < min(need, held.sum())).sum(1))
    return [row[:n].astype(np.int32) for row, n in zip(order, enough)]


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = EVERY,
    k: int = K,
    per_part: int = PART,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (ids divisible by ``every``)."""
    spark, need = vectors.sparkSession, k + 1

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                # Adding zero makes one of both zeros, so equal vectors have equal bytes.
                raw = [x.tobytes() for x in _matrix(batch["v"]) + 0.0]
                yield batch[["id", "row"]].assign(same=[hashlib.blake2b(x, digest_size=16).digest() for x in raw], v=raw)

    numbered = usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
    rows = stage(numbered.mapInPandas(packed, "id long, row long, same binary, v binary"), "vectors")
    names = stage(rows.select("same").distinct(), "vector-names")
    parts = parts_for(names.count(), per_part)
    # A vector of very many copies is one row of the sample, as it is one candidate.
    first = names.orderBy(F.xxhash64("same"), "same").limit(max(SAMPLE, PER_PART * parts))
    picked = rows.join(F.broadcast(first), "same").groupBy("same").agg(F.min("v").alias("v")).orderBy(F.xxhash64("same"), "same").select("v").toPandas()
    if picked.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, probes = fit(_unpacked(picked["v"]), parts, k=k)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(part=router.scores(_unpacked(batch["v"])).argmax(1).astype(np.int32))

    place = F.row_number().over(Window.partitionBy("same").orderBy("id", "row"))
    least = rows.withColumn("place", place).where(F.col("place") <= need).groupBy("same").agg(
        F.sort_array(F.collect_list(F.struct("id", "row"))).alias("m"), F.min("v").alias("v")
    )
    schema = "ids array<long>, rows array<long>, v binary, part int"
    held = stage(least.select("m.id", "m.row", "v").toDF("ids", "rows", "v").mapInPandas(indexed, schema), "candidates")
    # One row per part: MOST_PARTS at most.
    sizes = held.groupBy("part").agg(F.sum(F.size("ids")).alias("rows"), F.count(F.lit(1)).alias("n")).toPandas().set_index("part")
    held_rows = sizes["rows"].reindex(range(parts), fill_value=0).to_numpy(np.int64)
    blocks = sizes["n"].reindex(range(parts), fill_value=0).to_numpy(np.int64)
    blocks = np.maximum(1, -(-blocks // block))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                order = np.argsort(-router.scores(_unpacked(batch["v"])), axis=1, kind="stable")
                yield batch.assign(parts=probed(order, held_rows, probes, need))

    asks = rows.where(F.pmod("id", F.lit(every)) == 0)
    asked = asks.groupBy("same").agg(F.min("v").alias("v")).mapInPandas(routed, "same binary, v binary, parts array<int>")
    asked = stage(asked.select("same", "v", F.explode("parts").alias("part")), "queries")
    q_sizes = asked.groupBy("part").count().toPandas().set_index("part")["count"]
    q_blocks = np.maximum(1, -(-q_sizes.reindex(range(parts), fill_value=0).to_numpy(np.int64) // query_block))

    of = lambda numbers: F.get(F.array(*[F.lit(int(x)) for x in numbers]), F.col("part"))
    every_block = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers) - 1))
    spread = lambda what, numbers: F.pmod(F.xxhash64(what), of(numbers)).cast("int")
    c = held.select("part", spread("v", blocks).alias("block"), every_block(q_blocks).alias("q_block"), "ids", "rows", "v")
    q = asked.select("part", every_block(blocks).alias("block"), spread("same", q_blocks).alias("q_block"), "same", "v")

    def rerank(ask: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(has):
            return pd.DataFrame({"same": [], "vec_id": [], "vec_row": [], "score": []})
        ids, at_row = has["ids"].to_numpy(), has["rows"].to_numpy()
        at, to, score = best_of(_unpacked(ask["v"]), _unpacked(has["v"]), np.array([x[0] for x in ids]), need)
        many = np.array([len(ids[i]) for i in to])
        same = ask["same"].to_numpy()[np.repeat(at, many)]
        return pd.DataFrame({
            "same": same, "vec_id": np.concatenate([ids[i] for i in to]), "vec_row": np.concatenate([at_row[i] for i in to]),
            "score": np.repeat(score, many),
        })

    keys = ["part", "block", "q_block"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(rerank, "same binary, vec_id long, vec_row long, score double")
    best = F.row_number().over(Window.partitionBy("same").orderBy(F.desc("score"), "vec_id", "vec_row"))
    found = found.withColumn("place", best).where(F.col("place") <= need).drop("place")
    # A query whose own row is not among its vector's least loses nothing: those rows are others'.
    own = asks.select("same", F.col("id").alias("query_id"), F.col("row").alias("query_row"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return (
        own.join(found, "same").where("vec_row <> query_row").withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
