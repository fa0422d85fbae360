"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of WORDS words. Texts with equal sets are one node, held once, with its number of
copies. Each run starts from all nodes and splits them recursively: a node with n shingles goes to the bucket of
every shingle whose hash, salted with the path so far, is below 1 / (SIMILARITY n), so two nodes of that similarity
share one such bucket on average. Buckets of one node vanish; buckets of up to SMALL nodes are leaves; larger
ones split again, DEPTH levels at most, after which what is left is similar and is a leaf too. Enough runs
are made that the expected recall at the similarity bound reaches RECALL, whatever the level.

Paths are drawn from a sample of each node's shingles (hash below POOL / n, the same hash for all nodes, so samples
of similar sets are similar); sampled shingles of a node travel instead of the text. In a leaf, pairs whose
samples agree by less than ROUGH are dropped, and the rest is verified on full shingle sets. A pair at the bound agrees
in about 55 of its samples' hashes or more, so the drop costs less than 1e-6 of recall, on top of 1 - RECALL.

Large clusters of near copies do not cost the square of their size. Where a bucket exceeds a block, the shingles that
most of a few of its members hold are its centre, and every member is compared with the centre, exactly. Jaccard distance
is a metric: members within (1 - SIMILARITY) / 2 of one centre are all similar to each other. Such a ball is one
unit: its links are counted without pairs, buckets that hold nothing but one ball vanish like those of one node, and
a leaf that mixes it with other nodes compares those with the ball, not the ball with itself.

A cluster that is spread wider than a ball fills many large leaves, which overlap. Where that asks for fewer pairs, its nodes in
them are a hub: compared with each other once, in a leaf of the hub's own, while the other leaves take the hub as one unit.

Leaves of equal members are judged once (members are compared by 128 bits). A pair is verified only in the least leaf that
both share, so it counts once without any list of pairs. A leaf yields one row per node: links, and an edge to the least
node it is joined to within the leaf. Leaves larger than a block are cut into blocks, and pairs of blocks are
separate tasks, so no group is held whole.

Null, empty and wordless texts have no set: each is a class of its own without links. Texts of fewer than
WORDS words are one shingle. Null and repeated ids are allowed: rows are told apart by their sets. Very long texts are
sets like others, and travel whole only if a sample agrees. Links count rows, copies included; the class is the least id of
all rows joined, directly or through others. An empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import mix64, shingles, stage, table, word_hashes
from lodestar.llm.components import components

WORDS, SIMILARITY, RECALL, DEPTH, SMALL, POOL, BLOCK = 5, 0.8, 0.9999, 3, 128, 96, 512
#: Share of agreeing samples below which a pair is not verified: about six standard deviations under the bound.
ROUGH = 0.5
#: Members of a bucket from which its centre is made.
CENTRE = 32
#: Hashes of wanted rows that go to every task, so that only those rows' texts are shuffled; of more, all texts are.
SENT = 1 << 22


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the similarity bound has met in a leaf with the given chance."""
    met = 1.0
    for _ in range(depth):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a shingle set."""
    spread = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    a = np.bitwise_xor.reduce(mix64(tokens + np.uint64(1)))
    b = (mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)) * (2 * spread + np.uint64(1))).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def pool_of(tokens: np.ndarray, size: float = POOL) -> np.ndarray:
    """Shingles whose common hash is below size / n: the sample that paths are drawn from, in hash order."""
    h = np.sort(mix64(tokens + np.uint64(0x2545F4914F6CDD1D)))
    if len(h) <= size:
        return h
    return h[: np.searchsorted(h, np.uint64(int(size / len(h) * 2**64)))]


def chosen(pool: np.ndarray, expected: float, path: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each path so far, the longer paths by the sampled shingles it chooses: row of the path, new path."""
    if not len(pool):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix64(pool[None, :] ^ path[:, None])
    bound = np.uint64(min(2**64 - 1, int(2**64 / (similarity * expected))))
    at, to = np.nonzero(h < bound)
    return at, mix64(h[at, to] + np.uint64(1))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and whole text: equal only for repeated rows."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", name, F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, pool: float) -> DataFrame:
    """id, row_key, set_key, n, pool of every row; set_key null where there are no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingles(word_hashes(text), words) if isinstance(text, str) else ()
                rows.append((set_key(tokens), len(tokens), pool_of(tokens, pool).tobytes()) if len(tokens) else (None, 0, None))
            out = pd.DataFrame(rows, columns=["set_key", "n", "pool"])
            out.insert(0, "id", batch["id"])
            out.insert(1, "row_key", batch["row_key"])
            yield out

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, row_key string, set_key binary, n int, pool binary")


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def entries_of(rows: DataFrame, similarity: float, runs: int, pool: float) -> DataFrame:
    """(path, node) of the buckets that each node of (node, n, pool) enters, from ``path`` if there is one; with ``unit``, if there is one."""
    start = mix64(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    names = ["node", "unit"] if "unit" in rows.columns else ["node"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [np.array([p], np.int64).view(np.uint64) for p in batch["path"]] if "path" in batch else [start] * len(batch)
            got = [
                chosen(np.frombuffer(raw, np.uint64), min(n, pool), path, similarity)[1]
                for raw, n, path in zip(batch["pool"], batch["n"], paths)
            ]
            if got:
                times = [len(p) for p in got]
                yield pd.DataFrame({"path": as_long(np.concatenate(got)), **{c: np.repeat(batch[c].to_numpy(), times) for c in names}})

    return rows.mapInPandas(run, ", ".join(f"{c} long" for c in ["path", *names]))


def met(entries: DataFrame) -> DataFrame:
    """The entries whose bucket holds another node, with its number of members; one shuffle, no join."""
    return entries.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("path"))).where("members > 1")


def mixed(entries: DataFrame) -> DataFrame:
    """The entries (path, node, unit) whose bucket holds another unit, with its number of members and 128 bits that stand for them; one shuffle, no join."""
    of_path = Window.partitionBy("path")
    told = {
        "members": F.count(F.lit(1)), "low": F.min("unit"), "high": F.max("unit"),
        "a": F.bit_xor(F.xxhash64("node")), "b": F.bit_xor(F.xxhash64("node", F.lit(1))),
    }
    return entries.withColumns({c: x.over(of_path) for c, x in told.items()}).where("low <> high").drop("low", "high")


def only(texts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Of ``texts``, those whose key may be in ``wanted``, by its hash, before a join that tells for sure; all, if too many are wanted."""
    hashes = stage(wanted.select(F.xxhash64(key).alias("hash")).distinct(), "wanted")
    if hashes.count() > SENT:
        return texts
    return texts.withColumn("hash", F.xxhash64(key)).join(F.broadcast(hashes), "hash", "left_semi").drop("hash")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, columns: list[str]) -> DataFrame:
    """``columns`` of (row_key, ...), a row per key, with the shingles of its text as ``tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[columns].assign(tokens=[shingles(word_hashes(t), words).tobytes() for t in batch["text"]])

    texts = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    kinds = dict(wanted.dtypes)
    rows = only(texts, wanted, "row_key").join(wanted, "row_key").dropDuplicates(["row_key"]).select("text", *columns)
    return rows.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "tokens binary"]))


def centred_on(docs: DataFrame, nodes: DataFrame, hot: DataFrame, similarity: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, centre_key, ball) of the nodes of large buckets, ``hot`` (path, node, members): ball, its least node, of those so near their centre that all of one ball are similar."""
    # A node is compared with one centre only: that of the largest bucket it is in.
    chosen_path = hot.groupBy("node").agg(F.min(F.struct((-F.col("members")).alias("m"), "path")).alias("best"))
    mine = stage(chosen_path.select("node", F.col("best.path").alias("path")), "hot-nodes")
    wanted = mine.join(nodes.select("node", "row_key"), "node").select("node", "path", "row_key")
    sets = stage(full_sets(docs, wanted, id_col, text_col, words, ["node", "path"]), "hot-sets")
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("node"), "node"))
    few = sets.withColumn("place", place).where(F.col("place") <= CENTRE).select("path", "tokens")

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        value, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]]), return_counts=True)
        most = value[2 * times > len(pdf)]
        return pd.DataFrame({"path": pdf["path"].iloc[:1], "centre": [most.tobytes()], "centre_key": [set_key(most) if len(most) else b""]})

    centres = few.groupBy("path").applyInPandas(middle, "path long, centre binary, centre_key binary")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for raw, middle_raw in zip(batch["tokens"], batch["centre"]):
                a, c = np.frombuffer(raw, np.uint64), np.frombuffer(middle_raw, np.uint64)
                shared = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(shared >= (1 + similarity) / 2 * (len(a) + len(c) - shared) + 1e-9)
            yield batch[["node", "centre_key"]].assign(near=keep)

    told = stage(sets.join(stage(centres, "centres"), "path").mapInPandas(near, "node long, centre_key binary, near boolean"), "near-centres", done=[sets, mine])
    least = told.where("near").groupBy("centre_key").agg(F.min("node").alias("ball"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return stage(told.join(least, "centre_key", "left").select("node", "centre_key", F.when(F.col("near"), F.col("ball")).alias("ball")), "centred", done=[told])


def with_hubs(leaves: DataFrame, centred: DataFrame, block: int) -> DataFrame:
    """``leaves`` with the hubs among their nodes as units, and a leaf for each hub.

    A leaf larger than a block goes by the centre that most of its nodes have, a unit by that of most of its large leaves. The units of
    one centre are a hub if together they make fewer pairs than in all those leaves. Its leaf has a negative path, the others
    none, so it is the least that two of its nodes share.
    """
    leaves = leaves.withColumn("path", F.shiftrightunsigned("path", 1))
    n = F.count(F.lit(1)).alias("n")
    large = stage(leaves.where(F.col("members") > block).select("path", "node", "unit"), "large-leaves")
    if large.isEmpty():
        return leaves
    of_path = large.join(centred, "node").groupBy("path", "centre_key").agg(n).groupBy("path").agg(F.max_by("centre_key", F.struct("n", "centre_key")).alias("centre"))
    of_unit = large.join(of_path, "path").groupBy("unit", "centre").agg(n).groupBy("unit").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))
    of_unit = stage(of_unit, "unit-centres")
    apart = large.join(of_unit, "unit").groupBy("path", "centre").agg(n).groupBy("centre").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    # A ball comes whole, with its nodes that are in no large leaf.
    every = large.select("node", "unit").unionByName(centred.where("ball is not null").select("node", F.col("ball").alias("unit"))).distinct().join(of_unit, "unit")
    whole = every.groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub"))
    whole = whole.join(apart, "centre").where(F.col("members") * F.col("members") < F.col("apart")).select("centre", "hub", "members")
    hubs = stage(every.join(whole, "centre").select("node", "hub", "members", "unit"), "hubs", done=[large])
    units = leaves.join(hubs.select("node", "hub"), "node", "left").select("path", "node", F.coalesce("hub", "unit").alias("unit"), "members")
    own = hubs.select((-1 - F.col("hub")).alias("path"), "node", "unit", "members")
    of_path = Window.partitionBy("path")
    seen = units.withColumns({"low": F.min("unit").over(of_path), "high": F.max("unit").over(of_path)})
    return seen.where("low <> high").drop("low", "high").unionByName(own)


def leaves_of(nodes: DataFrame, first: DataFrame, balls: DataFrame, similarity: float, depth: int, small: int, pool: float) -> DataFrame:
    """(path, node, unit, members) of the leaves, from the entries of the first level; unit is the node's ball, or itself.

    Leaves of one unit are gone, and of leaves with equal members one is left.
    """
    alone = nodes.select("node", F.col("node").alias("unit"))
    units = alone.unionByName(balls.select("node", F.col("ball").alias("unit"))).groupBy("node").agg(F.min("unit").alias("unit"))
    units, ends = stage(units, "units"), []
    level, done = first.select("path", "node").join(units, "node").select("path", "node", "unit"), [first]
    for at in range(1, depth + 1):
        live = stage(mixed(level), "buckets", done=done)
        ends.append(live if at == depth else live.where(F.col("members") <= small))
        large = live.where(F.col("members") > small)
        if at == depth or large.isEmpty():
            break
        rows = large.select("path", "node", "unit").join(nodes.select("node", "n", "pool"), "node")
        level, done = entries_of(rows, similarity, 1, pool), []
    # Leaves of equal members get one path, so their rows fall together.
    leaf = F.xxhash64("members", "a", "b").alias("path")
    return functools.reduce(DataFrame.unionByName, ends).select(leaf, "node", "unit", "members").distinct()


def blocked(leaves: DataFrame, block: int) -> DataFrame:
    """Leaves cut into blocks; a row goes to each pair of blocks that holds its own: (path, i, j, side, node, unit).

    The blocks of a ball meet those of other balls and other nodes, not each other.
    """
    zero = F.lit(0).cast("long")
    whole = leaves.where(F.col("members") <= block).select("path", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node", "unit")
    cut = leaves.where(F.col("members") > block)
    in_unit = cut.groupBy("path", "unit").agg(F.count(F.lit(1)).alias("many"))
    cut = cut.join(in_unit, ["path", "unit"]).withColumn("kind", F.when(F.col("many") > 1, F.col("unit")).otherwise(F.lit(-1)))
    kinds = cut.groupBy("path", "kind").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    cell = lambda kind, number: F.xxhash64("path", kind, number)
    cells = kinds.select("path", F.col("kind").alias("other_kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"))
    cells = cells.select("path", "other_kind", cell("other_kind", "number").alias("other"))
    mine = cut.join(kinds, ["path", "kind"]).withColumn("side", cell("kind", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    pairs = mine.join(cells, "path").where((F.col("kind") == -1) | (F.col("kind") != F.col("other_kind")))
    return whole.unionByName(
        pairs.select("path", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "unit")
    )


def together(rows: DataFrame) -> DataFrame:
    """The rows of each (path, i, j) next to each other in one partition; none has more than two blocks of them."""
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")


def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int, int], dict[str, np.ndarray]]]:
    """Each (path, i, j) with its rows as arrays by column, from sorted batches; one batch and one group are held."""
    rest: pd.DataFrame | None = None
    names = ["path", "i", "j"]
    for batch in batches:
        if not len(batch):
            continue
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = batch[names].to_numpy(np.int64)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _groups_in(batch.iloc[:last], key, cuts[:-1])
        rest = batch.iloc[last:]
    if rest is not None:
        yield from _groups_in(rest, rest[names].to_numpy(np.int64), [])


def per_group(batches, judge, names: tuple[str, ...], rows: int = 5000) -> Iterator[pd.DataFrame]:
    """What ``judge`` returns for each group, as frames of about ``rows`` rows."""
    out, size = [], 0
    for (path, i, j), g in groups(batches):
        parts = [p for p in judge(path, i, j, g) if len(p[0])]
        out.extend(parts)
        size += sum(len(p[0]) for p in parts)
        if size >= rows:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))
            out, size = [], 0
    if out:
        yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))


def _groups_in(rows: pd.DataFrame, key: np.ndarray, cuts) -> Iterator:
    if len(rows):
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        for at, to in zip([0, *cuts], [*cuts, len(rows)]):
            if to - at > 1:
                yield tuple(map(int, key[at])), {c: v[at:to] for c, v in columns.items()}


def first_shared(a, b, path: int, units_a: np.ndarray, units_b: np.ndarray, same: bool) -> np.ndarray:
    """Pairs of different units that share no leaf before ``path``: those that are to be judged here."""
    here = units_a[:, None] != units_b[None, :]
    if same and len(a) == 2:
        return here & (np.intersect1d(a[0], a[1], assume_unique=True)[0] == path)
    if here.any():
        before = [x[: np.searchsorted(x, path)] for x in a]
        here &= overlap(before, before if same else [x[: np.searchsorted(x, path)] for x in b]) == 0
    return here


def overlap(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two lists of distinct-valued arrays, by slices of a 0/1 matrix."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    if a is b and len(a) == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(a[0], a[1], assume_unique=True))
        out[0, 0], out[1, 1] = len(a[0]), len(a[1])
        return out
    fa, fb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    if a is b:
        common, times = np.unique(fa, return_counts=True)
        common = common[times > 1]
    else:
        common = np.intersect1d(fa, fb)
    ca, cb = np.searchsorted(common, fa), np.searchsorted(common, fb)
    if not len(common):
        return out
    ka, kb = common[np.minimum(ca, len(common) - 1)] == fa, common[np.minimum(cb, len(common) - 1)] == fb
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for at in range(0, len(common), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ia, ib = (ca >= at) & (ca < at + width), (cb >= at) & (cb < at + width)
        x[ra[ia], ca[ia] - at] = 1
        y[rb[ib], cb[ib] - at] = 1
        out += x @ y.T
    if a is b:
        np.fill_diagonal(out, [len(x) for x in a])
    return out


def rough_similarity(a: list[np.ndarray], na: np.ndarray, b: list[np.ndarray], nb: np.ndarray, pool: float) -> np.ndarray:
    """Estimated Jaccard similarity of all pairs from samples, over hashes that both would have sampled."""
    limit = lambda n: np.minimum(pool / np.maximum(n, 1), 1 - 2.0**-11)
    low = np.minimum(limit(na)[:, None], limit(nb)[None, :])
    bound = (low * 2.0**64).astype(np.uint64)
    mine = np.stack([np.searchsorted(x, bound[k]) for k, x in enumerate(a)])
    theirs = np.stack([np.searchsorted(y, bound[:, k]) for k, y in enumerate(b)], axis=1)
    shared = overlap(a, b)
    return shared / np.maximum(1, mine + theirs - shared)


def similar_sets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    depth: int = DEPTH,
    small: int = SMALL,
    pool: float = POOL,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id, n_links, copy_id (least id with the same set), n_copies, row_key, class_key of every row."""
    rows = stage(sketch(docs, id_col, text_col, words, pool), "sets")
    grouped = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("rep"), F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("pool").alias("pool")
    )
    nodes = stage(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    first = stage(met(entries_of(nodes.select("node", "n", "pool"), similarity, runs_needed(recall, depth), pool)), "met")
    hot = first.where(F.col("members") > block)
    any_hot = not hot.isEmpty()
    if not any_hot:
        balls = nodes.select("node", F.col("node").alias("ball")).limit(0)
    else:
        centred = centred_on(docs, nodes, hot, similarity, words, id_col, text_col)
        balls = centred.where("ball is not null").select("node", "ball")
    leaves = stage(leaves_of(nodes, first, balls, similarity, depth, small, pool), "leaves")
    if any_hot:
        leaves = stage(with_hubs(leaves, centred, block), "leaves", done=[leaves])
    held = leaves.groupBy("node").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    known = stage(held.join(nodes.select("node", "n", "pool"), "node"), "leaf-nodes")

    def rough_one(path, i, j, g) -> list[tuple]:
        at, to = (g["side"] == i).nonzero()[0], (g["side"] == j).nonzero()[0]
        here = first_shared(g["paths"][at], g["paths"][to], path, g["unit"][at], g["unit"][to], i == j)
        if here.any():
            pools = [np.frombuffer(x, np.uint64) for x in g["pool"]]
            a = [pools[k] for k in at]
            b = a if i == j else [pools[k] for k in to]
            here &= rough_similarity(a, g["n"][at], b, g["n"][to], pool) >= ROUGH
        x, y = at[here.any(1)], to[here.any(0)]
        rows = np.union1d(x, y) if i == j else np.concatenate([x, y])
        return [(np.full(len(rows), path), np.full(len(rows), i), np.full(len(rows), j), g["side"][rows], g["node"][rows], g["unit"][rows])]

    def rough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from per_group(batches, rough_one, ("path", "i", "j", "side", "node", "unit"))

    keys = "path long, i long, j long, side long, node long, unit long"
    candidates = stage(together(blocked(leaves, block).join(known, "node")).mapInPandas(rough, keys), "candidates", done=[leaves])
    spots = ["path", "i", "j", "side", "unit"]
    places = candidates.groupBy("node").agg(F.collect_list(F.struct(*spots)).alias("at")).select("node", *[F.col(f"at.{c}").alias(c) for c in spots])
    wanted = places.join(known.select("node", "paths"), "node").join(nodes.select("node", "row_key", "copies"), "node")
    sets = full_sets(docs, wanted, id_col, text_col, words, ["node", "copies", "paths", *spots])
    alone = ["node", "copies", "paths", "tokens"]
    placed = sets.select(*alone, F.explode(F.arrays_zip(*spots)).alias("at")).select("at.*", *alone)

    def verify_one(path, i, j, g) -> list[tuple]:
        at, to = (g["side"] == i).nonzero()[0], (g["side"] == j).nonzero()[0]
        here = first_shared(g["paths"][at], g["paths"][to], path, g["unit"][at], g["unit"][to], i == j)
        if here.any():
            sets = [np.frombuffer(x, np.uint64) for x in g["tokens"]]
            a = [sets[k] for k in at]
            b = a if i == j else [sets[k] for k in to]
            shared = overlap(a, b).astype(np.float64)
            total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
            here &= shared >= similarity * total - 1e-9
        if not here.any():
            return []
        return linked(g["node"][at], g["copies"][at], g["node"][to], g["copies"][to], here, i == j)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from per_group(batches, verify_one, ("node", "links", "other"))

    in_ball = balls.join(nodes.select("node", "copies"), "node")
    ball_links = in_ball.join(in_ball.groupBy("ball").agg(F.sum("copies").alias("all")), "ball").select(
        "node", (F.col("all") - F.col("copies")).alias("links"), F.col("ball").alias("other")
    )
    verified = together(placed).mapInPandas(verify, "node long, links long, other long")
    verified = stage(verified.unionByName(ball_links), "links", done=[candidates, known])
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = roots.join(nodes.select("node", "rep"), "node")
    classes = joined.groupBy("root").agg(F.min("rep").alias("class_rep")).join(roots, "root").join(links, "node", "left")
    judged = nodes.select("node", "set_key", "rep", "copies").join(classes.select("node", "root", "class_rep", "links"), "node", "left")
    judged = stage(
        judged.select(
            F.col("set_key").alias("key"), F.coalesce("class_rep", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"),
            F.coalesce("root", "node").alias("class_key"),
        ),
        "classes", done=[nodes, verified, roots],
    )
    out = rows.select("id", "row_key", "set_key").join(judged, F.col("set_key") == F.col("key"), "left")
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copy_id", "id").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "row_key", "class_key",
    )


def linked(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, near: np.ndarray, same: bool) -> list[tuple]:
    """(nodes, copies each is linked to, least node joined to each here, directly or through others), a part per side."""
    lx, ly, far = x.copy(), y.copy(), np.iinfo(np.int64).max
    while True:
        nx = np.minimum(lx, np.where(near, ly[None, :], far).min(1))
        ny = nx if same else np.minimum(ly, np.where(near, nx[:, None], far).min(0))
        if (nx == lx).all() and (ny == ly).all():
            break
        lx, ly = nx, ny
    some = near.any(1)
    parts = [(x[some], (near @ cy)[some], lx[some])]
    if not same:
        some = near.any(0)
        parts.append((y[some], (cx @ near)[some], ly[some]))
    return parts


def near_dup_stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least (id, row key), with the columns of ``docs``; wordless rows all stay."""
    judged = similar_sets(docs, id_col, text_col)
    kept = judged.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("kept"))
    kept = stage(kept.select(F.col("kept.row_key").alias("kept_key")), "kept")
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("kept_key"), worded.alias("worded"))
    repeat = F.row_number().over(Window.partitionBy("kept_key").orderBy(F.lit(1)))
    ones = only(rows.where("worded"), kept, "kept_key").join(kept, "kept_key").withColumn("repeat", repeat).where("repeat = 1").select("row.*")
    return ones.unionByName(rows.where("not worded").select("row.*"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents")).drop("row_key", "class_key")
