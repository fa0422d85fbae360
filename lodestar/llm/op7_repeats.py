"""Removal of repeated byte strings: every byte under a LENGTH-byte string that starts anywhere else too.

Blockwise suffix sorting: suffixes are dealt into buckets, one bucket is sorted at a time, and long ties are resolved by
ranks of a difference-cover sample. Only suffixes that can be repeated are dealt at all, and an order to LENGTH bytes
is enough, so suffixes are windows of LENGTH bytes.

1. Texts are told apart by digest, 128 bits wide, in every table and join. A text that occurs twice is removed whole; one
   copy stands for all.
2. The least hashed GRAM-byte gram of a window marks it: equal windows have equal marks, so the mark names a window's
   bucket. A mark found once can mark no repeated window; that rules out most of the corpus.
3. Stretches of windows with one recurring mark travel to its bucket as text, about two bytes a window. A bucket is closed:
   whatever a comparison of two of its windows reads lies in their stretches. So the ranks are made per bucket too.
   The cover sample, the positions whose remainder by v is in a difference cover of v, is ranked by doubling: each step joins
   the rank of a position with that of the one as far behind it as the rank reaches. The windows are then sorted by their first
   v bytes. Any two that tie have a sampled position at a common distance below v, so their order is that of
   two ranks, then of the last bytes that no rank reaches; ties are split by ternary partitioning around pivots. Equal
   neighbours in that order come back as intervals.
4. Marks of more than HOT stretches, or windows enough for so many, would make a bucket too large to sort in one task. Their
   windows are dealt one by one, by 128-bit fingerprints, deduplicated within a task; there, and only there, an equal
   fingerprint is taken for equal bytes. Which marks are hot reaches the texts by a join, not through the driver.

Memory is bounded by HOT and CHUNK, whatever the corpus. Strings are judged on the input. Matches never cross texts. A null
text is an empty one; texts under LENGTH bytes are left alone; very long texts are cut like others. Null and repeated ids are allowed. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import fingerprints, prefix_sums, stage, table
from lodestar.llm.op1_jaccard import row_key

LENGTH, GRAM, HOT = 200, 72, 2000
#: Fingerprints that a task packs together, and that a bucket holds on average; windows sorted together.
PACK, BUCKET, CHUNK = 400_000, 500_000, 1 << 18
#: Difference covers. Any two remainders by the key have a common distance to two elements.
COVERS = {21: (0, 1, 4, 14, 16), 7: (0, 1, 3), 3: (0, 1)}


def window_marks(sums: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Least gram hash within each window of ``length`` bytes."""
    low, width, need = fingerprints(sums, gram), 1, length - gram + 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = need - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def order_of(x: np.ndarray) -> np.ndarray:
    """Stable order of the rows of (n, width)."""
    return np.argsort(x[:, 0], kind="stable") if x.shape[1] == 1 else np.lexsort(x.T[::-1])


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted (n, width) begin."""
    return np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)])) if len(x) else np.zeros(0, np.int64)


def distinct_and_again(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of (n, width), and those that occur twice or more."""
    x = x[order_of(x)]
    at = starts_of(x)
    return x[at], x[at[np.diff(np.append(at, len(x))) > 1]]


_KNOWN = np.uint32(0xFFFFFFFF)


def pack(owners: list[bytes], values: list[np.ndarray], again: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """One row per bucket with all (value, owner) of a group of texts; owners are 16 bytes.

    A value that several of them have goes once, without an owner, and its owners get a row that says it recurs; such
    rows have no index and only pass through a bucket.
    """
    flat = np.concatenate([*values, *again])
    own = np.repeat(np.arange(len(owners), dtype=np.uint32), [len(v) for v in values])
    own = np.concatenate([own, np.full(len(flat) - len(own), _KNOWN)])
    order = order_of(flat)
    flat, own = flat[order], own[order]
    first = starts_of(flat)
    count = np.diff(np.append(first, len(flat)))
    many = np.repeat(count > 1, count)
    rows = []
    keys = np.frombuffer(b"".join(owners), np.int64).reshape(-1, 2)
    real = many & (own != _KNOWN)
    if real.any():
        rows.extend((int.from_bytes(k[:7]) % buckets, k, v, b"", b"", b"") for k, v in by_owner(keys[own[real]], flat[real]))
    send = np.concatenate([flat[first[count == 1]], flat[first[count > 1]]])
    who = np.concatenate([own[first[count == 1]], np.full((count > 1).sum(), _KNOWN)])
    times = np.concatenate([count[count == 1], count[count > 1]]).astype(np.uint32)
    bucket = (send[:, 0] >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    send, who, bucket, times = send[order], who[order], bucket[order], times[order]
    for part in np.split(np.arange(len(send)), np.flatnonzero(np.diff(bucket)) + 1):
        if len(part):
            named = who[part] != _KNOWN
            used, local = np.unique(who[part][named], return_inverse=True)
            index = np.full(len(part), _KNOWN)
            index[named] = local.astype(np.uint32)
            rows.append((int(bucket[part[0]]), b"", send[part].tobytes(), index.tobytes(), keys[used].tobytes(), times[part].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "owner", "values", "index", "owners", "times"])


def by_owner(keys: np.ndarray, values: np.ndarray) -> list[tuple[bytes, bytes]]:
    order = order_of(keys)
    keys, values = keys[order], values[order]
    cut = starts_of(keys)[1:]
    return [(k[0].tobytes(), v.tobytes()) for k, v in zip(np.split(keys, cut), np.split(values, cut)) if len(k)]


def recurring(rows: DataFrame, values_of, buckets: int, hot: int, width: int = 1) -> DataFrame:
    """(owner, values, hot): of the values in each owner's text, those that occur again there or in another's.

    ``values_of(row)`` gives the distinct values, sorted, and those of them that the text itself has twice, each as
    often as it counts beyond once; a value is ``width`` numbers.
    ``rows`` has ``owner`` (the text's digest, 16 bytes), ``text`` and what else values_of needs; a text that comes twice counts
    once. Rows with hot true have no owner and list values of more than ``hot`` occurrences.
    """
    schema = "bucket long, owner binary, values binary, index binary, owners binary, times binary"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, owners, values, again, size = set(), [], [], [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = bytes(row.owner)
                if key in met:
                    continue
                one, two = values_of(row)
                if not len(one):
                    continue
                met.add(key)
                owners.append(key)
                values.append(one)
                again.append(two)
                size += len(one)
                if size >= PACK:
                    yield pack(owners, values, again, buckets)
                    met, owners, values, again, size = set(), [], [], [], 0
        if owners:
            yield pack(owners, values, again, buckets)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        settled = pdf["index"].str.len() == 0
        out = [(o, v, False) for o, v in zip(pdf["owner"][settled], pdf["values"][settled])]
        pdf = pdf[~settled]
        if len(pdf):
            value = np.frombuffer(b"".join(pdf["values"]), np.uint64).reshape(-1, width)
            times = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["times"]])
            owner, known = [], []
            for raw, own in zip(pdf["index"], pdf["owners"]):
                at, keys = np.frombuffer(raw, np.uint32), np.frombuffer(own, np.int64).reshape(-1, 2)
                flag = at == _KNOWN
                known.append(flag)
                owner.append(np.concatenate([keys, np.zeros((1, 2), np.int64)])[np.where(flag, len(keys), at)])
            owner, known = np.concatenate(owner), np.concatenate(known)
            order = order_of(value)
            value, owner, known = value[order], owner[order], known[order]
            first = starts_of(value)
            count = np.diff(np.append(first, len(value)))
            differ = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)).any(1)
            keep = np.repeat((differ | np.logical_or.reduceat(known, first)) & (count > 1), count) & ~known
            if keep.any():
                out.extend((o, v, False) for o, v in by_owner(owner[keep], value[keep]))
            often = value[first][np.add.reduceat(times[order].astype(np.int64), first) > hot]
            if len(often):
                out.append((b"", often.tobytes(), True))
        return pd.DataFrame(out, columns=["owner", "values", "hot"])

    dealt = rows.mapInPandas(deal, schema)
    return dealt.groupBy("bucket").applyInPandas(find, "owner binary, values binary, hot boolean")


def hot_by_owner(found: DataFrame) -> DataFrame:
    """(owner, hot_marks) of the owners that have values listed as hot; each value is one long."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch["values"]]
            if parts:
                yield pd.DataFrame({"owner": np.repeat(batch["owner"].to_numpy(), [len(p) for p in parts]), "mark": np.concatenate(parts)})

    listed = lambda rows: rows.select("owner", "values").mapInPandas(unpack, "owner binary, mark long")
    pairs = listed(found.where("not hot")).join(listed(found.where("hot")).select("mark"), "mark")
    return pairs.groupBy("owner").agg(F.collect_list("mark").alias("hot_marks"))


def listed_by_owner(found: DataFrame) -> DataFrame:
    return found.where("not hot").groupBy("owner").agg(F.collect_list("values").alias("values"))


def stretches(marks: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 position of each run of wanted windows with one mark."""
    edge = np.concatenate([[True], (marks[1:] != marks[:-1]) | (wanted[1:] != wanted[:-1])])
    at = np.flatnonzero(edge)
    to = np.append(at[1:], len(marks))
    return at[wanted[at]], to[wanted[at]]


def text_marks(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks of a text, and those it has twice, as often as their stretches or windows count beyond one."""
    sums = prefix_sums(data)
    m, grams = window_marks(sums, length, gram), np.sort(fingerprints(sums, gram))
    mine, at, windows = np.unique(m, return_inverse=True, return_counts=True)
    times = np.searchsorted(grams, mine, "right") - np.searchsorted(grams, mine)
    runs = np.bincount(at[np.concatenate([[True], m[1:] != m[:-1]])], minlength=len(mine))
    # A gram that occurs once marks length - gram + 1 windows at most.
    worth = np.maximum(runs, -(-windows // (length - gram + 1)))
    return mine[:, None], np.repeat(mine, np.maximum(times > 1, worth - 1))[:, None]


def ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by their keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.cumsum(new)
    return rank


class CoverRanks:
    """Ranks of the difference-cover sample of a bucket's bytes, to ``reach`` bytes, and the order of two windows of 5 bytes or more."""

    def __init__(self, raw: np.ndarray, length: int):
        self.v = next(v for v in COVERS if 3 * v <= length or v == 3)
        cover, v = COVERS[self.v], self.v
        self.bytes = np.concatenate([raw, np.zeros(2 * length + 8, np.uint8)])
        self.words = np.ndarray(len(self.bytes) - 7, ">u8", self.bytes, strides=(1,))
        inside = np.isin(np.arange(v), cover)
        #: Distance, below v, at which suffixes of two given remainders are both in the sample.
        self.shift = np.array([[next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v]) for b in range(v)] for a in range(v)])
        at = np.flatnonzero(inside[np.arange(len(raw)) % v])
        self.rank = np.zeros(len(raw) + 2 * length, np.uint64)
        self.rank[at] = ranked(self.pieces(at, v))
        self.reach = v
        while v - 1 + 2 * self.reach <= length:
            self.rank[at] = ranked([self.rank[at] << np.uint64(32) | self.rank[at + self.reach]])
            self.reach *= 2
        self.length = length

    def pieces(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """The n bytes from each position as numbers whose order is that of the bytes."""
        if n < 8:
            return [self.words[at].astype(np.uint64) >> np.uint64(64 - 8 * n)]
        return [self.words[at + k].astype(np.uint64) for k in (*range(0, n - 8, 8), n - 8)]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for windows from a and b that agree in their first v bytes."""
        d = self.shift[a % self.v, b % self.v]
        sign = np.sign(self.rank[a + d].astype(np.int64) - self.rank[b + d].astype(np.int64)).astype(np.int8)
        # The ranks reach to d + reach, d being 0 at least; what follows is compared as bytes.
        open_ = np.flatnonzero(sign == 0)
        rest = self.length - self.reach
        for x, y in zip(*(self.pieces(p[open_] + self.reach, rest) for p in (a, b))):
            new = (x > y).astype(np.int8) - (x < y)
            sign[open_] = np.where(sign[open_] == 0, new, sign[open_])
        return sign


def sorted_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows from ``at`` by group and bytes, and for each but the last whether it equals the next."""
    ranks = CoverRanks(raw, length)
    keys = [group, *ranks.pieces(at, ranks.v)]
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    tie = np.ones(len(order) - 1, bool)
    for k in keys:
        sorted_k = k[order]
        tie &= sorted_k[1:] == sorted_k[:-1]
    # Segments of ties, as places in the order; each round splits them around the element in their middle.
    beside = np.concatenate([[False], tie]) | np.concatenate([tie, [False]])
    place = np.flatnonzero(beside)
    head = np.concatenate([[True], ~tie])[place]
    while len(place):
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(place)))
        segment = np.repeat(np.arange(len(begin)), size)
        pivot = order[place[begin + size // 2]]
        sign = ranks.compare(at[order[place]], at[pivot[segment]])
        moved = np.argsort(segment * 3 + sign + 1, kind="stable")
        order[place], sign = order[place][moved], sign[moved]
        part = segment * 3 + sign
        again = part[1:] == part[:-1]
        same[place[:-1][again & (sign[1:] == 0)]] = True
        # Parts that are not the pivot's and have two members or more go on.
        left = sign != 0
        left &= np.concatenate([[False], again]) | np.concatenate([again, [False]])
        head = np.concatenate([[True], ~again])[left]
        place = place[left]
    return order, same[:-1]


def equal_windows(mark: np.ndarray, spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, within the spans of one mark each, sorted by it, that have an equal: row, offset in its span, number."""
    size = np.array([len(x) for x in spans])
    begin = np.cumsum(size) - size
    n = size - length + 1
    row = np.repeat(np.arange(len(spans)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    raw, at = np.frombuffer(b"".join(spans), np.uint8), begin[row] + offset
    group = np.cumsum(np.concatenate([[0], mark[1:] != mark[:-1]]))
    order, same = sorted_windows(raw, at, group[row], length)
    found = np.zeros(len(row), bool)
    found[order[1:]] = same
    found[order[:-1]] |= same
    new = found & ~np.concatenate([[False], found[:-1] & (row[1:] == row[:-1])])
    at = np.flatnonzero(new)
    count = np.add.reduceat(found, at) if len(at) else np.zeros(0, np.int64)
    return row[at], offset[at], count


def members(x: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """Which rows of (n, width) are among the packed values."""
    known = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, x.shape[1])
    if not len(known):
        return np.zeros(len(x), bool)
    known = known[order_of(known)]
    at = np.searchsorted(known[:, 0], x[:, 0])
    found, open_ = np.zeros(len(x), bool), np.arange(len(x))
    while len(open_):
        # Values that share their first number lie next to each other.
        open_ = open_[at[open_] < len(known)]
        open_ = open_[known[at[open_], 0] == x[open_, 0]]
        hit = (known[at[open_]] == x[open_]).all(1)
        found[open_[hit]] = True
        open_ = open_[~hit]
        at[open_] += 1
    return found


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, if asked) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    base = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.unhex(F.md5(raw)).alias("owner"),
            F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"),
        ),
        "texts",
    )
    bytes_in = base.agg(F.sum("n_bytes")).first()[0] or 0
    reps = base.where(F.col("n_bytes") >= length).groupBy("owner").agg(
        F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies")
    )
    source = docs.select(row_key(id_col, text_col).alias("row_key"), text.alias("text")).where(F.octet_length("text") >= length)

    def marks(row) -> tuple[np.ndarray, np.ndarray]:
        return text_marks(utf8(row.text), length, gram)

    n_marks = bytes_in * 2 // (length - gram + 2)
    marked = stage(
        recurring(
            docs.select(F.unhex(F.md5(raw)).alias("owner"), text.alias("text")).where(F.octet_length("text") >= length),
            marks, max(8, n_marks // BUCKET), hot,
        ),
        "marks",
    )
    listed = listed_by_owner(marked).withColumnRenamed("values", "marks")
    any_hot = not marked.where("hot").isEmpty()
    if any_hot:
        listed = listed.join(hot_by_owner(marked), "owner", "left")
    else:
        listed = listed.withColumn("hot_marks", F.lit(None).cast("array<long>"))
    listed = reps.join(listed, "owner").select("row_key", "owner", "marks", "hot_marks")
    held = stage(source.join(listed, "row_key").select("owner", "text", "marks", "hot_marks"), "marked-texts", done=[marked])

    def hot_ones(m: np.ndarray, hot_marks) -> np.ndarray:
        return np.zeros(len(m), bool) if hot_marks is None else members(m, [np.asarray(hot_marks, np.int64).tobytes()])

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for owner, body, parts, hot_marks in zip(batch["owner"], batch["text"], batch["marks"], batch["hot_marks"]):
                data = utf8(body)
                m = window_marks(prefix_sums(data), length, gram)
                wanted = members(m[:, None], parts) & ~hot_ones(m[:, None], hot_marks)
                for at, to in zip(*stretches(m, wanted)):
                    rows.append((int(m[at].view(np.int64)), owner, int(at), data[at : to + length - 1].tobytes()))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["mark", "owner", "start", "span"])
                    rows = []
            yield pd.DataFrame(rows, columns=["mark", "owner", "start", "span"])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["mark"].iloc[-1]
            cut_at = int((batch["mark"] != last).sum())
            if cut_at or (waiting and waiting[-1]["mark"].iloc[-1] != last):
                yield from intervals(pd.concat([*waiting, batch.iloc[:cut_at]], ignore_index=True))
                waiting = []
            waiting.append(batch.iloc[cut_at:])
        if waiting:
            yield from intervals(pd.concat(waiting, ignore_index=True))

    def intervals(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole marks at a time, of about CHUNK windows together."""
        n = rows["span"].str.len().to_numpy(np.int64) - length + 1
        mark = rows["mark"].to_numpy()
        chunk = (np.cumsum(n) - n) // CHUNK
        # A mark goes with its first row.
        first = np.concatenate([[True], mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, bool)
        chunk = chunk[first][np.cumsum(first) - 1] if len(mark) else chunk
        for _, part in rows.groupby(chunk, sort=True):
            row, offset, count = equal_windows(part["mark"].to_numpy(), part["span"].tolist(), length)
            yield pd.DataFrame({"owner": part["owner"].to_numpy()[row], "start": part["start"].to_numpy()[row] + offset, "n": count})

    dealt = held.select("owner", "text", "marks", "hot_marks").mapInPandas(spans, "mark long, owner binary, start long, span binary")
    found = dealt.repartition("mark").sortWithinPartitions("mark").mapInPandas(match, "owner binary, start long, n long")
    result = found.groupBy("owner").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    result = result.withColumn("values", F.lit(None).cast("array<binary>"))

    def prints(data: np.ndarray) -> np.ndarray:
        """128 bits for each window."""
        return np.stack([fingerprints(prefix_sums(data, other), length) for other in (False, True)], 1)

    if any_hot:

        def windows(row) -> tuple[np.ndarray, np.ndarray]:
            data = utf8(row.text)
            at = hot_ones(window_marks(prefix_sums(data), length, gram)[:, None], row.hot_marks)
            return distinct_and_again(prints(data)[at])

        hot_texts = held.where("hot_marks is not null").select("owner", "text", "hot_marks")
        n_windows = hot_texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ones = listed_by_owner(recurring(hot_texts, windows, max(8, n_windows // BUCKET), 1 << 62, width=2))
        result = result.drop("values").join(ones, "owner", "full")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body, starts, ns, parts in zip(batch["text"], batch["starts"], batch["ns"], batch["values"]):
                data = utf8(body)
                depth = np.zeros(len(data) + 1, np.int64)
                if starts is not None:
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, starts + ns + (length - 1), -1)
                if parts is not None:
                    at = np.flatnonzero(members(prints(data), parts))
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans_gone = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = data[~gone].tobytes()
                rows.append((int(gone.sum()), spans_gone, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            out = pd.DataFrame(rows, columns=["removed", "spans", "kept_digest", "kept"])
            out.insert(0, "cut", batch["owner"])
            yield out

    result = stage(
        held.join(result, "owner").select("owner", "text", "starts", "ns", "values")
        .mapInPandas(cut, "cut binary, removed long, spans long, kept_digest string, kept binary"),
        "cut-texts",
    )
    twice = reps.where("copies > 1").select(F.col("owner").alias("twice"))
    out = base.join(twice, F.col("owner") == F.col("twice"), "left").join(
        result.dropDuplicates(["cut"]), F.col("owner") == F.col("cut"), "left"
    )
    pick = lambda all_of_it, part, none: F.when(F.col("twice").isNotNull(), all_of_it).otherwise(F.coalesce(part, none))
    kept = [] if not with_text else [pick(F.encode(F.lit(""), "UTF-8"), F.col("kept"), F.lit(None).cast("binary")).alias("kept")]
    return out.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.encode(F.lit(""), "UTF-8"), 256), F.col("kept_digest"), F.col("whole")).alias("kept_sha256"),
        *kept,
    )


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
