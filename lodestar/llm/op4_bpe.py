"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece keeps the leftmost pair of least rank at its root. A merge
writes the new token at its left position, retires the right one, and updates two live neighbours in
logarithmic time. Short pieces, which are nearly all, go through one tree per row of a matrix so that numpy
performs each step for thousands of distinct pieces at once; a long piece has a tree of its own.

Nulls count as empty texts: no tokens, and the digests of the empty string. Any vocabulary of rank lines
(base64 token, rank) works; its path is a parameter, and no special tokens are added. Very long texts are encoded whole.
Repeated rows give repeated results, an empty table none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces up to so many bytes share a matrix; distinct pieces remembered per Python worker.
MATRIX_BYTES, REMEMBERED = 64, 600_000
_NONE = np.int64(1) << np.int64(60)


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """ranks by token bytes, tokens by rank, and the sorted table of (left, right) pairs that merge."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = {rank: token for token, rank in ranks.items()}
    pairs = sorted(
        ((ranks[t[:k]] << 32) | ranks[t[k:]], rank)
        for t, rank in ranks.items()
        for k in range(1, len(t))
        if t[:k] in ranks and t[k:] in ranks
    )
    keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return ranks, tokens, keys, values, single, dict(pairs)


def _ranks_of(left, right, keys, values):
    """Merge rank of each pair, or _NONE."""
    wanted = (left << np.int64(32)) | right
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), values[at], _NONE)


def encode_long(piece: bytes, path: str) -> list[int]:
    """One piece, one tree: leaves hold rank * size + position, so the minimum is the leftmost least rank."""
    _, _, _, _, single, pair = vocabulary(path)
    n = len(piece)
    token = [int(single[b]) for b in piece]
    size = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62

    def key(i, j):
        rank = pair.get((token[i] << 32) | token[j]) if j < n else None
        return none if rank is None else rank * size + i

    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = key(i, i + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i, value):
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        token[i], after[i] = rank, after[j]
        put(j, none)
        if after[i] < n:
            before[after[i]] = i
        put(i, key(i, after[i]))
        if before[i] >= 0:
            put(before[i], key(before[i], i))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def encode_matrix(pieces: list[bytes], path: str) -> list[list[int]]:
    """Pieces of at most MATRIX_BYTES: the same trees, one per row, stepped together."""
    _, _, keys, values, single, _ = vocabulary(path)
    lengths = np.array([len(p) for p in pieces])
    width = 1 << max(1, int(lengths.max() - 1).bit_length())
    rows = np.arange(len(pieces))
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    token = single[raw]
    token[np.arange(width) >= lengths[:, None]] = -1
    after = np.tile(np.arange(1, width + 1), (len(pieces), 1))
    before = np.tile(np.arange(-1, width - 1), (len(pieces), 1))
    none = np.int64(1) << np.int64(62)
    tree = np.full((len(pieces), 2 * width), none, np.int64)
    rank = _ranks_of(token[:, :-1], token[:, 1:], keys, values)
    tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + np.arange(width - 1), none)
    half = width
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2

    def put(r, i, value):
        i = i + width
        tree[r, i] = value
        while i[0] > 1:
            i = i >> 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    def key(r, i, j):
        inside = j < width
        rank = _ranks_of(token[r, i], np.where(inside, token[r, np.minimum(j, width - 1)], -1), keys, values)
        return np.where(rank < _NONE, rank * width + i, none)

    live = rows[tree[:, 1] < none]
    while len(live):
        rank, i = np.divmod(tree[live, 1], width)
        j = after[live, i]
        beyond = after[live, j]
        token[live, i] = rank
        token[live, j] = -2
        after[live, i] = beyond
        inside = beyond < width
        before[live[inside], beyond[inside]] = i[inside]
        put(live, j, np.full(len(live), none))
        put(live, i, key(live, i, beyond))
        left = before[live, i]
        has = left >= 0
        if has.any():
            put(live[has], left[has], key(live[has], left[has], i[has]))
        live = live[tree[live, 1] < none]
    kept = token >= 0
    flat, counts = token[kept].tolist(), kept.sum(1)
    ends = np.cumsum(counts).tolist()
    return [flat[e - c : e] for e, c in zip(ends, counts.tolist())]


def encode_pieces(pieces: list[bytes], path: str) -> list[list[int]]:
    """Token ids of each piece, pieces merged separately."""
    ranks = vocabulary(path)[0]
    out: list = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[k] = [whole]
        elif len(piece) > MATRIX_BYTES:
            out[k] = encode_long(piece, path)
        else:
            groups.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(k)
    for members in groups.values():
        for at in range(0, len(members), 8192):
            part = members[at : at + 8192]
            for k, ids in zip(part, encode_matrix([pieces[k] for k in part], path)):
                out[k] = ids
    return out


#: Letters, numbers and white space of Latin-1, so that such texts can be split by the standard library.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """Splits a text into the matches of the pattern; Latin-1 texts take an equal, faster one."""
    import regex

    whole = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return whole.findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole.findall(text)
        return _LATIN.findall(text)

    return split


#: Characters whose distinct pieces are encoded together, so that the matrix steps are wide.
TOGETHER = 1 << 20


def encode(texts: list[str], path: str, pattern: str, known: dict) -> Iterator[tuple[int, str, bytes]]:
    """For each text: token count, its ids in decimal joined by a space, and the bytes its ids decode to.

    ``known`` maps a piece to (" id id ...", decoded bytes); it is emptied when full, so memory is bounded.
    """
    split, tokens = splitter(pattern), vocabulary(path)[1]
    group: list[list[str]] = []
    size = 0
    for k, text in enumerate(texts):
        group.append(split(text))
        size += len(text)
        if size < TOGETHER and k + 1 < len(texts):
            continue
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in set().union(*group) if p not in known]
        for piece, ids in zip(new, encode_pieces([p.encode() for p in new], path)):
            known[piece] = (" " + " ".join(map(str, ids)), b"".join(map(tokens.__getitem__, ids)))
        for pieces in group:
            got = [known[p] for p in pieces]
            joined = "".join([g[0] for g in got])
            yield joined.count(" "), joined[1:], b"".join([g[1] for g in got])
        group, size = [], 0


def bpe_roundtrip(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids if asked) of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            rows = []
            for n, ids, decoded in encode(texts, path, pattern, known):
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, [int(x) for x in ids.split()]) if keep_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(digest, schema + ", token_ids array<int>" * keep_ids)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"))
