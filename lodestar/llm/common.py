"""What the training-data operators share: shared-folder tables, table access, vectorised word hashes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the only word separator of these operators.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it; a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("LODESTAR_CHECKPOINT_DIR")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/lodestar-checkpoints"


def stage(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then re-reads files instead of recomputing. The folders of ``done``, staged tables that nothing
    reads any more, go at once; the others go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _where(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables."""
    for df in tables:
        where, files = _where(df.sparkSession, df.staged_at)
        files.delete(where, True)


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        odd = np.full(size, _ODD, np.uint64)
        odd[0] = 1
        _powers = np.multiply.accumulate(odd)
        odd[1:] = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _inverse = np.multiply.accumulate(odd)


_gap = np.zeros(256, bool)
_gap[[9, 10, 11, 12, 13, 32]] = True
_byte_code = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_other_code = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def prefix_sums(raw: np.ndarray, other: bool = False) -> np.ndarray:
    """Running polynomial sums of bytes, from which any substring's hash follows in constant time; ``other`` for a second one."""
    _grow_powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_other_code if other else _byte_code)[raw] * _powers[: len(raw)], out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    salt = np.uint64(int(_ODD) * length % 2**64)
    return mix64((sums[length:] - sums[:n]) * _inverse[:n] + salt)


def span_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from the running sums of their buffer."""
    return mix64((sums[stop] - sums[start]) * _inverse[start] + (stop - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each maximal run of bytes outside ASCII white space, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~_gap[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    return span_hashes(prefix_sums(raw), start, stop)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of every ``size`` successive words; a shorter text is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        total = mix64(total + _ODD) + words[k : k + n] * np.uint64(2 * k + 3)
    return np.unique(mix64(total))


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, which DuckDB has no function for."""
    entries = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        entries.append(value)
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"xor(c >> 8, [{', '.join(map(str, entries))}][xor(c & 255, b) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
