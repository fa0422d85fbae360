"""op11 against a sorted running sum in plain Python, on ties, repeated rows and texts of many copies."""

import hashlib
import random
import zlib

import pytest

from lodestar.llm import op11_sharding
from tests.llm.test_ops import ROWS, docs, same_rows  # noqa: F401


def brute(rows, n=8, whole=100):
    """(doc_id, size, crc, shard, slot) of (doc_id, text)."""
    key = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = sorted(((key(t or ""), key("" if i is None else str(i))), i, t or "") for i, t in rows)
    total, at, starts, copies = sum(len(t.encode()) + 1 for *_, t in order), 0, {}, {}
    placed = []
    for _, i, t in order:
        size = len(t.encode()) + 1
        starts.setdefault(t, at)
        copies[t] = copies.get(t, 0) + size
        placed.append((i, t, size, at))
        at += size
    out, slots = [], {}
    for i, t, size, start in placed:
        twice = 2 * starts[t] + copies[t] if copies[t] * whole * n <= total else 2 * start + size
        shard = min(n - 1, twice * n // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, zlib.crc32(t.encode()), shard, slots[shard]))
    return out


def test_edge_rows(docs):  # noqa: F811
    got = op11_sharding.shard(docs, keep_row=True).collect()
    same_rows([r[:5] for r in got], brute([(r[0], r[1]) for r in ROWS]))
    assert all((r.row.doc_id, r.row.kept) == (r.doc_id, "k") for r in got)
    assert op11_sharding.shard(docs.limit(0)).collect() == []


@pytest.mark.parametrize("ranges", [None, 8, 300])
def test_hot_texts_and_rows(spark, ranges):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcé ") for _ in range(r.randrange(0, 400)))) for i in range(1200)]
    rows += [(5000 + i, "copies " * 20) for i in range(700)] + [(9, "same")] * 400 + [(None, None)] * 300 + [(7000, "long " * 40_000)]
    rows += [(8000 + i, f"pair {i // 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same_rows([x[:5] for x in op11_sharding.shard(df, ranges=ranges).collect()], brute(rows))


def test_no_range_holds_a_hot_text(spark):
    rows = [(i, "hot " * 5) for i in range(3000)] + [(0, "row " * 5)] * 3000 + [(i, str(i)) for i in range(3000)]
    staged = op11_sharding.stage(op11_sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text", False), "test-sharding")
    n, size = staged.count(), sum(r["size"] for r in staged.select("size").collect())
    most = op11_sharding.ranged(staged, n, size, 64).groupBy("c0", "c1", "c2").count().agg({"count": "max"}).first()[0]
    assert most <= 8 * n / 64


def test_shards_are_near_equal_and_written_in_order(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(1, 2000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    op11_sharding.write_shards(df, str(tmp_path / "out"), files=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("row.*").collect())) == rows
    sizes = back.selectExpr("shard", "length(row.text) + 1 as size").groupBy("shard").sum("size").collect()
    assert len(sizes) == 8 and max(x[1] for x in sizes) - min(x[1] for x in sizes) <= 2 * 2001 + sum(x[1] for x in sizes) // 800
