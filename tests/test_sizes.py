"""What is written, shuffled and scored: collections, the stream into one, and the pruned search."""

import os
import random

import numpy as np
import pytest

from lodestar import session
from lodestar.operators import search
from lodestar.plans import stream_queries
from lodestar.sources import writers
from lodestar.streaming import streams
from tests.test_features import held, points_of


def stages(spark):
    """What Spark still tells of its stages; it forgets old ones."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))


def last(spark):
    return max((s.stageId() for s in stages(spark)), default=-1)


def dealt(spark, since, what="Bytes"):
    """Bytes, or records, shuffled by the stages after that one."""
    return sum(getattr(s, f"shuffleWrite{what}")() for s in stages(spark) if s.stageId() > since)


def test_a_batch_is_written_once_and_leaves_no_folder_that_no_version_names(spark, tmp_path):
    c = writers.Collection(spark, str(tmp_path / "c"), 2, buckets=2)
    c.upsert(points_of(spark, [(d, 0, "first") for d in range(9)] + [(8, 0, "first")]))
    assert len(held(c)) == 9
    # Some earlier points stay in both buckets, a point comes twice, and a new document fills no bucket alone.
    c.upsert(points_of(spark, [(d, 0, "second") for d in range(4)] + [(3, 0, "second"), (50, 1, "new")]))
    assert held(c) == sorted([(d, f"{d}:0", "second" if d < 4 else "first") for d in range(9)] + [(50, "50:1", "new")])
    named = {f for v in c._versions() for f in c._load(v).folders.values()}
    there = {f"data/{u}/{b}" for u in os.listdir(f"{c.path}/data") for b in os.listdir(f"{c.path}/data/{u}") if b.startswith("_bucket=")}
    assert there == named


def test_stream_collection_writes_texts_once_for_each_time_they_come(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(500))) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for module in (session, streams):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"{tmp_path}/shared")
    size = lambda top: sum(p.stat().st_size for p in top.rglob("*.parquet") if p.is_file())
    before = last(spark)
    got = stream_queries.stream_collection(spark, str(tmp_path)).collect()
    assert len(got) == 300 and {x.tokens for x in got} == {501}
    # Two versions of the collection, with vectors, and no other copy; texts are not shuffled.
    assert size(tmp_path / "shared") < 3 * size(tmp_path / "documents.parquet")
    assert dealt(spark, before) < size(tmp_path / "documents.parquet") / 4


def test_pruned_search_leaves_postings_where_they_are(spark):
    """Ids, counts of terms and hits are shuffled, and no row for each term of an item."""
    r = random.Random(8)
    items = [(f"i{i}", r.sample(range(400), 200)) for i in range(1000)]
    d = spark.createDataFrame(items, "item_id string, terms array<string>").repartition(4)
    q = spark.createDataFrame([(n, [str(x) for x in range(40 * n, 40 * n + 40)]) for n in range(10)], "query_id long, terms array<string>")
    d.count()
    before = last(spark)
    got = search.bm25_top(q, d, 3)
    assert 0 < dealt(spark, before, "Records") < 1000 * 200 / 8
    want = search.top_k(search.bm25(q, d), 3).select("query_id", "rank", "item_id", "score")
    assert sorted(map(tuple, got.select("query_id", "rank", "item_id", "score").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("group", [5, 1000])
def test_pruned_search_of_ids_that_come_twice_and_of_many_terms(spark, monkeypatch, group):
    r = random.Random(group)
    items = [(i % 150, r.choices("abcdefgh", [9, 8, 5, 3, 2, 1, 1, 1], k=r.randrange(0, 30))) for i in range(200 if group > 5 else 150)]
    asked = [(q, r.choices("abcdefghx", k=r.randrange(1, 6))) for q in range(30)]
    q, d = spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame(items, "item_id long, terms array<string>")
    want = sorted(map(tuple, search.top_k(search.bm25(q, d), 4).select("query_id", "rank", "item_id", "score").collect()))
    monkeypatch.setattr(search, "GROUP", group)
    monkeypatch.setattr(search, "BLOCK", 40)
    assert sorted(map(tuple, search.bm25_top(q, d, 4).select("query_id", "rank", "item_id", "score").collect())) == want


def test_pruned_search_of_common_and_rare_terms_in_blocks():
    """Against all scores: terms left aside, ties, and a block whose own hits cut the rest."""
    r = np.random.default_rng(4)
    share = np.concatenate([np.full(10, 0.6), np.full(40, 0.05), np.full(50, 0.004)])
    have = r.random((3000, 100)) < share
    w = np.round(np.where(have, r.random((3000, 100)) * (1 - np.log(share)), 0), 1)
    asked = [(n, r.choice(100, 20, replace=False)) for n in range(40)] + [(40, np.arange(10)), (41, np.arange(90, 100))]
    best = search.BestOf(asked, 5)
    for at in range(0, 3000, 700):
        item, term = np.nonzero(w[at : at + 700])
        best.add(item + at, term, w[item + at, term])
    got = best.rows()
    for n, terms in asked:
        score = np.round(w[:, terms].sum(1), 6)
        want = [i for i in np.lexsort((np.arange(3000), -score))[:5] if score[i] > 0]
        assert got[got["query_id"] == n]["item"].tolist() == want
    assert best.full < 3000 * len(asked) / 20
