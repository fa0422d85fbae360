"""Collections, pruned search, percentiles, costs, sketches, limits on streams, topics and citations against plain Python."""

import itertools
import os
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import citations, ingest, observe, search
from lodestar.plans import retrieval_queries, stream_queries
from lodestar.sources import writers
from lodestar.streaming import streams

# Collections -------------------------------------------------------------------------------------------------------


def points_of(spark, rows):
    """(doc_id, chunk number, word) -> points with an embedding."""
    rows = [(100 * d + n, d, f"{d}:{n}", w, [1.0, 2.0]) for d, n, w in rows]
    return spark.createDataFrame(rows, "point_id long, doc_id long, chunk_id string, chunk_text string, embedding array<double>")


def held(c):
    return sorted((r.doc_id, r.chunk_id, r.chunk_text) for r in c.read().collect())


def files_of(c):
    return {b: sorted(os.listdir(f"{c.path}/{f}")) for b, f in c.manifest().folders.items()}


def test_a_batch_leaves_untouched_buckets_alone(spark, tmp_path):
    c = writers.Collection(spark, str(tmp_path / "c"), 2, buckets=8)
    assert c.read() is None and c.count() == 0
    c.upsert(points_of(spark, [(d, n, "first") for d in range(20) for n in range(3)]))
    before, folders = files_of(c), c.manifest().folders
    c.upsert(points_of(spark, [(3, 0, "second"), (99, 0, "new")]))
    touched = {r.b for r in spark.createDataFrame([(3,), (99,)], "doc_id long").select(c._bucket(8).alias("b")).collect()}
    after = files_of(c)
    assert {b for b in after if before.get(b) != after[b]} == touched and len(touched) < len(before)
    assert all(c.manifest().folders[b] == f for b, f in folders.items() if b not in touched)
    want = [(d, f"{d}:{n}", "first") for d in range(20) for n in range(3) if d != 3] + [(3, "3:0", "second"), (99, "99:0", "new")]
    assert held(c) == sorted(want)
    # By point only, the rest of a document stays.
    c.upsert(points_of(spark, [(4, 1, "third")]), by_document=False)
    assert {t for d, i, t in held(c) if d == 4} == {"first", "third"}
    asked = spark.createDataFrame([(4,), (99,), (1234,)], "doc_id long")
    assert sorted(r.chunk_id for r in c.lookup(asked).collect()) == ["4:0", "4:1", "4:2", "99:0"]
    with pytest.raises(Exception, match="dimension is not 2"):
        c.upsert(points_of(spark, [(5, 0, "x")]).withColumn("embedding", F.array(F.lit(1.0))))
    assert c.upsert(points_of(spark, [(5, 0, "x")]).limit(0)).count() == c.count()


def test_old_versions_and_lost_folders_go(spark, tmp_path):
    c = writers.Collection(spark, str(tmp_path / "c"), 2, buckets=2)
    for n in range(5):
        c.upsert(points_of(spark, [(d, 0, f"v{n}") for d in range(6)]))
    assert c._versions() == [3, 4] and len(os.listdir(f"{c.path}/data")) <= 5
    named = {f for v in c._versions() for f in c._load(v).folders.values()}
    there = {f"data/{u}/{b}" for u in os.listdir(f"{c.path}/data") for b in os.listdir(f"{c.path}/data/{u}") if b.startswith("_bucket=")}
    assert there == named
    os.makedirs(f"{c.path}/data/lost/_bucket=0")
    assert c.vacuum(hours=1) == 0 and c.vacuum(hours=-1) >= 1 and not os.path.exists(f"{c.path}/data/lost")
    assert {t for *_, t in held(c)} == {"v4"}


@pytest.mark.parametrize("other", [[(7, 0, "other")], [(1, 0, "other"), (1, 1, "other"), (7, 0, "other")]])
def test_a_writer_that_loses_the_race_comes_after_the_other(spark, tmp_path, other):
    one, two = (writers.Collection(spark, str(tmp_path / "c"), 2, buckets=4) for _ in range(2))
    one.upsert(points_of(spark, [(d, 0, "first") for d in range(8)]))
    plain, calls = one._merged, []

    def late(rows, base, of, by_document):
        made = plain(rows, base, of, by_document)
        calls.append(of)
        if len(calls) == 1:
            two.upsert(points_of(spark, other))
        return made

    one._merged = late
    one.upsert(points_of(spark, [(1, 0, "mine"), (2, 0, "mine")]))
    want = {d: "first" for d in range(8)} | {d: "other" for d, *_ in other} | {1: "mine", 2: "mine"}
    assert {d: t for d, _, t in held(one)} == want and len(held(one)) == 8
    # Only buckets that the other writer has changed were merged again.
    changed = {r.b for r in spark.createDataFrame([(d,) for d, *_ in other], "doc_id long").select(one._bucket(4).alias("b")).collect()}
    assert len(calls) == 2 and set(calls[1]) == set(calls[0]) & changed
    with pytest.raises(writers.Conflict):
        one._commit(writers.Manifest(one.manifest().version, 4, "", {}))


# Search ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 4, 30])
def test_pruned_search_gives_what_scoring_all_gives(spark, k):
    r = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    items = [(i, r.choices(words, weights, k=r.randrange(0, 80))) for i in range(400)] + [(900 + i, ["w3", "w50"]) for i in range(40)] + [(999, None)]
    asked = [(q, r.choices(words, k=r.randrange(1, 25))) for q in range(25)] + [(70, []), (71, ["unknown"]), (72, ["w3", "w50"])]
    q, d = spark.createDataFrame(asked, "query_id long, terms array<string>"), spark.createDataFrame(items, "item_id long, terms array<string>")
    want = sorted(map(tuple, search.top_k(search.bm25(q, d), k).select("query_id", "rank", "item_id", "score").collect()))
    assert sorted(map(tuple, search.bm25_top(q, d, k).select("query_id", "rank", "item_id", "score").collect())) == want
    assert search.bm25_top(q.limit(0), d, k).count() == 0 and search.bm25_top(q, d.limit(0), k).count() == 0


def test_search_is_done_once_and_counts_only_terms_asked(spark):
    q = spark.createDataFrame([(1, ["a", "b"])], "query_id long, terms array<string>")
    d = spark.createDataFrame([(5, ["a", "x", "a"]), (6, ["y"]), (7, None)], "item_id long, terms array<string>")
    found = search.bm25_top(q, d, 3)
    assert "MapIn" not in found._jdf.queryExecution().optimizedPlan().toString() and [r.item_id for r in found.collect()] == [5]
    rows = d.select("item_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")).coalesce(1).mapInArrow(
        lambda batches: search._counted(batches, ["", "a", "b"]), "term string, item_id long, length int, tf long"
    )
    assert sorted(map(tuple, rows.collect())) == [("", 5, 3, 1), ("", 6, 1, 1), ("", 7, 0, 1), ("a", 5, 3, 2)]


def test_pruned_search_in_blocks_and_groups(spark, monkeypatch):
    r = random.Random(5)
    items = [(f"é{i % 90}:{i}", r.choices("abcdefgh", [9, 8, 5, 3, 2, 1, 1, 1], k=r.randrange(0, 30))) for i in range(600)]
    asked = [(f"q{q}", r.choices("abcdefghx", k=r.randrange(1, 6))) for q in range(40)]
    q, d = spark.createDataFrame(asked, "query_id string, terms array<string>"), spark.createDataFrame(items, "item_id string, terms array<string>")
    want = sorted(map(tuple, search.top_k(search.bm25(q, d), 7).select("query_id", "rank", "item_id", "score").collect()))
    monkeypatch.setattr(search, "BLOCK", 50)
    monkeypatch.setattr(search, "GROUP", 30)
    assert sorted(map(tuple, search.bm25_top(q, d, 7).select("query_id", "rank", "item_id", "score").collect())) == want
    with pytest.raises(ValueError):
        search.bm25_top(q, d, 0)


def test_pruned_search_scores_few_pairs_in_full(spark):
    sf = "/root/testdata/sf0.1"
    q, d = retrieval_queries.asked(spark, sf), retrieval_queries.documents_as_items(spark, sf)
    rows = search.postings(q, d).toPandas()
    number = {t: i for i, t in enumerate(sorted(set(rows["term"])))}
    asked = [(r.query_id, np.array([number[t] for t in set(r.terms) if t in number], np.int64)) for r in q.collect()]
    rows = rows.assign(term=rows["term"].map(number)).sort_values("item_id", kind="stable")
    best, every = search.BestOf(asked, 10), 0
    cuts = np.searchsorted(rows["item_id"], np.arange(0, 10_001, 500))
    for a, b in zip(cuts, cuts[1:]):
        part = rows.iloc[a:b]
        best.add(part["item_id"].to_numpy(), part["term"].to_numpy(), part["w"].to_numpy())
        have = {t: set(g) for t, g in part.groupby("term")["item_id"]}
        every += sum(len(set().union(*(have.get(t, set()) for t in terms))) for _, terms in asked)
    print("pairs in full", best.full, "of", every)
    assert 0 < best.full < every / 10


# Figures -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("last", [5, 40, 10_000])
def test_percentiles_by_selection(spark, last):
    r = np.random.default_rng(last)
    rows = [("a", float(x)) for x in r.normal(size=3000)] + [("b", float(x)) for x in r.integers(0, 3, 500)] + [("one", 7.0)]
    rows += [("ties", 1.0)] * 900 + [("ties", 2.0)] * 50 + [(None, float(i)) for i in range(41)] + [("none", None), ("a", None), ("a", -0.0)]
    got = {x.kind: x for x in observe.latency(spark.createDataFrame(rows, "kind string, value double").repartition(3), ["kind"], shares=(0.5, 0.95, 0.999), last=last).collect()}
    assert set(got) == {"a", "b", "one", "ties", None, "none"} and got["none"].p50 is None and got["none"].n == 1
    for kind in ("a", "b", "one", "ties", None):
        v = [x for k, x in rows if k == kind and x is not None]
        assert [got[kind][p] for p in ("p50", "p95", "p99.9")] == pytest.approx(np.quantile(v, [0.5, 0.95, 0.999]).tolist(), abs=1e-12)


def test_prices_as_of_their_time(spark):
    r = random.Random(3)
    start = datetime(2026, 1, 1)
    prices = [(m, start + timedelta(hours=r.randrange(0, 900), seconds=r.randrange(3600)), float(r.randrange(1, 99)), 2.0) for m in ("a", "b") for _ in range(9)]
    prices += [("a", prices[0][1], 500.0, 2.0), ("late", start + timedelta(days=400), 1.0, 1.0), ("old", start - timedelta(days=3), 4.0, 1.0)]
    calls = [(i, r.choice(["a", "b", "old", "late", "none", None]), start + timedelta(hours=r.randrange(0, 1000)), 10, 20, 1.0) for i in range(400)]
    calls += [(1000 + i, m, at, 10, 20, 1.0) for i, (m, at, *_) in enumerate(prices)]
    rows = spark.createDataFrame(calls, "id long, model string, ts timestamp, tokens_in long, tokens_out long, latency double")
    dated = spark.createDataFrame(prices, "model string, valid_from timestamp, price_in double, price_out double")
    got = {x.id: x for x in observe.call_costs(rows, dated).collect()}
    assert len(got) == len(calls)
    for i, model, ts, *_ in calls:
        held = [(since, p) for m, since, p, _ in prices if m == model and since <= ts]
        last = max((since for since, _ in held), default=None)
        among = {p for since, p in held if since == last}
        assert got[i].price_in in among if among else got[i].price_in is None and got[i].cost is None
    assert {x.model: x.unpriced for x in observe.usage(observe.call_costs(rows, dated), ["model"]).collect()}["late"] == sum(c[1] == "late" and c[0] < 1000 for c in calls)
    assert observe.call_costs(rows.limit(0), dated).count() == 0 and observe.call_costs(rows, dated.limit(0)).where("cost is null").count() == len(calls)


def test_sketches_merge_in_any_order(spark):
    r = random.Random(4)
    rows = [(i % 7, "xyz"[i % 3], r.randrange(900), r.gauss(0, 1)) for i in range(6000)]
    events = spark.createDataFrame(rows, "day int, kind string, who long, value double")
    stored = observe.sketched(events, ["day", "kind"], "who", "value")
    ways = [observe.merged_sketches(observe.merged_sketches(stored, a), []) for a in (["day"], ["kind"])] + [observe.merged_sketches(stored, [])]
    told = [observe.told_by_sketches(w).first() for w in ways]
    assert len({(t.n, t.distinct) for t in told}) == 1 and told[0].n == 6000
    assert abs(told[0].distinct - len({x[2] for x in rows})) <= 0.05 * 900
    values = np.sort([x[3] for x in rows])
    for t in told:
        assert all(abs(np.searchsorted(values, t[p]) / 6000 - share) < 0.02 for p, share in (("p50", 0.5), ("p95", 0.95)))


def test_points_whose_hashed_terms_cancel_stay(spark):
    """Both terms of the second text fall into one bucket with opposite signs."""
    rows = spark.createDataFrame([(1, "one two three"), (2, "Les eux."), (3, " ... "), (4, None)], "point_id long, chunk_text string")
    got = {r.point_id: r.embedding for r in ingest.embedded(rows).collect()}
    assert set(got) == {1, 2} and got[2] == [0.0] * vectors.DIMENSION
    assert sum(x * x for x in got[1]) == pytest.approx(1)


def test_stream_collection_keeps_a_text_that_the_added_word_cancels(spark, tmp_path):
    """The word of document 1 cancels the one that is added to it."""
    spark.createDataFrame([(1, "w15"), (2, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = stream_queries.stream_collection(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.dimension, r.tokens) for r in got} == {(1, 64, 2), (2, 64, 3)}


def test_stream_collection_reads_a_table_in_as_many_files_as_it_has_and_never_both_times_at_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} two") for i in range(12)], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    seen, drain = [], streams.drain

    def watched(stream, name, merge):
        def told(batch, number):
            rows = batch.select("text", F.input_file_name().alias("file")).collect()
            seen.append((len({r.file for r in rows}), {r.text.endswith(" again") for r in rows}))
            merge(batch, number)

        drain(stream, name, told)

    monkeypatch.setattr(streams, "drain", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = stream_queries.stream_collection(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x for _, x in seen] == [{False}, {True}] and all(n > 1 for n, _ in seen), seen
    assert sorted((r.doc_id, r.tokens) for r in got) == [(i, 3) for i in range(12)]


# Streams -----------------------------------------------------------------------------------------------------------


def test_rate_limit_on_late_events_and_its_state(spark, tmp_path):
    r = random.Random(6)
    start = datetime(2026, 1, 1)
    events = [(i, r.randrange(5), start + timedelta(seconds=r.randrange(0, 40_000))) for i in range(300)] + [(500, 1, start), (501, 1, start)]
    late = sorted(events, key=lambda e: e[2] + timedelta(seconds=r.randrange(0, 7200)))
    schema = "event_id long, user_id long, ts timestamp"
    for n in range(4):
        spark.createDataFrame(late[n * 76 : (n + 1) * 76], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for days in (2, 4):
        spark.createDataFrame([(9000 + days, -1, start + timedelta(days=days))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with streams.keyed_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = streams.rate_limited(stream, 3600, 3, "3 hours").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        query = query.format("parquet").start(f"{tmp_path}/out")
        query.awaitTermination()
    want = sorted(map(tuple, observe.over_limit(spark.createDataFrame(events, schema), 3600, 3).select("event_id", "user_id", "recent").collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("event_id", "user_id", "recent").collect())) == want and want
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, query.recentProgress) if p["stateOperators"]]
    assert max(rows) > rows[-1], rows


def test_rate_limit_when_old_times_are_cleared_and_nothing_waits(spark, tmp_path):
    start, schema = datetime(2026, 1, 1), "event_id long, user_id long, ts timestamp"
    # The first later event lets user 1 be judged, the second is past the reach of what is kept of it.
    for rows in ([(i, 1, start + timedelta(seconds=i)) for i in range(3)], [(10, -1, start + timedelta(minutes=200))], [(11, -1, start + timedelta(hours=20))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with streams.keyed_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        done = streams.run_once(streams.rate_limited(stream, 3600, 2, "3 hours"), "rate-limit-cleared")
    assert [tuple(r) for r in done.collect()] == [(2, 1, 3)]


def test_a_stream_without_a_batch_is_an_empty_table(spark, tmp_path):
    os.mkdir(tmp_path / "none")
    stream = spark.readStream.schema("event_id long, event_type string, ts timestamp, value double").parquet(f"{tmp_path}/none")
    assert streams.run_once(streams.event_windows(stream), "none", "complete").count() == 0
    assert streams.run_once(stream, "none").count() == 0


# Chunks and citations ----------------------------------------------------------------------------------------------


def test_topic_cuts_are_the_best(spark):
    r = random.Random(7)
    for n in range(1, 9):
        for _ in range(25):
            sizes, likes = [r.randrange(1, 9) for _ in range(n)], [0] + [r.randrange(0, 4) for _ in range(n - 1)]
            least, most = r.randrange(1, 8), r.randrange(8, 14)
            best = None
            for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), m) for m in range(n)):
                ends = [0, *cuts, n]
                parts = [sizes[a:b] for a, b in zip(ends, ends[1:])]
                if any(sum(p) > most and len(p) > 1 for p in parts):
                    continue
                told = (sum(sum(p) < least for p in parts[:-1]), sum(likes[c] for c in cuts), len(cuts))
                best = min(best or told, told)
            starts = ingest.topic_starts(sizes, likes, least, most)
            parts = [sizes[a:b] for a, b in zip(starts, [*starts[1:], n])]
            assert starts[0] == 0 and all(sum(p) <= most or len(p) == 1 for p in parts)
            assert (sum(sum(p) < least for p in parts[:-1]), sum(likes[c] for c in starts[1:]), len(starts) - 1) == best


def test_topic_chunks_hold_every_word_and_overlap(spark):
    r = random.Random(8)
    topic = lambda words, n: " ".join(" ".join(r.choices(words, k=9)) + "." for _ in range(n))
    body = topic(["sea", "ship", "wave"], 8) + " " + topic(["tax", "law", "court"], 8)
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "One. Two!")], "doc_id long, text string")
    got = sorted(ingest.chunk_topics(docs, least=40, most=90, overlap=5).collect(), key=lambda x: (x.doc_id, x.chunk_no))
    assert [x.first_sentence for x in got if x.doc_id == 1] == [0, 8] and [x.overlap for x in got] == [0, 5, 0]
    assert " ".join(" ".join(x.chunk_text.split()[x.overlap :]) for x in got if x.doc_id == 1) == " ".join(body.split())
    assert [(x.doc_id, x.chunk_text) for x in got if x.doc_id > 1] == [(4, "One. Two!")]


def test_topic_query_against_plain_python(spark):
    import hashlib

    import regex

    from lodestar.plans import ingest_queries
    from tests.conftest import SMALL

    want = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        cut = re.sub(r"([.!?])[ \n]+", r"\1\n", r.text or "").split("\n")
        words = [w for w in (s.split() for s in cut) if w]
        terms = [{t for t in regex.split(r"[^\p{L}\p{N}]+", " ".join(w).lower()) if t} for w in words]
        likes = []
        for i in range(len(terms)):
            a, b = set().union(*terms[max(0, i - 3) : i]), set().union(*terms[i : i + 3])
            likes.append(1_000_000 * len(a & b) // min(len(a), len(b)) if a and b else 0)
        starts = ingest.topic_starts([len(w) for w in words], likes, 400, 800)
        for n, at in enumerate(starts):
            own = sum(words[at : [*starts, len(words)][n + 1]], [])
            head = sum(words[:at], [])[-80:]
            want.add((r.doc_id, n, at, len(own), len(head), hashlib.md5(" ".join(head + own).encode()).hexdigest()))
    got = ingest_queries.chunk_topics(spark, SMALL).select("doc_id", "chunk_no", "first_sentence", "tokens", "overlap", "chunk_md5").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_citations_by_position(spark):
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, "  ".join(words)), (2, None)], "doc_id long, text string")
    ranges = {r.chunk_no: (r.low, r.high) for r in citations.chunk_ranges(docs, 10, 2).collect()}
    body = " ".join(words)
    chunks = {r.chunk_no: r.chunk_text for r in ingest.chunk_words(docs, size=10, overlap=2).collect()}
    assert {n: body[a:b] for n, (a, b) in ranges.items()} == chunks
    claims = [("in", "w9 w10", 1), ("first", "w0 w1", 0), ("next", "w11", 0), ("across", "w5 w6 w7 w8 w9 w10 w11", 0), ("nowhere", "w9 w8", 0), ("null", "x", 0)]
    rows = spark.createDataFrame([(c, s, f"1:{n}", 1 if c != "null" else 2, n) for c, s, n in claims], "claim_id string, sentence string, chunk_id string, doc_id long, chunk_no int")
    got = {r.claim_id: (r.located, r.supported, r.elsewhere) for r in citations.checked(rows, docs, 10, 2).collect()}
    assert got == {
        "in": (True, True, False), "first": (True, True, False), "next": (True, False, True), "across": (True, False, False),
        "nowhere": (False, False, False), "null": (False, False, False),
    }


def test_runs_of_one_second_and_rejected_ratings_are_kept(spark, tmp_path):
    run = spark.createDataFrame([("d", 1)], "dataset string, n int")
    now = datetime(2026, 1, 1)
    paths = [writers.persist_run(run, str(tmp_path), "d", "v", now) for _ in range(3)]
    assert len(set(paths)) == 3 and paths == sorted(paths)
    rejected = writers.append_ratings(spark.createDataFrame([("q", 4), ("q", 9), ("q", None)], "question string, rating int"), str(tmp_path / "ratings"))
    assert sorted(str(r.rating) for r in rejected.collect()) == ["9", "None"]
    assert spark.read.json(str(tmp_path / "ratings")).count() == 1 and spark.read.json(str(tmp_path / "ratings-rejected")).count() == 2


def test_strengths_by_joins_and_by_the_driver(spark):
    from lodestar.operators import evaluate

    r = random.Random(9)
    rows = [(a, b, r.choice(["a", "a", "b", "tie"])) for a in "wxyz" for b in "wxyz" if a < b for _ in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "left string, right string, verdict string")
    wins, n = dict.fromkeys("wxyz", 0.0), {}
    for a, b, v in rows:
        wins[a] += {"a": 1, "b": 0}.get(v, 0.5)
        wins[b] += {"a": 0, "b": 1}.get(v, 0.5)
        n[a, b] = n[b, a] = n.get((a, b), 0) + 1
    p = dict.fromkeys("wxyz", 1.0)
    for _ in range(4):
        p = {a: (wins[a] + 1.5) / sum((n[a, b] + 1) / (p[a] + p[b]) for b in "wxyz" if b != a) for a in "wxyz"}
    for few in (0, 100):
        got = {x.name: x for x in evaluate.strengths(df, rounds=4, every=2, few_rows=few).collect()}
        assert {a: got[a].strength for a in got} == pytest.approx({a: p[a] * 4 / sum(p.values()) for a in p})
        assert {a: got[a].wins for a in got} == pytest.approx(wins)


def test_order_of_a_pair_is_its_hash(spark):
    import zlib

    from lodestar.operators import evaluate

    rows = [(i, "q", "x" * (i % 3), "y" * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "pair_id long, question string, a string, b string")
    longer = lambda q, one, two: F.when(F.length(one) > F.length(two), 0).when(F.length(two) > F.length(one), 1)
    got = {x.pair_id: (x.shown_first, x.verdict) for x in evaluate.swapped(df, longer).collect()}
    for i, _, a, b in rows:
        want = "a" if len(a) > len(b) else "b" if len(b) > len(a) else "tie"
        assert got[i] == ("b" if zlib.crc32(f"order:{i}".encode()) % 2 else "a", want)
    assert {x for x, _ in got.values()} == {"a", "b"}


def test_rows_beyond_a_part_of_a_batch_are_all_read(spark):
    n = 2 * ingest.ROWS + 5
    rows = [(f"{i}.md", None if i % 7 == 0 else f"t{i}é".encode() + b"\xff") for i in range(n)]
    got = {r.name: r.text for r in ingest.load_text(spark.createDataFrame(rows, "name string, content binary").coalesce(1)).collect()}
    assert got == {f"{i}.md": None if i % 7 == 0 else f"t{i}é" for i in range(n)}
    docs = spark.createDataFrame([(i, f"One of {i}. Two of {i}.") for i in range(n)], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in ingest.chunk_topics(docs).collect()) == list(range(n))
