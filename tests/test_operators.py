"""Boundaries and edge rows of the retrieval and evaluation operators."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text, vectors
from lodestar.operators import answer, dedupe, evaluate, ingest, observe, search
from lodestar.plans import ingest_queries, retrieval_queries
from lodestar.sources import readers, writers


def test_chunk_boundaries(spark):
    sizes = (0, 1, 520, 521, 600, 601, 1040, 1041, 1120, 1700)
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in sizes] + [(-1, None)], "doc_id long, text string")
    got = {}
    for r in ingest.chunk_words(docs).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_no, r.tokens))
    for n in sizes:
        want = [(k, min(600, n - at)) for k, at in enumerate(range(0, n, 520))]
        assert sorted(got.get(n, [])) == want
    assert -1 not in got
    with pytest.raises(ValueError):
        ingest.chunk_words(docs, size=0)


def test_words_at_unusual_white_space(spark):
    rows = [("a b",), ("a　b",), ("a\x1cb",), ("a\x85b",), ("a\x0bb",), ("a​b",), ("﻿a b",), (None,)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(text.words(F.col("t")).alias("w")).collect()]
    assert got == [t.split() if t is not None else None for (t,) in rows]


def test_invalid_bytes_are_dropped(spark):
    files = spark.createDataFrame([("x.md", bytearray(b"ab\xff\xfecd\xc3")), ("y.txt", None)], "name string, content binary")
    assert {r.name: r.text for r in ingest.load_text(files).collect()} == {"x.md": "abcd", "y.txt": None}


def test_suffixes(spark):
    names = {"a.pdf": ".pdf", "A.PDF": ".pdf", "x": "", ".bashrc": "", "a.tar.gz": ".gz", "a.": ""}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.suffix(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == names


def test_template_fills_the_question_first(spark):
    row = spark.range(1).select(text.fill_template(F.lit("{question}|{context}"), F.lit("say {context}"), F.lit("C")).alias("p")).first()
    assert row.p == "say C|C"


def test_regressions_are_strict_and_count_missing_as_zero(spark):
    rows = [("1", 0.85, 0.8, None, 0.5), ("2", 0.80, 0.75, 0.4, None), ("3", 0.70, 0.75, 0.4, None)]
    runs = spark.createDataFrame(rows, f"file_name string, {', '.join(m + ' double' for m in evaluate.METRICS)}")
    got = {(r.metric, r["from"], r.to) for r in evaluate.regressions(runs).collect()}
    want = set()
    for k, metric in enumerate(evaluate.METRICS, 1):
        for a, b in zip(rows, rows[1:]):
            if (b[k] or 0.0) - (a[k] or 0.0) < -0.05:
                want.add((metric, a[0], b[0]))
    assert got == want


def test_mean_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], ", ".join(m + " double" for m in evaluate.METRICS))
    row = evaluate.mean_scores(empty).first()
    assert row.aggregate is None and row.n == 0


def test_ratings_are_quarantined(spark, tmp_path):
    lines = ['{"question":"q","answer":"a","rating":5,"provider":""}', "", '{"question":"q","answer":"a","rating":7}', "{broken", '{"question":"q","answer":"a","rating":1,"comment":"x y"}']
    path = tmp_path / "ratings.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    valid, rest = readers.ratings(spark, str(path))
    assert sorted(r.rating for r in valid.collect()) == [1, 5] and len(rest.collect()) == 2
    assert readers.golden(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_collection_replaces_documents(spark, tmp_path):
    schema = "point_id long, embedding array<float>, chunk_id string, doc_id string"
    c = writers.Collection(spark, str(tmp_path / "points"), 2)
    assert c.count() == 0
    c.upsert(spark.createDataFrame([(1, [0.0, 1.0], "a:0", "a"), (2, [1.0, 0.0], "a:1", "a"), (3, [1.0, 0.0], "b:0", "b")], schema))
    got = c.upsert(spark.createDataFrame([(1, [0.5, 0.5], "a:0", "a")], schema)).collect()
    assert sorted((r.point_id, r.embedding[0]) for r in got) == [(1, 0.5), (3, 1.0)]
    with pytest.raises(Exception, match="dimension"):
        c.upsert(spark.createDataFrame([(9, [1.0], "c:0", "c")], schema))


def test_a_failing_provider_stops_no_other_row(spark):
    schema = "query_id long, question string, provider string, model string, prompt_version string"
    asked = spark.createDataFrame([(1, "q", None, "", None), (2, "q", "nobody", None, "v9"), (3, "q", "local", None, None)], schema)
    hits = spark.createDataFrame([(1, 1, "a:0", "body"), (2, 1, "a:0", "body")], "query_id long, rank int, item_id string, chunk_text string")
    prompts = spark.createDataFrame([("default", "{question} Context:\n{context}")], "version string, template string")
    got = {r.query_id: r for r in answer.ask(asked, hits, prompts, indexed=1).collect()}
    assert got[1].provider == "local" and not got[1].refusal and "body" in got[1].answer
    assert got[2].refusal and got[2].answer == "unknown provider: nobody" and got[2].is_fallback
    assert got[3].refusal and got[3].answer == answer.NOTHING_RELEVANT and got[3].sources[0].chunk_id == "none"


def test_near_pairs_by_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(1, base), (2, base), (3, base[:59] + ["x"]), (4, base[30:]), (5, ["a"]), (6, []), (7, ["a"])]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in docs if w}
    least = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(i, j) for i in set(least.values()) for j in set(least.values()) if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    want |= {(j, i) for i, j in least.items() if i != j}
    got = dedupe.near_pairs(spark.createDataFrame(docs + [(8, base), (None, base)], "doc_id long, w array<string>"), 5, 0.8).collect()
    assert {(r.a, r.b) for r in got} == want | {(1, 8)} and len(got) == len(want) + 1


def test_near_pairs_of_many_copies_are_as_many_as_the_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.split(F.lit("one two three four five six seven"), " ").alias("w"))
    got = dedupe.near_pairs(docs, 5, 0.8).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("b"), F.max("a").alias("a")).first()
    assert (got.n, got.b, got.a) == (2999, 2999, 0)


def test_top_k_ties_go_to_the_smaller_item(spark):
    rows = spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.5), (1, 9, 0.7)], "query_id long, item_id long, score double")
    assert [(r["rank"], r.item_id) for r in search.top_k(rows, 2).orderBy("rank").collect()] == [(1, 9), (2, 2)]
    with pytest.raises(ValueError):
        search.top_k(rows, 0)


@pytest.mark.parametrize("last", [1, 70, observe.LAST])
def test_percentiles_of_hot_tied_null_and_single_groups(spark, last):
    rng = np.random.default_rng(3)
    values = {"hot": [float(x) for x in rng.lognormal(0, 3, 4000)], "tied": [1.0] * 700 + [2.0] * 300, "one": [5.0], None: [1.0, 4.0], "none": []}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    got = {r.kind: r for r in observe.latency(spark.createDataFrame(rows, "kind string, value double"), ["kind"], last=last).collect()}
    assert len(got) == len(values) and got["none"].n == 1 and got["none"].p50 is None and got["none"].mean is None
    for kind, vs in values.items():
        if vs:
            assert (got[kind].p50, got[kind].p95, got[kind].mean) == pytest.approx((*np.percentile(vs, [50, 95]), np.mean(vs)))
    assert got["hot"].n == 4001
    assert observe.latency(spark.createDataFrame([], "kind string, value double"), ["kind"]).isEmpty()


def test_limits_count_the_window_up_to_the_event(spark):
    events = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (1, 30), (2, 0)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    assert [r.recent for r in observe.over_limit(events, 10, 2).collect()] == [3]


def test_multi_query_takes_late_words_of_a_turn_and_finds_chunks(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(9))
    turns = [(1, 0, "user", f"{filler} needle"), (1, 1, "assistant", "haystack"), (1, 2, "user", "Needle! other")]
    docs = [(1, " ".join(f"x{i}" for i in range(700)) + " needle"), (2, "haystack"), (3, "other words")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.conv_id, r.chunk_id): r.found_by for r in retrieval_queries.multi_query_chunks(spark, str(tmp_path)).collect()}
    assert got == {(1, "1:1"): 2, (1, "3:0"): 1}


def test_multi_query_union_takes_all_terms_of_a_turn(spark, tmp_path):
    turns = [(1, 0, "user", " ".join(f"w{i}" for i in range(40)) + " needle"), (1, 1, "assistant", "haystack")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "a needle"), (8, "haystack")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.conv_id, r.item_id, r.found_by) for r in retrieval_queries.multi_query_union(spark, str(tmp_path)).collect()]
    assert got == [(1, 7, 1)]


def test_second_batch_has_every_document_whole(spark, tmp_path):
    docs = [(1, "odd one stays"), (2, " ".join(f"word{j} of" for j in range(600))), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda query: sorted((r.chunk_id, r.batch) for r in query(spark, str(tmp_path)).collect())
    assert run(ingest_queries.chunk_replace_by_doc) == [("1:0", "second"), ("2:0", "second"), ("2:1", "second")]
    assert run(ingest_queries.chunk_upsert_latest) == [("1:0", "second"), ("2:0", "second"), ("2:1", "second"), ("2:2", "first")]
    assert {r.chunk_id for r in ingest_queries.incremental_new_chunks(spark, str(tmp_path)).collect()} == {"2:0", "2:1"}


def test_revised_batch_has_odd_documents_and_last_chunks(spark, tmp_path):
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(n))) for i, n in ((1, 1000), (2, 1000), (3, 1000), (4, 1), (5, 1))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_id for r in ingest_queries.incremental_revised_chunks(spark, str(tmp_path)).collect()}
    assert got == {"1:1", "2:0", "4:0", "5:0"}


def test_near_pairs_deal_out_prefixes_only(spark):
    """Fewer rows are shuffled than two for each shingle; a changed copy of each tenth text is found."""
    r = random.Random(3)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(400)] for _ in range(50)]
    rows = list(enumerate(texts)) + [(100 + i, texts[i][:200] + ["changed"] + texts[i][201:]) for i in range(0, 50, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, w array<string>")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    dealt = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    before = dealt()
    # No table is small enough to be broadcast, as with large ones.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = dedupe.near_pairs(docs, 5, 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((x.a, x.b) for x in found) == [(i, 100 + i) for i in range(0, 50, 10)]
    assert all(x.similarity == round(391 / 401, 6) for x in found)
    assert 0 < dealt() - before < 2 * 396 * len(rows)


def test_postings_count_terms_in_their_row(spark):
    """Fewer rows are shuffled than there are occurrences; items of one id and length count as one."""
    rows = [(i, ["a", "b"] * 50 + [f"c{i}"]) for i in range(100)] + [(3, ["a"] * 101), (200, None), (201, [])]
    items = spark.createDataFrame(rows, "item_id long, terms array<string>")
    asked = spark.createDataFrame([(1, ["a", "b", "none"])], "query_id long, terms array<string>")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    dealt = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))
    before = dealt()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {(x.term, x.item_id): x.w for x in search.postings(asked, items).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < dealt() - before < 100 * 101 / 4
    assert set(got) == {(t, i) for t in "ab" for i in range(100)}
    n, avg = 103, 101 * 101 / 103
    weight = lambda tf: np.log(1 + (n - 100 + 0.5) / 100.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 101 / avg))
    assert got["a", 3] == pytest.approx(weight(151)) and got["b", 3] == pytest.approx(weight(50)) and got["a", 4] == pytest.approx(weight(50))


def test_hashed_terms_are_summed_in_their_row(spark):
    rows = [(1, ["a", "b", "a", "é"]), (1, ["c", "a"]), (2, []), (3, None), (None, ["b"]), (4, [f"w{i % 37}" for i in range(5000)])]
    frame = spark.createDataFrame(rows * 2, "k long, terms array<string>").repartition(3)
    out = vectors.hashed_embedding(frame, "k", "terms")
    # No row for each term.
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k, terms in rows * 2:
        for t in terms or []:
            d = hashlib.sha256(t.encode()).hexdigest()
            want.setdefault(k, np.zeros(64))[int(d[:4], 16) % 64] += 1 if d[4] < "8" else -1
    got = {r.k: r.embedding for r in out.collect()}
    assert got == {k: (v / np.sqrt((v * v).sum())).tolist() for k, v in want.items()}
