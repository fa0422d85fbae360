"""Readers, writers, hooks and small expressions that no query reaches."""

import io
import os
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestar import session
from lodestar.functions import text, vectors
from lodestar.operators import answer, evaluate, ingest, search
from lodestar.plans import evaluation_queries
from lodestar.sources import readers, writers
from lodestar.streaming import streams


def test_files_of_nested_folders_and_kinds(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes("héllo\xff".encode("latin-1") + b"x")
    (tmp_path / "in" / "deep" / "b.html").write_text("<p>one &amp; two</p><script>no</script>", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "in" / "c.docx", "w") as z:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:body></w:document>')
    rows = {r.name: r.text for r in ingest.load_text(readers.files(spark, str(tmp_path / "in"))).collect()}
    assert rows == {"a.md": "hllox", "b.html": "one & two", "c.docx": "one two\nthree"}


def test_run_is_persisted_read_and_compared(spark, tmp_path):
    folder = str(tmp_path / "runs")
    score = "struct<" + ",".join(f"{m}:double" for m in evaluate.METRICS) + ">"
    for hour, version, value in ((1, "v/1", 0.9), (2, None, 0.4)):
        rows = spark.createDataFrame([("q1", "a", None, (value,) * 4), ("q2", "b", "c", (value,) * 4)], f"question string, answer string, ideal_answer string, score {score}")
        means = evaluate.mean_scores(rows.select("score.*"))
        run = writers.run_document(rows, means, "golden:1", {"provider": "local", "prompt_version": version})
        path = writers.persist_run(run, folder, "golden:1", version, datetime(2026, 1, 1, hour, tzinfo=timezone.utc))
        assert os.path.basename(path) == f"20260101T0{hour}0000Z-golden-1-{'v_1' if version else 'default'}.json"
    history = readers.runs(spark, folder)
    assert sorted((r.file_name[9:11], r.n, len(r.per_example)) for r in history.collect()) == [("01", 2, 2), ("02", 2, 2)]
    got = evaluate.regressions(readers.run_metrics(history).drop("dataset")).collect()
    assert {(r.metric, r.from_prompt, r.to_prompt) for r in got} == {(m, "v/1", None) for m in evaluate.METRICS}


def test_run_context_keeps_its_log_or_is_off(spark, tmp_path):
    with writers.run_context(spark, None, "x") as log:
        assert log is None
    with pytest.raises(KeyError):
        with writers.run_context(spark, str(tmp_path), "eval-x", {"n": 3}, ["eval"]) as log:
            log.table("examples", spark.createDataFrame([(1, 2)], "b int, a int"))
            raise KeyError
    assert spark.read.parquet(f"{tmp_path}/eval-x/examples").columns == ["a", "b"]
    assert spark.read.json(f"{tmp_path}/eval-x/finished").first().failed is True


def test_prompts_ratings_traces_and_golden(spark, tmp_path):
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "v1.md").write_text("{question}", encoding="utf-8")
    (tmp_path / "prompts" / "notes.txt").write_text("no", encoding="utf-8")
    assert [tuple(r) for r in readers.prompts(spark, str(tmp_path / "prompts")).collect()] == [("v1", "{question}")]
    (tmp_path / "g.jsonl").write_text('{"question":"q","ideal_answer":"a","expected_sources":["d"]}\n\n', encoding="utf-8")
    assert [r.question for r in readers.golden(spark, str(tmp_path / "g.jsonl")).collect()] == ["q"]
    path = str(tmp_path / "ratings")
    writers.append_ratings(spark.createDataFrame([("q", "a", 4, "local"), ("q", "a", 9, "local")], "question string, answer string, rating int, provider string"), path)
    valid, rest = readers.ratings(spark, path, "local")
    assert [(r.rating, len(r.id)) for r in valid.collect()] == [(4, 12)] and rest.count() == 0
    writers.append_traces(spark.createDataFrame([("t1", "ask"), ("t2", "ask")], "id string, name string"), str(tmp_path / "traces"))
    assert readers.trace(spark.read.parquet(str(tmp_path / "traces")), "t2").count() == 1


def test_collection_survives_a_failed_write_and_names_stale_points(spark, tmp_path):
    schema = "point_id long, doc_id string, chunk_id string, chunk_text string"
    points = spark.createDataFrame([(1, "a", "a:0", "one two"), (2, "b", "b:0", "three")], schema)
    c = writers.Collection(spark, str(tmp_path / "points"), vectors.DIMENSION)
    c.upsert(ingest.embedded(points))
    os.mkdir(tmp_path / "points" / "00000001")
    vectors.EMBEDDERS["ones"] = lambda texts: [[1.0] * vectors.DIMENSION for _ in texts]
    c.upsert(ingest.embedded(points.where("point_id = 1"), embedder="ones", version="2"))
    assert c.count() == 2 and [r.point_id for r in c.to_embed_again("2").collect()] == [2]
    twice = points.where("point_id = 2").unionByName(points.where("point_id = 2").withColumn("chunk_text", F.lit("four")))
    texts = {c.upsert(ingest.embedded(twice.repartition(n).limit(2)).dropDuplicates(["chunk_text"])).where("point_id = 2").first().chunk_text for n in (1, 3)}
    assert len(texts) == 1


def test_stream_upsert_and_sibling_folders(spark, tmp_path):
    for name, word in (("docs", "one"), ("docs_old", "stale")):
        spark.createDataFrame([(1, f"{word} two")], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}")
    c = writers.Collection(spark, str(tmp_path / "points"), vectors.DIMENSION)
    put = streams.upsert_into(c)
    made = lambda docs: ingest.embedded(ingest.points(ingest.chunk_words(docs), F.col("doc_id").cast("string")))
    for _ in range(2):
        streams.drain(streams.read_table(spark, f"{tmp_path}/docs"), "upsert", lambda batch, n: put(made(batch), n))
    assert [r.chunk_text for r in c.read().collect()] == ["one two"]


def test_jdbc_reads_a_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.createDataFrame([(1, "a")], "id int, name string").write.option("createTableColumnTypes", "name varchar(9)").jdbc(url, "t")
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no Derby driver here: {type(e).__name__}")
    assert [tuple(r) for r in readers.jdbc(spark, url, "t").collect()] == [(1, "a")]


def test_dense_of_many_queries_nulls_and_uneven_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [0.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "item_id long, v array<double>").repartition(4)
    asked = corpus.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    plain = sorted(map(tuple, search.dense(asked, corpus, 6, own=False).collect()))
    monkeypatch.setattr(search, "BROADCAST", 1)
    assert plain == sorted(map(tuple, search.dense(asked, corpus, 6, own=False).collect()))
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    for q in (0, 10, 20, 30):
        scores = [(-round(sum(a * b for a, b in zip(unit(dict(rows)[q]), unit(v))), 6), i) for i, v in rows if v and len(v) == 3 and i != q]
        assert [i for _, i in sorted(scores)[:6]] == [r[1] for r in sorted((x for x in plain if x[0] == q), key=lambda r: r[3])]
    with pytest.raises(ValueError):
        search.dense(asked, corpus, 1, metric="l2")


def test_expressions_without_a_query(spark):
    row = spark.createDataFrame([("a/b:c", "  x ", "", "http://h//", [("text", " a"), ("tool", "b"), ("text", "c ")])], "n string, s string, e string, u string, b array<struct<type:string,text:string>>")
    got = row.select(
        text.safe_name(F.col("n")), text.strip(F.col("s")), text.is_blank(F.col("e")), text.truthy(F.col("e")), text.without_trailing_slashes(F.col("u")),
        text.join_blocks(F.col("b")), vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), writers.run_label(F.lit("d"), F.lit(""), F.lit(None), F.lit("v")),
    ).first()
    assert list(got)[:6] == ["a_b-c", "x", True, False, "http://h", "ac"] and got[6] == pytest.approx(0.5**0.5) and got[7] == "eval-d-default-default-v"


def test_missing_key_is_that_rows_error(spark, monkeypatch):
    monkeypatch.setitem(answer.GENERATORS, "paid", answer.hosted("LODESTAR_TEST_NO_SUCH_KEY", lambda key, prompt: prompt))
    asked = spark.createDataFrame([(1, "q", "paid", None, None)], "query_id long, question string, provider string, model string, prompt_version string")
    hits = spark.createDataFrame([(1, 1, "a:0", "body")], "query_id long, rank int, item_id string, chunk_text string")
    got = answer.ask(asked, hits, spark.createDataFrame([], "version string, template string"), 1).first()
    assert got.refusal and "LODESTAR_TEST_NO_SUCH_KEY is not configured" in got.answer and got.sources[0].chunk_id == "a:0"


def test_repair_reaches_failed_rows_once(spark):
    rows = spark.createDataFrame([(1, '{"k": 5}'), (2, "k=7"), (3, "none"), (4, None)], "id int, raw string")
    fix = lambda raw: '{"k": %d}' % int(raw.split("=")[1])
    got = {r.id: (r.state, r.parsed and r.parsed.k) for r in answer.repaired(rows, "k int", lambda p: p["k"].between(0, 80), fix).collect()}
    assert got == {1: ("valid", 5), 2: ("repaired", 7), 3: ("failed", None), 4: ("failed", None)}


def test_judges_pairs_ranges_and_uncited_answers(spark):
    rows = spark.createDataFrame([(1, "q", "[a:0] yes", "c", 0.5, False, [("a", 0.5)]), (2, "q", "no", "c", 1.5, False, [("a", 2.0)])], "query_id long, question string, answer string, context string, confidence double, refusal boolean, sources array<struct<chunk_id:string,score:double>>")
    said = lambda q, a, c: '{"faithfulness": 0.5, "answer_relevance": 7, "reasoning": "r"}' if "yes" in a else "{broken"
    got = {r.query_id: (r.faithfulness, r.answer_relevance, r.reasoning) for r in evaluate.judged(rows, said).collect()}
    assert got == {1: (0.5, None, "r"), 2: (None, None, None)}
    pairs = spark.createDataFrame([(1, "q", "long answer", "x"), (2, "q", "same", "same")], "query_id long, question string, a string, b string")
    assert {r.query_id: r.verdict for r in evaluate.pairwise(pairs, lambda q, a, b: int(len(b) > len(a))).collect()} == {1: "a", 2: "tie"}
    assert [r.query_id for r in rows.where(evaluate.in_range(rows)).collect()] == [1]
    assert {r.query_id: r.refusal for r in answer.refuse_uncited(rows).collect()} == {1: False, 2: True}


def test_truth_of_short_passages(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, "x one two y"), (3, "one two three"), (4, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "zabcz"), (2, "the xx one two yy"), (3, "none two three"), (4, "0 a b c d e f g hh"), (5, "b c d e f")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in evaluation_queries.truth(spark, str(tmp_path)).collect()}
    bench = {1: "abc", 2: "x one two y", 3: "one two three", 4: "a b c d e f g h"}
    assert got == {(i, d) for i, p in bench.items() for d, t in docs if p in t}


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Cluster:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    monkeypatch.delenv("LODESTAR_CHECKPOINT_DIR", raising=False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
