"""The pipeline's stages on a small table, each against what plain Python says of its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import pandas as pd
from lodestar.llm.common import shared_dir
from lodestar.llm.common import stage as staged
from lodestar.llm.op3_mixing import mix_sql
from lodestar.llm.registry import oracle_sql, queries
from tests.llm.test_ops import base_of, brute_join, prose, reference_tokens

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    enc, docs = reference_tokens(), spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = f"{shared_dir(spark)}/test-pipeline/{name}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in after}
            for r in before:
                n, *_, repeated = base_of(r.text)
                assert r.doc_id not in kept or (n >= 50 and 100 * repeated <= 50 * n)
            assert 0 < len(after) < len(before)
        elif name == "lines":
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            old = {r.doc_id: r.text for r in before}
            assert all(len(r.text) == r.n_chars <= len(old[r.doc_id]) for r in after)
        elif name == "near_duplicates":
            texts = [r.text for r in before]
            links, kept = brute_join(texts), {r.doc_id for r in after}
            root = list(range(len(before)))
            for _ in range(20):
                root = [min([root[i], *(root[j] for j in x)]) for i, x in enumerate(links)]
            assert len(after) == len(set(root)) and kept <= {r.doc_id for r in before}
        elif name == "mixture":
            times = Counter(r.doc_id for r in after)
            frame = pd.DataFrame([(r.doc_id, r.text, r.source) for r in before], columns=["doc_id", "text", "source"])
            db = duckdb.connect()
            db.register("mine", frame)
            want = {i: taken // size for i, size, _, _, taken in db.execute(mix_sql("mine")).fetchall() if taken}
            assert len(want) == sum(n > 0 for n in times.values()) > 0 and times == want
        else:
            text = {r.doc_id: r.text for r in before}
            for r in after:
                ids = enc.encode_ordinary(text[r.doc_id])
                assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


CLASHING = ("row", "v", "site", "kept", "key", "slot", "taken", "epoch", "node", "path", "lines", "boiler", "w", "edge", "rest")


def test_stages_on_nulls_ties_and_clashing_columns(spark, tmp_path):
    texts = [None, "", " \n", prose(80, 1), prose(80, 1), prose(80, 1) + " end", prose(20_000, 2), prose(90, 3), "word " * 60, "é" * 70]
    rows = [(None if i in (3, 9) else i, t, None if i % 3 else "en", None if i % 4 == 1 else "s", len(t or ""), *["x"] * len(CLASHING)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for kind in ("full", "empty"):
        spark.createDataFrame([(7, 0, 0), (7, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{kind}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{kind}/documents.parquet")
        columns, counts = docs.columns, []
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, f"{tmp_path}/{kind}"), f"test-{name}")
            assert docs.columns == columns or name == "tokens"
            counts.append(docs.count())
        # Seven rows are prose of 50 words or more; the repeated and changed ones leave three.
        assert counts[:3] == ([7, 7, 3] if kind == "full" else [0, 0, 0])
        assert corpus_pipeline.run(spark, f"{tmp_path}/{kind}").count() == counts[-1]


def test_registry_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(oracle_sql()) <= set(queries()) and len(corpus_pipeline.STAGES) == 5
