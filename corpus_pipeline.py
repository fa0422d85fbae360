"""Corpus pipeline: quality, boilerplate lines, near duplicates, source mix, token ids.

Each stage is written as Parquet into the shared folder and read again, so a lost executor or a failed stage costs no
earlier one; a stage's files go when the next one's are written, the last one's with the session.

Null and repeated ids, null and empty texts, null languages and sources, and further columns of any name are allowed in
all stages. An empty table stays empty, with the columns that each stage gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import stage as staged, table
from lodestar.llm.op1_jaccard import near_dup_stage
from lodestar.llm.op2_quality import quality_stage
from lodestar.llm.op3_mixing import mix_stage
from lodestar.llm.op4_bpe import bpe_roundtrip
from lodestar.llm.op9_lines import line_stage
from lodestar.session import on_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold.

    Null, empty and wordless texts fail the rules. Repeated rows are judged alike; without labels only the rules decide.
    """
    return quality_stage(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too much of their source repeats; n_chars, if there, is measured anew.

    Documents without a source keep every line, and a null text stays null. Very long texts are cut like others.
    """
    return line_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id, and of least digest where ids tie or are null.

    Null, empty and wordless texts are no copies of each other and all stay; of repeated rows one stays.
    """
    return near_dup_stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, or not at all.

    A null source is one of its own. Wordless documents have size 0 and are not taken; ties go by id.
    """
    return mix_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document of the mix; a null text has no tokens. Repeated rows give repeated results."""
    return bpe_roundtrip(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Hashed n-grams, sampled paths and token ranks are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


@on_workers
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", done=before)
        before = [docs]
    return docs
