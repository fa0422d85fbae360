"""Readers: files of any kind, golden sets, run histories, ratings, prompts, traces."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources import schemas


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """All regular files below the paths: name (base name), path, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", "content")


def _json(spark: SparkSession, path: str, ddl: str, **options) -> DataFrame:
    """An absent path is an empty table."""
    try:
        return spark.read.schema(ddl).options(**options).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped, a malformed line stops the read, an absent file is empty."""
    return _json(spark, path, schemas.GOLDEN, mode="FAILFAST")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One document per file, or per folder that a writer made for it, with its file_name, which orders the history."""
    rows = spark.read.schema(schemas.RUN).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    own, above = F.element_at(parts, -1), F.element_at(parts, -2)
    return rows.select("*", F.when(above.endswith(".json"), above).otherwise(own).alias("file_name"))


def run_metrics(history: DataFrame) -> DataFrame:
    """file_name, dataset, prompt_version and the four metrics of the aggregate, as regressions() takes them."""
    return history.select("file_name", "dataset", "prompt_version", "aggregate.*")


def ratings(spark: SparkSession, path: str, provider: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): malformed lines and ratings outside 1..5 stop no one else's read."""
    rows = _json(spark, path, schemas.RATING + ", _corrupt string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    good = F.col("_corrupt").isNull() & F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    valid = rows.where(good).drop("_corrupt")
    if provider:
        valid = valid.where(F.col("provider") == provider)
    return valid, rows.where(~good)


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """version (file stem) and template of every file."""
    rows = files(spark, folder).where(text.suffix(F.col("name")) == ".md")
    return rows.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("version"), F.decode("content", "UTF-8").alias("template"))


def trace(traces: DataFrame, trace_id: str) -> DataFrame:
    return traces.where(F.col("id") == trace_id)


def jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A relational table; partitioned reads by the usual options."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
