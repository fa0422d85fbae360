"""Writers: collections of points, runs, ratings, traces."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions import text, vectors
from lodestar.operators import ingest
from lodestar.session import staged


class Conflict(Exception):
    """Another writer has taken the next version of a manifest."""


@dataclass
class Manifest:
    """What a version of a collection consists of: a folder for each bucket that has points."""

    version: int = -1
    buckets: int = 64
    schema: str = ""
    folders: dict[int, str] = field(default_factory=dict)


class Collection:
    """Points of one dimension in buckets by hash of their document, so that a batch rewrites only what it touches.

    A version is a manifest: one file that names a folder for each bucket. A batch is written by bucket into a folder of its own, from
    where its rows are, so texts are not dealt out. That folder is the new bucket where no earlier point stays; where one does, the bucket
    is written anew from both. The batch commits by giving the next manifest its name, which fails if
    another writer has taken it. Then the batch is put on top of that version: only buckets that the other has
    changed are merged again. Readers see a whole version, never a part of one. Folders that the last KEEP versions no longer name
    go after a commit; what a failed writer left goes with ``vacuum``. A point belongs to one document for good.
    """

    KEEP, TRIES = 2, 20

    def __init__(self, spark: SparkSession, path: str, dimension: int, buckets: int = 64):
        self.spark, self.path, self.dimension, self.buckets = spark, path, dimension, buckets

    def _where(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list:
        where, files = self._where(name)
        return list(files.listStatus(where)) if files.exists(where) else []

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed("_manifests")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> Manifest:
        where, files = self._where(f"_manifests/{version:08d}.json")
        stream = files.open(where)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, told["buckets"], told["schema"], {int(b): f for b, f in told["folders"].items()})

    def manifest(self) -> Manifest:
        """The last version; an empty one if there is none yet."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest(buckets=self.buckets)

    def _commit(self, new: Manifest) -> None:
        body = json.dumps({"buckets": new.buckets, "schema": new.schema, "folders": new.folders})
        draft, files = self._where(f"_manifests/.{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        out.write(bytearray(body, "utf-8"))
        out.close()
        final, _ = self._where(f"_manifests/{new.version:08d}.json")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark._sc._gateway.new_array(jvm.Options.Rename, 1)
        never[0] = jvm.Options.Rename.NONE
        try:
            jvm.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, never)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(new.version) from None
            raise

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def _table(self, base: Manifest, of: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in sorted(base.folders.items()) if of is None or b in set(of)]
        if not folders:
            return None
        schema = StructType.fromJson(json.loads(base.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        """The points of the last version; None before the first."""
        now = self.manifest()
        if now.version < 0:
            return None
        found = self._table(now)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(now.schema))) if found is None else found

    def lookup(self, documents: DataFrame) -> DataFrame:
        """The points of (doc_id), from the buckets that can hold them."""
        now = self.manifest()
        of = [r["b"] for r in documents.select(self._bucket(now.buckets).alias("b")).distinct().collect()]
        found = self._table(now, of)
        return self.read().limit(0) if found is None else found.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")

    def _made(self, folder: str) -> dict[int, str]:
        """The buckets that a folder has points of."""
        names = [s.getPath().getName() for s in self._listed(folder)]
        return {int(n[8:]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _drop(self, name: str) -> None:
        where, files = self._where(name)
        files.delete(where, True)

    def _merged(self, rows: DataFrame, base: Manifest, of: list[int], by_document: bool) -> dict[int, str]:
        """Writes those of the buckets anew where earlier points stay, or a point comes twice; where each of them is now.

        Which these are is found by ids alone; any other bucket has the batch's rows and nothing else.
        """
        new, old, key = rows.where(F.col("_bucket").isin(of)), self._table(base, of), "doc_id" if by_document else "point_id"
        twice = new.groupBy("point_id").count().where("count > 1")
        mixed = new.select("point_id", "_bucket").join(twice, "point_id", "left_semi").select("_bucket")
        if old is not None:
            stay = old.select("doc_id", "point_id").join(new.select(key).distinct(), key, "left_anti")
            mixed = mixed.union(stay.select(self._bucket(base.buckets)))
        anew = sorted(r["_bucket"] for r in mixed.distinct().collect())
        if not anew:
            return {}
        new = new.where(F.col("_bucket").isin(anew)).drop("_bucket")
        old = self._table(base, anew)
        both = ingest.upsert(new.limit(0) if old is None else old, new, "point_id", by_group="doc_id" if by_document else None)
        folder = f"data/{uuid.uuid4().hex}"
        both.withColumn("_bucket", self._bucket(base.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return self._made(folder)

    def upsert(self, new: DataFrame, by_document: bool = True) -> DataFrame | None:
        """Insert or replace by point, and whole documents too unless told not to; a wrong dimension is an error."""
        base = self.manifest()
        checked = new.withColumn("embedding", vectors.checked(F.col("embedding"), self.dimension))
        if (held := self._table(base)) is not None:
            # Of the collection's columns and types, also where no earlier point stays.
            checked = held.limit(0).unionByName(checked)
        rows, folder = checked.withColumn("_bucket", self._bucket(base.buckets)), f"data/{uuid.uuid4().hex}"
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        came = self._made(folder)
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        touched = todo = sorted(came)
        made: dict[int, str] = {}
        for _ in range(self.TRIES if touched else 0):
            made |= {b: came[b] for b in todo} | self._merged(rows, base, todo, by_document)
            folders = base.folders | made
            try:
                self._commit(Manifest(base.version + 1, base.buckets, base.schema or checked.schema.json(), folders))
            except Conflict:
                latest = self.manifest()
                todo = [b for b in touched if latest.folders.get(b) != base.folders.get(b)]
                base = latest
                continue
            # What was written anew is not read from the batch's folder.
            left = [f for b, f in came.items() if made[b] != f]
            for name in left if len(left) < len(came) else [folder]:
                self._drop(name)
            self._retire()
            return self.read()
        if touched:
            raise Conflict(f"{self.path}: {self.TRIES} commits were lost to other writers")
        self._drop(folder)
        return self.read()

    def _retire(self) -> None:
        """Delete what only older versions name, and these."""
        versions = self._versions()
        kept = {f for v in versions[-self.KEEP :] for f in self._load(v).folders.values()}
        for v in versions[: -self.KEEP]:
            for f in set(self._load(v).folders.values()) - kept:
                self._drop(f)
            self._drop(f"_manifests/{v:08d}.json")

    def vacuum(self, hours: float = 24) -> int:
        """Delete folders of that age that no version names: what failed writers have left. Returns their number."""
        named = {f.split("/")[1] for v in self._versions() for f in self._load(v).folders.values()}
        late = time.time() * 1000 - hours * 3_600_000
        lost = [s.getPath() for s in self._listed("data") if s.getPath().getName() not in named and s.getModificationTime() <= late]
        for where in lost:
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(lost)

    def count(self) -> int:
        now = self.read()
        return 0 if now is None else now.count()

    def to_embed_again(self, version: str) -> DataFrame:
        """Points of another model version."""
        return self.read().where(F.col("model_version") != version)


class RunLog:
    """Rows that a run logs: its tables and metrics, kept under its name."""

    def __init__(self, spark: SparkSession, folder: str, name: str, config: dict, tags: list[str]):
        self.spark, self.path = spark, f"{folder}/{name}"
        row = spark.createDataFrame([(name, {k: str(v) for k, v in config.items()}, tags)], "name string, config map<string,string>, tags array<string>")
        row.write.mode("overwrite").json(f"{self.path}/config")

    def table(self, name: str, rows: DataFrame) -> None:
        rows.select(*sorted(rows.columns)).write.mode("overwrite").parquet(f"{self.path}/{name}")


@contextmanager
def run_context(spark: SparkSession, folder: str | None, name: str, config: dict | None = None, tags: list[str] | None = None) -> Iterator[RunLog | None]:
    """A log of the run, or None where no folder is named; ``finished`` is written even if the run fails."""
    if not folder:
        yield None
        return
    log = RunLog(spark, folder, name, config or {}, tags or [])
    failed = True
    try:
        yield log
        failed = False
    finally:
        spark.createDataFrame([(name, failed)], "name string, failed boolean").write.mode("overwrite").json(f"{log.path}/finished")


def run_document(per_example: DataFrame, aggregate: DataFrame, dataset: str, config: dict) -> DataFrame:
    """One row in the stored form of a run, from (question, answer, ideal_answer, score) and (aggregate, n).

    A golden set is a list for people to read, so its examples fit one document.
    """
    one = per_example.agg(F.collect_list(F.struct("question", "answer", "ideal_answer", "score")).alias("per_example"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
    fields = [F.lit(config.get(c)).cast("string").alias(c) for c in ("provider", "model", "prompt_version")]
    return one.withColumn("one", F.lit(1)).join(aggregate.withColumn("one", F.lit(1)), "one").select(
        F.lit(dataset).alias("dataset"), *fields, F.col("n").cast("int").alias("n"), "aggregate", "per_example", stamp.alias("created_at")
    )


def run_name(dataset, prompt_version, now: datetime | None = None) -> str:
    now = now or datetime.now(timezone.utc)
    safe = lambda s: (s or "default").replace("/", "_").replace(":", "-")
    return f"{now:%Y%m%dT%H%M%SZ}-{safe(dataset)}-{safe(prompt_version)}"


def persist_run(run: DataFrame, folder: str, dataset: str, prompt_version: str | None, now: datetime | None = None) -> str:
    """Writes a run document under its run_name, which orders the history; returns the path.

    A name that another run of the same second has taken gets a number behind it, so neither is lost.
    """
    name = f"{folder}/{run_name(dataset, prompt_version, now)}"
    for n in range(100):
        path = f"{name}.json" if n == 0 else f"{name}_{n:02d}.json"
        try:
            run.coalesce(1).write.mode("errorifexists").json(path)
            return path
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise FileExistsError(name)


def append_ratings(ratings: DataFrame, path: str) -> DataFrame:
    """Adds id and created_at; ids are random. Ratings out of 1 to 5 are written to ``<path>-rejected`` and returned."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")
    rows = staged(ratings.withColumn("id", F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12)).withColumn("created_at", stamp), "ratings")
    good = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    rows.where(good).write.mode("append").json(path)
    rejected = rows.where(~good)
    if not rejected.isEmpty():
        rejected.write.mode("append").json(f"{path.rstrip('/')}-rejected")
    return rejected


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").parquet(path)


def run_label(dataset, provider, model, prompt_version):
    parts = [text.or_default(c, "default") for c in (dataset, provider, model, prompt_version)]
    return F.concat_ws("-", F.lit("eval"), *parts)
