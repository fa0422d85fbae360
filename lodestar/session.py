"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "lodestar") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LODESTAR_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_KEY, os.environ.get("LODESTAR_CHECKPOINT_DIR", "/tmp/lodestar-checkpoints"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only a local session may do without naming one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or os.environ.get("LODESTAR_CHECKPOINT_DIR")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return named or "/tmp/lodestar-checkpoints"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back: computed once, whoever reads it; gone with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def on_workers(query):
    """``query`` with this checkout on the Python workers' path, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)
        return query(spark, *args)

    return run
