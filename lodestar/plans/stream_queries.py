"""Streaming queries: each drains its table once; the oracle is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators import ingest
from lodestar.plans import sql
from lodestar.session import staged, table
from lodestar.sources.writers import Collection
from lodestar.streaming import streams


def stream_event_windows(spark, sf):
    out = streams.event_windows(streams.read_table(spark, f"{sf}/events.parquet"))
    done = streams.run_once(out, "windows", "complete")
    return done.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_dedup(spark, sf):
    events = streams.read_table(spark, f"{sf}/events.parquet")
    # Every event comes twice.
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    done = streams.run_once(streams.deduplicated(twice, "event_id").drop("copy"), "dedup")
    return done.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_ingest_chunks(spark, sf):
    out = streams.chunks(streams.read_table(spark, f"{sf}/documents.parquet"))
    return streams.run_once(out, "chunks").select("doc_id", "chunk_no", "tokens", F.md5("chunk_text").alias("chunk_md5"))


def arrivals(spark, sf, path: str, files: int = 6) -> None:
    """The events as files that come one after another, each event up to a day after its time, and a last one that ends the stream.

    An event of no user, long after the others, moves the watermark past them.
    """
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(DAY))
    ends = staged(events.withColumn("late", late), "arrivals")
    first, last = ends.agg(F.min("late"), F.max("late")).first()
    if first is None:
        return
    width = max(1, (last - first) // files + 1)
    for n in range(files):
        ends.where(F.floor((F.col("late") - F.lit(first)) / F.lit(width)) == n).drop("late").coalesce(1).write.mode("append").parquet(path)
    end = ends.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.write.mode("append").parquet(path)


def stream_rate_limit(spark, sf):
    """rate_limit_violations from events that come in late and out of order."""
    path = streams.shared(spark, "arrivals")
    arrivals(spark, sf, path)
    with streams.keyed_state(spark):
        events = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        done = streams.run_once(streams.rate_limited(events, 6 * 3600, 3, "2 days"), "rate-limit")
    return done.select("event_id", "user_id", "recent")


def stream_collection(spark, sf):
    """Documents that stream in from the files of their table into a collection: chunked, embedded, and put in place of their earlier points."""
    held = Collection(spark, streams.shared(spark, "collection"), vectors.DIMENSION, buckets=16)
    made = lambda batch: ingest.embedded(ingest.points(ingest.chunk_words(batch), F.col("doc_id").cast("string")))
    docs = streams.read_table(spark, f"{sf}/documents.parquet").select("doc_id", "text")
    # The second time, every document has a word more.
    for name, stream in (("collection", docs), ("collection-again", docs.withColumn("text", F.concat("text", F.lit(" again"))))):
        streams.drain(stream, name, lambda batch, number: held.upsert(made(batch)) and None)
    return held.read().select("doc_id", "chunk_id", "point_id", "tokens", F.size("embedding").alias("dimension"), F.md5("chunk_text").alias("chunk_md5"))


DAY = 86_400_000_000
QUERIES = {f.__name__: f for f in (stream_event_windows, stream_dedup, stream_ingest_chunks, stream_rate_limit, stream_collection)}
ORACLES = {
    "stream_rate_limit": "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3",
    "stream_collection": f"""WITH again AS (SELECT doc_id, text || ' again' AS text FROM documents), {sql.chunks(source='again')}
SELECT doc_id, doc_id || ':' || chunk_no AS chunk_id, CAST('0x' || substr(sha256(doc_id || ':' || chunk_no), 1, 15) AS BIGINT) AS point_id, tokens, 64::INTEGER AS dimension, md5(chunk_text) AS chunk_md5
FROM chunks WHERE len({sql.terms('chunk_text')}) > 0""",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "stream_ingest_chunks": f"WITH {sql.chunks()} SELECT doc_id, chunk_no, tokens, md5(chunk_text) AS chunk_md5 FROM chunks",
}
