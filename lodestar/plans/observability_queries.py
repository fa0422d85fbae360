"""Observability and guards over request logs, conversations, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import text
from lodestar.operators import observe
from lodestar.plans import sql
from lodestar.session import staged, table


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_config_cube(spark, sf):
    k = F.from_json("props", "k INT")["k"]
    rows = _events(spark, sf).select("event_type", F.pmod(k, F.lit(4)).alias("variant"), "value")
    return rows.cube("event_type", "variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def latency_percentiles(spark, sf):
    out = observe.latency(_events(spark, sf), ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95")])


def failure_rate_daily(spark, sf):
    out = observe.failure_rate(_events(spark, sf), F.col("event_type") == "error")
    return out.select(F.col("day").cast("string").alias("day"), "n", "failed", F.round("rate", 6).alias("rate"))


def metric_timeline(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    daily = _events(spark, sf).groupBy("event_type", day).agg(F.round(F.avg("value"), 6).alias("value"))
    out = observe.timeline(daily, "event_type", "day", "value")
    return out.select("event_type", "day", "value", "previous", F.round("moving", 4).alias("moving"))


def conversation_traces(spark, sf):
    out = observe.traces(table(spark, sf, "conversations"))
    return out.select("conv_id", "n_events", "chars", "events")


def _calls(spark, sf):
    """Each assistant turn is a call: the words before it go in, its own come out; the event of the conversation's number is its log entry."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = text.word_count(F.col("text")).cast("long")
    turns = table(spark, sf, "conversations").withColumn("n", n).withColumn("tokens_in", F.coalesce(F.sum("n").over(before), F.lit(0)))
    said = turns.where("role = 'assistant'").select("conv_id", "turn", "tokens_in", F.col("n").alias("tokens_out"))
    version = F.concat(F.lit("v"), F.pmod(F.from_json("props", "k INT")["k"], F.lit(3)).cast("string"))
    log = _events(spark, sf).select(F.col("event_id").alias("conv_id"), "ts", F.col("event_type").alias("model"), version.alias("prompt_version"), F.col("value").alias("latency"))
    return said.join(log, "conv_id", "left")


def _prices(spark, sf):
    """A price of each model for every week of the log, valid from its first event there."""
    week = F.date_trunc("week", "ts").alias("week")
    weekly = _events(spark, sf).groupBy(F.col("event_type").alias("model"), week).agg(F.min("ts").alias("valid_from"), F.round(F.avg("value"), 4).alias("price_in"))
    return weekly.select("model", "valid_from", "price_in", (3 * F.col("price_in")).alias("price_out"))


def call_usage(spark, sf):
    out = observe.call_costs(_calls(spark, sf), _prices(spark, sf))
    return out.select("conv_id", "turn", "model", "prompt_version", "tokens_in", "tokens_out", "latency", "price_in", F.round("cost", 6).alias("cost"))


def usage_by_configuration(spark, sf):
    out = observe.usage(observe.call_costs(_calls(spark, sf), _prices(spark, sf)), ["model", "prompt_version"])
    return out.select("model", "prompt_version", "calls", "tokens_in", "tokens_out", F.round("cost", 4).alias("cost"), F.round("latency", 6).alias("latency"), "unpriced")


def sketched_configurations(spark, sf):
    """Users and values by any configuration from stored sketches of days, held against exact figures.

    The sketches of a day, a kind of event and a variant are stored; the configurations are made from them alone. ``users_near`` tells whether
    the estimate of users is within 5 %, ``ranks_near`` whether the estimated median and 95th percentile have the ranks they should, to 2 %.
    """
    day, variant = F.date_format("ts", "yyyy-MM-dd"), F.pmod(F.from_json("props", "k INT")["k"], F.lit(4))
    events = _events(spark, sf).select(day.alias("day"), "event_type", variant.alias("variant"), "user_id", "value")
    stored = staged(observe.sketched(events, ["day", "event_type", "variant"], "user_id", "value"), "sketches")
    out = None
    for by in (["event_type"], ["variant"], ["event_type", "variant"], ["day"]):
        told = observe.told_by_sketches(observe.merged_sketches(stored, by)).withColumnRenamed("n", "told")
        rows = events.join(told, by)
        exact = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("told").alias("told"), F.max("distinct").alias("distinct"),
            *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_below") for p in ("p50", "p95")],
            *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_upto") for p in ("p50", "p95")],
        )
        near = [(F.col(f"{p}_below") <= share + 0.02) & (F.col(f"{p}_upto") >= share - 0.02) for p, share in (("p50", 0.5), ("p95", 0.95))]
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
        part = exact.select(
            F.lit(",".join(by)).alias("configuration"), key.alias("part"), "n", "users", (F.col("told") == F.col("n")).alias("n_same"),
            (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("users_near"), (near[0] & near[1]).alias("ranks_near"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def rate_limit_violations(spark, sf):
    return observe.over_limit(_events(spark, sf), 6 * 3600, 3).select("event_id", "user_id", "recent")


def pii_redaction(spark, sf):
    clean = text.redact(F.col("text"))
    marks = [(F.length(clean) - F.length(F.replace(clean, F.lit(m)))).cast("int") for m in ("[email]", "[ip]", "[phone]")]
    return table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), *[m.alias(n) for m, n in zip(marks, ("email_chars", "ip_chars", "phone_chars"))])


def injection_flags(spark, sf):
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), text.injected(F.col("html")).alias("flag"))
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), text.injected(F.col("text")).alias("flag"))
    return pages.unionByName(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"))


def user_sessions(spark, sf):
    """Sessions of a user end after 30 idle minutes."""
    s = F.session_window("ts", "30 minutes")
    out = _events(spark, sf).groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "value")


QUERIES = {f.__name__: f for f in (
    run_config_cube, latency_percentiles, failure_rate_daily, metric_timeline, conversation_traces, rate_limit_violations, pii_redaction, injection_flags, user_sessions,
    call_usage, usage_by_configuration, sketched_configurations,
)}

_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(text, '{text.EMAIL}', '[email]', 'g'), '{text.ADDRESS}', '[ip]', 'g'), '{text.PHONE}', '[phone]', 'g')"
_WORDS = sql.words("text")
_COSTS = f"""turns AS (SELECT *, CAST(len({_WORDS}) AS BIGINT) AS n FROM conversations),
said AS (SELECT * FROM (SELECT conv_id, turn, role, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_in, n AS tokens_out FROM turns) WHERE role = 'assistant'),
calls AS (SELECT said.*, ts, event_type AS model, 'v' || (CAST(json_extract(props, '$.k') AS INTEGER) % 3) AS prompt_version, value AS latency FROM said LEFT JOIN events ON event_id = conv_id),
prices AS (SELECT event_type AS model, min(ts) AS valid_from, round(avg(value), 4) AS price_in FROM events GROUP BY event_type, date_trunc('week', ts)),
priced AS (SELECT c.*, price_in, (tokens_in * price_in + tokens_out * (3 * price_in)) / 1000.0::DOUBLE AS cost FROM calls c ASOF LEFT JOIN prices p ON c.model = p.model AND c.ts >= p.valid_from)"""
_CONFIGURED = "SELECT '{0}' AS configuration, {1} AS part, count(*) AS n, count(DISTINCT user_id) AS users, true AS n_same, true AS users_near, true AS ranks_near FROM e GROUP BY {0}"
_CHARS = "CAST(length(c) - length(replace(c, '{0}', '')) AS INTEGER)"
ORACLES = {
    "call_usage": f"WITH {_COSTS} SELECT conv_id, turn, model, prompt_version, tokens_in, tokens_out, latency, price_in, round(cost, 6) AS cost FROM priced",
    "usage_by_configuration": f"WITH {_COSTS} SELECT model, prompt_version, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 4) AS cost, round(avg(latency), 6) AS latency, count(*) FILTER (WHERE cost IS NULL) AS unpriced FROM priced GROUP BY model, prompt_version",
    "sketched_configurations": "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS variant, user_id FROM events) "
    + " UNION ALL ".join(_CONFIGURED.format(",".join(by), " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in by)) for by in (["event_type"], ["variant"], ["event_type", "variant"], ["day"])),
    "run_config_cube": "SELECT event_type, variant, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS variant, value FROM events) GROUP BY CUBE (event_type, variant)",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type",
    "failure_rate_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1",
    "metric_timeline": "WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2) SELECT event_type, day, value, lag(value) OVER w AS previous, round(avg(value) OVER (w ROWS 6 PRECEDING), 4) AS moving FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
    "conversation_traces": """SELECT conv_id, count(*) AS n_events, CAST(sum(length(text)) AS BIGINT) AS chars, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) || ']' AS events FROM conversations GROUP BY conv_id""",
    "rate_limit_violations": "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 3",
    "pii_redaction": f"SELECT doc_id, md5(c) AS clean_md5, {_CHARS.format('[email]')} AS email_chars, {_CHARS.format('[ip]')} AS ip_chars, {_CHARS.format('[phone]')} AS phone_chars FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "injection_flags": f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE flag) AS flagged FROM (SELECT 'page' AS kind, coalesce(regexp_matches(html, '{text.INJECTION}'), false) AS flag FROM pages UNION ALL SELECT 'document', coalesce(regexp_matches(text, '{text.INJECTION}'), false) FROM documents) GROUP BY kind",
    "user_sessions": """WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, sid""",
}
