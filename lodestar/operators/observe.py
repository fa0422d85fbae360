"""Request logs, traces, metric timelines and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import staged


#: Different values that a task puts in order at most, parts into which a longer range is cut, and the accuracy of the sketch that cuts it.
LAST, CUTS, ACCURACY = 50_000, 64, 2000


def latency(events: DataFrame, by: list[str], value: str = "value", shares: tuple[float, ...] = (0.5, 0.95), last: int = LAST) -> DataFrame:
    """Count, mean and exact percentiles, interpolated, of each group, by distributed selection; null values count as rows only.

    Each group starts as one range. A range of more than ``last`` values is cut into CUTS parts at approximate quantiles, the
    rows of the parts are counted, and those that hold a wanted rank are the next ranges; equal values are one, with their
    count. A part has about one CUTS-th of the values of its range, so a few rounds leave ranges that one task puts in order, however
    large a group is. Only the first round, and only for groups over ``last`` rows, reads the table more than twice. Columns are
    p50, p95 and so on, by share.
    """
    rows = events.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v"))
    groups = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("m"), F.avg("v").alias("mean")), "latency-groups")
    places = [F.lit(p) * (F.col("m") - 1) for p in shares]
    ranks = groups.select("g", F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]).alias("ranks"))
    # A range is known by its group and the number of the group's rows before it.
    held = rows.where("v is not null").select("g", F.lit(0).cast("long").alias("before"), "v", F.lit(1).cast("long").alias("c"))
    ranges = groups.select("g", F.lit(0).cast("long").alias("before"), F.col("m").alias("values"))
    ends = []
    while True:
        short = ranges.where(F.col("values") <= last).select("g", "before")
        ends.append(held.join(short, ["g", "before"]).groupBy("g", "before", "v").agg(F.sum("c").alias("c")))
        long = ranges.where(F.col("values") > last).select("g", "before")
        if long.isEmpty():
            break
        part = held.join(long, ["g", "before"])
        cuts = part.groupBy("g", "before").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], ACCURACY).alias("cuts"))
        cuts = staged(cuts.join(ranks, "g"), "latency-cuts")
        parted = part.join(cuts.select("g", "before", "cuts"), ["g", "before"]).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v"))))
        upto = F.sum("inside").over(Window.partitionBy("g", "before").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = parted.groupBy("g", "before", "part").agg(F.sum("c").alias("inside")).withColumn("start", F.col("before") + upto - F.col("inside"))
        within = F.exists("ranks", lambda r: (F.col("start") <= r) & (r < F.col("start") + F.col("inside")))
        wanted = counted.join(cuts.select("g", "before", "ranks"), ["g", "before"]).where(within).select("g", "before", "part", "start")
        held = staged(
            parted.drop("cuts").join(staged(wanted, "latency-parts"), ["g", "before", "part"]).groupBy("g", F.col("start").alias("before"), "v").agg(F.sum("c").alias("c")),
            "latency-values",
        )
        ranges = staged(held.groupBy("g", "before").agg(F.count(F.lit(1)).alias("values")), "latency-ranges")
    ordered = F.sum("c").over(Window.partitionBy("g", "before").orderBy("v"))
    placed = reduce(DataFrame.unionByName, ends).withColumn("upto", F.col("before") + ordered)
    # The value of a rank is the least one with more rows up to it.
    at = lambda i: F.min(F.when(F.col("upto") > F.get("ranks", F.lit(i)), F.col("v"))).alias(f"v{i}")
    found = placed.join(ranks, "g").groupBy("g").agg(*[at(i) for i in range(2 * len(shares))])
    between = lambda x, low, high: F.col(low) + (x - F.floor(x)) * (F.col(high) - F.col(low))
    names = [f"p{round(100 * p, 4):g}" for p in shares]
    return groups.join(found, "g", "left").select(
        *[F.col("g")[c].alias(c) for c in by], "n", "mean", *[between(x, f"v{2 * i}", f"v{2 * i + 1}").alias(name) for i, (x, name) in enumerate(zip(places, names))]
    )


def failure_rate(events: DataFrame, failed) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").alias("day")
    return events.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), (F.count_if(failed) / F.count(F.lit(1))).alias("rate"))


def timeline(daily: DataFrame, key: str, order: str, value: str, days: int = 7) -> DataFrame:
    """Each value with the one before and the mean over the last ``days`` rows."""
    w = Window.partitionBy(key).orderBy(order)
    return daily.withColumn("previous", F.lag(value).over(w)).withColumn("moving", F.avg(value).over(w.rowsBetween(1 - days, 0)))


def over_limit(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Events of a user with more than ``limit`` events in the ``seconds`` up to and with it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn("at", at).withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > limit).drop("at")


def traces(turns: DataFrame) -> DataFrame:
    """Conversation turns as one trace per conversation: its inputs and ordered events; a conversation is short."""
    event = F.struct("turn", "role", F.length("text").alias("chars"))
    events = F.array_sort(F.collect_list(event))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.length("text")).alias("chars"), F.to_json(events).alias("events"))


def sorted_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames over the sorted union of their columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def metric_rows(scores: DataFrame, metrics: tuple[str, ...], prefix: str = "eval/") -> DataFrame:
    """(…metrics) -> name, value with the prefix and without nulls."""
    long = scores.select(*metrics).unpivot([], list(metrics), "name", "value")
    return long.where("value is not null").select(F.concat(F.lit(prefix), "name").alias("name"), "value")


def as_of(rows: DataFrame, dated: DataFrame, by: list[str], at: str, since: str, hours: int = 24) -> DataFrame:
    """Each row with the columns of the ``dated`` row of its key that was last in force at its time; nulls where none was.

    A dated row holds from ``since`` until the next of its key; of several with one time the greatest digest holds. Its time is cut into
    bins, as far as ``rows`` reach, and rows meet it in their own bin: an equi-join on key and bin, which may be split where one
    is hot, instead of a range condition over all of a key. In a bin, a row meets what changed there and one more.
    """
    step = hours * 3_600_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last, first = rows.agg(F.max(micros(at)), F.min(micros(at))).first()
    order = Window.partitionBy(*by).orderBy("_since")
    whole = F.xxhash64(F.to_json(F.struct(*sorted(dated.columns))))
    once = dated.withColumn("_since", micros(since)).withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_since").orderBy(F.desc(whole))))
    spans = once.where("_place = 1").drop("_place").withColumn("_until", F.lead("_since").over(order))
    bins = F.sequence(
        F.floor(F.greatest(F.col("_since"), F.lit(first or 0)) / step), F.floor(F.least(F.coalesce(F.col("_until") - 1, F.lit(last or 0)), F.lit(last or 0)) / step)
    )
    reach = (F.col("_since") <= F.lit(last or 0)) & (F.col("_until").isNull() | (F.col("_until") > F.lit(first or 0)))
    spread = spans.where(reach).withColumn("_bin", F.explode(bins)).withColumnsRenamed({c: f"_{c}" for c in by})
    placed = rows.withColumn("_at", micros(at)).withColumn("_in", F.floor(F.col("_at") / step))
    same = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_in") == F.col("_bin"), F.col("_since") <= F.col("_at")]
    held = reduce(lambda a, b: a & b, same) & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
    return placed.join(spread, held, "left").drop("_at", "_in", "_bin", "_since", "_until", *[f"_{c}" for c in by])


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, ts, tokens_in, tokens_out) with their cost, by the price for a thousand tokens that was valid then."""
    priced = as_of(calls, prices.select("model", "valid_from", "price_in", "price_out"), ["model"], "ts", "valid_from")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / F.lit(1000.0)
    return priced.withColumn("cost", cost).drop("valid_from")


def usage(priced: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens, cost and mean latency by configuration; calls without a price count, and are told."""
    return priced.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"),
        F.avg("latency").alias("latency"), F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )


#: Of the stored sketches: the 2^12 least hashes for distinct counts (exact below, else a standard error of 1.6 %), whose union is the
#: same in any order, and k for quantiles (rank error 0.7 % at 99 %).
LOG_HASHES, QUANTILE_K = 12, 400


def sketched(events: DataFrame, by: list[str], who: str, value: str) -> DataFrame:
    """One row for each combination of ``by``, with its count and sketches that can be merged: distinct ``who``, quantiles of ``value``."""
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(who, LOG_HASHES).alias("who"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("quantiles")
    )


def merged_sketches(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches by fewer columns; in any number of steps and any order."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.theta_union_agg("who", LOG_HASHES).alias("who"), F.kll_merge_agg_double("quantiles", QUANTILE_K).alias("quantiles")
    )


def told_by_sketches(stored: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The estimates that the sketches hold: distinct, and p50, p95 and so on."""
    names = [f"p{round(100 * p, 4):g}" for p in shares]
    return stored.withColumn("distinct", F.theta_sketch_estimate("who")).withColumns(
        {name: F.kll_sketch_get_quantile_double("quantiles", F.lit(p)) for name, p in zip(names, shares)}
    ).drop("who", "quantiles")
