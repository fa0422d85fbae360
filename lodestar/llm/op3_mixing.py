"""Mixing sources to target weights by weighted exponential keys.

Targets: the sources share a budget of words by weight; a target stops at a multiple of its source's size and
the excess is reshared by weight until none is above (water filling, in closed form over the sources table).
Selection: a source whose target holds whole copies of it takes those complete epochs first. The rest of the
budget is drawn without replacement by Efraimidis-Spirakis keys, -ln(u) / quality, ascending, with a running
sum of sizes: a document is in if the budget reaches past its middle. Keys come from MD5 of id, text digest and seed,
so reruns and any partitioning agree; equal rows tie and are then indistinguishable.

No source is ever gathered in one task: each is cut into bins of the key's own distribution, bins are
summed, and only the one bin in which the budget ends is sorted. Bins follow the distribution at the greatest and at the
least quality together, so neither kind of document crowds the last ones, and their number grows with the table, one for
IN_BIN rows; the result is the same for any number.

Null, empty or wordless texts have size 0 and take 0 words. A null source is a source of its own, ranked last.
Null ids are ordinary ids. Very long texts count whole, and one may overshoot by half its size. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import stage, table

WEIGHTS, SHARE, CEILING, IN_BIN, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 100_000, "mix-1"
LEAST_QUALITY = 0.05


def n_words(text: Column) -> Column:
    """Words of a text: starts of runs outside ASCII white space; a null text has none."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(plain, " +"), lambda w: w != "")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight in [LEAST_QUALITY, 1]: one less five times the share of characters that are symbols."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) - symbols * F.lit(5.0) / (F.length(text) + F.lit(1)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) -> plus target. One row per source goes through the windows."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(w, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # In ascending order of cap / weight, a source is capped if the level, with all before it capped, reaches it. From the
    # first that is not, levels fall, as they take more caps off than those sources use: the greatest is the water's.
    levels = (
        weighted.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("before", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("water") * F.col("weight"))
    )
    return levels.select("source", "source_size", target.alias("target"))


def random_key(id_col: Column, text: Column, seed: str) -> Column:
    """-ln(u) / quality, with u in (0, 1) from the first 52 bits of a digest."""
    name = F.concat_ws(
        ":", F.coalesce(id_col.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed)
    )
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / quality(text)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    ceiling: float = CEILING,
    bins: int | None = None,
    seed: str = SEED,
    keep_row: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; ``keep_row`` adds the input row as a struct."""
    bins = bins or min(1 << 16, max(1024, docs.count() // IN_BIN))
    below = lambda rate: F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.lit(rate))) * F.lit(bins))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        random_key(F.col(id_col), F.col(text_col), seed).alias("key"),
        *[F.struct("*").alias("row")] * keep_row,
    ).withColumn("slot", (below(1.0) + below(LEAST_QUALITY)).cast("int"))
    if not keep_row:
        sized = stage(sized, "mix-sized")
    # Both tables below have at most a row per source and bin, whatever the number of documents.
    slots = stage(sized.groupBy("source", "slot").agg(F.sum("size").alias("in_slot")), "mix-slots")
    sizes = slots.groupBy("source").agg(F.sum("in_slot").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = (
        targets(sizes, weights, share, ceiling)
        .withColumn("epochs", whole)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = slots.withColumn("upto", F.sum("in_slot").over(upto))
    cut = (
        reached.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .groupBy("of", "source_size", "target", "epochs", "rest")
        .agg(F.min(F.when((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")), F.struct("slot", "upto", "in_slot"))).alias("edge"))
        .select("of", "source_size", "target", "epochs", "rest", F.col("edge.slot").alias("edge"), (F.col("edge.upto") - F.col("edge.in_slot")).alias("below"))
    )
    # A row per source: small enough for Catalyst to broadcast by its measured size, and else a skew join.
    joined = sized.join(stage(cut, "mix-cut"), F.col("source").eqNullSafe(F.col("of")))
    last = F.coalesce(F.col("slot") == F.col("edge"), F.lit(False))
    run = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    sure = joined.where(~last).withColumn("drawn", F.coalesce(F.col("slot") < F.col("edge"), F.lit(False)))
    edge = joined.where(last).withColumn(
        "drawn", F.col("below") + F.sum("size").over(run) - F.col("size") / F.lit(2.0) <= F.col("rest")
    )
    taken = F.col("epochs") * F.col("size") + F.when(F.col("drawn"), F.col("size")).otherwise(F.lit(0))
    return sure.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *["row"] * keep_row
    )


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with the columns of ``docs``."""
    mixed = mix(docs, keep_row=True).where("taken > 0")
    times = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return mixed.select("row", times.alias("epoch")).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_GAPS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def mix_sql(docs: str = "documents") -> str:
    """The same rows by one sorted running sum per source."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, text,
         CAST(len(list_filter(string_split(translate(coalesce(text, ''), {_GAPS}, '     '), ' '), lambda w: w <> '')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')), '{SEED}')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE)
           / greatest(0.05::DOUBLE, 1.0::DOUBLE - (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) * 5.0::DOUBLE / (length(coalesce(text, '')) + 1)) AS key
  FROM {docs}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, source_size * {CEILING}::DOUBLE AS cap, [{', '.join(f'{x}::DOUBLE' for x in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INT) + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sizes),
ranked AS (
  SELECT *, (sum(source_size) OVER ()) * {SHARE}::DOUBLE AS budget,
         sum(cap) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) - cap AS before,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, rk ROWS UNBOUNDED PRECEDING) + weight AS weight_left
  FROM weighted),
levels AS (SELECT *, (budget - before) / weight_left AS lev, (budget - before) / weight_left * weight >= cap AS capped FROM ranked),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, (max(lev) FILTER (WHERE NOT capped) OVER ()) * weight) END AS target
  FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
drawn AS (
  SELECT s.*, g.source_size, g.target, g.epochs,
         g.target - g.epochs * g.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN rests g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN rest > 0 AND middle <= rest THEN size ELSE 0 END AS BIGINT) AS taken
FROM drawn"""
