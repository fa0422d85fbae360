"""Sharding by sampled splitters: shards of nearly equal bytes, each a run of rows in one order. DataFrame functions only.

Rows are ordered by a digest of the text, then of the id, so equal texts lie side by side. A size-weighted sample of
digests, every DRAWS-th of it in order, gives splitters, which cut the table into ranges; a splitter is a range of its
own, so a text that fills more than its share has one to itself. Such an overfull range is subdivided in the same way by
the next key, the digest of the id, and one that is still overfull (rows alike) by a row number, so no task holds more
than a few ranges' worth. Exact sums of all ranges then place every row: a row's shard is where the middle of it falls
in the running sum of bytes. Texts whose copies together take at most WHOLE of a shard are placed as one, so they
stay together; the copies of a larger one are placed one by one. So shards differ by a text or by WHOLE, and neither
shards nor slots depend on the sample, on the number of ranges or on the partitioning.

A row weighs its bytes plus the mean of all rows in the sample, so that very many short rows are found like a few long
ones. Only splitters, at most RANGES a level, pass through the driver.

A null text counts as empty: size 1, with the empty text's copies. Null ids are ordinary and tie with each other; rows that
tie are alike, so any of them may take any of their slots. A very long text is one row. An empty table gives no rows, a table of
fewer rows than shards leaves shards empty. Other columns are left out, or kept in a struct, so that no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import crc_sql, stage, table

SHARDS, WHOLE, IN_RANGE, RANGES, DRAWS = 8, 100, 50_000, (64, 1 << 16), 32
_KEYS = ("k0", "k1", "k2")


def digest(value: Column) -> Column:
    """The first 60 bits of a value's MD5, as a number."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, keep_row: bool) -> DataFrame:
    """doc_id, size, text_crc32 and the three keys of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest(text).alias("k0"),
        digest(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("k1"),
        F.monotonically_increasing_id().alias("k2"),
        *[F.struct("*").alias("row")] * keep_row,
    )


def _numbers(values: list[int]) -> Column:
    """A constant array; one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def placed(within: Column, key: Column, splitters: list[tuple[int, int]]) -> Column:
    """Twice the number of (range, key) splitters below, and one more where the row's own is a splitter."""
    if not splitters:
        return F.lit(0).cast("long")
    ranges, keys = (_numbers([s[i] for s in splitters]) for i in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])

    def step(at: Column, by: Column) -> Column:
        r, k = F.get(ranges, at + by - 1), F.get(keys, at + by - 1)
        return F.when((r < within) | ((r == within) & (k < key)), at + by).otherwise(at)

    below = F.aggregate(steps, F.lit(0), step)
    hit = lambda n: (F.get(ranges, n) == within) & (F.get(keys, n) == key)
    twice = F.transform(F.array(below), lambda n: n * 2 + F.when(hit(n), 1).otherwise(0))
    return F.element_at(twice, 1).cast("long")


def splitters_of(rows: DataFrame, within: Column, key: str, weight: Column, share: float) -> list[tuple[int, int]]:
    """(range, key) splitters of the rows, one for each ``share`` of weight in a range, from DRAWS size-weighted draws a share."""
    u = F.pmod(F.xxhash64(*_KEYS, F.lit(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(weight * F.lit(DRAWS / share) + u).cast("int")
    sample = rows.select(within.alias("p"), F.col(key).alias("k"), draws.alias("draws")).where("draws > 0")
    sample = sample.select("p", "k", F.explode(F.sequence(F.lit(1), "draws")).alias("draw"))
    every = F.filter(F.sort_array(F.collect_list("k")), lambda k, i: i % F.lit(DRAWS) == F.lit(DRAWS - 1))
    found = sample.groupBy("p").agg(F.array_distinct(every).alias("ks")).select("p", F.explode("ks").alias("k"))
    return sorted((r["p"], r["k"]) for r in found.collect())


def ranged(rows: DataFrame, n_rows: int, n_bytes: int, ranges: int) -> DataFrame:
    """Rows with the range (c0, c1, c2) of each, overfull ones subdivided by the next key."""
    weight = F.col("size") + F.lit(n_bytes / max(n_rows, 1))
    share = 2 * max(n_bytes, 1) / ranges
    out, within, part = rows, F.lit(0).cast("long"), rows
    for level, key in enumerate(_KEYS):
        splitters = splitters_of(part, within, key, weight, share) if part is not None else []
        out = out.withColumn(f"c{level}", placed(within, F.col(key), splitters))
        within, part = F.col(f"c{level}"), None
        if splitters:
            whole = out.groupBy(within.alias("c")).agg(F.sum(weight).alias("w")).where((F.col("w") > 2 * share) & (F.col("c") % 2 == 1))
            over = [r["c"] for r in whole.select("c").collect()]
            part = out.where(within.isin(over)) if over else None
    return out


def shard(
    docs: DataFrame,
    n_shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int | None = None,
    whole: int = WHOLE,
    keep_row: bool = False,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard) of every row; ``keep_row`` adds the input row as a struct.

    Copies of a text stay together where they take at most one part in ``whole`` of a shard.
    """
    rows = stage(sized(docs, id_col, text_col, keep_row), "shard-sized")
    n_rows, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(RANGES[1], max(RANGES[0], -(-n_rows // IN_RANGE), n_bytes >> 28))
    cells = ["c0", "c1", "c2"]
    rows = stage(ranged(rows, n_rows, n_bytes, ranges), "shard-ranged", done=[rows])
    # Ranges are a few times RANGES at most, whatever the table.
    sums = rows.groupBy(*cells).agg(F.sum("size").alias("in_cell"), F.count(F.lit(1)).alias("rows_in_cell"))
    order = Window.orderBy(*cells).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy("c0")
    sums = (
        sums.withColumn("before", F.sum("in_cell").over(order) - F.col("in_cell"))
        .withColumn("rows_before", F.sum("rows_in_cell").over(order) - F.col("rows_in_cell"))
        .withColumn("alone_start", F.min("before").over(first))
        .withColumn("alone_bytes", F.sum("in_cell").over(first))
        .drop("in_cell", "rows_in_cell")
    )
    sums = stage(sums, "shard-ranges")
    run = Window.partitionBy(*cells).orderBy("k0", "k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*cells, "k0")
    told = (
        rows.join(sums, cells)
        .withColumn("start", F.col("before") + F.sum("size").over(run) - F.col("size"))
        .withColumn("row_no", F.col("rows_before") + F.row_number().over(run) - 1)
        .withColumn("text_start", F.min("start").over(same))
        .withColumn("text_bytes", F.sum("size").over(same))
    )
    # A range of one text may be cut into several; its sums are those of the ranges.
    alone = F.col("c0") % 2 == 1
    start, copies = F.when(alone, F.col("alone_start")).otherwise(F.col("text_start")), F.when(alone, F.col("alone_bytes")).otherwise(F.col("text_bytes"))
    together = copies * F.lit(whole * n_shards) <= F.lit(n_bytes)
    twice = F.when(together, 2 * start + copies).otherwise(2 * F.col("start") + F.col("size"))
    told = told.select(
        "doc_id", "size", "text_crc32", "row_no", twice.alias("twice"), *["row"] * keep_row
    ).withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"twice * {n_shards} div {2 * max(n_bytes, 1)}")).cast("int"))
    told = stage(told, "shard-placed", done=[rows, sums])
    starts = told.groupBy("shard").agg(F.min("row_no").alias("first_no"))
    return told.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first_no")).alias("slot"), *["row"] * keep_row
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, files: int = 64, **options) -> None:
    """The rows of ``docs`` as Parquet, a folder a shard, in the order of their slots; ``files`` over all shards, about."""
    rows = shard(docs, n_shards, keep_row=True, **options)
    ordered = rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_sql(docs: str = "documents") -> str:
    """The same rows by one running sum over the whole table."""
    key = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"
    return f"""
WITH sized AS (
  SELECT doc_id, octet_length(encode(t)) + 1 AS size, {crc_sql('t')} AS text_crc32, {key.format('t')} AS k0, {key.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS k1
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM {docs})),
run AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY k0, k1 ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start, row_number() OVER (ORDER BY k0, k1) AS row_no,
         CAST(sum(size) OVER () AS BIGINT) AS total, CAST(sum(size) OVER (PARTITION BY k0) AS BIGINT) AS copies FROM sized),
mid AS (SELECT *, CASE WHEN copies * {WHOLE * SHARDS} <= total THEN 2 * min(start) OVER (PARTITION BY k0) + copies ELSE 2 * start + size END AS twice FROM run),
put AS (SELECT *, CAST(least({SHARDS - 1}, twice * {SHARDS} // (2 * total)) AS INTEGER) AS shard FROM mid)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_no - min(row_no) OVER (PARTITION BY shard) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM put"""
