"""Site-relative line dedup: drop lines that too large a share of a site's pages contain.

Lines are counted once per page and site, with partial sums before the shuffle; a line is boilerplate when its
pages exceed ``ratio`` of the site's. A site has at most (mean lines per page) / ratio such lines, whatever its
size, so they travel as one array per site; Catalyst broadcasts that table if its measured size allows and
otherwise joins by site, where adaptive execution splits a hot site.

Lines are compared without leading and trailing ASCII white space; blank lines are neither counted nor
dropped; a dropped line goes with its line break and what stays is unchanged. A site of fewer than ``min_pages`` rows
is judged too: it loses lines on two pages or more whose share exceeds a bound that falls evenly from 1 to ``ratio`` at
``min_pages``, so no site is exempt at any table size. Rows without a site keep every line. A null text stays null with no
lines; a very long one is cut into lines like others. Repeated rows count as pages of their own. An empty table gives no
rows. Input columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import stage, table

RATIO, MIN_PAGES = 0.2, 10
#: Scripts, styles and comments, whole; then any tag. Each becomes a line break.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]+>"
BLANK = " \t\x0b\x0c\r"


def html_lines(html: Column) -> Column:
    """Text of a page, one line between any two tags, without blank lines."""
    lines = F.split(F.regexp_replace(html, MARKUP, "\n"), "\n")
    trimmed = F.transform(lines, lambda x: F.trim(x, F.lit(BLANK)))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.nullif(host, F.lit(""))


def _keys(lines: Column) -> Column:
    trimmed = F.transform(lines, lambda x: F.trim(x, F.lit(BLANK)))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.xxhash64(x))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, text) -> one row per site with boilerplate: site, boiler (hashes of its lines)."""
    pages = pages.where(F.col("site").isNotNull())
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    short = F.lit(1.0) - F.col("n_pages") / F.lit(min_pages)
    bound = F.when(F.col("n_pages") >= min_pages, F.lit(ratio)).otherwise(F.lit(ratio) + F.lit(1.0 - ratio) * short)
    least = F.when(F.col("n_pages") >= min_pages, 1).otherwise(2)
    found = (
        pages.select("site", F.explode(F.array_distinct(_keys(F.split("text", "\n")))).alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        found.join(totals, "site")
        .where((F.col("n") > bound * F.col("n_pages")) & (F.col("n") >= least))
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("line")).alias("boiler"))
    )


def drop_lines(docs: DataFrame, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every row as: row (the input row), site, n_lines, n_dropped, kept_text."""
    pages = docs.select(F.struct("*").alias("row"), site.alias("site"), text.alias("text"))
    boiler = stage(boilerplate(pages.select("site", "text"), ratio, min_pages), "site-lines")
    joined = pages.join(boiler, "site", "left").withColumn("lines", F.split("text", "\n"))
    drop = lambda x: F.array_contains(F.col("boiler"), F.xxhash64(F.trim(x, F.lit(BLANK))))
    filled = F.filter("lines", lambda x: F.trim(x, F.lit(BLANK)) != "")
    kept = F.filter("lines", lambda x: (F.trim(x, F.lit(BLANK)) == "") | ~drop(x))
    counted = joined.withColumn("kept", F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(kept))
    return counted.select(
        "row",
        "site",
        F.coalesce(F.size(filled), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def line_stage(docs: DataFrame, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines of each site gone from the text, and n_chars, if there, measured anew."""
    new = {text_col: F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    out = drop_lines(docs, F.col(site_col), F.col(text_col))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = drop_lines(pages, url_host(F.col("url")), html_lines(F.col("html")))
    return out.select(
        F.col("row.page_id").alias("page_id"), F.col("site").alias("host"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def line_sql() -> str:
    blank = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH cleaned AS (
  SELECT page_id, nullif(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS site,
         list_filter(list_transform(string_split(regexp_replace(html, '{MARKUP}', chr(10), 'g'), chr(10)), lambda x: trim(x, {blank})), lambda x: x <> '') AS lines
  FROM pages),
per_line AS (SELECT site, line, count(*) AS n FROM (SELECT site, unnest(list_distinct(lines)) AS line FROM cleaned WHERE site IS NOT NULL) GROUP BY ALL),
totals AS (SELECT site, count(*) AS n_pages FROM cleaned WHERE site IS NOT NULL GROUP BY site),
bounds AS (SELECT *, CASE WHEN n_pages >= {MIN_PAGES} THEN {RATIO}::DOUBLE ELSE {RATIO}::DOUBLE + {1 - RATIO}::DOUBLE * (1.0::DOUBLE - n_pages / {MIN_PAGES}::DOUBLE) END AS bound, CASE WHEN n_pages >= {MIN_PAGES} THEN 1 ELSE 2 END AS least FROM totals),
boiler AS (SELECT site, list(line) AS bad FROM per_line JOIN bounds USING (site) WHERE n > bound * n_pages AND n >= least GROUP BY site)
SELECT page_id, c.site AS host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(lines, lambda x: list_contains(coalesce(bad, []), x))), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)), '')) AS kept_sha256
FROM cleaned c LEFT JOIN boiler b ON c.site = b.site"""
