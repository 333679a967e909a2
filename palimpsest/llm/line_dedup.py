"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the pages of the host; lines above a
ratio are boilerplate there and go. A page has a bounded number of distinct lines on average, so a
host has at most that number over the ratio of such lines: what is joined back is small for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, named_apart, table

#: Lines in more than this share of a host's pages, and in this many pages at least, are boilerplate.
RATIO, PAGES = 0.05, 5
#: Boilerplate lines of all hosts (8 bytes each) that may be broadcast.
BROADCAST_LINES = 500_000
#: Parts into which the pages of a host are dealt if they are not.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: str, ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """Rows (host, line hashes) of the lines that exceed the ratio, blank ones aside."""
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select(F.col(host).alias("host"), F.explode(distinct).alias("line"))
    counts = counts.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    totals = totals.select(F.col("host").alias("h"), "pages")
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("boilerplate"))


def dedup_lines(pages: DataFrame, host: str = "source", ratio: float = RATIO, least: int = PAGES) -> DataFrame:
    """All rows and columns, with boilerplate lines gone from text, and n_lines and n_dropped.

    Lines are split at newlines and compared trimmed of spaces; blank lines stay. Null texts stay
    null and have no lines; a null host is a host of its own; repeated rows count as pages of
    their own; a page whose lines all go keeps an empty text; an empty table gives no rows.
    Columns named n_lines or n_dropped are replaced; others may have any names.
    """
    pages = pages.drop("n_lines", "n_dropped")
    site, found_lines, part, deal, left = (named_apart(c, pages) for c in ("site", "boilerplate", "part", "deal", "left_lines"))
    found = cut(boilerplate_lines(pages, host, ratio, least))
    held = found.agg(F.sum(F.size("boilerplate"))).first()[0] or 0
    named = found.select(F.col("host").alias(site), F.col("boilerplate").alias(found_lines))
    if held <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(named), F.col(host).eqNullSafe(F.col(site)), "left")
    else:
        salted = named.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn(deal, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col(host).eqNullSafe(F.col(site)) & (F.col(deal) == F.col(part)), "left").drop(deal, part)
    lines = _lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(found_lines, _key(x)) | (F.trim(x) == ""))
    joined = joined.withColumn(left, F.when(F.col(found_lines).isNull(), lines).otherwise(kept))
    n_lines = F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long")
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size(left)).cast("long")
    joined = joined.withColumn("n_lines", n_lines).withColumn("n_dropped", F.col("n_lines") - n_kept)
    return joined.withColumn("text", F.array_join(left, "\n")).drop(left, site, found_lines)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Replaces docs by docs without boilerplate lines; both have the columns of documents.
ORACLE_LINES = r"""
lines AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM numbered),
counts AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT rid) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL),
hosts AS (SELECT source, count(*) AS pages FROM numbered GROUP BY ALL),
bad AS (SELECT c.source, c.line FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n >= 5 AND n > 0.05 * pages),
judged AS (SELECT l.rid, l.pos, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line),
kept AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY rid)
"""

QUERIES = {"op4_line_dedup": query}
ORACLE_SQL = {
    "op4_line_dedup": f"""WITH numbered AS (SELECT row_number() OVER () AS rid, * FROM documents), {ORACLE_LINES}
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.text) END AS kept_sha256
FROM numbered d LEFT JOIN kept k USING (rid)"""
}
