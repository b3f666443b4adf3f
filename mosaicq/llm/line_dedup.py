"""Line dedup by site-relative frequency.

For each host, the share of its pages that contain a line; lines above the boilerplate ratio are
dropped from all pages of that host. Lines are compared whole, by a 64-bit hash, and counted once a
page; blank lines are neither counted nor dropped. A host has at most (distinct lines a page / ratio)
such lines, so they travel as one array a host, of which a text keeps those it has; whether these arrays are broadcast is decided by
their measured size, and beyond the bound a shuffled join takes over, whose hot hosts adaptive
execution splits. Counts are combined before the shuffle, and texts are not shuffled for counting.

Defined results: null text stays null (no lines), empty text stays empty; a null host is a host of
its own; repeated rows count as pages one by one; all columns of the input come back unchanged but
the text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import materialise

RATIO_PERCENT = 2
#: A line that one page alone has is not repeated, however few pages its host has; the ratio decides all else.
REPEATED = 2
BROADCAST_BYTES = 8 << 20
_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio_percent: int = RATIO_PERCENT, min_pages: int = REPEATED) -> DataFrame:
    """(host, line hash, pages with the line, pages of the host) of the lines above the ratio."""
    rows = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("n_pages"))
    once = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _filled), lambda x: F.xxhash64(x)))
    counts = rows.select("host", F.explode(once).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return (
        counts.alias("c")
        .join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
        .where(F.col("n") * 100 > F.col("n_pages") * ratio_percent)
        .select("c.host", "line", "n", "n_pages")
    )


def dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio_percent: int = RATIO_PERCENT, min_pages: int = REPEATED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(r: the input row, n_lines, n_dropped, text: what is left) of every row."""
    found = materialise(boilerplate(docs, host_col, text_col, ratio_percent, min_pages).groupBy("host").agg(F.collect_list("line").alias("drop")), "line-dedup")
    size = found.agg(F.coalesce(F.sum(F.size("drop") * 8 + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 64), F.lit(0))).first()[0]
    side = F.broadcast(found) if size <= broadcast_bytes else found
    rows = docs.select(F.struct("*").alias("r"))
    joined = rows.join(side.withColumnRenamed("host", "_host"), F.col(f"r.{host_col}").eqNullSafe(F.col("_host")), "left")
    text = F.col(f"r.{text_col}")
    # A hash join of the text's lines and the host's: only those that this text has are looked up line by line.
    joined = joined.withColumn("drop", F.array_intersect(F.transform(_lines(text), lambda x: F.xxhash64(x)), F.col("drop")))
    touched = F.size("drop") > 0
    kept = F.filter(_lines(text), lambda x: ~(_filled(x) & F.array_contains("drop", F.xxhash64(x))))
    left = F.when(touched, F.array_join(kept, "\n")).otherwise(text)
    n_lines = F.coalesce(F.size(F.filter(_lines(text), _filled)), F.lit(0)).cast("long")
    n_dropped = F.when(touched, F.size(_lines(text)) - F.size(kept)).otherwise(0)
    return joined.select("r", n_lines.alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), left.alias("text"))


def cleaned(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the lines dropped from its text, all other columns as they were."""
    out = dedup(docs, text_col=text_col, **options)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("r")[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its site's boilerplate lines dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return dedup(docs).select("r.doc_id", "n_lines", "n_dropped", "text")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT row, source, i, ls[i] AS line FROM (SELECT row, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT *, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> '' AS filled FROM l),
t AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
c AS (SELECT source, line, count(DISTINCT row) AS n FROM f WHERE filled GROUP BY source, line),
b AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 2 AND n * 100 > n_pages * 2),
m AS (SELECT f.*, b.line IS NOT NULL AND f.filled AS dropped FROM f LEFT JOIN b ON f.source IS NOT DISTINCT FROM b.source AND f.line = b.line),
g AS (SELECT row, sum(CAST(filled AS INTEGER)) AS n_lines, sum(CAST(dropped AS INTEGER)) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped) AS rest FROM m GROUP BY row)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text
FROM d LEFT JOIN g ON d.row = g.row
"""
