"""Line dedup by site-relative frequency (operator 5).

A line's frequency on a host is the number of the host's pages that contain it,
over the number of the host's pages.  Lines above `max_ratio` (and on at least
`min_pages` pages, so that small hosts keep their text) are boilerplate and are
dropped from that host's pages.

Lines are parts between newlines, compared without the white space at their
ends.  Only digests of lines are shuffled, each once per page and summed before
the shuffle, so a line on a third of all pages is no hot key.  A host has at
most (lines per page / max_ratio) boilerplate lines; the table of them is
broadcast after its size is known, and else joined by host and a salt.

With `distinct`, pages of a host with one text count as one page, both in a
line's count and in the host's: text that was copied onto many pages is no
boilerplate, and stays for a later dedup of documents.  The pipeline works so,
with `SITE_RATIO`; the query of this operator counts rows, as its SQL does.

Cases: blank lines are kept and never counted; null texts are pages without
lines and stay null; empty texts stay empty; a null host is a host; repeated
rows are pages each; rows with a null id are kept; other columns are carried
along only if named, whatever other names there are; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._store import stored

MAX_RATIO, MIN_PAGES = 0.02, 5
#: A ratio over distinct pages that site furniture reaches and lines of common text don't.
SITE_RATIO = 0.06
#: Digests of boilerplate lines (32 characters each) that may be broadcast.
MAX_BROADCAST_LINES = 200_000
SALTS = 64


def _digest(line: Column) -> Column:
    return F.md5(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


_BLANK = "d41d8cd98f00b204e9800998ecf8427e"  # of the empty string


def boilerplate_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(host, lines array<string>): digests of the boilerplate lines of each host that has some. distinct: pages of a host with one text are one page."""
    pages = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), _digest)).alias("lines")
    if distinct:  # copies meet in their task first; what is shuffled are digests
        pages = pages.select("host", F.md5("text").alias("page"), lines)
        found = pages.groupBy("host", "page").agg(F.first("lines").alias("lines")).select("host", F.explode("lines").alias("line"))
        pages = pages.select("host", "page").distinct()
    else:
        found = pages.select("host", lines).select("host", F.explode("lines").alias("line"))
    found = found.filter(F.col("line") != _BLANK).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "h")
    kept = found.join(totals, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return kept.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., kept_text, n_lines, n_dropped) for each row."""
    lines = stored(boilerplate_lines(df, host_col, text_col, max_ratio, min_pages, distinct), "boilerplate").select(F.col("host").alias("h"), "lines")
    size = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{host_col}`").alias("host"), *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep))]
    pages = df.select(*cols)
    if size <= MAX_BROADCAST_LINES:
        pages = pages.join(F.broadcast(lines), F.col("host").eqNullSafe(F.col("h")), "left")
    else:  # a host with a third of all pages is dealt to SALTS tasks
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)))
        lines = lines.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.join(lines, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("salt2")), "left")
    every = F.split("text", "\n", -1)
    left = F.when(F.col("lines").isNull(), every).otherwise(F.filter(every, lambda x: ~F.array_contains(F.col("lines"), _digest(x))))
    pages = pages.withColumn("left", left)
    n = F.coalesce(F.size(every), F.lit(0))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long")
    kept = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("left")).cast("long")
    return pages.select(
        F.col("id").alias(id_col), *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)),
        F.when(F.col("text").isNotNull(), F.array_join("left", "\n")).alias("kept_text"), n.alias("n_lines"), (n - kept).alias("n_dropped"),
    )


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` without the lines that are boilerplate on their source, as counts and a digest."""
    out = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS page FROM documents),
lines AS (SELECT DISTINCT page, source, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS line FROM pages)),
counts AS (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line HAVING count(*) >= 5),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n > t.pages * 0.02),
parts AS (SELECT p.page, p.source, s.pos, s.line FROM pages p, LATERAL (SELECT unnest(string_split(p.text, chr(10))) AS line, generate_subscripts(string_split(p.text, chr(10)), 1) AS pos) s),
judged AS (SELECT q.page, q.pos, q.line, b.line IS NOT NULL AS gone FROM parts q LEFT JOIN boiler b ON q.source IS NOT DISTINCT FROM b.source AND trim(q.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = b.line),
done AS (SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM judged GROUP BY page)
SELECT p.doc_id, CAST(coalesce(d.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(d.n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(CASE WHEN p.text IS NOT NULL THEN coalesce(d.kept, '') END) AS BIGINT) AS n_chars_kept, sha256(CASE WHEN p.text IS NOT NULL THEN coalesce(d.kept, '') END) AS kept_sha256
FROM pages p LEFT JOIN done d USING (page)
"""
