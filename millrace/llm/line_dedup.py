"""Line dedup by site-relative frequency.

Native: DataFrame operations only.

A line is boilerplate of a host if the share of the host's pages that hold it is
above a ratio; such lines are cut from that host's pages. Lines are compared
without the white space around them; blank lines are neither counted nor cut.

The first pass counts (host, line) with partial sums before the shuffle; a line
stands as two 64-bit hashes of different seeds, so no text is shuffled. At
most (mean distinct lines of a page) / ratio lines of a host can be above the
ratio, so the lines to drop fit one small row per host even for a host with a
third of all pages. The second pass brings that row to the host's pages: by a
broadcast if all of them together are under a checked size, else by a sort
merge join, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, fresh, null_safe_join, table

RATIO, MIN_PAGES = 0.2, 5
#: Dropped lines of all hosts together up to which they are broadcast, 16 bytes each.
BROADCAST_LINES = 250_000

SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, host: str, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, dropped): for each host with any, the marks of the lines on more than ``ratio`` of its pages and on ``min_pages`` at least."""
    own = F.transform(F.array_distinct(F.filter(F.transform(lines, bare), lambda x: x != "")), mark)
    slim = pages.select(F.col(host).alias("host"), own.alias("own"))
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = slim.select("host", F.inline("own")).groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = null_safe_join(counts, totals, ["host"]).filter(F.col("n") / F.col("pages") > F.lit(float(ratio)))
    return over.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("dropped"))


def dedup_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = False) -> DataFrame:
    """``pages`` with ``text`` cut; all other columns as they are, with ``n_lines_dropped`` added.

    Null text stays null and an empty one empty; a very long text is split and
    cut whole. Pages of a null host are a host of their own. Repeated rows are pages of their own and count as such.
    A host needs ``min_pages`` pages with a line before it can be boilerplate,
    so small hosts keep everything. With ``keep_whole`` a page made of
    boilerplate lines alone is left alone: it is a copied page, which is the
    business of near-dedup. A column named ``n_lines_dropped`` is replaced.
    """
    drop = fresh("drop")
    found = checkpointed(boilerplate(pages, host, lines_of(F.coalesce(F.col(text), F.lit(""))), ratio, min_pages)).withColumnsRenamed({"dropped": drop})
    small = found.agg(F.coalesce(F.sum(F.size(drop)), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_LINES
    out = null_safe_join(pages.drop("n_lines_dropped"), found.withColumnRenamed("host", host), [host], "left", small)
    kept = fresh("kept")
    # A blank line has no mark among those dropped; pages of hosts without any aren't looked at.
    out = out.withColumn(kept, F.when(F.col(drop).isNotNull(), F.filter(lines_of(F.col(text)), lambda x: ~F.array_contains(F.col(drop), mark(bare(x))))))
    cut = F.col(drop).isNotNull() & F.col(text).isNotNull()
    if keep_whole:
        cut = cut & F.exists(F.col(kept), lambda x: bare(x) != "")
    n = F.size(lines_of(F.col(text))) - F.size(kept)
    out = out.withColumns({text: F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text)), "n_lines_dropped": F.when(cut, n).otherwise(0).cast("long")})
    return out.drop(drop, kept)


#: HTML elements that end a line of text.
BLOCKS = "p|div|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|br|hr|article|section|nav|header|footer|aside|main|table|tr|td|th|pre|blockquote|form|title|head|body|html"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def html_lines(html: Column) -> Column:
    """Text of a page with a line for each block element: scripts, styles, comments and tags go."""
    for pattern, to in (("(?is)<script\\b.*?</script\\s*>", " "), ("(?is)<style\\b.*?</style\\s*>", " "), ("(?s)<!--.*?-->", " "), (f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n"), ("<[^>]*>", "")):
        html = F.regexp_replace(html, pattern, to)
    return html


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(F.col("url"), HOST, 1)).alias("host"), html_lines(F.col("html")).alias("text"))
    # The lines are read twice; the markup is taken off once.
    out = dedup_lines(checkpointed(pages), "host", "text")
    return out.select("page_id", "host", F.length("text").cast("long").alias("n_chars"), "n_lines_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text
  FROM pages
), q AS (SELECT *, row_number() OVER () AS r, string_split(text, chr(10)) AS lines FROM p),
e AS (SELECT DISTINCT r, host, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT r, host, unnest(lines) AS l FROM q)),
n AS (SELECT host, count(*) AS pages FROM q GROUP BY host),
b AS (SELECT e.host, line FROM e JOIN n ON e.host IS NOT DISTINCT FROM n.host WHERE line <> '' GROUP BY e.host, line, pages HAVING count(*) >= {MIN_PAGES} AND count(*) / pages > {RATIO}),
g AS (SELECT host, list(line) AS dropped FROM b GROUP BY host),
k AS (SELECT q.page_id, q.host, q.text, q.lines, g.dropped, list_filter(q.lines, lambda x: NOT list_contains(g.dropped, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM q LEFT JOIN g ON q.host IS NOT DISTINCT FROM g.host),
t AS (SELECT page_id, host, CASE WHEN dropped IS NULL OR text IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text, CASE WHEN dropped IS NULL OR text IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n FROM k)
SELECT page_id, host, CAST(length(text) AS BIGINT) AS n_chars, CAST(n AS BIGINT) AS n_lines_dropped, md5(text) AS text_md5 FROM t
"""
