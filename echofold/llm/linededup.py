"""Line dedup by site-relative frequency: lines that over RATIO of a host's pages contain are boilerplate and are dropped.

Pages of one text within a host count once, in a line's pages and in the host's: a text copied often says nothing new about
its lines, which would else all go with the last copy. Each page gives its distinct lines (spaces trimmed, blank lines left
out); copies fold, then pages are counted by host and line, both partly before the shuffle, so a hot line or host costs a
row a task. Lines and texts stand as 64-bit hashes within their host. A host has at most (its lines a page) / RATIO
boilerplate lines, since each is on that share of its pages; that short list is joined to the pages, which so meet no other
page: as a broadcast while the lists hold BROADCAST_LINES or fewer, else by a join whose hot hosts Spark may split.

Defined results: null text stays null, and counts as a page of the empty text; a null host counts as the host ""; blank
lines stay; a page whose lines all go has empty text; a host with fewer than MIN_PAGES different pages with the line loses
none; repeated rows count once and lose the same lines; an empty table gives an empty table; all columns of the pages are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.storage import settled

RATIO = 0.02
MIN_PAGES = 3
BROADCAST_LINES = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host string, line long (hash), n long (its different pages) for each line over the ratio."""
    of = F.coalesce(pages[host].cast("string"), F.lit(""))
    page = F.xxhash64(F.coalesce(pages[text], F.lit(""))).alias("page")
    totals = pages.select(of.alias("host"), page).groupBy("host").agg(F.count_distinct("page").alias("pages"))
    own = F.array_distinct(F.filter(F.transform(_lines(pages[text]), lambda x: F.trim(x)), lambda x: x != ""))
    lines = pages.select(of.alias("host"), page, F.explode(F.transform(own, lambda x: F.xxhash64(x))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("page").alias("n"))
    return counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line", "n")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """pages with boilerplate lines out of text; dropped names a further column for the number of lines dropped."""
    found = settled(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    few = found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    lists = found.groupBy("host").agg(F.collect_list("line").alias("lines")).select(F.struct("host", "lines").alias("_boilerplate"))
    names = pages.columns
    rows = pages.select(F.struct(*[pages[c] for c in names]).alias("_page"))
    rows = rows.join(F.broadcast(lists) if few else lists, F.coalesce(F.col(f"_page.`{host}`").cast("string"), F.lit("")) == F.col("_boilerplate.host"), "left")
    lines = _lines(F.col(f"_page.`{text}`"))
    bad = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(F.trim(x))), F.col("_boilerplate.lines"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_bad"), F.xxhash64(F.trim(x))))
    rows = rows.withColumn("_bad", bad)
    some = F.size("_bad") > 0
    clean = F.when(some, F.array_join(kept, "\n")).otherwise(F.col(f"_page.`{text}`"))
    out = [clean.alias(c) if c == text else F.col(f"_page.`{c}`").alias(c) for c in names]
    if dropped:
        out.append(F.when(some, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias(dropped))
    return rows.select(*out)


ORACLE_SQL = f"""
WITH page AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT DISTINCT host, text, trim(x) AS line FROM (SELECT host, text, unnest(lines) AS x FROM page) WHERE trim(x) <> ''),
total AS (SELECT host, count(DISTINCT coalesce(text, '')) AS pages FROM page GROUP BY host),
bad AS (SELECT host, list(line) AS bad FROM (SELECT host, line, count(*) AS n FROM line GROUP BY host, line) JOIN total USING (host)
        WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host)
SELECT doc_id,
       CASE WHEN bad IS NULL THEN text ELSE coalesce(array_to_string(list_filter(lines, lambda x: NOT list_contains(bad, trim(x))), chr(10)), '') END AS text,
       CASE WHEN bad IS NULL THEN 0 ELSE len(list_filter(lines, lambda x: list_contains(bad, trim(x)))) END AS n_dropped
FROM page LEFT JOIN bad USING (host)
"""
