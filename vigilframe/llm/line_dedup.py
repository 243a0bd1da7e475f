"""Line dedup by site-relative frequency.

A line of a page is boilerplate when the share of its site's pages that contain
it exceeds ``ratio`` and at least ``min_pages`` pages do.  Boilerplate lines go,
all others stay in place.  Lines are compared without surrounding blanks (U+0020) by
a 128-bit digest; blank lines are never counted or dropped.

A site with ``n`` pages of ``m`` lines has at most ``m / ratio`` such lines, so
their digests fit in one array per site; the arrays are broadcast only up to
``broadcast_lines`` digests in all, beyond that they are joined by shuffle.

Null texts stay null and hold no lines; rows with a null site stay as they are.
Repeated rows are separate pages; a line repeated within a page counts once.  An
empty table gives an empty result.  Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, table


def _digests(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), lambda x: F.md5(x))


def _apart(known: DataFrame, ratio: float, min_pages: int, broadcast_lines: int, copies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(__site, line)`` of the lines that are boilerplate among different pages of ``known(__site, __text)``.

    A first count over all pages, which is never too low, finds the lines that could
    be; only the distinct texts that hold one go through ``copies``.
    """
    body = F.xxhash64("__text").alias("__body")
    bodies = known.groupBy("__site", body).agg(F.count("*")).groupBy("__site").agg(F.count("*").alias("bodies"))
    held = known.select("__site", F.explode(_digests(F.col("__text"))).alias("line")).groupBy("__site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    could = cut(held.join(bodies, "__site").where(F.col("n") > F.lit(ratio) * F.col("bodies")).groupBy("__site").agg(F.collect_list("line").alias("could")))
    lines = F.array_intersect(_digests(F.col("__text")), "could")
    few = (could.agg(F.sum(F.size("could"))).first()[0] or 0) <= broadcast_lines
    some = known.join(F.broadcast(could) if few else could, "__site").select("__site", body, "__text", lines.alias("lines")).where("size(lines) > 0")
    some = cut(some.dropDuplicates(["__site", "__body"]))
    classes = copies(some.select("__body", "__text").dropDuplicates(["__body"])).select("__body", F.col("component").alias("__class"))
    some = cut(some.drop("__text").join(classes, "__body"))
    merged = some.groupBy("__site", "__class").agg((F.count("*") - 1).alias("more")).groupBy("__site").agg(F.sum("more").alias("more"))
    totals = bodies.join(merged, "__site").select("__site", (F.col("bodies") - F.col("more")).alias("pages"))
    n = some.select("__site", "__class", F.explode("lines").alias("line")).groupBy("__site", "line", "__class").agg(F.count("*")).groupBy("__site", "line").agg(F.count("*").alias("n"))
    return n.join(totals, "__site").where((F.col("n") >= min_pages) & (F.col("n") > F.lit(ratio) * F.col("pages"))).select("__site", "line")


def drop_site_lines(
    pages: DataFrame,
    site_col: str,
    text_col: str,
    ratio: float = 0.3,
    min_pages: int = 3,
    broadcast_lines: int = 100_000,
    counts: tuple[str, str] | None = None,
    keep_whole: bool = False,
    copies: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``pages`` without boilerplate lines in ``text_col``.

    ``keep_whole``: a page all of whose lines are boilerplate is a copy of other
    pages rather than a page with boilerplate; it stays as it is.  ``copies`` gives
    ``(__body, component)`` of texts ``(__body, __text)``: pages of one component
    count once, for a line as for its site.  Exact copies count once then too; near
    copies that hold no line frequent among pages still count each for their site.  ``counts`` names two more columns: non-blank lines before, lines dropped.
    """
    site, text = F.col(site_col), F.col(text_col)
    known = pages.where(site.isNotNull())
    if copies:
        found = _apart(known.select(site.alias("__site"), text.alias("__text")), ratio, min_pages, broadcast_lines, copies)
    else:
        totals = known.groupBy(site.alias("__site")).agg(F.count("*").alias("pages"))
        held = known.select(site.alias("__site"), F.explode(_digests(text)).alias("line")).groupBy("__site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
        found = held.join(totals, "__site").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    common = cut(found.groupBy("__site").agg(F.collect_list("line").alias("__common")))
    small = (common.agg(F.sum(F.size("__common"))).first()[0] or 0) <= broadcast_lines
    joined = pages.join(F.broadcast(common) if small else common, site == F.col("__site"), "left")
    lines = F.split(text, "\n")
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains("__common", F.md5(F.trim(x)))
    as_is = F.col("__common").isNull()
    if keep_whole:
        as_is = as_is | ~F.exists(lines, lambda x: (F.trim(x) != "") & stays(x))
    kept = F.when(as_is, text).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    out = {c: F.col(c) for c in pages.columns} | {text_col: kept}
    if counts:
        filled = lambda x: F.trim(x) != ""
        before = F.coalesce(F.size(F.filter(lines, filled)), F.lit(0))
        out |= {counts[0]: before.cast("long"), counts[1]: F.when(as_is | text.isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: ~stays(x)))).cast("long")}
    return joined.select(*[c.alias(n) for n, c in out.items()])


#: Elements that end a line.
BLOCKS = "p|div|li|ul|ol|nav|br|h[1-6]|tr|td|th|table|section|article|header|footer|title|body|head|html|main|aside|form|blockquote|pre|option|dd|dt|dl"
HIDDEN = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HOST = r"^[a-z][a-z0-9+.-]*://([^/?#:@]+)"


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per block element."""
    out = F.regexp_replace(html, HIDDEN, "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def op1_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.nullif(F.regexp_extract(F.lower("url"), HOST, 1), F.lit(""))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), html_lines(F.col("html")).alias("text"))
    return drop_site_lines(pages, "host", "text", counts=("n_lines", "n_dropped"))


def _unescaped(column: str) -> str:
    for name, char in ENTITIES:
        column = f"replace({column}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return column


OP1_SQL = rf"""
WITH pages_text AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host,
    {_unescaped(rf"regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS text
  FROM pages
), lines AS (
  SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM pages_text
), totals AS (SELECT host, count(*) AS pages FROM pages_text GROUP BY host),
common AS (
  SELECT l.host, trim(line) AS line FROM lines l JOIN totals t ON l.host = t.host WHERE trim(line) <> ''
  GROUP BY l.host, trim(line), t.pages HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) > 0.3 * t.pages
), marked AS (
  SELECT l.*, c.line IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host = c.host AND trim(l.line) = c.line
)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
  count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM marked GROUP BY page_id, host
"""
