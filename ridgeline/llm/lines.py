"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm._store import columns, materialize, own_prefix, tidied

#: A line is boilerplate of a site if it stands on more than this share of the site's pages. A line of one page repeats nothing, so two pages are the least at any size.
RATIO = 0.05

#: Elements whose content is no text, and elements that end a line.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|body|html|blockquote|pre|td|th|figure|figcaption|hr|form|dl|dt|dd)\b[^>]*>"
TAG = r"<[^>]*>"
SPACES = r"[ \t\r\f]{2,}|[\t\r\f]"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """The url's host in lower case; null if the url is null or has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The visible text of a page, a line for each block element, without empty lines."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, TAG, "")
    text = F.regexp_replace(text, SPACES, " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?: ?\n ?)+", "\n"), r"^[\n ]+|[\n ]+$", "")


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, once: bool = False) -> DataFrame:
    """site, hashes: the line hashes that exceed the ratio. A site has fewer of them than its mean number of lines divided by ratio, so its list is bounded however many pages it has.

    once: pages of a site with the same text count as one page, so that a page copied often does not make its own lines boilerplate.
    """
    known = pages.filter(F.col(site).isNotNull() & F.col(text).isNotNull())
    line = F.explode(F.array_distinct(_hashes(F.col(text)))).alias("line")
    if once:
        whole = F.xxhash64(text).alias("whole")
        lines = known.select(F.col(site).alias("site"), whole, line).distinct()
        every = known.select(F.col(site).alias("site"), whole).distinct()
    else:
        lines = known.select(F.col(site).alias("site"), line)
        every = pages.filter(F.col(site).isNotNull()).select(F.col(site).alias("site"))
    lines = lines.groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    totals = every.groupBy("site").agg(F.count("*").alias("pages"))
    over = lines.join(totals, "site").filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return over.groupBy("site").agg(F.collect_set("line").alias("hashes"))


@tidied
def drop_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, once: bool = False) -> DataFrame:
    """pages with text cleaned of its site's boilerplate lines, and n_lines and n_dropped added.

    A line is compared as it stands, between newlines; each page counts once for a line it repeats. Every page stays, with an empty text if
    all its lines go. A null text stays null (0 lines); pages without a site stay as they are, since no frequency is known for them.
    The lists of boilerplate lines are written first: Spark broadcasts them where their size allows, else joins by site and splits a hot one.
    Columns of pages named n_lines and n_dropped are replaced.
    """
    pages = pages.drop("n_lines", "n_dropped")
    p = own_prefix(pages)
    known = materialize(boilerplate(pages, site, text, ratio, once)).withColumnsRenamed({"site": f"{p}site", "hashes": f"{p}hashes"})
    joined = pages.join(known, F.col(site) == F.col(f"{p}site"), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col(f"{p}hashes"), F.xxhash64(line)))
    out = joined.withColumn(f"{p}lines", lines).withColumn(f"{p}kept", F.when(F.col(f"{p}hashes").isNull(), F.col(f"{p}lines")).otherwise(kept))
    counts = {"n_lines": F.coalesce(F.size(f"{p}lines"), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size(f"{p}lines") - F.size(f"{p}kept"), F.lit(0)).cast("long")}
    out = out.withColumns(counts).withColumn(text, F.array_join(f"{p}kept", "\n"))
    return out.select(*columns(pages), "n_lines", "n_dropped")


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line))
