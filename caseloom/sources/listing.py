"""Listings: typed entries out of HTML pages, with regular expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def parse(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, hrefs and labels; null html has none of them."""
    group = lambda k: F.regexp_extract_all("html", F.lit(_ROW), F.lit(k))
    return pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit(_ROW)).alias("n_links"),
        group(1).alias("hrefs"), group(2).alias("labels"), F.regexp_count("html", F.lit(r"<li[\s>]")).alias("declared"),
    )


# The named entities and what they stand for; the ampersand is last, so that nothing is read twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """What a reader sees of a piece of HTML: no tags, entities as characters, single spaces."""
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0b\x0c\r]+", " "))


def document_id(href: Column) -> Column:
    """The last step of a link without query or fragment; null for an empty one."""
    last = F.regexp_extract(href, r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.when(last != "", last)


def entries(pages: DataFrame) -> DataFrame:
    """One row a listed document, in order; a page whose rows don't all parse fails the job."""
    parsed = parse(pages)
    checked = parsed.withColumn("hrefs", F.when(F.col("declared") != F.col("n_links"), F.raise_error(F.lit("the rows that a page declares aren't the rows that were parsed"))).otherwise(F.col("hrefs")))
    return checked.select("page_id", F.posexplode(F.arrays_zip("hrefs", "labels")).alias("position", "row")).select("page_id", "position", F.col("row.hrefs").alias("href"), plain_text(F.col("row.labels")).alias("label"), document_id(F.col("row.hrefs")).alias("document"))
