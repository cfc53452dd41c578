"""Link edges and URLs that are known but not captured yet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.html import link_hrefs
from docloom.functions.urls import normalize_url, resolve_link
from docloom.operators.assign import assign_sources
from docloom.plans.scratch import materialize


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) in document order, duplicates kept."""
    hrefs = F.posexplode(link_hrefs(F.col("html"))).alias("pos", "href")
    return pages.select("page_id", "url", hrefs)


def page_edges(pages: DataFrame) -> DataFrame:
    """(page_id, src_url, pos, href, target_url), normalised; other schemes dropped."""
    edges = extract_links(pages.withColumn("url", normalize_url(F.col("url"))))
    target = normalize_url(resolve_link(F.col("url"), F.col("href")))
    return edges.select(
        "page_id", F.col("url").alias("src_url"), "pos", "href", target.alias("target_url")
    ).filter(F.col("target_url") != "")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src_url, pos, href, target_url) of all links of all pages."""
    return page_edges(pages).drop("page_id")


def first_captures(pages: DataFrame) -> DataFrame:
    """(url, page_id): the capture that stands for a URL, from two narrow columns."""
    url = normalize_url(F.col("url")).alias("url")
    return pages.select(url, "page_id").groupBy("url").agg(F.min("page_id").alias("page_id"))


def drop_seen(frontier: DataFrame, seen: DataFrame, on) -> DataFrame:
    return frontier.join(seen, on, "left_anti")


def pending_links(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, url) of allowed links without a captured page.

    Targets are made distinct before the rules are tried, so a link that every page carries
    is checked once. They are written, because the rules look at them twice and the HTML
    should be read once.
    """
    targets = link_edges(pages).select(F.col("target_url").alias("url")).distinct()
    captured = pages.select(normalize_url(F.col("url")).alias("url"))
    fresh = materialize(drop_seen(targets, captured, "url"), "targets")
    return assign_sources(fresh, sources).select("source", "url")
