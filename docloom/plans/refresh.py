"""Composed jobs: refresh of corpus and index from captured pages, and index rebuild."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.urls import normalize_url
from docloom.operators.assign import assign_sources, source_order
from docloom.operators.corpus import (
    changed_rows,
    flag_versions,
    index_summary,
    max_doc_id,
    only_keys_of,
)
from docloom.operators.extract import extract_pages
from docloom.operators.frontier import crawl_frontier
from docloom.operators.index import Index, merge_index, read_index, write_index
from docloom.operators.links import first_captures
from docloom.plans.scratch import exists, materialize
from docloom.schemas import EXTRACTED
from docloom.sources.pages import admit_fetch
from docloom.sources.tables import read_corpus, update_corpus


def extract_batch(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``EXTRACTED`` rows: every page once per source that covers it.

    A page is converted once, however many sources cover it, and not at all when none does.
    Versions of a URL are ordered by capture time, where the table has it, and by page id.
    Failed captures are left out before anything else.
    """
    pages = admit_fetch(pages)
    seq = F.lit(0).cast("long")
    if "fetched_at" in pages.columns:
        seq = F.unix_micros("fetched_at")
    else:
        pages = pages.withColumn("fetched_at", F.current_timestamp())
    pages = pages.withColumn("url", normalize_url(F.col("url")))
    pairs = materialize(assign_sources(pages.select("url").distinct(), sources), "pairs")
    covered = pages.join(pairs.select("url"), "url", "left_semi")
    rows = extract_pages(covered).join(pairs, "url").withColumn("seq", seq)
    return rows.select(*EXTRACTED.names)


def crawl_batch(pages: DataFrame, sources: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``EXTRACTED`` rows of the pages that a breadth-first visit reaches, in its order.

    A URL is visited once, so only its first capture counts.
    """
    pages = admit_fetch(pages)
    if "fetched_at" not in pages.columns:
        pages = pages.withColumn("fetched_at", F.current_timestamp())
    pages = pages.withColumn("url", normalize_url(F.col("url")))
    first = materialize(first_captures(pages).select("page_id"), "captures")
    pages = pages.join(first, "page_id", "left_semi")
    extracted = materialize(extract_pages(pages), "extracted")
    full = pages.join(extracted.select("page_id"), "page_id", "left_semi")
    visits = crawl_frontier(full, sources, max_pages)
    order = sources.select(F.col("name").alias("source"), source_order(sources).alias("source_ord"))
    rows = visits.withColumnRenamed("crawl_ord", "seq").join(order, "source")
    return rows.join(extracted, "url").select(*EXTRACTED.names)


def drop_stale(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Leave out versions captured before the stored one."""
    stored = corpus.select("url", F.col("fetched_at").alias("stored_at"))
    stored = only_keys_of(stored, batch, "url")
    late = F.coalesce(F.col("fetched_at") < F.col("stored_at"), F.lit(False))
    return batch.join(stored, "url", "left").filter(~late).drop("stored_at")


def apply_batch(
    spark: SparkSession, batch: DataFrame, sources: DataFrame, corpus_path: str, index_path: str
) -> DataFrame:
    """Merge extracted pages into corpus and index and return the summary per source.

    The index goes first. If the run dies in between, the pages still count as changed in
    the next run, which gives them ids above those that the index has seen.
    """
    # The number is written with the rows, so it names one version in all that follows.
    batch = materialize(batch.withColumn("version", F.monotonically_increasing_id()), "batch")
    corpus = read_corpus(spark, corpus_path)
    # Only the URLs of the batch are compared; of the others the largest id is asked for.
    stored = materialize(read_corpus(spark, corpus_path, batch), "stored")
    flagged = materialize(flag_versions(batch, stored), "flagged")
    indexed = exists(spark, f"{index_path}/stats")
    used = max_doc_id(read_index(spark, index_path).doc_len) if indexed else 0
    changed = materialize(changed_rows(batch, flagged, corpus, used), "changed")
    if indexed:
        if not changed.isEmpty():
            merge_index(spark, index_path, changed)
    else:
        write_index(changed, index_path)
    update_corpus(changed, corpus_path)
    return index_summary(sources, flagged)


def refresh(
    pages: DataFrame,
    sources: DataFrame,
    corpus_path: str,
    index_path: str,
    crawl: bool = False,
    max_pages: int | None = None,
) -> DataFrame:
    """Captured pages to searchable corpus. ``crawl`` follows links instead of taking all."""
    batch = crawl_batch(pages, sources, max_pages) if crawl else extract_batch(pages, sources)
    return apply_batch(pages.sparkSession, batch, sources, corpus_path, index_path)


def rebuild_index(corpus: DataFrame, path: str, partitions: int | None = None) -> Index:
    """A fresh index in a new folder, with all replaced postings gone."""
    return write_index(corpus, path, partitions=partitions)
