"""Ranked search: one query, or a whole table of queries in one job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.window import extract
from docloom.operators.index import Index
from docloom.operators.match import Batch, parse, text_queries
from docloom.operators.rank import bm25, bm25_best, top_k
from docloom.operators.snippet import with_indexed_hits, with_snippet
from docloom.plans.local import local_table
from docloom.plans.scratch import materialize
from docloom.schemas import STR


def join_corpus(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Stored columns for ranked hits, by one join.

    The ranked hits are written first: they are few, and with their size measured Spark
    broadcasts them where that pays, so that the corpus is read in place.
    """
    hits = materialize(hits, "ranked")
    stored = corpus.select("doc_id", "title", "url", "source", "content")
    return hits.join(stored, "doc_id")


def rank_batch(queries: DataFrame, index: Index, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) for every query, without stored columns."""
    return _rank(parse(queries), index, corpus, k).select("query_id", "rank", "doc_id", "score")


def _rank(batch: Batch, index: Index, corpus: DataFrame, k: int) -> DataFrame:
    # The bounds are those of all documents, so the best of a source may be far below the mark.
    alternatives = batch.single_slot and batch.programs is None
    if k > 0 and batch.queries and alternatives and not batch.source_bound:
        return top_k(bm25_best(batch, index, k), k)
    return top_k(bm25(batch, index, corpus if batch.source_bound else None), k)


def search_batch(
    queries: DataFrame, index: Index, corpus: DataFrame, k: int = 10, snippets: bool = True
) -> DataFrame:
    """All queries of a ``QUERIES`` table: query_id, rank, id, title, url, source, score, snippet.

    The best few rows are tokenised again for their snippets; without a limit (a negative ``k``) hits
    come from the index, which must be that of ``corpus``.
    """
    batch = parse(queries)
    ranked = _rank(batch, index, corpus, k)
    if snippets and k < 0:
        rows = join_corpus(with_indexed_hits(ranked, batch, index), corpus)
        rows = rows.withColumn("snippet", extract(F.col("content"), F.col("hits")))
    elif snippets:
        rows = with_snippet(join_corpus(ranked, corpus), batch, index)
    else:
        rows = join_corpus(ranked, corpus)
    shown = ["query_id", "rank", F.col("doc_id").alias("id"), "title", "url", "source", "score"]
    if snippets:
        shown.append("snippet")
    return rows.select(shown)


def search(query: str, index: Index, corpus: DataFrame, limit: int = 10, source=None) -> DataFrame:
    """One plain-text query: all its tokens are required."""
    spark = index.postings.sparkSession
    one = local_table(spark, [{"text": query}], T.StructType([T.StructField("text", STR)]))
    queries = text_queries(one, F.lit("q"), F.col("text"))
    queries = queries.withColumn("source", F.lit(source).cast("string"))
    return search_batch(queries, index, corpus, limit).drop("query_id").orderBy("rank")
