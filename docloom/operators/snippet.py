"""Highlighted extracts of the content column for rows that are already ranked."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.window import HITS, extract
from docloom.operators.index import Index, build_postings
from docloom.operators.match import (
    Batch,
    look_up,
    near_starts,
    pattern_terms,
    pattern_tokens,
    phrase_starts,
)
from docloom.plans.scratch import materialize
from docloom.schemas import INDEXED


COLUMN = INDEXED.index("content")


def content_hits(rows: DataFrame, batch: Batch, index: Index) -> DataFrame:
    """(query_id, doc_id, hits): phrase instances in the content of the ranked rows.

    Only these rows are tokenised again; the index is not read.
    """
    texts = rows.dropDuplicates(["doc_id"]).select(
        "doc_id", *[(F.col(c) if c == "content" else F.lit("")).alias(c) for c in INDEXED]
    )
    postings = build_postings(texts, index.buckets).filter(F.col("col") == COLUMN)
    tokens = pattern_tokens(batch, index)
    wanted = F.col("cols").isNull() | F.array_contains("cols", F.lit(COLUMN).cast("tinyint"))
    return _instances(phrase_starts(postings.join(tokens.filter(wanted), "term")), batch)


def indexed_hits(ranked: DataFrame, batch: Batch, index: Index) -> DataFrame:
    """The same from the positions in the index, for very many rows: no text is read or moved."""
    found = look_up(pattern_terms(batch, index), index).filter(F.col("col") == COLUMN)
    starts = phrase_starts(found.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi"))
    # Rows that repeat an id have their postings in one place.
    return _instances(starts.withColumn("starts", F.array_distinct("starts")), batch)


def _instances(starts: DataFrame, batch: Batch) -> DataFrame:
    found = starts.select("pattern", "doc_id", "n_terms", F.explode("starts").alias("start"))
    plain = batch.clauses.filter(F.col("near_key").isNull() & (F.col("kind") != "not"))
    sides = [plain.join(found, "pattern")]
    if batch.near:
        close = near_starts(batch, starts).select("key", "doc_id", "start")
        near = batch.clauses.filter(F.col("near_key").isNotNull() & (F.col("kind") != "not"))
        near = near.withColumn("n_terms", F.size("tokens")).join(close, "key")
        sides.append(near)
    columns = ["query_id", "clause_id", "doc_id", "start", "n_terms"]
    hits = sides[0].select(columns)
    for side in sides[1:]:
        hits = hits.unionByName(side.select(columns))
    hit = F.struct(
        "start", F.col("clause_id").alias("phrase"), F.col("n_terms").alias("size")
    )
    return hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def with_snippet(rows: DataFrame, batch: Batch, index: Index) -> DataFrame:
    """Add ``snippet`` to ranked rows that carry query_id, doc_id and content.

    The rows are used twice, so they are fetched from the corpus once and written. Where they name
    the clauses ``used`` for their score, only these are shown.
    """
    rows = materialize(rows, "ranked")
    rows = _with_hits(rows, content_hits(rows, batch, index))
    return rows.withColumn("snippet", extract(F.col("content"), F.col("hits")))


def with_indexed_hits(ranked: DataFrame, batch: Batch, index: Index) -> DataFrame:
    """Add ``hits`` to ranked rows before they have their content, so that only narrow rows are
    grouped and joined, and a text moves once, to the rows that show it."""
    ranked = materialize(ranked, "ranked")
    return _with_hits(ranked, indexed_hits(ranked, batch, index))


def _with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    found = F.coalesce("hits", F.array().cast(HITS))
    if "used" in rows.columns:
        found = F.filter(found, lambda hit: F.array_contains("used", hit["phrase"]))
    return rows.join(hits, ["query_id", "doc_id"], "left").withColumn("hits", found)
