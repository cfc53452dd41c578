"""The document corpus: incremental merge, point reads and statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.plans.ordered import global_lag, global_row_number

INSERTED, UPDATED, SKIPPED = "inserted", "updated", "skipped"


def only_keys_of(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is wanted.

    Done before a left join: few wanted keys are then broadcast and the stored side is
    filtered in place, where the left join alone would shuffle all of it.
    """
    return stored.join(wanted.select(key), key, "left_semi")


def match_existing(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the stored id and hash of each URL; only three narrow corpus columns are read."""
    stored = corpus.select(
        "url", F.col("doc_id").alias("old_id"), F.col("content_hash").alias("old_hash")
    )
    return batch.join(only_keys_of(stored, batch, "url"), "url", "left")


def classify_changes(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """``change`` of each row of a batch with one version per URL. Only content counts."""
    hashed = batch.withColumn("content_hash", content_hash(F.col("content")))
    change = (
        F.when(F.col("old_id").isNull(), INSERTED)
        .when(F.col("old_hash") == F.col("content_hash"), SKIPPED)
        .otherwise(UPDATED)
    )
    return match_existing(hashed, corpus).withColumn("change", change).drop("old_hash")


def version_order(batch: DataFrame) -> list[str]:
    """Columns that order the versions of a URL. Source name and content settle ties; versions
    equal in all of them are the same version, and ``version`` numbers them if present."""
    order = ["source_ord", "seq", "page_id", "source", "content_hash", "version"]
    return [name for name in order if name in [*batch.columns, "content_hash"]]


def flag_versions(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Fate of every version when the batch is applied in ``version_order``; NULLs come first.

    Gives url, the columns of the order, old_id and ``change``. A version
    counts as changed when its hash differs from the version before it, or from the stored
    one. Only narrow columns are ordered; a URL with very many versions is spread over
    several partitions.
    """
    order = version_order(batch)
    hashed = batch.withColumn("content_hash", content_hash(F.col("content")))
    ordered = global_lag(
        hashed.select("url", *order), ["url"], order, F.col("content_hash"), "before"
    )
    ordered = match_existing(ordered, corpus)
    before = F.coalesce("before", "old_hash")
    change = (
        F.when(before.isNull(), INSERTED)
        .when(before == F.col("content_hash"), SKIPPED)
        .otherwise(UPDATED)
    )
    return ordered.withColumn("change", change).drop("before", "old_hash")


def fold_versions(batch: DataFrame, flagged: DataFrame) -> DataFrame:
    """Final row of every URL that changed: its last changed version.

    Adds old_id (NULL for a new URL) and the position of its first version, which decides
    the order of new ids.
    """
    order = version_order(batch)
    changed = flagged.filter(F.col("change") != SKIPPED)
    place = F.struct(*order)
    last = changed.groupBy("url").agg(
        F.max(place).alias("last"),
        F.min(place).alias("first"),
        F.max("old_id").alias("old_id"),
    )
    last = last.select(
        F.col("url").alias("_url"),
        F.col("last").alias("_last"),
        "old_id",
        F.col("first.source_ord").alias("first_ord"),
        F.col("first.seq").alias("first_seq"),
        (F.col("first.page_id") if "page_id" in order else F.lit(None).cast("long")).alias("first_page"),
    )
    # Null-safe, and one row per URL even if versions alike in everything occur twice.
    rows = batch.withColumn("content_hash", content_hash(F.col("content")))
    same = F.lit(True)
    for name in order:
        same = same & F.col(name).eqNullSafe(F.col(f"_last.{name}"))
    rows = rows.join(last, (F.col("url") == F.col("_url")) & same).drop("_url", "_last")
    return rows if "version" in order else rows.dropDuplicates(["url"])


def assign_ids(final: DataFrame, max_id: int) -> DataFrame:
    """Keep stored ids; new URLs get max_id+1, +2, ... in order of first insertion."""
    fresh = final.filter(F.col("old_id").isNull()).select("url", "first_ord", "first_seq", "first_page")
    numbered = global_row_number(fresh, [], ["first_ord", "first_seq", "first_page", "url"], "nth")
    ids = numbered.select("url", (F.col("nth") + F.lit(max_id)).cast("long").alias("new_id"))
    return (
        final.join(ids, "url", "left")
        .withColumn("doc_id", F.coalesce("old_id", "new_id"))
        .drop("new_id", "first_ord", "first_seq", "first_page")
    )


def max_doc_id(corpus: DataFrame) -> int:
    return corpus.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first().m


def changed_rows(
    batch: DataFrame, flagged: DataFrame, corpus: DataFrame, used_id: int = 0
) -> DataFrame:
    """Corpus rows to insert or replace; new ids are above all stored ones and ``used_id``."""
    rows = assign_ids(fold_versions(batch, flagged), max(used_id, max_doc_id(corpus)))
    return rows.select(*corpus.columns)


def merge_corpus(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    kept = corpus.join(changed.select("url"), "url", "left_anti").select(*corpus.columns)
    return kept.unionByName(changed.select(*corpus.columns))


def index_summary(sources: DataFrame, flagged: DataFrame) -> DataFrame:
    """Versions processed, changed and skipped per source; idle sources show zeros."""
    counts = flagged.groupBy("source").agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("change") != SKIPPED).alias("updated"),
        F.count_if(F.col("change") == SKIPPED).alias("skipped"),
    )
    names = sources.select(F.col("name").alias("source"))
    return names.join(counts, "source", "left").fillna(0, ["processed", "updated", "skipped"])


def read_by_id(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per wanted ``doc_id``; stored columns are NULL when it does not exist."""
    return ids.join(only_keys_of(corpus, ids, "doc_id"), "doc_id", "left")


def read_by_url(corpus: DataFrame, urls: DataFrame) -> DataFrame:
    return urls.join(only_keys_of(corpus, urls, "url"), "url", "left")


def get_document(corpus: DataFrame, doc_id=None, url=None) -> DataFrame:
    """Point read with a pushed filter; the id wins when both are given."""
    if doc_id is None and url is None:
        raise ValueError("give the id or the URL of a document")
    wanted = F.col("doc_id") == doc_id if doc_id is not None else F.col("url") == url
    return corpus.filter(wanted).select("doc_id", "url", "source", "title", "content", "fetched_at")


def list_urls(corpus: DataFrame) -> DataFrame:
    return corpus.select("url")


def count_by_source(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(F.count("*").alias("count")).orderBy("source")


def corpus_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("documents"))


def corpus_stats_report(corpus: DataFrame) -> DataFrame:
    """Total and per-source counts. One row per source: their number has no bound."""
    per_source = corpus.groupBy("source").agg(F.count("*").alias("count"))
    total = per_source.agg(F.sum("count").alias("documents"))
    return per_source.select(total.scalar().alias("documents"), "source", "count")
