"""Breadth-first visit of captured pages from the start URLs of every source."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.urls import normalize_url
from docloom.operators.assign import keep_own
from docloom.operators.links import drop_seen, first_captures, page_edges
from docloom.plans.ordered import global_row_number
from docloom.plans.scratch import materialize, scratch_path
from docloom.schemas import LONG, STR

_VISITED = T.StructType(
    [
        T.StructField("source", STR),
        T.StructField("url", STR),
        T.StructField("crawl_ord", LONG),
        T.StructField("depth", T.IntegerType()),
    ]
)

_SEEN = T.StructType(
    [T.StructField("source", STR), T.StructField("url", STR), T.StructField("shard", T.IntegerType())]
)

#: Folders over which visits are dealt by a hash of (source, url).
SHARDS = 64


def with_shard(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("source", "url"), F.lit(SHARDS)).cast("int"))


def add_seen(rows: DataFrame, folder: str) -> None:
    """Append (source, url) to the visits of ``folder``."""
    dealt = with_shard(rows.select("source", "url")).hint("rebalance", "shard")
    dealt.write.mode("append").partitionBy("shard").parquet(folder)


def seen_among(found: DataFrame, folder: str) -> DataFrame:
    """(source, url) of ``found`` that ``folder`` holds; only shards that may hold one are read.

    ``found`` should be a written table: its measured size lets Spark broadcast it, and with the
    filter its shards prune the folders at run time.
    """
    wanted = with_shard(found.select("source", "url")).filter("shard >= 0")
    visits = found.sparkSession.read.schema(_SEEN).parquet(folder)
    return visits.join(wanted, ["shard", "source", "url"], "left_semi").select("source", "url")


def dedupe_first(found: DataFrame) -> DataFrame:
    """First occurrence of each (source, url) by (parent_ord, pos), without a sort."""
    return (
        found.groupBy("source", "url")
        .agg(F.min(F.struct("parent_ord", "pos")).alias("at"))
        .select("source", "url", "at.parent_ord", "at.pos")
    )


def page_budget(found: DataFrame, budgets: DataFrame) -> DataFrame:
    """Number the rows of each source in (parent_ord, pos) order and keep what is left.

    ``budgets`` has (source, used, max_pages); ``crawl_ord`` continues after ``used``.
    """
    numbered = global_row_number(found, ["source"], ["parent_ord", "pos", "url"], "nth")
    placed = numbered.join(budgets, "source").withColumn("crawl_ord", F.col("nth") + F.col("used"))
    return placed.filter(F.col("crawl_ord") <= F.col("max_pages")).select(
        "source", "url", "crawl_ord"
    )


def source_budgets(sources: DataFrame, max_pages: int | None = None) -> DataFrame:
    """A run-level budget replaces that of every source; None and 0 mean "not set"."""
    own = F.lit(max_pages) if max_pages else F.col("max_pages")
    return sources.select(F.col("name").alias("source"), own.cast("long").alias("max_pages"))


def start_frontier(sources: DataFrame) -> DataFrame:
    starts = sources.select(
        F.col("name").alias("source"), F.posexplode("start_urls").alias("pos", "start")
    )
    starts = starts.select("source", "pos", normalize_url(F.col("start")).alias("url"))
    fit = keep_own(starts.filter("url <> ''"), sources)
    return dedupe_first(fit.withColumn("parent_ord", F.lit(0).cast("long")))


def link_table(pages: DataFrame) -> DataFrame:
    """(src_url, url, pos): every link once per pair, from the first capture of a URL."""
    edges = page_edges(pages).join(first_captures(pages).select("page_id"), "page_id", "left_semi")
    edges = edges.groupBy("src_url", F.col("target_url").alias("url"))
    return materialize(edges.agg(F.min("pos").alias("pos")), "links")


def crawl_frontier(
    pages: DataFrame, sources: DataFrame, max_pages: int | None = None
) -> DataFrame:
    """(source, url, crawl_ord, depth) in visiting order, independent for each source.

    ``pages`` holds the captured pages that have content: only these are expanded, each URL
    in its first capture. A URL without a page is visited too and uses up budget, as a failed
    download would. All sources advance together, one level per round: the links of the pages
    just visited are tested against the rules of the source that visited them, so what a round
    makes follows the visits and not the number of sources. Every level is a written table, so
    the plan of a round does not grow and lost executors do not repeat earlier rounds. A round
    reads its own level, and of the earlier visits only the shards that its links fall into.
    """
    spark = pages.sparkSession
    links = link_table(pages)
    budgets = materialize(source_budgets(sources, max_pages), "budgets")
    levels, seen = scratch_path(spark, "visited"), scratch_path(spark, "seen")

    def read(folder):
        return spark.read.schema(_VISITED).option("basePath", levels).parquet(folder)

    def write(level, found, used):
        left = budgets.join(used, "source", "left").fillna(0, ["used"])
        folder = f"{levels}/depth={level}"
        page_budget(found, left).write.parquet(folder)
        visits = read(folder)
        add_seen(visits, seen)
        return visits

    none_used = budgets.select("source", F.lit(0).cast("long").alias("used"))
    level, frontier = 0, write(0, start_frontier(sources), none_used)
    while not frontier.isEmpty():
        found = frontier.select(
            "source", F.col("url").alias("src_url"), F.col("crawl_ord").alias("parent_ord")
        ).join(links, "src_url")
        found = materialize(keep_own(dedupe_first(found), sources), "found")
        found = drop_seen(found, seen_among(found, seen), ["source", "url"])
        # Only a source that visited something at this level can go on from it.
        used = frontier.groupBy("source").agg(F.max("crawl_ord").alias("used"))
        level += 1
        frontier = write(level, found, used)
    return read(levels)
