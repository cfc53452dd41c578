"""The stored corpus and result files.

A corpus only grows: every update appends a segment with its own rows and the URLs whose older
rows they replace. A small marker, written last, makes the segment visible, so a reader never
sees half an update, a driver lost in between leaves the corpus as it was, and repeating the
update overwrites only what was not visible. ``compact_corpus`` leaves replaced rows behind.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.scratch import exists, materialize
from docloom.schemas import CORPUS

# Rows are laid out by URL hash within a segment. Large corpora want thousands of buckets; the
# number is kept with every segment.
BUCKETS = 16

_INT = T.IntegerType()
_STORED = T.StructType(
    [*CORPUS.fields, T.StructField("segment", _INT), T.StructField("bucket", _INT)]
)
_REPLACED = "url string, segment int"
_MARKER = "buckets int, segment int"


def _last_segment(spark: SparkSession, path: str):
    """(segment, buckets) of the newest visible segment, or None."""
    if not exists(spark, f"{path}/segments"):
        return None
    found = spark.read.schema(_MARKER).json(f"{path}/segments")
    return found.orderBy(F.desc("segment")).select("segment", "buckets").first()


def _bucket(url, buckets: int):
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def read_corpus(spark: SparkSession, path: str, urls: DataFrame | None = None) -> DataFrame:
    """Current rows, or those of ``urls`` (url).

    Those that a later segment replaces are left out by a join with the replaced URLs, a narrow
    table of updates only. Wanted URLs are joined on their bucket as well, so that buckets
    without any are not read.
    """
    last = _last_segment(spark, path)
    if last is None:
        return spark.createDataFrame([], CORPUS)
    rows = spark.read.schema(_STORED).parquet(f"{path}/rows").filter(F.col("segment") <= last.segment)
    if urls is not None:
        # Written, so that their size is known and few of them are broadcast.
        keyed = urls.select("url").distinct().withColumn("bucket", _bucket("url", last.buckets))
        keyed = materialize(keyed, "keys").filter(F.length("url") > 0)
        wanted = keyed.select("url")
        rows = rows.join(keyed, ["bucket", "url"], "left_semi")
    if last.segment:
        newer = spark.read.schema(_REPLACED).parquet(f"{path}/replaced")
        newer = newer.filter(F.col("segment") <= last.segment)
        if urls is not None:
            newer = newer.join(wanted, "url", "left_semi")
        newer = newer.groupBy("url").agg(F.max("segment").alias("_newest"))
        current = F.col("_newest").isNull() | (F.col("segment") >= F.col("_newest"))
        rows = rows.join(newer, "url", "left").filter(current)
    return rows.select(*CORPUS.names)


def _append(rows: DataFrame, path: str, segment: int, buckets: int) -> None:
    """Files sorted by id, with a Bloom filter for point reads by URL; the marker comes last."""
    spark = rows.sparkSession
    rows = rows.select(*CORPUS.names)
    placed = rows.withColumn("bucket", _bucket("url", buckets))
    (
        placed.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "doc_id")
        .write.partitionBy("bucket")
        .option("parquet.bloom.filter.enabled#url", "true")
        .mode("overwrite")
        .parquet(f"{path}/rows/segment={segment}")
    )
    if segment:
        rows.select("url").write.mode("overwrite").parquet(f"{path}/replaced/segment={segment}")
    marker = spark.range(1).select(F.lit(buckets).alias("buckets"))
    marker.coalesce(1).write.mode("overwrite").json(f"{path}/segments/segment={segment}")


def write_corpus(corpus: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """First segment of a new corpus."""
    if _last_segment(corpus.sparkSession, path) is not None:
        raise FileExistsError(f"{path} already holds a corpus; use update_corpus")
    _append(corpus, path, 0, buckets)


def update_corpus(changed: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace or add rows by URL, writing only these rows. An empty update writes nothing."""
    last = _last_segment(changed.sparkSession, path)
    if last is None:
        write_corpus(changed, path, buckets)
    elif not changed.isEmpty():
        _append(changed, path, last.segment + 1, last.buckets)


def compact_corpus(spark: SparkSession, path: str, target: str, buckets: int | None = None) -> None:
    """Write the current rows as the only segment of a new corpus in ``target``."""
    last = _last_segment(spark, path)
    if last is None:
        raise FileNotFoundError(f"{path} holds no corpus")
    write_corpus(read_corpus(spark, path), target, buckets or last.buckets)


def results_json(results: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)
