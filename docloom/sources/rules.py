"""Source rules: which pages belong to which source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.urls import SEED_EXCLUDES, authority, package_include_pattern
from docloom.operators.assign import source_order
from docloom.schemas import SEEDS, SOURCES

# Page budgets where none is given.
SOURCE_PAGES, SEED_PAGES = 5000, 1000


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of sources, read as one value so that its order is known: ``source_ord`` is the
    place in the list where an entry has none. Of several files each counts from 0."""
    listed = F.from_json("value", T.ArrayType(SOURCES))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(listed).alias("place", "s"))
    rows = rows.select("place", "s.*").withColumn("source_ord", F.coalesce("source_ord", "place"))
    return source_rules(rows.drop("place"))


def source_rules(sources: DataFrame) -> DataFrame:
    """Fill in the defaults of missing fields."""
    none = F.array().cast("array<string>")
    return sources.select(
        "name",
        "start_urls",
        "allowed_domains",
        F.coalesce("include_patterns", none).alias("include_patterns"),
        F.coalesce("exclude_patterns", none).alias("exclude_patterns"),
        F.coalesce("max_pages", F.lit(SOURCE_PAGES)).alias("max_pages"),
        source_order(sources).alias("source_ord"),
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEEDS).json(path, multiLine=True)


def seed_rules(seeds: DataFrame, repair: bool = False) -> DataFrame:
    """One source rule per seed URL; a narrow projection for seed tables of any size."""
    kind = F.coalesce("doc_type", F.lit("auto"))
    return seeds.select(
        "name",
        F.array("doc_url").alias("start_urls"),
        F.array(authority(F.col("doc_url"))).alias("allowed_domains"),
        F.array(package_include_pattern(F.col("doc_url"), kind, repair)).alias("include_patterns"),
        F.array(*[F.lit(p) for p in SEED_EXCLUDES]).alias("exclude_patterns"),
        F.coalesce("max_pages", F.lit(SEED_PAGES)).alias("max_pages"),
        F.lit(0).alias("source_ord"),
    )
