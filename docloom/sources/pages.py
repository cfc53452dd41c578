"""Captured pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schemas import CAPTURE, PAGES


def page_schema(spark: SparkSession, path: str) -> T.StructType:
    """``PAGES`` and those of the capture columns that the files have."""
    stored = set(spark.read.parquet(path).columns)
    return T.StructType([*PAGES.fields, *[f for f in CAPTURE.fields if f.name in stored]])


def scan_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Stored pages. ``partitions`` deals them anew, for files of a few large row groups that Spark
    would read with as few tasks."""
    pages = spark.read.schema(page_schema(spark, path)).parquet(path)
    return pages.repartition(partitions) if partitions else pages


def admit_fetch(pages: DataFrame) -> DataFrame:
    """Successful HTML responses; a column that the table does not record admits all."""
    if "status" in pages.columns:
        pages = pages.filter(F.col("status") == 200)
    if "content_type" in pages.columns:
        pages = pages.filter(F.col("content_type").contains("text/html"))
    return pages
