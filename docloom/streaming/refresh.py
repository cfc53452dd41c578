"""Continuous refresh: new page files are merged as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.refresh import apply_batch, drop_stale, extract_batch
from docloom.plans.scratch import materialize
from docloom.schemas import PAGES
from docloom.sources.tables import read_corpus


def page_stream(
    spark: SparkSession, path: str, glob: str = "*.parquet", files: int = 1000, schema=PAGES
):
    """Page files of a folder as a stream, a bounded number of files per micro-batch.

    ``schema`` may add the columns of ``CAPTURE`` that the files have.
    """
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files)
        .parquet(path)
    )


def stream_refresh(
    pages: DataFrame, sources: DataFrame, corpus_path: str, index_path: str, checkpoint: str
) -> StreamingQuery:
    """Start the merge of all available pages. A replayed micro-batch changes nothing.

    Within a micro-batch the versions of a URL apply in their own order; one that was
    captured before the stored version is left out, whenever it arrives.
    """

    def merge(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        extracted = materialize(extract_batch(batch, sources), "extracted")
        fresh = drop_stale(extracted, read_corpus(session, corpus_path, extracted))
        apply_batch(session, fresh, sources, corpus_path, index_path)

    return (
        pages.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
