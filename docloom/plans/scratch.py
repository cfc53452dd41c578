"""Intermediate tables in the shared folder that the cluster names."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor must be able to reach."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return shared.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/docloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's intermediate tables, once no DataFrame needs them any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, which also cuts its lineage.

    A written table survives the loss of executors and, unlike ``checkpoint()``, is
    computed once and can be read by column.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
