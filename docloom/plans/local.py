"""Tables given on the driver."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Rows given on the driver, as a relation whose size the optimizer knows.

    Spark then broadcasts it only when that size is below its broadcast threshold.
    """
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema)
