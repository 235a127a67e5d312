"""Table scans (IO1), schema inspection (IO3) and the bounded preview (IO2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Scan one parquet table. Column pruning and filter pushdown happen downstream."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def describe_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``DESC t``: one row per column with its type and nullability.

    Built from the schema object (metadata only, one row per column); no data is read.
    """
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    schema = T.StructType(
        [
            T.StructField("col_name", T.StringType(), False),
            T.StructField("data_type", T.StringType(), False),
            T.StructField("nullable", T.BooleanType(), False),
        ]
    )
    return spark.createDataFrame(rows, schema)
