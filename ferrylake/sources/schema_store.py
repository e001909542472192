"""A store of settled schemas, one Parquet partition per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("dataset", T.StringType()),
])


def save_schema(schema_rows: DataFrame, store: str, dataset: str) -> None:
    """Persist ``(pos, name, type, confidence)`` rows for ``dataset``.

    Dynamic partition overwrite replaces only this dataset's partition, so
    datasets do not overwrite each other (the reference keeps one global slot).
    """
    rows = schema_rows.select(
        F.col("pos").cast("int"), F.col("name").cast("string"),
        F.col("type").cast("string"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"),
        F.lit(dataset).alias("dataset"))
    (rows.coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset").parquet(store))


def load_schema(spark: SparkSession, store: str, dataset: str) -> DataFrame:
    """The stored rows of ``dataset`` (pruned to its partition); empty when the
    store is missing or unreadable."""
    try:
        df = spark.read.schema(STORE_SCHEMA).parquet(store)
        df.limit(0).collect()  # fails fast on a missing store
    except Exception:  # missing or broken store reads as empty, as in the reference
        return spark.createDataFrame([], STORE_SCHEMA).drop("dataset")
    return df.filter(F.col("dataset") == F.lit(dataset)).drop("dataset")
