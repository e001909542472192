"""The ``table`` fixture of these tests (``spark`` comes from the folder above)."""

import pytest
from pyspark.sql import functions as F

# names that the operators use inside, as columns of the input
CLASH = ("key", "row", "size", "shard", "slot", "host", "n_words", "spans", "window", "class",
         "bands", "score", "sequence_id", "gram", "_text", "_own", "_in_0", "path", "low")


@pytest.fixture()
def table(spark):
    """Rows as a table with further columns whose names clash with inner ones."""
    def make(rows, schema, clash=True):
        df = spark.createDataFrame(rows, schema).repartition(3)
        if clash:
            df = df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])
        return df
    return make
