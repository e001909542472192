"""The driver's test tables: names, text columns and loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column order of the driver's parquet tables (nested
# ``embeddings.embedding`` has no text form and is left out of text profiles).
TEXT_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

# Near-unique long text: classified value by value, never pre-grouped.
WIDE_TEXT = {
    "documents": ["text"],
    "pages": ["html"],
    "benchmark": ["text"],
    "conversations": ["text"],
}

TABLE_NAMES = list(TEXT_COLUMNS)


_SCHEMAS: dict[str, object] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read once per path (later loads skip the
    footer-reading job)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = df.schema
    return df
