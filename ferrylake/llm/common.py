"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.session import ensure_checkpoint_dir, scratch_path, ship_package
from ferrylake.tables import load

__all__ = ["load", "ship_package", "checkpointed", "written", "bounded_join", "pick",
           "BROADCAST_ROWS", "let"]

# A side is broadcast only when its counted rows are at most this many and their
# measured text at most so many bytes; otherwise the join shuffles both sides and
# adaptive execution splits the hot keys.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a large intermediate as Parquet under the shared scratch folder and
    read it back, so that later steps survive a lost executor without redoing it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` over ``value``, which is evaluated once however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def bounded_join(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join; ``small`` (already materialised) is broadcast if it is counted to have
    at most ``rows`` rows of together at most ``BROADCAST_BYTES`` (as JSON, which is
    longer than the rows themselves), else both sides are shuffled."""
    text = F.octet_length(F.to_json(F.struct(*[_col(small, c) for c in small.columns])))
    n, size = small.limit(rows + 1).select(text.alias("n")).agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= rows and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns under internal names (new name = old name);
    further columns, also ones whose names clash with ours, are left behind."""
    return df.select(*[_col(df, old).alias(new) for new, old in columns.items()])


def _col(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`")
