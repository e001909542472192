"""Contiguous shards of near equal bytes by global prefix sums.

Rows are put in id order over range partitions (only id, size and checksum, not
the text); each partition's totals give the offset of the next, and the global
byte position of a row names its shard: positions are cut at equal targets.

Cases: null text has no bytes (size 8, checksum of no bytes); null ids come first; ties
and repeated rows are placed next to each other, each with its own slot; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.llm.common import checkpointed, pick

SHARDS = 24
ROW_BYTES = 8


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32) of every row."""
    d = pick(docs, doc_id=id, _text=text)
    body = F.coalesce(F.col("_text"), F.lit("")).cast("binary")
    return d.select("doc_id", (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                    F.crc32(body).alias("text_crc32"))


def shards(sizes: DataFrame, n: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """``sizes`` rows with ``shard`` (0 to n-1) and ``slot`` (gapless from 0).

    ``partitions`` is the number of range partitions (the session's shuffle
    partitions by default). The only tables on one task or broadcast have one
    row per range partition or per shard.
    """
    spark = sizes.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the last range key spreads rows that tie in everything else
    tie = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    ranged = (sizes.withColumn("_tie", tie)
              .repartitionByRange(parts, "doc_id", "text_crc32", "size", "_tie")
              .withColumn("_part", F.spark_partition_id()))
    ranged = checkpointed(ranged)             # the numbering below reads one ordering
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"),
                                         F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding,
                                                Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(every).alias("_all"))
    within = Window.partitionBy("_part").orderBy("doc_id", "text_crc32", "size", "_tie")
    placed = (ranged.join(F.broadcast(offsets), "_part")
              .withColumn("_row", F.col("_row0") + F.row_number().over(within) - 1)
              .withColumn("_end", F.col("_byte0") + F.sum("size").over(
                  within.rowsBetween(Window.unboundedPreceding, 0))))
    # a row belongs to the shard that holds its middle byte
    # (whole-number division; twice the position times n fits a long up to 190 PB)
    middle = f"(_end * 2 - size) * {n}L div (_all * 2)"
    shard = F.least(F.lit(n - 1), F.expr(middle)).cast("int")
    placed = checkpointed(placed.select("doc_id", "size", "text_crc32", "_row",
                                        shard.alias("shard")))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("_row") - F.col("_first")).alias("slot")))

