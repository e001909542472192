"""Object inventories and bulk-job plans.

An inventory is a DataFrame ``(container, key, size, mtime)``; a plan is a
DataFrame that changes nothing. ``ferrylake.plans.bulk`` executes written
plans.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrylake.session import ensure_checkpoint_dir

DELETE_BATCH = 1000  # fixed value: keys per delete call

INVENTORY_SCHEMA = "container string, key string, size bigint, mtime timestamp"


def container_counts(inventory: DataFrame) -> DataFrame:
    """Objects and bytes per container (partial aggregation, tiny shuffle)."""
    return inventory.groupBy("container").agg(
        F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def outcome_summary(ledger: DataFrame, by: Sequence[str] = ("container",)) -> DataFrame:
    """Done / failed / total per group; a group succeeded when nothing
    failed. The failures themselves stay in the ledger (``failures``), never
    collected into one row."""
    ok = F.col("status") == F.lit("ok")
    return ledger.groupBy(*by).agg(
        F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"),
        F.count(F.lit(1)).alias("total")).withColumn("success", F.col("failed") == 0)


def failures(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") != F.lit("ok"))


def keys_present(keys: DataFrame, inventory: DataFrame,
                 on: Sequence[str] = ("container", "key")) -> DataFrame:
    """Requested keys that exist (left semi join)."""
    return keys.join(inventory.select(*on), list(on), "left_semi")


def keys_missing(keys: DataFrame, inventory: DataFrame,
                 on: Sequence[str] = ("container", "key")) -> DataFrame:
    """Requested keys that do not exist (left anti join)."""
    return keys.join(inventory.select(*on), list(on), "left_anti")


def plan_copy(src: DataFrame, dst_container: str | None = None,
              dst_inventory: DataFrame | None = None, dst_prefix: str = "",
              keep_container: bool = False, collisions: str | None = None) -> DataFrame:
    """B1: every source object and where it goes; ``overwrites`` marks keys
    that already exist at the destination (left join on the key, both sides
    shuffled on it; keys are unique per container, so no key fans out).

    ``dst_key`` is the source key under ``dst_prefix`` (with the source
    container as a folder when ``keep_container``). Several containers may so
    name one target: with ``collisions`` the plan is settled by that rule
    (``settle_targets``) before it looks at the destination; without, the run
    refuses such rows."""
    if dst_container is None:
        raise ValueError("a copy plan needs a destination container")
    rel = F.concat(F.col("container"), F.lit("/"), F.col("key")) if keep_container else F.col("key")
    plan = src.select("container", "key", "size",
                      F.lit(dst_container).alias("dst_container"),
                      F.concat(F.lit(dst_prefix), rel).alias("dst_key"))
    if collisions:
        plan = settle_targets(plan, collisions)
    if dst_inventory is None:
        return plan.withColumn("overwrites", F.lit(False))
    existing = dst_inventory.select(F.col("container").alias("dst_container"),
                                    F.col("key").alias("dst_key"),
                                    F.lit(True).alias("overwrites"))
    # refused rows write nothing, and the others are one a target: no key is hot
    refused = F.col("refused") if collisions else F.lit(False)
    out = plan.filter(~refused).join(existing, ["dst_container", "dst_key"], "left").select(
        *plan.columns, F.coalesce("overwrites", F.lit(False)).alias("overwrites"))
    return out.unionByName(plan.filter("refused").withColumn("overwrites", F.lit(False))) \
        if collisions else out


def plan_move(src: DataFrame, dst_container: str | None = None,
              dst_inventory: DataFrame | None = None, dst_prefix: str = "",
              keep_container: bool = False, collisions: str | None = None) -> DataFrame:
    """B2: a copy plan whose originals are deleted after a successful copy."""
    return plan_copy(src, dst_container, dst_inventory, dst_prefix, keep_container, collisions) \
        .withColumn("action", F.lit("move"))


def plan_sync(src: DataFrame, dst: DataFrame, dst_container: str, dst_prefix: str = "",
              checksums: bool = False) -> DataFrame:
    """What makes the objects under ``dst_prefix`` of the destination those of
    the source: ``(action, container, key, size, dst_container, dst_key)``.

    ``copy``: the destination does not have the object, has one of another size, or
    one written before the source's last change; ``unchanged``: it has it; ``remove``:
    the source does not have it any more (container and key are null). With
    ``checksums`` both inventories have a column ``checksum``, which then decides
    instead of the times. One full join on the key, which is unique on each side.
    Destination objects outside the prefix are not looked at.
    """
    compare = ["checksum"] if checksums else []
    s = src.select("container", "key", "size", "mtime", *compare,
                   F.concat(F.lit(dst_prefix), "key").alias("dst_key"))
    d = dst.filter(F.col("key").startswith(dst_prefix)).select(
        F.col("key").alias("dst_key"), F.col("size").alias("_size"),
        F.col("mtime").alias("_mtime"), *[F.col(c).alias("_" + c) for c in compare],
        F.lit(True).alias("_there"))
    same = F.col("size").eqNullSafe(F.col("_size")) & (
        F.col("checksum").eqNullSafe(F.col("_checksum")) if checksums
        else F.col("_mtime") >= F.col("mtime"))
    action = (F.when(F.col("container").isNull(), "remove")
              .when(F.col("_there").isNull() | ~F.coalesce(same, F.lit(False)), "copy")
              .otherwise("unchanged"))
    return s.join(d, "dst_key", "full").select(
        action.alias("action"), "container", "key",
        F.coalesce("size", "_size").alias("size"),
        F.lit(dst_container).alias("dst_container"), "dst_key")


TARGET = ("dst_container", "dst_key")


def shared_targets(plan: DataFrame) -> DataFrame:
    """(dst_container, dst_key, sources): the targets that several rows name (partial
    counts, so a target that many rows name is one row a map task)."""
    return plan.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("sources")).filter("sources > 1")


def settle_targets(plan: DataFrame, rule: str = "refuse") -> DataFrame:
    """B1/B2: no two rows of the plan that run write one target.

    Adds ``rivals`` (rows that name the target, this one included) and ``refused``.
    Rows of a shared target are taken by container and key:

    * ``refuse``: all of them are refused;
    * ``first``: the first keeps it, the others are refused;
    * ``rename``: the first keeps it, the others get ``~`` and 16 hex digits of the
      SHA-256 of their container and key before the extension; rows whose new
      target is another row's after all are refused.

    A target that any number of rows name is never one task's: the rows are
    numbered by ranges of (target, container, key), see ``sequence_in_group``.
    """
    if rule not in ("refuse", "first", "rename"):
        raise ValueError(f"no such rule: {rule}")
    if shared_targets(plan).isEmpty():
        return plan.withColumns({"rivals": F.lit(1).cast("bigint"), "refused": F.lit(False)})
    out = sequence_in_group(plan, TARGET, ("container", "key"), "_nth", total="rivals")
    later = F.col("_nth") > 1
    if rule != "rename":
        lost = (F.col("rivals") > 1) if rule == "refuse" else later
        return out.withColumn("refused", lost).drop("_nth")
    mark = F.concat(F.lit("~"), F.substring(F.sha2(F.concat_ws("\n", "container", "key"), 256), 1, 16))
    # the extension: the last dot of the name and what follows, not a leading dot
    parts = F.regexp_extract("dst_key", r"(?s)^(.*?[^/])(\.[^./]*)?$", 1), \
        F.regexp_extract("dst_key", r"(?s)^(.*?[^/])(\.[^./]*)?$", 2)
    new = out.withColumn("dst_key", F.when(later, F.concat(parts[0], mark, parts[1]))
                         .otherwise(F.col("dst_key"))).drop("_nth")
    if shared_targets(new).isEmpty():
        return new.withColumn("refused", F.lit(False))
    again = sequence_in_group(new, TARGET, ("container", "key"), "_nth", total="_same")
    return again.withColumn("refused", F.col("_same") > 1).drop("_nth", "_same")


def sequence_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str],
                      name: str = "seq", n_partitions: int | None = None,
                      stable: bool = True, total: str | None = None) -> DataFrame:
    """1-based position of each row within its group, by ``order`` (ties are
    numbered in an arbitrary but fixed order); with ``total`` also the group's rows.

    Unlike ``row_number() over (partition by group)``, no group is ever held by
    one task: rows are range-partitioned on (group, order), numbered inside
    each partition, and each partition's count per group is turned into an
    offset by a running sum over the (partition, group) counts - at most
    #partitions rows per group. The numbered rows are checkpointed to the
    shared checkpoint folder (``stable``), so the two reads that follow see
    the same partitioning and numbering even if a task or executor is lost.
    """
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    if stable:
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    stats = tagged.groupBy(*group, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(*group, "_pid", "_first",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))
    offsets = offsets.select(F.col("_pid").alias("_p"), "_first", "_before", "_total",
                             *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)])
    same = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):             # a null group is a group like any other
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    out = tagged.join(offsets, same).drop("_p", *[f"_g{i}" for i in range(len(group))])
    out = out.withColumn(name, (F.col("_before") + F.col("_mid") - F.col("_first") + 1)
                         .cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_pid", "_mid", "_first", "_before", "_total")


def delete_batches(keys: DataFrame, size: int = DELETE_BATCH,
                   group: Sequence[str] = ("container",),
                   order: Sequence[str] = ("key",)) -> DataFrame:
    """Batches of at most ``size`` keys per container, in key order."""
    seq = sequence_in_group(keys, group, order)
    return seq.withColumn("batch", F.floor((F.col("seq") - 1) / F.lit(size)).cast("bigint"))


def plan_delete(inventory: DataFrame, size: int = DELETE_BATCH) -> DataFrame:
    """Every object of the container(s), batched; containers stay."""
    return delete_batches(inventory.select("container", "key", "size"), size)


def plan_delete_many(inventories: DataFrame) -> DataFrame:
    """Per container, objects found and what a delete would remove."""
    return container_counts(inventories).select(
        "container", F.col("objects").alias("objects_found"),
        F.col("objects").alias("would_delete"), "bytes")
