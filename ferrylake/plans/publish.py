"""A table's new contents take effect at once or not at all.

Each write goes to a folder of its own, ``<root>/v-<time>-<id>``; the table points at
one of them and is turned to the new one by a single ``ALTER TABLE … SET LOCATION``
after the write is whole. A write that fails half-way, or whose columns are not the
table's, leaves the table and its files as they were. Versions before the current one
are kept for queries that are still reading them, ``keep`` of them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ferrylake.plans import catalog as T
from ferrylake.sources.text import convert_to_parquet


def publish(df: DataFrame, root: str, database: str, table: str, keep: int = 1,
            comment: str | None = None) -> dict:
    """Write ``df`` as the next version of an external Parquet table and turn the table
    to it; the table is registered if it is new. ``location`` is the version's folder,
    ``removed`` the older versions that went."""
    spark = df.sparkSession
    db, tbl = T.slug_name(database, "db"), T.slug_name(table, "tbl")
    name = f"{T._q(db)}.{T._q(tbl)}"
    out = f"{root.rstrip('/')}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    said = {"database": db, "table": tbl}
    try:
        convert_to_parquet(df, out, mode="errorifexists")
        if spark.catalog.tableExists(name):
            if other := T._differs(spark, db, tbl, out, None, None):
                remove_folder(spark, out)
                return {"success": False, "error": other, **said}
            spark.sql(f"ALTER TABLE {name} SET LOCATION {T._lit(out)}")
            spark.catalog.refreshTable(name)
        else:
            res = T.register_table(spark, db, tbl, out, None, fmt="parquet", comment=comment)
            if not res["success"]:
                remove_folder(spark, out)
                return {**res, **said}
    except Exception as e:  # noqa: BLE001 - reported; the table still has its old version
        remove_folder(spark, out)
        return {"success": False, "error": f"{type(e).__name__}: {e}", **said}
    old = [v for v in versions(spark, root) if v < out.rsplit("/", 1)[1]]
    gone = old[:max(len(old) - keep, 0)]
    for v in gone:
        remove_folder(spark, f"{root.rstrip('/')}/{v}")
    return {"success": True, "location": out, "removed": len(gone),
            "message": f"table {db}.{tbl}: turned to {out}", **said}


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the version folders under ``root``, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v-"))


def roll_back(spark: SparkSession, root: str, database: str, table: str) -> dict:
    """Turn a table back to the version before its current one."""
    db, tbl = T.slug_name(database, "db"), T.slug_name(table, "tbl")
    name = f"{T._q(db)}.{T._q(tbl)}"
    now = T.table_location(spark, db, tbl).rstrip("/").rsplit("/", 1)[1]
    before = [v for v in versions(spark, root) if v < now]
    if not before:
        return {"success": False, "error": f"no version of {db}.{tbl} before {now}"}
    spark.sql(f"ALTER TABLE {name} SET LOCATION {T._lit(root.rstrip('/') + '/' + before[-1])}")
    spark.catalog.refreshTable(name)
    return {"success": True, "location": before[-1]}


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
