"""Execute written bulk plans (B5-B8); every run leaves a ledger of outcomes.

Rules that keep the jobs safe on a cluster that loses executors:

* A run reads a plan already *written* (Parquet): a lazy listing would be
  listed again on a retry and could differ.
* Copy overwrites its target, delete of an absent key is success: a task that
  is retried repeats its work with the same outcome.
* A copy is done only if it has as many bytes as its source; on local and
  Hadoop file systems it is written under another name and renamed, so a failed
  or doubled attempt never leaves a short target. An object is never copied
  onto itself, and a tree never into itself.
* No target is written by two rows of a run: rows that name one target are refused
  (unless the plan was settled by another rule, ``operators.objects.settle_targets``).
* A move deletes only originals whose copy the *written* copy ledger reports
  as done (left semi join), never "the first n keys", and only while the target
  still has the bytes of that copy.
* The work is spread by the hash of container and key (copy) or by delete batch
  (at most 1000 keys per group), so no task holds a whole container, nor all
  objects of one name.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import dest_key
from ferrylake.operators import objects as O
from ferrylake.session import remove_scratch, scratch_path, ship_package
from ferrylake.sources.inventory import filesystem, kind_of, object_inventory

LEDGER_SCHEMA = ("container string, key string, dst_container string, dst_key string, "
                 "status string, error string, bytes bigint")
DELETE_LEDGER_SCHEMA = "container string, key string, status string, error string"
CHUNK = 8 << 20


def write_plan(plan: DataFrame, path: str | None = None) -> str:
    """Freeze a plan as Parquet; runs only ever read written plans."""
    path = path or scratch_path(plan.sparkSession, "plan")
    plan.write.mode("errorifexists").parquet(path)
    return path


def _join(base: str, key: str) -> str:
    return f"{base.rstrip('/')}/{key}"


def _copy_one(src_fs, src, dst_fs, dst) -> int:
    """Copy one object and return its size; an error if the copy has another one.
    Within one store the store copies (no byte passes through here)."""
    if src_fs.equals(dst_fs) and src_fs.normalize_path(src) == dst_fs.normalize_path(dst):
        raise ValueError("source and target are the same object")
    size = src_fs.get_file_info(src).size
    if size is None:
        raise FileNotFoundError(src)
    renames = dst_fs.type_name in ("local", "hdfs")     # object stores put whole objects
    parent = dst.rsplit("/", 1)[0]
    if parent and renames:
        dst_fs.create_dir(parent, recursive=True)
    to = f"{parent}/.{uuid.uuid4().hex}.part" if renames else dst
    try:
        if src_fs.equals(dst_fs):
            dst_fs.copy_file(src, to)
        else:
            with src_fs.open_input_stream(src) as fin, dst_fs.open_output_stream(to) as fout:
                while buf := fin.read(CHUNK):
                    fout.write(buf)
        n = dst_fs.get_file_info(to).size
        if n != size:
            raise OSError(f"{n} of {size} bytes copied")
        if renames:
            dst_fs.move(to, dst)
    except Exception:
        if renames and dst_fs.get_file_info(to).size is not None:
            dst_fs.delete_file(to)
        raise
    return n


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict = {}

    def fs_of(root):
        if root not in cache:
            cache[root] = filesystem(root)
        return cache[root]

    for pdf in batches:
        out = []
        for c, k, dc, dk, size in zip(pdf["container"], pdf["key"], pdf["dst_container"],
                                      pdf["dst_key"], pdf["size"]):
            try:
                sfs, sbase = fs_of(c)
                dfs, dbase = fs_of(dc)
                n = _copy_one(sfs, _join(sbase, k), dfs, _join(dbase, dk))
                if not pd.isna(size) and n != int(size):
                    raise OSError(f"{n} bytes now, {int(size)} when it was planned")
                out.append((c, k, dc, dk, "ok", None, n))
            except Exception as e:  # noqa: BLE001 - one failure must not stop the rest
                out.append((c, k, dc, dk, "failed", f"{type(e).__name__}: {e}", 0))
        yield pd.DataFrame(out, columns=["container", "key", "dst_container", "dst_key",
                                         "status", "error", "bytes"])


# --- large objects in parts --------------------------------------------------

PART_BYTES = 128 << 20
_PARTS = ("container string, key string, dst_container string, dst_key string, size bigint, "
          "begin bigint, stop bigint, part_name string")
_PART_LEDGER = _PARTS + ", copied bigint, error string"


def _in_parts(part_bytes: int):
    """Rows of objects that are written in parts: larger than one, to a local or mounted
    file system, where tasks can write at their own places of one file. (An object store
    takes an object from one writer, which sends parts at once by itself.)"""
    local = ~F.col("dst_container").rlike("^[A-Za-z][A-Za-z0-9+.-]+:") \
        | F.col("dst_container").startswith("file:")
    return F.coalesce((F.col("size") > part_bytes) & local, F.lit(False))


def _copy_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Write each part at its place; a part that is written again writes the same."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            done, error = 0, None
            try:
                sfs, sbase = filesystem(r.container)
                dfs, dbase = filesystem(r.dst_container)
                to = _join(dbase, r.part_name)
                if sfs.equals(dfs) and sfs.normalize_path(_join(sbase, r.key)) == \
                        dfs.normalize_path(_join(dbase, r.dst_key)):
                    raise ValueError("source and target are the same object")
                dfs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with sfs.open_input_file(_join(sbase, r.key)) as fin:
                    if fin.size() != r.size:
                        raise OSError(f"{fin.size()} bytes now, {r.size} when it was planned")
                    fd = os.open(to, os.O_RDWR | os.O_CREAT, 0o666)
                    try:
                        at = r.begin
                        while at < r.stop and (buf := fin.read_at(min(CHUNK, r.stop - at), at)):
                            at += os.pwrite(fd, buf, at)
                        os.fsync(fd)
                    finally:
                        os.close(fd)
                done = at - r.begin
            except Exception as e:  # noqa: BLE001 - one failure must not stop the rest
                error = f"{type(e).__name__}: {e}"
            out.append((*r, done, error))
        yield pd.DataFrame(out, columns=[*pdf.columns, "copied", "error"])


def _join_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Put an object whose parts are all there in its place, else remove them."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            dfs, dbase = filesystem(r.dst_container)
            part, to = _join(dbase, r.part_name), _join(dbase, r.dst_key)
            error = r.error
            try:
                n = dfs.get_file_info(part).size
                if error is None and r.copied == r.size and n is None \
                        and dfs.get_file_info(to).size == r.size:
                    pass                               # a task before this one renamed it
                elif error is None and (r.copied != r.size or n != r.size):
                    error = f"{r.copied} of {r.size} bytes copied"
                elif error is None:
                    dfs.move(part, to)
                if error is not None and n is not None:
                    dfs.delete_file(part)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
            out.append((r.container, r.key, r.dst_container, r.dst_key,
                        "failed" if error else "ok", error, 0 if error else r.size))
        yield pd.DataFrame(out, columns=["container", "key", "dst_container", "dst_key",
                                         "status", "error", "bytes"])


def _copy_large(spark: SparkSession, large: DataFrame, part_bytes: int, scratch: str) -> DataFrame:
    """Ledger of objects copied in parts: (object, part) rows are dealt over tasks, their
    written ledger decides which objects are whole."""
    run = uuid.uuid4().hex
    name = F.concat(F.regexp_extract("dst_key", "(?s)^(.*/)?[^/]*$", 1), F.lit(f".{run}-"),
                    F.substring(F.sha2(F.concat_ws("\n", "container", "key"), 256), 1, 24),
                    F.lit(".part"))
    begins = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(part_bytes).cast("bigint"))
    parts = large.withColumn("part_name", name).withColumn("begin", F.explode(begins)).withColumn(
        "stop", F.least(F.col("begin") + part_bytes, F.col("size"))).select(
        *[c.split(" ")[0] for c in _PARTS.split(", ")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts.repartition(n, "container", "key", "begin").mapInPandas(
        _copy_parts, _PART_LEDGER).write.parquet(scratch)
    whole = spark.read.parquet(scratch).groupBy(
        "container", "key", "dst_container", "dst_key", "size", "part_name").agg(
        F.sum("copied").alias("copied"), F.min("error").alias("error"))
    return whole.mapInPandas(_join_parts, LEDGER_SCHEMA)


def _read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_copy(spark: SparkSession, plan_path: str, ledger_path: str | None = None,
             parallelism: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Copy every planned object, carry on after failures; the ledger
    ``(container, key, dst_container, dst_key, status, error, bytes)`` is
    written and returned. If the plan has sizes, an object that has another one by
    now is a failure. Rows that name the same target are not copied: their status
    is ``refused``, and the error says how many name it. Work is spread by container
    and key over ``parallelism`` tasks (default: the shuffle partitions). An object of
    more than ``part_bytes`` that goes to a local or mounted file system is copied in
    parts by several tasks and renamed into place when all are there; if the plan has no
    sizes, no object is."""
    ship_package(spark)
    plan = spark.read.parquet(plan_path)
    if "size" not in plan.columns:
        plan = plan.withColumn("size", F.lit(None).cast("bigint"))
    if "refused" not in plan.columns:
        plan = O.settle_targets(plan, "refuse")
    told = plan.filter("refused").select(
        "container", "key", "dst_container", "dst_key", F.lit("refused").alias("status"),
        F.format_string("%d objects go to this target", "rivals").alias("error"),
        F.lit(0).cast("bigint").alias("bytes"))
    plan = plan.filter(~F.col("refused")).select(
        "container", "key", "dst_container", "dst_key", "size")
    by = ["container", "key"]
    large = plan.filter(_in_parts(part_bytes))
    parts_path = None if large.isEmpty() else scratch_path(spark, "copy-parts")
    if parts_path:
        told = told.unionByName(_copy_large(spark, large, part_bytes, parts_path))
        plan = plan.filter(~_in_parts(part_bytes))
    dealt = plan.repartition(parallelism, *by) if parallelism else plan.repartition(*by)
    ledger = dealt.mapInPandas(_copy_batches, LEDGER_SCHEMA).unionByName(told)
    ledger_path = ledger_path or scratch_path(spark, "copy-ledger")
    ledger.write.mode("overwrite").parquet(ledger_path)
    if parts_path:
        remove_scratch(spark, parts_path)
    return _read_ledger(spark, ledger_path)


DELETE_THREADS = 8


def _delete_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """One call per key, some at a time; a key that is gone already is done. With the
    columns of a copy, the original goes only if the copy is there with its bytes."""
    guarded = "dst_container" in pdf.columns
    names = [pdf["container"], pdf["dst_container"]] if guarded else [pdf["container"]]
    roots = {c: filesystem(c) for c in pd.concat(names).unique()}

    def delete(c: str, k: str, *copy) -> tuple:
        fs, base = roots[c]
        try:
            if copy:
                to, there, size = copy
                dfs, dbase = roots[to]
                now = dfs.get_file_info(_join(dbase, there)).size
                if now != size:
                    raise OSError(f"the copy has {now} bytes, not {size}: the original stays")
            fs.delete_file(_join(base, k))
        except FileNotFoundError:
            pass
        except Exception as e:  # noqa: BLE001
            return c, k, "failed", f"{type(e).__name__}: {e}"
        return c, k, "ok", None

    columns = ["container", "key"] + ["dst_container", "dst_key", "bytes"] * guarded
    with ThreadPoolExecutor(DELETE_THREADS) as pool:
        out = list(pool.map(delete, *[pdf[c] for c in columns]))
    return pd.DataFrame(out, columns=["container", "key", "status", "error"])


def run_delete(spark: SparkSession, plan_path: str, ledger_path: str | None = None) -> DataFrame:
    """Delete in batches of at most 1000 keys (one pandas group each);
    a failure is reported per key. Ledger ``(container, key, status, error)``. A plan
    with ``dst_container``, ``dst_key`` and ``bytes`` deletes originals of copies: one
    whose copy is not there with these bytes is kept and reported."""
    ship_package(spark)
    plan = spark.read.parquet(plan_path)
    if "batch" not in plan.columns:
        plan = O.delete_batches(plan.select("container", "key"))
    copy = [c for c in ("dst_container", "dst_key", "bytes") if c in plan.columns]
    ledger = plan.select("container", "key", "batch", *copy).groupBy("container", "batch") \
        .applyInPandas(_delete_group, DELETE_LEDGER_SCHEMA)
    ledger_path = ledger_path or scratch_path(spark, "delete-ledger")
    ledger.write.mode("overwrite").parquet(ledger_path)
    return _read_ledger(spark, ledger_path)


def run_move(spark: SparkSession, plan_path: str, ledger_path: str | None = None) -> DataFrame:
    """Copy, then delete exactly the originals the written copy ledger
    reports as copied, while their copies have the ledger's bytes. Refused rows
    keep their originals. Ledger has the copy columns plus ``deleted``."""
    copy_path, delete_path = (scratch_path(spark, x) for x in ("copy-ledger", "delete-ledger"))
    copy_ledger = run_copy(spark, plan_path, copy_path)
    copied = copy_ledger.filter(F.col("status") == "ok").select(
        "container", "key", "dst_container", "dst_key", "bytes")
    to_delete = write_plan(O.delete_batches(copied))
    del_ledger = run_delete(spark, to_delete, delete_path)
    deleted = del_ledger.select("container", "key", (F.col("status") == "ok").alias("deleted"),
                                F.col("error").alias("delete_error"))
    moved = copy_ledger.join(deleted, ["container", "key"], "left").select(
        "container", "key", "dst_container", "dst_key",
        F.when((F.col("status") == "ok") & F.col("deleted"), F.lit("ok"))
        .when(F.col("status") == "refused", F.lit("refused"))
        .otherwise(F.lit("failed")).alias("status"),
        F.coalesce("error", "delete_error").alias("error"), "bytes",
        F.coalesce("deleted", F.lit(False)).alias("deleted"))
    ledger_path = ledger_path or scratch_path(spark, "move-ledger")
    moved.write.mode("overwrite").parquet(ledger_path)
    remove_scratch(spark, copy_path, delete_path, to_delete)
    return _read_ledger(spark, ledger_path)


def run_sync(spark: SparkSession, plan_path: str, ledger_path: str | None = None) -> DataFrame:
    """Run a written ``plan_sync``: copies first, then removals, and these only if
    no copy failed, so a half-way sync has every object of the last one. Ledger: the
    copy columns plus ``action``; unchanged objects are listed as ``ok``, removals that
    were left out as ``skipped``."""
    copies, removals = (scratch_path(spark, x) for x in ("copy-ledger", "delete-ledger"))
    plan = spark.read.parquet(plan_path)
    to_copy = write_plan(plan.filter("action = 'copy'").drop("action"))
    copied = run_copy(spark, to_copy, copies).withColumn("action", F.lit("copy"))
    clean = copied.filter("status <> 'ok'").isEmpty()
    gone = plan.filter("action = 'remove'").select(
        F.col("dst_container").alias("container"), F.col("dst_key").alias("key"))
    to_remove = write_plan(O.delete_batches(gone))
    if clean:
        removed = run_delete(spark, to_remove, removals)
    else:
        removed = spark.read.parquet(to_remove).select(
            "container", "key", F.lit("skipped").alias("status"),
            F.lit("a copy failed").alias("error"))
    none = F.lit(None).cast("string")
    removed = removed.select(none.alias("container"), none.alias("key"),
                             F.col("container").alias("dst_container"),
                             F.col("key").alias("dst_key"), "status", "error",
                             F.lit(0).cast("bigint").alias("bytes"),
                             F.lit("remove").alias("action"))
    kept = plan.filter("action = 'unchanged'").select(
        "container", "key", "dst_container", "dst_key", F.lit("ok").alias("status"),
        none.alias("error"), F.col("size").alias("bytes"), "action")
    ledger_path = ledger_path or scratch_path(spark, "sync-ledger")
    copied.unionByName(removed).unionByName(kept).write.mode("overwrite").parquet(ledger_path)
    remove_scratch(spark, copies, to_copy, to_remove, *([removals] if clean else []))
    return _read_ledger(spark, ledger_path)


def with_checksums(inventory: DataFrame) -> DataFrame:
    """An inventory with the SHA-256 of each object, read in chunks by executors."""
    ship_package(inventory.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for c, k in zip(pdf["container"], pdf["key"]):
                fs, base = filesystem(c)
                h = hashlib.sha256()
                with fs.open_input_stream(_join(base, k)) as f:
                    while buf := f.read(CHUNK):
                        h.update(buf)
                sums.append(h.hexdigest())
            yield pdf.assign(checksum=sums)

    n = int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inventory.repartition(n, "container", "key").mapInPandas(
        run, O.INVENTORY_SCHEMA + ", checksum string")


def sync_plan(spark: SparkSession, src: DataFrame, dst_root: str, prefix: str = "",
              checksums: bool = False) -> DataFrame:
    """The plan that makes ``prefix`` of ``dst_root`` the inventory ``src``."""
    root = dst_root.rstrip("/")
    there = object_inventory(spark, root) if kind_of(root) == "folder" else \
        spark.createDataFrame([], O.INVENTORY_SCHEMA)
    if checksums:
        src, there = with_checksums(src), with_checksums(there)
    return O.plan_sync(src, there, root, prefix, checksums)


def land_folder(spark: SparkSession, local_root: str, dst_root: str, prefix: str = "raw/",
                ledger_path: str | None = None, sync: bool = False,
                checksums: bool = False) -> DataFrame:
    """A whole tree copied under ``prefix`` of ``dst_root``, layout kept; an
    error if there is no such tree. With ``sync`` only what is new or changed is
    copied, and what left the tree is removed (``plan_sync``); the ledger then has
    the column ``action``."""
    inv = object_inventory(spark, local_root)
    root = local_root.rstrip("/")
    if sync:
        plan_path = write_plan(sync_plan(spark, inv, dst_root, prefix, checksums))
        ledger = run_sync(spark, plan_path, ledger_path)
    else:
        plan = inv.select(
            "container", "key", F.lit(dst_root.rstrip("/")).alias("dst_container"),
            dest_key(F.concat(F.lit(root + "/"), F.col("key")), root, prefix).alias("dst_key"),
            "size")
        plan_path = write_plan(plan)
        ledger = run_copy(spark, plan_path, ledger_path)
    remove_scratch(spark, plan_path)
    return ledger


def _put_batches(root: str):
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(root)
        for pdf in batches:
            out = []
            for k, body in zip(pdf["key"], pdf["body"]):
                try:
                    path = _join(base, k)
                    parent = path.rsplit("/", 1)[0]
                    fs.create_dir(parent, recursive=True)
                    data = (body or "").encode("utf-8")
                    with fs.open_output_stream(path) as f:
                        f.write(data)
                    out.append((root, k, "ok", None, len(data)))
                except Exception as e:  # noqa: BLE001
                    out.append((root, k, "failed", f"{type(e).__name__}: {e}", 0))
            yield pd.DataFrame(out, columns=["container", "key", "status", "error", "bytes"])
    return put


def put_objects(df: DataFrame, root: str, key: str = "key", body: str = "body",
                parallelism: int | None = None) -> DataFrame:
    """Write each row's text ``body`` as object ``key`` under ``root`` (one
    small object per row, written by executors); returns the ledger."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(key).alias("key"), F.col(body).alias("body"))
    rows = rows.repartition(parallelism) if parallelism else rows.repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")))
    ledger = rows.mapInPandas(_put_batches(root.rstrip("/")),
                              "container string, key string, status string, error string, bytes bigint")
    path = scratch_path(spark, "put-ledger")
    ledger.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# --------------------------------------------------------------------------
# Whole-tree jobs: plan (the reference's dry run) or plan + run.


def _exists(root: str) -> bool:
    return kind_of(root) == "folder"


def _refuse_overlap(src_root: str, dst_root: str) -> None:
    """A tree is not copied or moved onto or into itself, nor over a folder that
    holds it."""
    (sfs, src), (dfs, dst) = filesystem(src_root), filesystem(dst_root)
    a, b = src.rstrip("/") + "/", dst.rstrip("/") + "/"
    if sfs.equals(dfs) and (a.startswith(b) or b.startswith(a)):
        raise ValueError(f"{src_root} and {dst_root} are the same tree, or one holds the other")


def plan_copy_tree(spark: SparkSession, src_root: str, dst_root: str,
                   move: bool = False) -> DataFrame:
    """B1/B2 over two roots: every object of ``src_root`` to the same key in
    ``dst_root``; ``overwrites`` from the destination's own inventory. The
    destination must exist (create it first), as in the reference."""
    if not _exists(dst_root):
        raise ValueError(f"no such destination: {dst_root}")
    _refuse_overlap(src_root, dst_root)
    src = object_inventory(spark, src_root)
    dst = object_inventory(spark, dst_root)
    plan = O.plan_move if move else O.plan_copy
    return plan(src.select("container", "key", "size"), dst_root.rstrip("/"), dst)


def copy_tree(spark: SparkSession, src_root: str, dst_root: str, dry_run: bool = True,
              move: bool = False) -> dict:
    """Copy (or move) a whole tree. ``dry_run`` returns the written plan and
    its size without touching an object; otherwise the plan is run and the
    ledger returned with its summary."""
    plan_path = write_plan(plan_copy_tree(spark, src_root, dst_root, move))
    plan = spark.read.parquet(plan_path)
    if dry_run:
        n = plan.count()
        verb = "move" if move else "copy"
        return {"success": True, "plan": plan_path, f"would_{verb}": n,
                "overwrites": plan.filter("overwrites").count(),
                "message": f"dry run, {verb}: {n} objects of {src_root} to {dst_root}"}
    ledger = run_move(spark, plan_path) if move else run_copy(spark, plan_path)
    s = O.outcome_summary(ledger, by=[]).first()
    return {"success": s is None or s["failed"] == 0, "plan": plan_path, "ledger": ledger,
            "done": 0 if s is None else s["done"], "failed": 0 if s is None else s["failed"]}


def delete_tree(spark: SparkSession, root: str, dry_run: bool = True) -> dict:
    """Delete every object under ``root`` (the root itself is kept)."""
    plan_path = write_plan(O.plan_delete(object_inventory(spark, root)))
    plan = spark.read.parquet(plan_path)
    if dry_run:
        n = plan.count()
        return {"success": True, "plan": plan_path, "would_delete": n,
                "message": f"dry run, delete: {n} objects of {root}"}
    ledger = run_delete(spark, plan_path)
    s = O.outcome_summary(ledger, by=[]).first()
    return {"success": s is None or s["failed"] == 0, "plan": plan_path, "ledger": ledger,
            "deleted": 0 if s is None else s["done"], "failed": 0 if s is None else s["failed"]}


def plan_delete_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Per root, objects found and what a delete would remove; a root
    that does not exist is listed with its error instead of stopping the rest."""
    parts, missing = [], []
    for r in roots:
        if _exists(r):
            parts.append(object_inventory(spark, r))
        else:
            missing.append((r.rstrip("/"), f"no such folder: {r}"))
    schema = "container string, objects_found bigint, would_delete bigint, bytes bigint, error string"
    out = spark.createDataFrame([(c, 0, 0, 0, e) for c, e in missing], schema)
    if parts:
        inv = parts[0]
        for p in parts[1:]:
            inv = inv.unionByName(p)
        found = O.plan_delete_many(inv).withColumn("error", F.lit(None).cast("string"))
        out = found.unionByName(out)
    return out
