"""The objects under a root as a DataFrame ``(container, key, size, mtime)``.

The driver lists only the first level of the root; every sub-folder is then
listed, recursively, by an executor task (``mapInPandas`` over the folder
names), so a tree with millions of objects is listed in parallel and never
passes through the driver as a whole. Zero-byte objects (folder markers on
object stores) are kept: Spark's ``binaryFile`` source would drop them.
"""

from __future__ import annotations

import itertools
import os
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.operators.objects import INVENTORY_SCHEMA
from ferrylake.session import ensure_checkpoint_dir, ship_package, to_local


# Schemes of stores that pyarrow opens, and the names Spark has for the same ones.
SCHEMES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs",
           "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def store_uri(uri: str) -> str | None:
    """``uri`` as pyarrow spells it, None for a local path; an error for a scheme
    that is neither."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", uri)
    if not m or m[1].lower() == "file":
        return None
    if m[1].lower() not in SCHEMES or not uri[m.end():].startswith("//"):
        raise ValueError(f"no file system known for {uri!r}")
    return SCHEMES[m[1].lower()] + uri[m.end() - 1:]


def filesystem(uri: str):
    """(pyarrow FileSystem, path) for a local path or a URI (s3a://, hdfs://, ...)."""
    from pyarrow import fs as pafs
    store = store_uri(uri)
    if store:
        return pafs.FileSystem.from_uri(store)
    return pafs.LocalFileSystem(), os.path.abspath(to_local(uri))


def kind_of(uri: str) -> str:
    """``file``, ``folder`` or ``missing``."""
    from pyarrow import fs as pafs
    fs, base = filesystem(uri)
    kind = fs.get_file_info(base).type
    return {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}.get(kind, "missing")


def _rel(path: str, base: str) -> str:
    base = base.rstrip("/")
    return path[len(base) + 1:] if path.startswith(base + "/") else path


def _row(info, container: str, base: str) -> tuple:
    mtime = info.mtime
    if mtime is not None and getattr(mtime, "tzinfo", None) is not None:
        mtime = mtime.replace(tzinfo=None)
    return (container, _rel(info.path, base), int(info.size or 0), mtime)


CHUNK = 10_000        # rows of one pandas frame


def _chunks(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, CHUNK)):
        yield pd.DataFrame(part, columns=columns)


def _entries(fs, folder: str, recursive: bool) -> Iterator:
    """The files and folders in (or below) a folder. A local or mounted folder is read
    entry by entry, however many it has; other stores hand over a whole listing."""
    from pyarrow import fs as pafs
    if not isinstance(fs, pafs.LocalFileSystem):
        yield from fs.get_file_info(pafs.FileSelector(folder, recursive=recursive,
                                                      allow_not_found=True))
        return
    open_folders = [folder]
    while open_folders:
        try:
            entries = os.scandir(open_folders.pop())
        except FileNotFoundError:
            continue
        with entries:
            while paths := [e.path for e in itertools.islice(entries, CHUNK)]:
                for info in fs.get_file_info(paths):
                    yield info
                    if recursive and info.type == pafs.FileType.Directory:
                        open_folders.append(info.path)


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs
    for pdf in batches:
        for root, folder in zip(pdf["root"], pdf["folder"]):
            fs, base = filesystem(root)
            rows = (_row(info, root, base) for info in _entries(fs, folder, recursive=True)
                    if info.type == pafs.FileType.File)
            yield from _chunks(rows, ["container", "key", "size", "mtime"])


_LEVEL_SCHEMA = "container string, key string, size bigint, mtime timestamp, folder string"


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level of each folder: its files, and its sub-folders (as rows with
    a ``folder`` and no key)."""
    from pyarrow import fs as pafs
    for pdf in batches:
        for root, folder in zip(pdf["root"], pdf["folder"]):
            fs, base = filesystem(root)
            rows = ((*_row(info, root, base), None) if info.type == pafs.FileType.File
                    else (root, None, None, None, info.path)
                    for info in _entries(fs, folder, recursive=False)
                    if info.type in (pafs.FileType.File, pafs.FileType.Directory))
            yield from _chunks(rows, ["container", "key", "size", "mtime", "folder"])


def object_inventory(spark: SparkSession, root: str, max_depth: int = 3,
                     min_prefixes: int | None = None) -> DataFrame:
    """All objects under ``root``; the container column is the root itself, so
    a plan built from the inventory can be executed.

    Folders are expanded breadth first, one level per small Spark job, until
    there are at least ``min_prefixes`` (default 4 per core) folders or
    ``max_depth`` levels; executors then list each remaining folder
    recursively. Folder names come back to the driver only while they are
    fewer than ``min_prefixes``. A tree whose
    objects sit in one big sub-folder is thus split over its sub-folders. A
    single flat folder is still listed by one task: a file-system listing
    cannot be split inside one folder. On a local or mounted file system that task
    holds ``CHUNK`` entries at a time.

    Each folder is listed once: a level's rows are checkpointed before they are
    used, so files and folders are of one moment. A missing root is an error."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    root = root.rstrip("/")
    if kind_of(root) != "folder":
        raise FileNotFoundError(f"{root} is not a folder")
    _fs, base = filesystem(root)
    target = min_prefixes or spark.sparkContext.defaultParallelism * 4
    wide = max(target, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    parts = []
    frontier = spark.createDataFrame([(root, base)], "root string, folder string")
    n = 1
    for depth in range(max_depth):
        listed = frontier.repartition(max(1, min(n, wide))).mapInPandas(
            _list_level, _LEVEL_SCHEMA).checkpoint(eager=True)
        parts.append(listed.filter(F.col("key").isNotNull()).drop("folder"))
        folders = listed.filter(F.col("folder").isNotNull()) \
            .select(F.col("container").alias("root"), "folder")
        n = folders.count()
        if n == 0:
            frontier = None
            break
        if n >= target or depth == max_depth - 1:
            frontier = folders  # stays a DataFrame: never collected, however many
            break
        # few folders: bring the names back and go one level deeper
        frontier = spark.createDataFrame(folders.collect(), "root string, folder string")
    if frontier is not None:
        parts.append(frontier.repartition(max(1, min(n, wide)))
                     .mapInPandas(_list_folders, INVENTORY_SCHEMA).checkpoint(eager=True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
