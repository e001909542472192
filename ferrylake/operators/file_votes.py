"""A1/A6 over files that keep arriving: each file's counts are kept, so a later vote
reads only the files that are new or have changed.

The counts of a vote are sums over rows, so a folder's vote is the sum of its files'.
A store holds, per file (key, size, mtime) and column, the counts of ``type_counts``;
it is written as a new folder each time and the last whole one counts, so a vote that
fails half-way leaves the one before.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrylake.operators.profile import COUNT_COLS, _counts
from ferrylake.plans.publish import remove_folder, versions
from ferrylake.sources import text as S
from ferrylake.sources.split_csv import RANGE_BYTES, csv_files, file_headers, record_runs, split_records

FILE = ["key", "size", "mtime"]
STORE = ("key string, size bigint, mtime timestamp, at int, column string, total bigint, "
         + ", ".join(f"{c} bigint" for c in ["n_blank", *COUNT_COLS]))


@dataclass
class FolderVote:
    """``counts`` as ``type_counts`` gives them, and how many files were read, were known
    already, and have left (or changed) since the last vote."""
    counts: DataFrame
    read: int
    kept: int
    gone: int


def file_counts(files: DataFrame, mode: str = "overlap", range_bytes: int = RANGE_BYTES,
                settle: bool = False) -> DataFrame:
    """The counts of each file's columns, in the columns of ``STORE``; a file without
    rows has counts of 0. With ``settle`` the rows are counted at once, so that the driver
    plans the classifiers once and not again for each stage of the joins behind them."""
    spark = files.sparkSession
    headers = file_headers(files)
    names = headers.join(files.select("container", *FILE), ["container", "key"]).select(
        *FILE, F.posexplode("header").alias("at", "column"))
    if headers.isEmpty():
        return spark.createDataFrame([], STORE)
    kinds = S.header_kinds(headers)
    runs = S.runs_with_kinds(record_runs(spark, files, range_bytes), headers, kinds)
    cells = S.header_cells(split_records(runs, keep=["key", "kind"]), kinds, "key")
    long = cells.select("key", F.inline(F.transform("header", lambda c, i: F.struct(
        c.alias("column"), F.when(i < F.col("_n"), F.get("_cells", i)).alias("value")))))
    counted = _counts(long, F.lit(1).cast("bigint"), mode, ["key", "column"])
    if settle:
        counted = counted.checkpoint(eager=True)         # a row a file and column
    out = names.join(counted, ["key", "column"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
               for c in ["total", "n_blank", *COUNT_COLS]]
    return out.select(*FILE, F.col("at").cast("int").alias("at"), "column", *numbers)


def vote_files(spark: SparkSession, path: str, store: str, mode: str = "overlap",
               csv_only: bool = False, range_bytes: int = RANGE_BYTES) -> FolderVote:
    """The vote of all CSV files under ``path`` by the counts kept in ``store`` (one
    store a folder and mode). A file is known if its name, size and time of change are;
    a column that a file lacks is null in all its rows, as ``read_text_table`` has it."""
    files = csv_files(spark, path, csv_only)
    if files is None:
        raise ValueError(f"files under {path} cannot be told apart: no such folder, "
                         "compressed files or a store that only Spark can read")
    root = store.rstrip("/")
    last = versions(spark, root)
    known = spark.read.schema(STORE).parquet(f"{root}/{last[-1]}") if last else \
        spark.createDataFrame([], STORE)
    seen = compare_files(files, known).checkpoint(eager=True)
    new = seen.filter("here AND NOT known").select("container", *FILE)
    kept = known.join(seen.filter("here AND known").select(*FILE), FILE, "left_semi")
    n_new, n_kept, n_gone = seen.agg(
        F.count_if(F.expr("here AND NOT known")), F.count_if(F.expr("here AND known")),
        F.count_if(F.expr("NOT here"))).first()
    out = f"{root}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    counts = file_counts(new, mode, range_bytes, settle=True) if n_new else \
        spark.createDataFrame([], STORE)
    kept.unionByName(counts).write.parquet(out)
    for v in last[:-1]:
        remove_folder(spark, f"{root}/{v}")
    merged = merge_counts(spark.read.schema(STORE).parquet(out), mode)
    return FolderVote(merged, n_new, n_kept, n_gone)


def compare_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """(container, key, size, mtime, here, known): the files of an inventory and those with
    kept counts, a row each; ``here`` and ``known`` say on which sides a file is."""
    there = known.select(*FILE).distinct().withColumn("known", F.lit(True))
    both = files.withColumn("here", F.lit(True)).join(there, FILE, "full")
    sides = [F.coalesce(c, F.lit(False)).alias(c) for c in ["here", "known"]]
    return both.select("container", *FILE, *sides)


def merge_counts(counts: DataFrame, mode: str = "overlap") -> DataFrame:
    """Sums of the files' counts; columns in the order of the first file."""
    numbers = ["total", "n_blank", *COUNT_COLS]
    per_file = counts.groupBy(*FILE).agg(F.max("total").alias("rows"))
    rows = F.coalesce(F.sum("rows"), F.lit(0))
    summed = counts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in numbers], F.min(F.struct("key", "at")).alias("_first"))
    # rows of the files that lack a column: null, a string to one vote, blank to the other
    whole = per_file.agg(rows.alias("_rows"))
    absent = F.col("_rows") - F.col("total")
    counts_as = "n_string" if mode == "overlap" else "n_blank"
    full = summed.join(F.broadcast(whole)).withColumn(
        counts_as, F.col(counts_as) + absent).withColumn("total", F.col("_rows"))
    pos = F.row_number().over(Window.orderBy("_first")) - 1      # one row a column
    return full.select(pos.cast("int").alias("pos"), "column", *numbers)
