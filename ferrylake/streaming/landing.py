"""Landing-folder streams: the type vote and the typed append as Structured
Streaming queries over CSV files arriving in a folder.

* ``profile_stream``: the A1 counts kept as streaming state (one row per
  column, however many files arrive); each trigger writes the whole snapshot to
  a place of its own, so a reader never meets a gap (``read_snapshot``).
* ``ingest_stream``: each new file typed with the settled schema (R6) and
  appended to Parquet; the checkpoint makes the file sink exactly-once.

Both default to ``availableNow``: process what has landed, then stop.
"""

from __future__ import annotations

import csv
import io
import sys
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ferrylake.operators import apply as R6
from ferrylake.operators import profile as A
from ferrylake.session import ship_package
from ferrylake.sources.text import _CORRUPT, CSV_READ


def text_stream(spark: SparkSession, folder: str, columns: Sequence[str],
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New CSV files anywhere below ``folder`` as a stream of text rows.

    As in ``read_text_table``, each file is read by its own header: its columns may
    have another order, a column it lacks and a field that a short row does not have
    are null, an empty field is "". Columns that ``columns`` does not name are left
    out; a file whose header names none of them, or one twice, stops the stream."""
    ship_package(spark)
    cells = [f"_c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, _CORRUPT]])
    # a file of quoted line breaks is not split: its rows come in order, header first
    reader = (spark.readStream.options(**{**CSV_READ, "header": "false"})
              .option("multiLine", "true").schema(schema)
              .option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", "false")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.csv(folder).select("*", F.col("_metadata.file_path").alias("_file"))
    out = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return df.mapInPandas(_by_header(list(columns), cells), out)


def _by_header(columns: list[str], cells: list[str]
               ) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows by position, file after file, to rows of ``columns`` by each file's header."""

    def split(record: str) -> list[str]:
        return next(csv.reader(io.StringIO(record, newline="")), [""])

    def fields(row: pd.Series) -> list[str]:
        """A record's fields; one of another width than ``cells`` is kept as text."""
        if pd.isna(row[_CORRUPT]):
            return [x or "" for x in row[cells]]
        return split(row[_CORRUPT])

    def positions(file: str, header: list[str]) -> dict[str, int]:
        if len(set(header)) < len(header) or not set(header) & set(columns):
            raise ValueError(f"{file} has the header {header}; wanted are {columns}, once each")
        return {c: i for i, c in enumerate(header)}

    def mapped(rows: pd.DataFrame, place: dict[str, int]) -> pd.DataFrame:
        odd = rows[_CORRUPT].notna().to_numpy()
        texts = list(map(split, rows[_CORRUPT].to_numpy(object)[odd]))
        out = {}
        for c in columns:
            i = place.get(c, sys.maxsize)
            col = np.full(len(rows), None, object)
            if i < len(cells):
                col[:] = rows[cells[i]].fillna("").to_numpy(object)
            col[odd] = [t[i] if i < len(t) else None for t in texts]
            out[c] = col
        return pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        file, place = None, {}
        for b in batches:
            names = b["_file"].to_numpy(object)
            starts = [k for k in range(len(b)) if not k or names[k] != names[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(b)]):
                if names[lo] != file:
                    file = names[lo]
                    place = positions(file, fields(b.iloc[lo]))
                    lo += 1
                yield mapped(b.iloc[lo:hi], place)

    return run


def profile_stream(spark: SparkSession, folder: str, columns: Sequence[str], out: str,
                   checkpoint: str, mode: str = "overlap",
                   available_now: bool = True) -> StreamingQuery:
    """Running type counts of a landing folder; each trigger's snapshot is the
    partition ``epoch=<n>`` of ``out``."""
    counts = A.type_counts(text_stream(spark, folder, columns), mode=mode,
                           pre_group=False, already_text=True)

    def write_snapshot(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = (counts.writeStream.outputMode("complete").foreachBatch(write_snapshot)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The counts of the last trigger that ``profile_stream`` has finished."""
    every = spark.read.parquet(out)
    last = every.agg(F.max("epoch")).first()[0]
    return every.filter(F.col("epoch") == last).drop("epoch")


def ingest_stream(spark: SparkSession, folder: str, columns: Sequence[str], schema,
                  out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Typed Parquet appended as files land."""
    typed = R6.apply_schema(text_stream(spark, folder, columns), schema)
    w = (typed.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
