"""Text-table and file sources and sinks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylake.sources.split_csv import (RANGE_BYTES, csv_files, file_headers, file_ranges,
                                         record_runs, split_records)

# CSV dialect of the text tables: comma, double quote, a quote inside a quoted
# field doubled (RFC 4180), header row.
CSV_READ = {
    "header": "true",
    "inferSchema": "false",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_WRITE = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


_CORRUPT = "_ferrylake_record"


def read_text_table(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True,
                    empty_as_blank: bool = True, csv_only: bool = False,
                    by_header: bool = True, range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """CSV with a header, every value as text.

    Blank lines are skipped and surplus values of a long row dropped. An empty
    field is ``""`` (null with ``empty_as_blank=False``); a field that a short row
    does not have is null, which the vote counts in ``total`` and as string only.

    Files of a folder may have their columns in different orders, or different
    columns: each is read by its own header, and a column a file lacks is null
    (``by_header=False`` trusts the caller that all headers are equal and skips
    the look at each file's first record). Only a file's first record is its header,
    whatever rows follow.

    ``multi_line`` keeps quoted line breaks inside one value. Files are cut into
    records by ranges of ``range_bytes``, many tasks a file (``split_csv``);
    ``range_bytes=None``, compressed files and stores that only Spark can open
    take Spark's own reader, one task a file. ``multi_line=False`` is for data known
    to have no quoted line breaks: Spark splits such files itself.

    ``csv_only`` reads every ``*.csv`` file (any letter case) below ``path``;
    the file list never passes through the driver. Names that begin with ``_`` or
    ``.`` are passed over; ``ingest`` refuses those.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.options(**CSV_READ).option("multiLine", str(multi_line).lower())
    if csv_only:
        reader = reader.option("recursiveFileLookup", "true") \
            .option("pathGlobFilter", "*.[cC][sS][vV]")
    names = reader.csv(paths).columns
    if not names:
        return reader.csv(paths)
    files = csv_files(spark, path, csv_only) if isinstance(path, str) else None
    kinds = 1
    if by_header and files is not None:
        headers = file_headers(files)
        kinds = headers.select("header").distinct().limit(2).count()
    if kinds > 1:
        return _read_mixed(files, headers, empty_as_blank, range_bytes or RANGE_BYTES)
    schema = _text_schema(names)
    if multi_line and range_bytes and files is not None:
        df = _parsed(split_records(record_runs(spark, files, range_bytes)), schema)
    else:
        df = reader.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT) \
            .option("columnPruning", "false").csv(paths)
    if not empty_as_blank:
        return df.drop(_CORRUPT)
    here = _field_count(len(names))
    return df.select([F.when(F.lit(i) < here, F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c)
                      for i, c in enumerate(names)])


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*names, _CORRUPT]])


def _parsed(records: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """The fields of CSV records, by the dialect of the text tables."""
    options = {k: v for k, v in CSV_READ.items() if k not in ("header", "inferSchema")}
    options |= {"multiLine": "true", "columnNameOfCorruptRecord": _CORRUPT}
    fields = F.from_csv("record", _ddl(schema), options)
    return records.select(fields.alias("_fields"), *keep).select("_fields.*", *keep)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"
                     for f in schema.fields)


def _field_count(width: int) -> Column:
    """How many fields a record has: all of them, unless the reader kept the record
    because it has another number; then its separators outside quotes are counted."""
    bare = F.regexp_replace(F.col(_CORRUPT), '"[^"]*"', "")
    seps = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return F.when(F.col(_CORRUPT).isNull(), F.lit(width)).otherwise(seps + 1)


def _read_mixed(files: DataFrame, headers: DataFrame, empty_as_blank: bool,
                range_bytes: int) -> DataFrame:
    """Files of unequal headers: each row by its file's header."""
    runs = record_runs(files.sparkSession, files, range_bytes)
    kinds = header_kinds(headers)
    records = split_records(runs_with_kinds(runs, headers, kinds), keep=["kind"])
    return _by_header(records, headers, kinds, empty_as_blank)


def header_kinds(headers: DataFrame) -> DataFrame:
    """(kind, header): the different headers, numbered in the order of the first file;
    as many as a table has versions."""
    rows = headers.groupBy("header").agg(F.min("key").alias("k")).orderBy("k").collect()
    return headers.sparkSession.createDataFrame(
        [(i, r["header"]) for i, r in enumerate(rows)], "kind bigint, header array<string>")


def runs_with_kinds(runs: DataFrame, headers: DataFrame, kinds: DataFrame) -> DataFrame:
    """The runs (a row each) with the kind of their file's header, which their records
    take along, so that no record is shuffled or sent around to meet its header. Plans
    over listings have no sizes: which side is small is said here."""
    of_file = headers.join(F.broadcast(kinds), "header").select("container", "key", "kind")
    return runs.join(of_file.hint("merge"), ["container", "key"])


def header_columns(headers: DataFrame, kinds: DataFrame) -> list[str]:
    """The columns of files with these headers, in the order of the first file."""
    bad = headers.filter(F.size("header") != F.size(F.array_distinct("header"))).first()
    if bad:
        raise ValueError(f"{bad['key']} names a column twice: {bad['header']}")
    return list(dict.fromkeys(c for r in kinds.orderBy("kind").collect() for c in r["header"]))


def header_cells(records: DataFrame, kinds: DataFrame, *keep: str) -> DataFrame:
    """(_cells, _n, header, *keep): the fields of records that have a ``kind``, how many
    a record has, and its file's header."""
    width = kinds.agg(F.max(F.size("header"))).first()[0]
    cells = [f"_c{i}" for i in range(width)]
    df = _parsed(records, _text_schema(cells), "kind", *keep)
    rows = df.select(F.array(*[F.coalesce(c, F.lit("")) for c in cells]).alias("_cells"),
                     _field_count(width).alias("_n"), "kind", *keep)
    return rows.join(F.broadcast(kinds), "kind").drop("kind")


def _by_header(records: DataFrame, headers: DataFrame, kinds: DataFrame, empty_as_blank: bool,
               *keep: str) -> DataFrame:
    columns = header_columns(headers, kinds)

    def cell(c: str) -> Column:
        at = F.array_position("header", c)
        value = F.get("_cells", (at - 1).cast("int"))
        return F.when((at > 0) & (at <= F.col("_n")),
                      value if empty_as_blank else F.nullif(value, F.lit(""))).alias(c)

    return header_cells(records, kinds, *keep).select([cell(c) for c in columns] + list(keep))


SAMPLE_BYTES = 1 << 20


def first_rows(spark: SparkSession, path: str, n: int | str | float | None = 500,
               csv_only: bool = False, empty_as_blank: bool = True,
               range_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The first ``n`` rows of CSV files as they stand: files by name, rows by their
    place. Ranges are read from the front, twice as many each time, until there are
    enough rows; the rest of the files is not opened. Columns are those of the files
    read, by their headers."""
    files = csv_files(spark, path, csv_only)
    if files is None:
        raise ValueError(f"the order of rows under {path} is not known: no such folder, "
                         "compressed files or a store that only Spark can read")
    n = _row_limit(n)
    ranges, take = file_ranges(files, range_bytes).count(), 1
    while True:
        runs = record_runs(spark, files, range_bytes, first=take).checkpoint(eager=True)
        records = split_records(runs, files=True)
        if take >= ranges or n is not None and not runs.isEmpty() \
                and records.limit(n).count() >= n:
            break
        take *= 2
    used = files.join(runs.select("container", "key").distinct(), ["container", "key"], "left_semi")
    headers = file_headers(used)
    if headers.isEmpty():
        raise ValueError(f"no header in the files under {path}")
    kinds = header_kinds(headers)
    records = split_records(runs_with_kinds(runs, headers, kinds), files=True, keep=["kind"])
    rows = _by_header(records.withColumnsRenamed({"begin": "_begin", "place": "_place"}).withColumn(
        "_file", F.col("key")), headers, kinds, empty_as_blank, "_file", "_begin", "_place")
    order = ["_file", "_begin", "_place"]
    rows = rows.orderBy(*order)
    return (rows if n is None else rows.limit(n)).drop(*order)


def sample_rows(df: DataFrame, n: int | str | float | None = 500,
                order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (a top-k, not a full sort).

    ``n`` may be a number or numeric text; anything else means 500, as in the
    reference. ``n=None`` keeps the whole table.
    """
    n = _row_limit(n)
    if n is None:
        return df
    if not order_by:
        raise ValueError("a sample needs order_by: Spark tables have no row order "
                         "(first_rows takes the rows of files as they stand)")
    return df.orderBy(*order_by).limit(n)


def _row_limit(n: int | str | float | None) -> int | None:
    if n is None:
        return None
    try:
        if isinstance(n, str):
            n = int(n) if n.strip() else 500
        else:
            n = int(n)
    except (TypeError, ValueError):
        n = 500
    return max(n, 0)  # the reference stops before the first row for n <= 0


FILE_BYTES = 128 << 20
VALUE_BYTES = 12              # of a value that is no string, its separator included


def write_text_table(df: DataFrame, out: str, mode: str = "overwrite",
                     n_files: int | None = None, file_bytes: int | None = None) -> str:
    """Write a table as CSV text (every value cast to string) in ``n_files`` files, each
    by one task; with ``file_bytes`` in more if these would be larger than about that."""
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    if n_files:
        if file_bytes:
            n_files = max(n_files, -(-text_bytes(df) // file_bytes))
        text = text.repartition(n_files)
    text.write.mode(mode).options(**CSV_WRITE).csv(out)
    return out


def text_bytes(df: DataFrame) -> int:
    """About how many bytes a table has as text: strings by their length, values of other
    types, which are not read for this, by a fixed width."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    long = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings),
               F.lit(len(strings) + VALUE_BYTES * (len(df.columns) - len(strings))))
    return df.agg(F.coalesce(F.sum(long.cast("bigint")), F.lit(0))).first()[0]


def scan_csv_table(spark: SparkSession, location: str, schema: T.StructType | str,
                   header: bool = True, multi_line: bool = True,
                   range_bytes: int | None = RANGE_BYTES) -> DataFrame:
    """S3: an external CSV table read with a declared schema; values that do
    not fit the type read as null (PERMISSIVE). Files are read by ranges of
    ``range_bytes`` as in ``read_text_table``, columns by position."""
    files = csv_files(spark, location) if multi_line and range_bytes else None
    if files is not None:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        records = split_records(record_runs(spark, files, range_bytes), headers=header)
        return _parsed(records, T.StructType([*declared.fields, T.StructField(
            _CORRUPT, T.StringType())])).drop(_CORRUPT)
    return (spark.read.options(**CSV_READ).option("header", str(header).lower())
            .option("multiLine", str(multi_line).lower()).schema(schema).csv(location))


def scan_parquet_table(spark: SparkSession, location: str) -> DataFrame:
    """An external Parquet table."""
    return spark.read.parquet(location)


def convert_to_parquet(df: DataFrame, out: str, mode: str = "overwrite",
                       partition_by: Sequence[str] = ()) -> str:
    """Write a (typed) table as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
    return out


def object_texts(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` as one text value ``(path, text)``.

    One row per file; a file is read whole by one task (objects are small
    units here, as in the reference, which decodes a body in memory)."""
    # wholetext must go as the keyword: text() resets the option to False.
    return (spark.read.option("recursiveFileLookup", "true")
            .text(root, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
