"""CSV files cut into records by many tasks, quoted line breaks included.

A file is taken as byte ranges. A line belongs to the range it starts in, and a line
can only start in one of two states: at a record's start, or inside a quoted value. So
a range is a map of two states, found without knowing where it starts: the identity, a
flip, or a constant. Running along a file's ranges (constants reset, flips add up) gives
each range's own state, hence its first record start; from there to the next range's
first record start is a run of whole records, read by one task. No file is one task's;
a task holds a block of its range, and one record where that is longer.

Quotes open a value only at its start, and after a closing quote the rest up to the
separator belongs to the value, as Spark's CSV reader has it.
"""

from __future__ import annotations

import csv
import io
import re
from typing import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrylake.functions.scalars import has_suffix
from ferrylake.session import ensure_checkpoint_dir, ship_package
from ferrylake.sources.inventory import filesystem, kind_of, object_inventory

RANGE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20         # read at once in a range
READ_BYTES = 1 << 20          # read at once behind a range's end

_CLOSED = rb'"(?:[^"]++|"")*+"[^,]*+'          # a quoted value that ends in this line
_FIELDS = rb'(?:(?:' + _CLOSED + rb'|[^",][^,]*+|),)*+'
_OPEN = rb'"(?:[^"]++|"")*+'                   # a quoted value that does not
# lines that leave a value open, from a record's start and from inside a value
_OPENS = re.compile(_FIELDS + _OPEN, re.S)
_STAYS = re.compile(rb'(?:[^"]++|"")*+(?:"[^,]*+,' + _FIELDS + _OPEN + rb')?', re.S)

_STATES = "container string, key string, begin bigint, size bigint, " \
    "end0 int, end1 int, first0 bigint, first1 bigint"


def after_line(state: int, line: bytes) -> int:
    """The state (1: inside a quoted value) behind a line that starts in ``state``."""
    if b'"' not in line:
        return state
    return int((_STAYS if state else _OPENS).fullmatch(line) is not None)


def _open_file(container: str, key: str):
    fs, base = filesystem(container)
    return fs.open_input_file(f"{base.rstrip('/')}/{key}")


def _line_blocks(f, begin: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the lines that start in [begin, stop), some whole lines at a
    time; the last line is read to its end, which may lie behind ``stop``."""
    pos = max(begin - 1, 0)
    f.seek(pos)
    if begin:                                # a line starts behind a break, also the one before
        cut = -1
        while pos < stop and cut < 0:
            more = f.read(min(BLOCK_BYTES, stop - pos))
            if not more:
                return
            cut = more.find(b"\n")
            pos += len(more) if cut < 0 else cut + 1
        if cut < 0 or pos >= stop:
            return
        f.seek(pos)
    at, held = pos, []
    while pos < size:
        inside = pos < stop
        if not inside and not held:
            return
        more = f.read(min(BLOCK_BYTES, stop - pos) if inside else READ_BYTES)
        if not more:
            break
        pos += len(more)
        cut = more.rfind(b"\n") if inside else more.find(b"\n")
        if cut < 0:
            held.append(more)
            continue
        block = b"".join([*held, more[:cut + 1]])
        held = [more[cut + 1:]] if inside and cut + 1 < len(more) else []
        yield at, block
        at += len(block)
        if not inside:
            return
    if held:
        yield at, b"".join(held)


def _split(block: bytes) -> list[bytes]:
    lines = block.split(b"\n")
    if block.endswith(b"\n"):
        lines.pop()
    return lines


def file_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(container, key, begin, stop, size): the byte ranges of the files of an inventory."""
    begins = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))
    return files.filter("size > 0").select(
        "container", "key", F.explode(begins).alias("begin"), "size").withColumn(
        "stop", F.least(F.col("begin") + range_bytes, F.col("size")))


def _range_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            state, first = [0, 1], [None, None]
            with _open_file(r.container, r.key) as f:
                for at, block in _line_blocks(f, r.begin, r.stop, r.size):
                    if b'"' not in block and all(s or x is not None for s, x in zip(state, first)):
                        continue                         # changes nothing
                    for line in _split(block):
                        if line and line != b"\r":       # an empty line is no record
                            first = [at if x is None and not s else x
                                     for x, s in zip(first, state)]
                        state = [after_line(s, line) for s in state] if b'"' in line else state
                        at += len(line) + 1
            out.append((r.container, r.key, r.begin, r.size, *state, *first))
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _STATES.split(", ")])
        yield frame.astype({"first0": "Int64", "first1": "Int64"})


def record_runs(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES,
                first: int | None = None) -> DataFrame:
    """(container, key, begin, stop, head): runs of whole records, in all the files'
    records; ``head``: the run begins with the file's first. A file's ranges are a few numbers each, and run along
    in one window: a file of 5 TB has 160,000. With ``first`` only so many ranges are
    read, in the order of files and places, and a run that none of them ends is left out."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    ranges = file_ranges(files, range_bytes)
    if first is not None:
        ranges = ranges.orderBy("container", "key", "begin").limit(first)
    ranges = _dealt(ranges)
    states = ranges.mapInPandas(_range_states, _STATES).checkpoint(eager=True)
    along = Window.partitionBy("container", "key").orderBy("begin")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    reset = F.col("end0") == F.col("end1")
    flips = F.coalesce(F.sum(F.when(F.col("end0") > F.col("end1"), 1).otherwise(0)).over(before),
                       F.lit(0))
    s = states.withColumn("_flips", flips)
    known = F.last(F.when(reset, F.struct("end0", "_flips")), ignorenulls=True).over(before)
    s = s.withColumn("_known", known)
    # a constant range sets the state, the flips behind it turn it over
    state = F.when(F.col("_known").isNull(), F.col("_flips")).otherwise(
        F.col("_known.end0") + F.col("_flips") - F.col("_known._flips")) % 2
    last = F.max("begin").over(Window.partitionBy("container", "key")) + range_bytes
    runs = s.select("container", "key", F.when(last >= F.col("size"), F.col("size")).alias("size"),
                    F.when(state == 0, F.col("first0")).otherwise(F.col("first1"))
                    .alias("begin")).filter("begin is not null")
    return runs.select("container", "key", "begin",
                       F.coalesce(F.lead("begin").over(along), F.col("size")).alias("stop"),
                       F.lag("begin").over(along).isNull().alias("head")).filter("stop is not null")


def _dealt(ranges: DataFrame) -> DataFrame:
    """Rows of file places spread over tasks, as many each, which adaptive execution
    would else put together again, the rows being short."""
    spark = ranges.sparkSession
    n = ranges.count()
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism, n // 4)
    return ranges.repartitionByRange(max(1, min(n, most)), "container", "key", "begin")


def split_records(runs: DataFrame, headers: bool = True, files: bool = False,
                  keep: Sequence[str] = ()) -> DataFrame:
    """(record) of the runs, with ``files`` also container, key, the run's begin and the
    record's place in it: line breaks in quotes kept, empty lines left out, and with
    ``headers`` each file's first record too. ``keep``: other columns of the runs, whose
    values all records of a run get. The runs, a row each, are settled first: dealing them
    counts, samples and reads them, and the driver would plan and compile their windows
    and joins for each."""
    ensure_checkpoint_dir(runs.sparkSession)
    runs = runs.checkpoint(eager=True)
    of_run = ([f"{c} {runs.schema[c].dataType.simpleString()}" for c in keep]
              + ["container string", "key string", "begin bigint"] * files)
    names = [c.split(" ")[0] for c in of_run]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, same in zip(b.to_pylist(), range(b.num_rows)):
                place, skip = 0, bool(headers and r["head"])
                with _open_file(r["container"], r["key"]) as f:
                    for records in _records(_blocks(f, r["begin"], r["stop"])):
                        if skip and records:
                            records, skip = records[1:], False
                        n = len(records)
                        if not n:
                            continue
                        columns = {"record": _texts(records)}
                        columns |= {c: pa.repeat(b.column(c)[same], n) for c in names}
                        if files:
                            columns["place"] = pa.array(range(place, place + n), pa.int64())
                        place += n
                        yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(["record string", *of_run] + ["place bigint"] * files)
    return _dealt(runs).mapInArrow(run, schema)


def _blocks(f, begin: int, stop: int) -> Iterator[bytes]:
    """The bytes of [begin, stop) in blocks that end with a line, the last as it may."""
    f.seek(begin)
    held: list[bytes] = []
    while begin < stop and (more := f.read(min(BLOCK_BYTES, stop - begin))):
        begin += len(more)
        cut = more.rfind(b"\n") + 1
        if cut:
            yield b"".join([*held, more[:cut]])
            held = []
        if cut < len(more):
            held.append(more[cut:])
    if held:
        yield b"".join(held)


def _texts(records: list[bytes]) -> pa.Array:
    try:
        return pa.array(records, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:                  # not UTF-8: as Spark's reader shows it
        return pa.array([r.decode("utf-8", "replace") for r in records], pa.string())


def _records(blocks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Records, a list a block, of bytes that start with one; a value left open ends
    with the bytes."""
    held: list[bytes] = []
    state, ended = 0, False
    for block in blocks:
        ended = block.endswith(b"\n")
        records = lines = _split(block)
        if held or b'"' in block:
            records = []
            for line in lines:
                if b'"' in line:
                    state = after_line(state, line)
                held.append(line)
                if not state:
                    records.append(held[0] if len(held) == 1 else b"\n".join(held))
                    held = []
        if b"\r" in block:
            records = [r.removesuffix(b"\r") for r in records]
        yield list(filter(None, records))
    if held and ended:
        held.append(b"")
    if any(held):
        yield [b"\n".join(held)]


_PACKED = r"(?i)\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def csv_files(spark: SparkSession, path: str, csv_only: bool = False) -> DataFrame | None:
    """(container, key, size, mtime) of the files that Spark's reader would take: those of the
    folder, with ``csv_only`` all ``*.csv`` below it, or the one file. None if only
    Spark can read them: a store that pyarrow does not know, compressed files."""
    try:
        kind = kind_of(path)
    except Exception:  # noqa: BLE001
        return None
    if kind == "file":
        folder, name = path.rstrip("/").rsplit("/", 1)
        files = object_inventory(spark, folder).filter(F.col("key") == name)
    elif kind == "folder":
        inv = object_inventory(spark, path).filter(~F.col("key").rlike(r"(^|/)[_.]"))
        inv = inv.filter(has_suffix("key")) if csv_only else inv.filter(~F.col("key").contains("/"))
        files = inv
    else:
        return None
    return files if files.filter(F.col("key").rlike(_PACKED)).isEmpty() else None


def file_headers(files: DataFrame) -> DataFrame:
    """(container, key, header): the fields of each file's first record, read from as
    many of its first bytes as it takes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                record = _first_record(r.container, r.key)
                if record:
                    rows.append((r.container, r.key,
                                 next(csv.reader(io.StringIO(record, newline="")))))
            yield pd.DataFrame(rows, columns=["container", "key", "header"])

    ship_package(files.sparkSession)
    ensure_checkpoint_dir(files.sparkSession)
    return files.select("container", "key").mapInPandas(
        run, "container string, key string, header array<string>").checkpoint(eager=True)


def _first_record(container: str, key: str) -> str | None:
    with _open_file(container, key) as f:
        held: list[bytes] = []
        state, tail = 0, b""
        while more := f.read(READ_BYTES):
            *lines, tail = (tail + more).split(b"\n")
            for line in lines:
                state = after_line(state, line)
                held.append(line)
                if not state:
                    record, held = b"\n".join(held).removesuffix(b"\r"), []
                    if record:
                        return record.decode("utf-8", "replace")
        return b"\n".join([*held, tail]).removesuffix(b"\r").decode("utf-8", "replace") or None
