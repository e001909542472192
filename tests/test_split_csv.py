"""CSV files cut into records by byte ranges."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from ferrylake.sources import split_csv as X
from ferrylake.sources.text import read_text_table, scan_csv_table


def put(root, **files):
    os.makedirs(root, exist_ok=True)
    for name, body in files.items():
        with open(os.path.join(root, name + ".csv"), "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())
    return str(root)


def csv_text(rows, header=("a", "b", "c"), end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


VALUES = ["", "x", "two words", "line\nbreak", "a,b", 'say "hi"', '"', '""', "\n\n", "é🙂", "\r\n",
          ",", '",\n"', "long " * 30]


def random_rows(n, seed):
    rng = random.Random(seed)
    return [[rng.choice(VALUES) for _ in range(3)] for _ in range(n)]


def test_states_of_lines():
    for line, out in ((b"a,b", 0), (b'a,"b', 1), (b'a,"b""', 1), (b'a,"b"', 0), (b'5" pipe,b', 0),
                      (b'a,5",x"y', 0), (b'"a"b"c,"d', 1), (b'"",""', 0), (b'"', 1), (b'""', 0),
                      (b'"""', 1), (b',"', 1)):
        assert X.after_line(0, line) == out, line
    for line, out in ((b"a,b", 1), (b'a"', 0), (b'a""', 1), (b'a","b', 1), (b'a",b"', 0),
                      (b'"', 0), (b'""', 1), (b'""""""', 1), (b'", "x', 0), (b'","x', 1)):
        assert X.after_line(1, line) == out, line


@pytest.mark.parametrize("range_bytes", [3, 64, 1 << 20])
def test_equals_python_at_every_border(spark, tmp_path, range_bytes):
    want = []
    files = {}
    for k in range(3):
        rows = random_rows(8, k)
        files[f"f{k}"] = csv_text(rows, end="\r\n" if k == 1 else "\n").rstrip("\r\n" * (k == 2))
        want += [tuple(r) for r in rows]
    got = read_text_table(spark, put(tmp_path / "d", **files), range_bytes=range_bytes)
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equals_sparks_own_reader_on_ragged_and_stray_quotes(spark, tmp_path):
    rng = random.Random(11)
    bits = ['"', '""', ",", "\n", "a", "bc", '"x\ny"', '"q,\n\n"', " ", '5" pipe', ",,", "\n\n"]
    for n in range(4):
        body = "a,b,c\n" + "".join(rng.choice(bits) for _ in range(120)) + '"\n'
        # a value left open to the end takes all the rest in both readers
        root = put(tmp_path / f"d{n}", f=body)
        own = read_text_table(spark, root, range_bytes=None)
        for size in (5, 1 << 20):
            ours = read_text_table(spark, root, range_bytes=size)
            assert sorted(map(str, ours.collect())) == sorted(map(str, own.collect())), body


def test_more_tasks_than_files(spark, tmp_path):
    root = put(tmp_path / "d", one=csv_text([["x" * 50, "line\nbreak", str(i)] for i in range(2000)]))
    df = read_text_table(spark, root, range_bytes=4096)
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 4
    assert df.count() == 2000 and df.filter("b = 'line\nbreak'").count() == 2000


def test_one_record_over_many_ranges(spark, tmp_path):
    big = "line\n" * 4000
    root = put(tmp_path / "d", one=csv_text([["1", big, "x"], ["2", "y", "z"]]))
    rows = sorted(map(tuple, read_text_table(spark, root, range_bytes=100).collect()))
    assert rows == [("1", big, "x"), ("2", "y", "z")]


def test_only_the_first_record_is_the_header(spark, tmp_path):
    root = put(tmp_path / "d", one="a,b\n1,2\na,b\n", two="\n\nb,a\r\nb,a\n4,3\n", three="", four="\n")
    for size in (1, 1 << 20):
        got = sorted(map(tuple, read_text_table(spark, root, range_bytes=size).select(
            "a", "b").collect()))
        assert got == [("1", "2"), ("3", "4"), ("a", "b"), ("a", "b")]


def test_header_with_line_breaks_and_mixed_columns(spark, tmp_path):
    root = put(tmp_path / "d", one='"a\nx",b\n1,2\n', two='b,c,"a\nx"\n2,9,1\n')
    t = read_text_table(spark, root, range_bytes=3)
    assert sorted(map(str, t.select("a\nx", "b", "c").collect())) == sorted(
        map(str, spark.createDataFrame([("1", "2", None), ("1", "2", "9")],
                                       ["a\nx", "b", "c"]).collect()))


def test_single_file_nested_folder_and_compressed(spark, tmp_path):
    import gzip
    root = put(tmp_path / "d", one=csv_text([["1", "p\nq", "3"]]))
    assert [tuple(r) for r in read_text_table(spark, f"{root}/one.csv").collect()] == [
        ("1", "p\nq", "3")]
    put(tmp_path / "d" / "sub", two=csv_text([["4", "5", "6"]]))
    assert read_text_table(spark, root).count() == 1
    assert read_text_table(spark, root, csv_only=True).count() == 2
    os.makedirs(tmp_path / "z")
    with gzip.open(tmp_path / "z" / "x.csv.gz", "wt") as f:
        f.write(csv_text([["1", "p\nq", "3"]]))
    assert [tuple(r) for r in read_text_table(spark, str(tmp_path / "z")).collect()] == [
        ("1", "p\nq", "3")]


def test_declared_types_by_ranges(spark, tmp_path):
    root = put(tmp_path / "d", one='n,t\n1,"a\nb"\nx,c\n3\n')
    for size in (2, None):
        got = scan_csv_table(spark, root, "n int, t string", range_bytes=size).collect()
        assert sorted(map(str, got)) == ["Row(n=1, t='a\\nb')", "Row(n=3, t=None)",
                                         "Row(n=None, t='c')"]


def test_short_rows_and_blank_fields(spark, tmp_path):
    root = put(tmp_path / "d", one='a,b,c\n1\n2,,\n3,"",x,y\n')
    for size in (1, None):
        got = read_text_table(spark, root, range_bytes=size).orderBy("a").collect()
        assert [tuple(r) for r in got] == [("1", None, None), ("2", "", ""), ("3", "", "x")]


def test_blocks_of_a_range_give_the_same_lines_and_records(monkeypatch):
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice('a",\n\r\nb') for _ in range(rng.randint(1, 40))).encode()
        begin = rng.randrange(len(data))
        stop = rng.randint(begin + 1, len(data))
        seen = []
        for size in (1 << 20, rng.randint(1, 7)):
            monkeypatch.setattr(X, "BLOCK_BYTES", size)
            monkeypatch.setattr(X, "READ_BYTES", size)
            lines = [x for _, b in X._line_blocks(io.BytesIO(data), begin, stop, len(data))
                     for x in X._split(b)]
            starts = [k for k in range(begin, stop) if not k or data[k - 1:k] == b"\n"]
            assert lines == [data[k:].split(b"\n")[0] for k in starts]
            seen.append([r for part in X._records(X._blocks(io.BytesIO(data), 0, len(data)))
                         for r in part])
        assert seen[0] == seen[1]


def test_a_task_splits_its_range_block_by_block(spark, tmp_path, monkeypatch):
    """Batches are as large as a block, not as a range."""
    read = []

    class Noted(io.BytesIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    monkeypatch.setattr(X, "BLOCK_BYTES", 64)
    parts = list(X._records(X._blocks(Noted(b"abc,def\n" * 100), 0, 800)))
    assert max(read) <= 64 and len(parts) > 10 and sum(map(len, parts)) == 100


def test_ranges_are_dealt_one_a_task(spark):
    places = [("c", f"k{i % 4}", i * 32) for i in range(16)]
    df = spark.createDataFrame(places, "container string, key string, begin long")
    n = X._dealt(df).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in n.collect()) == -(-16 // min(16, max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism)))
