"""First rows of files as they stand (S2) and votes kept per file."""

import csv
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import file_votes
from ferrylake.operators.file_votes import file_counts, vote_files
from ferrylake.operators.profile import type_counts
from ferrylake.sources import text as S
from ferrylake.sources.split_csv import record_runs, split_records


def put(root, name, rows, header, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, name), "w", newline="") as f:
        f.write(out.getvalue())


VALUES = ["1", "2.5", "", "yes", "2024-01-05", "text", "a,b", "line\nbreak", 'q"q', " 7 ", "0"]


def rows(n, width, seed):
    rng = random.Random(seed)
    return [[rng.choice(VALUES) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 25, "30", None, 1000])
def test_first_rows_equal_python(spark, tmp_path, n):
    want = []
    for k in range(4):
        r = rows(12, 3, k)
        put(tmp_path, f"f{k}.csv", r, ["a", "b", "c"], "\r\n" if k == 2 else "\n")
        want += r
    got = S.first_rows(spark, str(tmp_path), n, range_bytes=64)
    m = len(want) if n is None else int(n)
    # rows come in order only if they are sorted last: collect keeps that order
    assert [list(r) for r in got.collect()] == want[:m]


def test_first_rows_open_few_ranges(spark, tmp_path, monkeypatch):
    for k in range(6):
        put(tmp_path, f"f{k}.csv", rows(200, 2, k), ["a", "b"])
    took = []
    whole = S.record_runs
    monkeypatch.setattr(S, "record_runs", lambda *a, first=None, **k: (
        took.append(first), whole(*a, first=first, **k))[1])
    assert S.first_rows(spark, str(tmp_path), 10, range_bytes=512).count() == 10
    assert took[-1] <= 2
    with pytest.raises(ValueError):
        S.first_rows(spark, f"{tmp_path}/none")


def full(spark, folder, mode):
    t = S.read_text_table(spark, folder)
    return {tuple(r) for r in type_counts(t, mode=mode, already_text=True).collect()}


@pytest.mark.parametrize("mode", ["overlap", "exclusive"])
def test_vote_after_each_change_equals_the_full_vote(spark, tmp_path, mode):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    put(folder, "a.csv", rows(30, 3, 1), ["a", "b", "c"])
    put(folder, "b.csv", rows(20, 3, 2), ["c", "a", "b"])
    one = vote_files(spark, folder, store, mode, range_bytes=100)
    assert (one.read, one.kept, one.gone) == (2, 0, 0)
    assert {tuple(r) for r in one.counts.collect()} == full(spark, folder, mode)

    put(folder, "c.csv", rows(10, 2, 3) + [["short"]], ["d", "a"])       # other columns
    put(folder, "d.csv", [], ["a", "b", "c"])                           # no rows
    two = vote_files(spark, folder, store, mode)
    assert (two.read, two.kept, two.gone) == (2, 2, 0)
    assert {tuple(r) for r in two.counts.collect()} == full(spark, folder, mode)

    time.sleep(0.05)
    os.remove(f"{folder}/a.csv")
    put(folder, "b.csv", rows(5, 3, 4), ["c", "a", "b"])                # changed
    three = vote_files(spark, folder, store, mode)
    assert (three.read, three.kept, three.gone) == (1, 2, 2)
    assert {tuple(r) for r in three.counts.collect()} == full(spark, folder, mode)

    four = vote_files(spark, folder, store, mode)
    assert (four.read, four.kept, four.gone) == (0, 3, 0)
    assert {tuple(r) for r in four.counts.collect()} == full(spark, folder, mode)
    assert len([d for d in os.listdir(store) if d.startswith("v-")]) == 2


def test_vote_of_an_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    vote = vote_files(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    assert vote.counts.count() == 0 and vote.read == 0
    assert vote.counts.columns[:3] == ["pos", "column", "total"]
    assert S.first_rows and F


@pytest.mark.parametrize("what", ["read", "vote"])
def test_records_do_not_travel_to_meet_their_header(spark, tmp_path, what):
    """Plans over listings have no sizes: records were broadcast through the driver."""
    put(tmp_path, "a.csv", rows(30, 2, 1), ["a", "b"])
    put(tmp_path, "b.csv", rows(30, 2, 2), ["b", "a"])
    if what == "read":
        df = S.read_text_table(spark, str(tmp_path))
    else:
        df = file_counts(S.csv_files(spark, str(tmp_path)))
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    cut = plan.split("MapInArrow")[0]
    sides = [x for x in cut.splitlines() if "Join" in x]
    # above the records only joins whose other side is said to be small
    assert any("rightHint=(strategy=broadcast)" in x for x in sides), plan


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_settled_before_they_are_dealt(spark, tmp_path):
    """Dealing reads them three times: the driver planned and compiled their windows and
    joins for each."""
    put(tmp_path, "a.csv", rows(30, 2, 1), ["a", "b"])
    files = S.csv_files(spark, str(tmp_path))
    plan = optimized(split_records(record_runs(spark, files, 64)))
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan, plan


def test_a_vote_counts_before_it_joins(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    put(folder, "a.csv", rows(30, 2, 1), ["a", "b"])
    put(folder, "b.csv", [], ["b", "c"])
    files = S.csv_files(spark, folder)
    plans = []
    whole = file_counts

    def counted(*a, **k):
        out = whole(*a, **k)
        plans.append(optimized(out))
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in whole(files).collect()}
        return out

    monkeypatch.setattr(file_votes, "file_counts", counted)
    vote = vote_files(spark, folder, str(tmp_path / "store"))
    assert vote.read == 2 and {tuple(r) for r in vote.counts.collect()} == full(
        spark, folder, "overlap")
    assert len(plans) == 1 and "MapInArrow" not in plans[0], plans[0]


def test_files_are_compared_in_one_pass(spark):
    files = spark.sql("SELECT * FROM VALUES ('r', 'a', 1L, timestamp'2024-01-01'), "
                      "('r', 'b', 2L, timestamp'2024-01-01'), ('r', 'n', 3L, CAST(NULL AS TIMESTAMP)) "
                      "AS t(container, key, size, mtime)")
    known = spark.sql("SELECT * FROM VALUES ('a', 1L, timestamp'2024-01-01'), "
                      "('a', 1L, timestamp'2024-01-01'), ('b', 9L, timestamp'2024-01-01'), "
                      "('n', 3L, CAST(NULL AS TIMESTAMP)) AS t(key, size, mtime)")
    seen = file_votes.compare_files(files, known).collect()
    assert sorted((r["key"], r["size"], r["here"], r["known"]) for r in seen) == [
        ("a", 1, True, True), ("b", 2, True, False), ("b", 9, False, True),
        ("n", 3, False, True), ("n", 3, True, False)]           # an unknown time equals none
