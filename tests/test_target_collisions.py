"""No two rows of a plan write one target."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import objects as O
from ferrylake.plans import bulk as B
from ferrylake.sources.inventory import object_inventory

PLAN = "container string, key string, size long, dst_container string, dst_key string"


def settled(spark, rows, rule):
    out = O.settle_targets(spark.createDataFrame(rows, PLAN).repartition(3), rule).collect()
    return {(r.container, r.key): (r.dst_key, r.rivals, r.refused) for r in out}


def rows_of(n=400):
    return [(f"c{i % 7}", f"k{i}", i, "d", "hot/.x.tar.gz" if i % 3 else f"k{i}")
            for i in range(n)] + [(None, "z", 1, "d", "hot/.x.tar.gz"), ("q", "z", 1, "d", None)]


def test_rules(spark):
    rows = rows_of()
    hot = sorted((r for r in rows if r[4] == "hot/.x.tar.gz"), key=lambda r: (r[0] or "", r[1]))
    first = hot[0][:2]
    refuse, keep, rename = (settled(spark, rows, x) for x in ("refuse", "first", "rename"))
    for r in rows:
        k = r[:2]
        is_hot = r[4] == "hot/.x.tar.gz"
        n = len(hot) if is_hot else 1
        assert refuse[k] == (r[4], n, is_hot)
        assert keep[k] == (r[4], n, is_hot and k != first)
        if not is_hot or k == first:
            assert rename[k] == (r[4], n, False)
        else:
            h = hashlib.sha256("\n".join(x for x in k if x is not None).encode()).hexdigest()[:16]
            assert rename[k] == (f"hot/.x.tar~{h}.gz", n, False)
    targets = [v[0] for v in rename.values()]
    assert len(set(targets)) == len(targets)


def test_a_renamed_target_that_is_taken_is_refused(spark):
    h = hashlib.sha256(b"b\nk").hexdigest()[:16]
    got = settled(spark, [("a", "k", 1, "d", "k.txt"), ("b", "k", 1, "d", "k.txt"),
                          ("c", "other", 1, "d", f"k~{h}.txt")], "rename")
    assert got[("a", "k")][2] is False
    assert got[("b", "k")][2] and got[("c", "other")][2]


def test_plan_without_shared_targets_and_empty_plan(spark):
    rows = [("a", f"k{i}", 1, "d", f"k{i}") for i in range(5)]
    assert all(v[1:] == (1, False) for v in settled(spark, rows, "refuse").values())
    assert settled(spark, [], "rename") == {}
    with pytest.raises(ValueError):
        settled(spark, rows, "last")


def tree(root, files):
    for k, body in files.items():
        path = os.path.join(root, k)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read()
            for d, _, fs in os.walk(root) for f in fs}


def two_trees(spark, tmp):
    tree(f"{tmp}/a", {"x.txt": "from a", "s/only_a.txt": "1"})
    tree(f"{tmp}/b", {"x.txt": "from b, longer", "only_b.txt": "2"})
    return object_inventory(spark, f"{tmp}/a").unionByName(object_inventory(spark, f"{tmp}/b"))


def test_move_of_two_containers_loses_nothing(spark, tmp_path):
    plan = O.plan_move(two_trees(spark, tmp_path), f"{tmp_path}/dst")
    ledger = B.run_move(spark, B.write_plan(plan))
    status = {(r.container.rsplit("/", 1)[1], r.key): (r.status, r.deleted)
              for r in ledger.collect()}
    assert status == {("a", "x.txt"): ("refused", False), ("b", "x.txt"): ("refused", False),
                      ("a", "s/only_a.txt"): ("ok", True), ("b", "only_b.txt"): ("ok", True)}
    assert files(f"{tmp_path}/dst") == {"s/only_a.txt": "1", "only_b.txt": "2"}
    assert files(f"{tmp_path}/a") == {"x.txt": "from a"}
    assert files(f"{tmp_path}/b") == {"x.txt": "from b, longer"}
    s = O.outcome_summary(ledger, by=[]).first()
    assert (s["done"], s["failed"], s["success"]) == (2, 2, False)


def test_move_by_rename_takes_all(spark, tmp_path):
    plan = O.plan_move(two_trees(spark, tmp_path), f"{tmp_path}/dst", collisions="rename")
    ledger = B.run_move(spark, B.write_plan(plan))
    assert {r.status for r in ledger.collect()} == {"ok"}
    moved = files(f"{tmp_path}/dst")
    assert sorted(moved.values()) == ["1", "2", "from a", "from b, longer"]
    assert moved["x.txt"] == "from a"
    assert not files(f"{tmp_path}/a") and not files(f"{tmp_path}/b")


def test_overwrites_are_marked_for_rows_that_write(spark, tmp_path):
    tree(f"{tmp_path}/dst", {"only_b.txt": "old", "x.txt": "old"})
    plan = O.plan_copy(two_trees(spark, tmp_path), f"{tmp_path}/dst",
                       object_inventory(spark, f"{tmp_path}/dst"), collisions="first")
    got = {(r.container.rsplit("/", 1)[1], r.key): (r.refused, r.overwrites)
           for r in plan.collect()}
    assert got == {("a", "x.txt"): (False, True), ("b", "x.txt"): (True, False),
                   ("a", "s/only_a.txt"): (False, False), ("b", "only_b.txt"): (False, True)}


def test_original_stays_when_its_copy_is_not_there_any_more(spark, tmp_path):
    tree(f"{tmp_path}/a", {"gone.txt": "123", "short.txt": "123", "fine.txt": "123"})
    tree(f"{tmp_path}/dst", {"short.txt": "12", "fine.txt": "123"})
    keys = spark.createDataFrame(
        [(f"{tmp_path}/a", k, f"{tmp_path}/dst", k, 3) for k in
         ("gone.txt", "short.txt", "fine.txt")],
        "container string, key string, dst_container string, dst_key string, bytes long")
    ledger = B.run_delete(spark, B.write_plan(O.delete_batches(keys))).collect()
    assert {r.key: r.status for r in ledger} == {
        "gone.txt": "failed", "short.txt": "failed", "fine.txt": "ok"}
    assert set(files(f"{tmp_path}/a")) == {"gone.txt", "short.txt"}


def test_sequence_totals(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = O.sequence_in_group(df, ["g"], ["id"], total="n").collect()
    assert {(r.g, r.n) for r in out} == {(0, 334), (1, 333), (2, 333)}
    assert all(r.seq == r.id // 3 + 1 for r in out)
