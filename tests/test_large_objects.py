"""Objects copied in parts (B5) and folders listed entry by entry."""

import os

import pandas as pd

from ferrylake.operators import objects as O
from ferrylake.plans import bulk as B
from ferrylake.sources import inventory
from ferrylake.sources.inventory import object_inventory


def put(root, files):
    for k, body in files.items():
        path = os.path.join(root, k)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(body)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read()
            for d, _, fs in os.walk(root) for f in fs}


def test_parts_make_the_object(spark, tmp_path):
    body = os.urandom(100_003)
    put(f"{tmp_path}/a", {"big.bin": body, "s/also big": body[:5001], "small": b"x" * 5000,
                          "empty": b""})
    plan = B.write_plan(O.plan_copy(object_inventory(spark, f"{tmp_path}/a"), f"{tmp_path}/d"))
    ledger = B.run_copy(spark, plan, part_bytes=5000).collect()
    assert {(r.key, r.status, r.bytes) for r in ledger} == {
        ("big.bin", "ok", 100_003), ("s/also big", "ok", 5001), ("small", "ok", 5000),
        ("empty", "ok", 0)}
    assert files(f"{tmp_path}/d") == files(f"{tmp_path}/a")      # no part is left
    moved = B.run_move(spark, B.write_plan(O.plan_move(
        object_inventory(spark, f"{tmp_path}/d"), f"{tmp_path}/e"))).collect()
    assert {r.status for r in moved} == {"ok"} and not files(f"{tmp_path}/d")


def test_a_part_is_redone_alone(tmp_path):
    body = os.urandom(3000)
    put(f"{tmp_path}/a", {"o": body})
    row = dict(container=f"{tmp_path}/a", key="o", dst_container=f"{tmp_path}/d", dst_key="o",
               size=3000, part_name=".run.part")
    parts = [pd.DataFrame([{**row, "begin": b, "stop": min(b + 1000, 3000)}])[
        [c.split(" ")[0] for c in B._PARTS.split(", ")]] for b in (0, 1000, 2000)]
    done = [next(B._copy_parts(iter([p]))) for p in parts]
    os.truncate(f"{tmp_path}/d/.run.part", 1500)                 # as if a task had died
    done[1:] = [next(B._copy_parts(iter([p]))) for p in parts[1:]]
    assert [d["copied"].iat[0] for d in done] == [1000] * 3
    whole = pd.DataFrame([{**row, "copied": 3000, "error": None}])[
        ["container", "key", "dst_container", "dst_key", "size", "part_name", "copied", "error"]]
    for _ in range(2):                                           # also when run again
        assert next(B._join_parts(iter([whole])))["status"].iat[0] == "ok"
    assert files(f"{tmp_path}/d") == {"o": body}


def test_changed_and_missing_large_objects_fail(spark, tmp_path):
    put(f"{tmp_path}/a", {"gone": b"1" * 300, "grown": b"2" * 300, "fine": b"3" * 300})
    plan = B.write_plan(O.plan_copy(object_inventory(spark, f"{tmp_path}/a"), f"{tmp_path}/d"))
    os.remove(f"{tmp_path}/a/gone")
    put(f"{tmp_path}/a", {"grown": b"2" * 301})
    ledger = {r.key: r.status for r in B.run_copy(spark, plan, part_bytes=100).collect()}
    assert ledger == {"gone": "failed", "grown": "failed", "fine": "ok"}
    assert set(files(f"{tmp_path}/d")) == {"fine"}


def test_flat_folder_is_listed_in_chunks(spark, tmp_path, monkeypatch):
    put(tmp_path, {f"k{i:04d}": b"x" * (i % 3) for i in range(950)} | {"s/t/u": b"1", "s/v": b""})
    monkeypatch.setattr(inventory, "CHUNK", 100)
    batches = iter([pd.DataFrame({"root": [str(tmp_path)], "folder": [str(tmp_path)]})])
    frames = list(inventory._list_folders(batches))
    assert max(map(len, frames)) <= 100
    got = pd.concat(frames)
    assert len(got) == 952 and set(got["key"]) >= {"s/t/u", "s/v", "k0949"}
    inv = object_inventory(spark, str(tmp_path)).collect()
    assert {(r.key, r.size) for r in inv} == set(zip(got["key"], got["size"]))
