"""Incremental landing, atomic publish, partitions that land later."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import objects as O
from ferrylake.plans import bulk as B
from ferrylake.plans import catalog as T
from ferrylake.plans.ingest import ingest
from ferrylake.plans.publish import publish, roll_back, versions
from ferrylake.sources.inventory import object_inventory

INVENTORY = "container string, key string, size long, mtime timestamp"


def put(root, files):
    for k, body in files.items():
        path = os.path.join(root, k)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read()
            for d, _, fs in os.walk(root) for f in fs}


def name(tmp_path, prefix):
    return f"{prefix}_{abs(hash(str(tmp_path))) % 10**9}"


def test_plan_sync_actions(spark):
    import datetime as dt
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    src = spark.createDataFrame(
        [("s", "same", 1, old), ("s", "longer", 2, old), ("s", "later", 1, new),
         ("s", "added", 1, old), ("s", "equal_time", 1, new), ("s", "empty", 0, old)], INVENTORY)
    dst = spark.createDataFrame(
        [("d", "p/same", 1, new), ("d", "p/longer", 1, new), ("d", "p/later", 1, old),
         ("d", "p/left", 5, new), ("d", "outside", 5, new), ("d", "p/equal_time", 1, new),
         ("d", "p/empty", 0, new)], INVENTORY)
    got = {r.dst_key: (r.action, r.container, r.size) for r in
           O.plan_sync(src, dst, "d", "p/").collect()}
    assert got == {"p/same": ("unchanged", "s", 1), "p/longer": ("copy", "s", 2),
                   "p/later": ("copy", "s", 1), "p/added": ("copy", "s", 1),
                   "p/left": ("remove", None, 5), "p/equal_time": ("unchanged", "s", 1),
                   "p/empty": ("unchanged", "s", 0)}
    sums = [d.withColumn("checksum", F.when(F.col("key").endswith("same"), F.lit("x")))
            for d in (src, dst)]
    by_sum = {r.dst_key: r.action for r in
              O.plan_sync(*sums, "d", "p/", checksums=True).collect()}
    assert by_sum["p/later"] == "unchanged" and by_sum["p/longer"] == "copy"
    assert O.plan_sync(src.limit(0), dst.limit(0), "d").count() == 0


def test_land_folder_sync(spark, tmp_path):
    src, lake = f"{tmp_path}/src", f"{tmp_path}/lake"
    put(src, {"a.txt": "1", "s/b.txt": "22", "s/c.txt": "333", "empty": ""})
    put(lake, {"other/x.txt": "not ours"})
    first = B.land_folder(spark, src, lake, "raw/", sync=True)
    assert {r.action for r in first.collect()} == {"copy"}
    os.remove(f"{src}/s/c.txt")
    time.sleep(0.05)
    put(src, {"a.txt": "9", "new.txt": "n"})
    second = {r.dst_key: (r.action, r.status) for r in
              B.land_folder(spark, src, lake, "raw/", sync=True).collect()}
    assert second == {"raw/a.txt": ("copy", "ok"), "raw/s/b.txt": ("unchanged", "ok"),
                      "raw/empty": ("unchanged", "ok"), "raw/new.txt": ("copy", "ok"),
                      "raw/s/c.txt": ("remove", "ok")}
    assert files(lake) == {"raw/a.txt": "9", "raw/s/b.txt": "22", "raw/empty": "",
                           "raw/new.txt": "n", "other/x.txt": "not ours"}


def test_checksums_see_what_times_do_not(spark, tmp_path):
    src, lake = f"{tmp_path}/src", f"{tmp_path}/lake"
    put(src, {"a.txt": "old"})
    B.land_folder(spark, src, lake, "", sync=True)
    put(src, {"a.txt": "new"})
    os.utime(f"{src}/a.txt", (1, 1))                 # an older file of the same size
    assert {r.action for r in B.land_folder(spark, src, lake, "", sync=True).collect()} \
        == {"unchanged"}
    B.land_folder(spark, src, lake, "", sync=True, checksums=True)
    assert files(lake) == {"a.txt": "new"}


def test_nothing_is_removed_after_a_failed_copy(spark, tmp_path):
    src, lake = f"{tmp_path}/src", f"{tmp_path}/lake"
    put(lake, {"stale.txt": "keep me"})
    put(src, {"a.txt": "1"})
    plan = B.write_plan(B.sync_plan(spark, object_inventory(spark, src), lake))
    os.remove(f"{src}/a.txt")                        # gone between plan and run
    got = {r.dst_key: (r.action, r.status) for r in B.run_sync(spark, plan).collect()}
    assert got == {"a.txt": ("copy", "failed"), "stale.txt": ("remove", "skipped")}
    assert files(lake) == {"stale.txt": "keep me"}


def test_second_ingest_has_only_what_is_there(spark, tmp_path):
    src, lake = f"{tmp_path}/src", f"{tmp_path}/lake"
    db = name(tmp_path, "sync")
    put(src, {"a.csv": "id,v\n1,x\n", "b.csv": "id,v\n2,y\n"})
    where = dict(database=db, table="t")
    first = ingest(spark, src, lake, **where)
    assert first.success and spark.table(f"{db}.t_parquet").count() == 2
    os.remove(f"{src}/b.csv")
    second = ingest(spark, src, lake, **where)
    assert second.success, second.errors
    assert [r.id for r in spark.table(f"{db}.t_parquet").collect()] == [1]
    assert [r.id for r in spark.table(f"{db}.t").collect()] == ["1"]
    assert '"unchanged": 1' in second.steps[0][2] and '"removed": 1' in second.steps[0][2]
    third = ingest(spark, f"{src}/a.csv", lake, **where)
    assert third.success and '"uploaded": 0' in third.steps[0][2]
    # other columns: the run fails and the table still reads its rows
    put(src, {"a.csv": "id,w,z\n1,x,3\n"})
    fourth = ingest(spark, src, lake, **where)
    assert not fourth.success
    assert [r.id for r in spark.table(f"{db}.t_parquet").collect()] == [1]


def test_publish_is_all_or_nothing(spark, tmp_path):
    root, db = f"{tmp_path}/root", name(tmp_path, "pub")
    df = spark.range(10).withColumn("v", F.lit("a"))
    one = publish(df, root, db, "T one")
    assert one["success"] and one["table"] == "t_one"
    reading = spark.table(f"{db}.t_one")             # a plan made on the first version
    bad = df.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("boom")).cast("string"))
                        .otherwise("b"))
    assert not publish(bad, root, db, "T one")["success"]
    assert {r.v for r in spark.table(f"{db}.t_one").collect()} == {"a"}
    other = publish(df.withColumn("more", F.lit(1)), root, db, "T one")
    assert not other["success"] and "other columns" in other["error"]
    assert len(versions(spark, root)) == 1
    two = publish(df.withColumn("v", F.lit("b")).limit(3), root, db, "T one")
    assert two["success"]
    assert [r.v for r in spark.table(f"{db}.t_one").collect()] == ["b"] * 3
    assert {r.v for r in reading.collect()} <= {"a", "b"}        # its files are still there
    assert spark.read.parquet(one["location"]).count() == 10
    assert publish(df, root, db, "T one")["removed"] == 1
    assert len(versions(spark, root)) == 2 and not os.path.exists(one["location"])
    assert roll_back(spark, root, db, "T one")["success"]
    assert spark.table(f"{db}.t_one").count() == 3
    assert not roll_back(spark, root, db, "T one")["success"]


def test_empty_table_and_missing_root(spark, tmp_path):
    db = name(tmp_path, "pube")
    assert versions(spark, f"{tmp_path}/none") == []
    assert publish(spark.range(0), f"{tmp_path}/r", db, "e")["success"]
    assert spark.table(f"{db}.e").count() == 0


def test_other_location_is_a_failure(spark, tmp_path):
    db = name(tmp_path, "loc")
    for x in ("one", "two"):
        spark.range(3).write.parquet(f"{tmp_path}/{x}")
    assert T.register_table(spark, db, "t", f"{tmp_path}/one", None, fmt="parquet")["success"]
    for same in (f"{tmp_path}/one/", f"file:{tmp_path}/one", f"file://{tmp_path}/one"):
        assert T.register_table(spark, db, "t", same, None, fmt="parquet")["success"]
    res = T.register_table(spark, db, "t", f"{tmp_path}/two", None, fmt="parquet")
    assert not res["success"] and "registered over" in res["error"]


@pytest.mark.parametrize("values", [("x", "y"), ("a b", "c%d=e")])
def test_partitions_that_land_and_leave_later(spark, tmp_path, values):
    db, loc = name(tmp_path, "part"), f"{tmp_path}/t"
    df = spark.range(12).select("id", F.when(F.col("id") % 2 == 0, values[0]).otherwise(
        values[1]).alias("k"), (F.col("id") % 3).cast("int").alias("j"))
    write = lambda d: d.write.mode("append").partitionBy("k", "j").parquet(loc)
    keys = [("k", "string"), ("j", "int")]
    write(df.filter("j < 2"))
    reg = lambda: T.register_table(spark, db, "t", loc, [("id", "bigint")], keys, "parquet")
    assert reg()["success"] and spark.table(f"{db}.t").count() == 8
    write(df.filter("j = 2"))
    first = [d for d in os.listdir(loc) if d.startswith("k=")][0]
    B.delete_tree(spark, f"{loc}/{first}/j=0", dry_run=False)
    os.remove(f"{loc}/{first}/j=0/._SUCCESS.crc") if os.path.exists(
        f"{loc}/{first}/j=0/._SUCCESS.crc") else None
    state = sorted(r.state for r in T.partition_diff(spark, db, "t").collect())
    assert state == ["gone"] + ["kept"] * 3 + ["new"] * 2
    assert reg()["success"]
    want = [r.id for r in spark.read.parquet(loc).orderBy("id").collect()]
    assert [r.id for r in spark.table(f"{db}.t").orderBy("id").collect()] == want
    assert len(want) == 10
