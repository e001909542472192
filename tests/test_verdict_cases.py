"""Cases where data could be lost or mixed: hidden and nested files, headers in
another order, short rows, datasets side by side, moves onto themselves."""

import os

import pytest
from pyspark.sql import functions as F

from ferrylake import session
from ferrylake.functions.scalars import json_args
from ferrylake.operators import objects as O
from ferrylake.operators import profile as A
from ferrylake.plans import bulk as B
from ferrylake.plans.ingest import ingest
from ferrylake.sources import text as S
from ferrylake.sources.inventory import object_inventory, store_uri


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hidden_csv_is_refused_not_lost(spark, tmp_path):
    d = str(tmp_path / "in")
    put(f"{d}/a.csv", "id,v\n1,x\n")
    put(f"{d}/_b.csv", "id,v\n2,y\n")
    run = ingest(spark, d, str(tmp_path / "lake"), database="h1", table="t")
    assert not run.success and "_b.csv" in str(run.errors)


def test_nested_csvs_are_in_both_tables(spark, tmp_path):
    d = str(tmp_path / "in")
    put(f"{d}/a.csv", "id,v\n1,x\n2,y\n")
    put(f"{d}/deep/er/b.csv", "id,v\n3,z\n")
    put(f"{d}/other/c.CSV", "v,id\nw,4\n")
    run = ingest(spark, d, str(tmp_path / "lake"), database="n1", table="t")
    assert run.success, run.errors
    typed = spark.table(f"{run.database}.{run.parquet_table}")
    assert rows(typed.select("id", "v")) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert spark.table(f"{run.database}.{run.table}").count() == 4


def test_files_are_read_by_their_own_header(spark, tmp_path):
    d = str(tmp_path / "mixed")
    put(f"{d}/a.csv", "id,name\n1,x\n2,\"y,\"\"z\"\n")
    put(f"{d}/b b+c.csv", "name,id,extra\nw,3,e\nv,4\n")
    assert rows(S.read_text_table(spark, d).select("id", "name", F.coalesce("extra", F.lit("-")))) \
        == [("1", "x", "-"), ("2", 'y,"z', "-"), ("3", "w", "e"), ("4", "v", "-")]


def test_absent_is_not_empty(spark, tmp_path):
    d = str(tmp_path / "short")
    put(f"{d}/r.csv", 'a,b,c\n1\n2,,\n3,"x,\ny"\n4,5,6,7\n,"",\n')
    t = S.read_text_table(spark, d)
    assert sorted((tuple(r) for r in t.collect()), key=str) == sorted(
        [("1", None, None), ("2", "", ""), ("3", "x,\ny", None), ("4", "5", "6"), ("", "", "")],
        key=str)
    counts = {r["column"]: r for r in A.type_counts(t).collect()}
    assert (counts["c"]["total"], counts["c"]["n_int"], counts["c"]["n_blank"]) == (5, 3, 2)


def test_same_table_name_in_two_databases(spark, tmp_path):
    lake = str(tmp_path / "lake")
    put(str(tmp_path / "a/f.csv"), "id,v\n1,x\n")
    put(str(tmp_path / "b/f.csv"), "id,w,u\n9,z,q\n")
    one = ingest(spark, str(tmp_path / "a"), lake, database="two1", table="t")
    two = ingest(spark, str(tmp_path / "b"), lake, database="two2", table="t")
    assert one.success and two.success, (one.errors, two.errors)
    assert rows(spark.table("two1.t_parquet")) == [(1, "x")]
    assert rows(spark.table("two2.t_parquet")) == [(9, "z", "q")]
    assert rows(spark.table("two1.t")) == [("1", "x")]


def test_reingest_with_other_columns_fails(spark, tmp_path):
    lake, d = str(tmp_path / "lake"), tmp_path / "c"
    put(str(d / "f.csv"), "id,v\n1,x\n")
    assert ingest(spark, str(d), lake, database="re1", table="t").success
    assert ingest(spark, str(d), lake, database="re1", table="t").success
    put(str(d / "f.csv"), "id,v,w\n1,x,y\n")
    run = ingest(spark, str(d), lake, database="re1", table="t")
    assert not run.success and "other columns" in str(run.errors)


def test_missing_source_fails_and_one_file_works(spark, tmp_path):
    lake = str(tmp_path / "lake")
    run = ingest(spark, str(tmp_path / "nowhere"), lake, database="m1", table="t")
    assert not run.success and run.errors[0]["step"] == "land"
    put(str(tmp_path / "f/one.csv"), "id\n1\n")
    put(str(tmp_path / "f/two.csv"), "id\n2\n")
    run = ingest(spark, str(tmp_path / "f/one.csv"), lake, database="m1", table="u")
    assert run.success and rows(spark.table("m1.u_parquet")) == [(1,)]
    with pytest.raises(FileNotFoundError):
        object_inventory(spark, str(tmp_path / "nowhere"))


def test_move_onto_or_into_itself_is_refused(spark, tmp_path):
    d = str(tmp_path / "t")
    put(f"{d}/a.txt", "aaa")
    os.makedirs(f"{d}/sub")
    for dst in (d, d + "/", f"{d}/sub", str(tmp_path)):
        with pytest.raises(ValueError, match="same tree"):
            B.copy_tree(spark, d, dst, dry_run=False, move=True)
    # a plan made by hand that maps an object onto itself fails, and the object stays
    plan = O.plan_move(object_inventory(spark, d), d)
    ledger = B.run_move(spark, B.write_plan(plan))
    assert {(r["status"], r["deleted"]) for r in ledger.collect()} == {("failed", False)}
    assert open(f"{d}/a.txt").read() == "aaa"


def test_source_that_changed_since_the_plan_is_not_deleted(spark, tmp_path):
    d, to = str(tmp_path / "s"), str(tmp_path / "d")
    put(f"{d}/a.txt", "12345")
    put(f"{d}/b.txt", "1")
    os.makedirs(to)
    path = B.write_plan(B.plan_copy_tree(spark, d, to, move=True))
    put(f"{d}/a.txt", "12")
    out = {r["key"]: (r["status"], r["deleted"]) for r in B.run_move(spark, path).collect()}
    assert out == {"a.txt": ("failed", False), "b.txt": ("ok", True)}
    assert os.path.exists(f"{d}/a.txt") and not os.path.exists(f"{d}/b.txt")
    assert not [f for f in os.listdir(to) if f.endswith(".part")]


def test_delete_over_three_batches(spark, tmp_path):
    d = str(tmp_path / "many")
    os.makedirs(d)
    for i in range(2001):
        open(f"{d}/k{i:04d}", "w").close()
    plan = O.plan_delete(object_inventory(spark, d))
    assert {(r["batch"], r["n"]) for r in plan.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n")).collect()} == {(0, 1000), (1, 1000), (2, 1)}
    path = B.write_plan(plan)
    os.remove(f"{d}/k0007")                       # gone already: done
    s = O.outcome_summary(B.run_delete(spark, path), by=[]).first()
    assert (s["done"], s["failed"]) == (2001, 0) and os.listdir(d) == []


def test_null_groups_are_numbered(spark):
    df = spark.createDataFrame([(None, "a"), ("c", "b"), (None, "c")], "container string, key string")
    out = {(r["container"], r["key"], r["seq"]) for r in O.delete_batches(df).collect()}
    assert out == {(None, "a", 1), (None, "c", 2), ("c", "b", 1)}


def test_schemes():
    assert store_uri("s3a://b/k") == "s3://b/k" and store_uri("s3n://b") == "s3://b"
    assert store_uri("hdfs://n:1/x") == "hdfs://n:1/x"
    assert store_uri("/a/b") is None and store_uri("file:///a") is None and store_uri("a:b" [:1]) is None
    for bad in ("dbfs:/x", "foo://x"):
        with pytest.raises(ValueError, match="no file system"):
            store_uri(bad)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:  # a session on a cluster that names no folder
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_broken_json_is_an_empty_map(spark):
    texts = ['{"a":1}', ' {"a":"x"} ', "{'a':1}", '{"a":1} trailing', '{"a":1', "[1]", '{"a":1},{"b":2}',
             "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r["i"]: r["m"] for r in df.select("i", json_args(F.col("t")).alias("m")).collect()}
    assert out[0] == {"a": "1"} and out[1] == {"a": "x"}
    assert all(out[i] == {} for i in range(2, len(texts)))
