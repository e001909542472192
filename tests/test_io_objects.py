"""S1-S8 round trips, object inventories, bulk jobs, batches and the catalog."""

import os

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import objects as O
from ferrylake.operators import profile as A
from ferrylake.plans import bulk as B
from ferrylake.plans import catalog as T
from ferrylake.sources import text as S
from ferrylake.sources.inventory import object_inventory


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


def test_csv_fixtures(spark, tmp_path):
    d = str(tmp_path)
    _write(f"{d}/quoted/q.csv", 'a,b\n"x ""q""","l1\nl2"\n')
    _write(f"{d}/ragged/r.csv", "a,b\n1\n\n1,2,3\n")
    _write(f"{d}/header/h.csv", "a,b\n")
    _write(f"{d}/empty/e.csv", "")
    q = S.read_text_table(spark, f"{d}/quoted").collect()
    assert [tuple(r) for r in q] == [('x "q"', "l1\nl2")]
    r = S.read_text_table(spark, f"{d}/ragged").collect()
    assert sorted((tuple(x) for x in r), key=str) == [("1", "2"), ("1", None)]
    with pytest.raises(ValueError, match="no rows"):
        A.infer_schema(S.read_text_table(spark, f"{d}/header"))
    with pytest.raises(ValueError):
        A.infer_schema(S.read_text_table(spark, f"{d}/empty"))


def test_text_roundtrip_and_parquet(spark, tmp_path):
    rows = [("1", " lead", 'q"uote', "multi\nline"), ("2", "", "a,b", "trail ")]
    df = spark.createDataFrame(rows, "id string, a string, b string, c string")
    out = S.write_text_table(df, str(tmp_path / "csv"))
    back = S.read_text_table(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    pq = S.convert_to_parquet(back, str(tmp_path / "pq"))
    assert sorted(tuple(r) for r in S.scan_parquet_table(spark, pq).collect()) == sorted(rows)


def _tree(root):
    _write(f"{root}/a/b/c.csv", "x,y\n1,2\n")
    _write(f"{root}/a/empty.txt", "")
    _write(f"{root}/with space/%odd.CSV", "x\n1\n")
    _write(f"{root}/top.txt", "top")
    for i in range(30):
        _write(f"{root}/many/f{i:03d}.txt", str(i))


def test_inventory_keeps_zero_byte_and_odd_keys(spark, tmp_path):
    root = str(tmp_path / "tree")
    _tree(root)
    inv = {r["key"]: r["size"] for r in object_inventory(spark, root).collect()}
    assert inv["a/empty.txt"] == 0 and "with space/%odd.CSV" in inv and "top.txt" in inv
    assert len(inv) == 34
    texts = {os.path.basename(r["path"]) for r in S.object_texts(spark, root).collect()}
    assert "top.txt" in texts


def test_copy_move_delete_ledgers(spark, tmp_path):
    root, mirror = str(tmp_path / "tree"), str(tmp_path / "mirror")
    _tree(root)
    inv = object_inventory(spark, root)
    plan = O.plan_copy(inv, mirror)
    # one planned key disappears before the run: it must fail alone
    plan_path = B.write_plan(plan.unionByName(
        plan.limit(1).withColumn("key", F.lit("gone/missing.txt"))
        .withColumn("dst_key", F.lit("gone/missing.txt"))))
    ledger = B.run_copy(spark, plan_path)
    summary = O.outcome_summary(ledger, by=[]).first()
    assert (summary["done"], summary["failed"], summary["total"]) == (34, 1, 35)
    assert summary["done"] + summary["failed"] == spark.read.parquet(plan_path).count()
    assert os.path.getsize(f"{mirror}/a/empty.txt") == 0
    archive = str(tmp_path / "archive")
    moved = B.run_move(spark, B.write_plan(O.plan_move(object_inventory(spark, mirror), archive)))
    assert moved.filter("status = 'ok'").count() == 34
    assert object_inventory(spark, mirror).count() == 0
    assert object_inventory(spark, archive).count() == 34
    deleted = B.run_delete(spark, B.write_plan(O.plan_delete(object_inventory(spark, archive))))
    assert deleted.filter("status = 'ok'").count() == 34
    assert object_inventory(spark, archive).count() == 0


def test_land_folder(spark, tmp_path):
    root, lake = str(tmp_path / "tree"), str(tmp_path / "lake")
    _tree(root)
    ledger = B.land_folder(spark, root, lake, "raw/")
    assert ledger.filter("status = 'ok'").count() == 34
    assert os.path.exists(f"{lake}/raw/with space/%odd.CSV")


def test_delete_batches_skewed(spark):
    # one container holds a third of the keys, more than one task's share
    rows = [("hot", f"k{i:05d}") for i in range(3000)] + \
           [(f"c{i % 50}", f"k{i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "container string, key string")
    got = O.delete_batches(df, size=7).collect()
    expect = {}
    for c in sorted({c for c, _ in rows}):
        for i, k in enumerate(sorted(k for cc, k in rows if cc == c)):
            expect[(c, k)] = (i + 1, i // 7)
    assert {(r["container"], r["key"]): (r["seq"], r["batch"]) for r in got} == expect


def test_keys_present_missing(spark):
    req = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a")], "container string, key string")
    inv = spark.createDataFrame([("c", "a"), ("d", "z")], "container string, key string")
    assert [tuple(r) for r in O.keys_present(req, inv).collect()] == [("c", "a")]
    assert sorted(tuple(r) for r in O.keys_missing(req, inv).collect()) == [("c", "b"), ("d", "a")]


def test_catalog(spark, tmp_path):
    loc = S.write_text_table(spark.createDataFrame([("1", "x")], "a string, b string"),
                             str(tmp_path / "t"))
    assert T.create_database(spark, "Cat Test-DB")["database"] == "cat_test_db"
    assert "was there" in T.create_database(spark, "cat test db")["message"]
    dry = T.register_table(spark, "cat test db", "T1", loc, [{"Name": "a", "Type": "integer"}],
                           dry_run=True)
    assert "`a` int" in dry["table_input"]
    res = T.register_table(spark, "cat test db", "T1", loc,
                           [{"Name": "a", "Type": "integer"}, {"Name": "b", "Type": "string"}])
    assert res["success"] and spark.table("cat_test_db.t1").first()["a"] == 1
    again = [{"Name": "a", "Type": "integer"}, {"Name": "b", "Type": "string"}]
    assert "was there" in T.register_table(spark, "cat test db", "T1", loc, again)["message"]
    other = T.register_table(spark, "cat test db", "T1", loc, [{"Name": "a", "Type": "string"}])
    assert not other["success"] and "other columns" in other["error"]
    assert [r[0] for r in T.list_tables(spark, "cat test db").select("tableName").collect()] == ["t1"]
    assert T.describe_table(spark, "cat test db", "t1").count() > 3
    assert not T.drop_database(spark, "cat test db")["success"]  # not empty
    assert T.drop_table(spark, "cat test db", "t1")["success"]
    assert os.path.exists(loc)  # external: files stay
    assert T.drop_database(spark, "cat test db")["success"]


def test_partitioned_table_repair(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "2024"), (2, "y", "2025")], "a int, b string, year string")
    loc = str(tmp_path / "p")
    df.write.partitionBy("year").parquet(loc)
    res = T.register_table(spark, "part db", "pt", loc, [{"Name": "a", "Type": "int"},
                                                        {"Name": "b", "Type": "string"}],
                           partition_keys=[{"Name": "year", "Type": "string"}], fmt="parquet")
    assert res["success"]
    assert spark.table("part_db.pt").count() == 2


def test_tree_jobs_dry_run_then_run(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    _tree(src)
    with pytest.raises(ValueError, match="no such destination"):
        B.plan_copy_tree(spark, src, dst)
    os.makedirs(dst)
    _write(f"{dst}/top.txt", "old")
    dry = B.copy_tree(spark, src, dst, dry_run=True)
    assert dry["would_copy"] == 34 and dry["overwrites"] == 1
    assert object_inventory(spark, dst).count() == 1  # nothing touched
    done = B.copy_tree(spark, src, dst, dry_run=False)
    assert done["success"] and done["done"] == 34
    assert open(f"{dst}/top.txt").read() == "top"
    roots = B.plan_delete_roots(spark, [src, dst, str(tmp_path / "nope")]).collect()
    by = {r["container"].rsplit("/", 1)[-1]: r for r in roots}
    assert by["src"]["would_delete"] == 34 and by["nope"]["error"]
    assert B.delete_tree(spark, dst, dry_run=True)["would_delete"] == 34
    assert B.delete_tree(spark, dst, dry_run=False)["deleted"] == 34
    assert object_inventory(spark, dst).count() == 0 and os.path.isdir(dst)


@pytest.mark.parametrize("min_prefixes", [1, 2, 100])
def test_inventory_same_for_any_expansion(spark, tmp_path, min_prefixes):
    root = str(tmp_path / "tree")
    _tree(root)
    for i in range(5):
        _write(f"{root}/deep/l1/l2/l3/f{i}.txt", "x")
    inv = object_inventory(spark, root, min_prefixes=min_prefixes)
    keys = sorted(r["key"] for r in inv.collect())
    expect = sorted(os.path.relpath(os.path.join(d, f), root)
                    for d, _, fs in os.walk(root) for f in fs)
    assert keys == expect


def test_files_of_text_grow_in_number_not_in_size(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "repeat('x', 88) AS t", "CAST(NULL AS STRING) AS u")
    one = S.write_text_table(df, str(tmp_path / "few"), n_files=2)
    more = S.write_text_table(df, str(tmp_path / "more"), n_files=2, file_bytes=20_000)
    few = S.write_text_table(df, str(tmp_path / "least"), n_files=2, file_bytes=1 << 20)
    files = [len([f for f in os.listdir(p) if f.endswith(".csv")]) for p in (one, more, few)]
    assert files == [2, -(-2000 * (88 + 2 + 12) // 20_000), 2]
    assert sorted(map(tuple, S.read_text_table(spark, more).collect())) == sorted(
        map(tuple, S.read_text_table(spark, one).collect()))
