"""I1/I2 round trip and the landing-folder streams."""

import os

from pyspark.sql import functions as F

from ferrylake.operators import profile as A
from ferrylake.operators import resolve as R
from ferrylake.plans.ingest import ingest, run_ledger
from ferrylake.sources import text as S
from ferrylake.streaming import landing
from ferrylake.tables import TEXT_COLUMNS, load

from conftest import SF001


def test_ingest_roundtrip(spark, tmp_path):
    orders = load(spark, SF001, "orders")
    folder = S.write_text_table(orders, str(tmp_path / "landing"), n_files=3)
    run = ingest(spark, folder, str(tmp_path / "lake"), database="Sales", table="Orders",
                 ledger_root=str(tmp_path / "runs"))
    assert run.success, run.errors
    typed = spark.table(f"{run.database}.{run.parquet_table}")
    assert [f.dataType.simpleString() for f in typed.schema.fields] == \
        ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]
    assert typed.exceptAll(orders.select(*typed.columns)).count() == 0
    assert orders.exceptAll(typed).count() == 0
    raw = spark.table(f"{run.database}.{run.table}")
    assert raw.count() == orders.count()
    steps = [r["step"] for r in spark.read.parquet(str(tmp_path / "runs")).orderBy("seq").collect()]
    assert steps[0] == "land" and steps[-1] == "save_schema"


def test_ingest_stops_on_open_columns_then_choices(spark, tmp_path):
    rows = [(str(i), f"{i}.5" if i % 2 else "n/a") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, reading string")
    folder = S.write_text_table(df, str(tmp_path / "landing"))
    run = ingest(spark, folder, str(tmp_path / "lake"))
    assert run.next == "disambiguate" and run.open_columns == ["reading"]
    choices = R.choices_frame(spark, [("reading", "double")])
    run2 = ingest(spark, folder, str(tmp_path / "lake2"), choices=choices, table="readings",
                  report_rejects=True)
    assert run2.success and run2.parquet_table
    rej = spark.read.parquet(run2.locations["rejects"]).collect()
    assert [(r["column"], r["value"], r["n"]) for r in rej] == [("reading", "n/a", 20)]
    typed = spark.table(f"{run2.database}.{run2.parquet_table}")
    assert typed.filter(F.col("reading").isNull()).count() == 20
    assert run_ledger(spark, run2).count() == len(run2.steps)


def test_profile_stream_equals_batch(spark, tmp_path):
    orders = load(spark, SF001, "orders")
    folder = S.write_text_table(orders, str(tmp_path / "landing"), n_files=3)
    out = str(tmp_path / "counts")
    landing.profile_stream(spark, folder, TEXT_COLUMNS["orders"], out,
                           str(tmp_path / "ckpt")).awaitTermination()
    got = {tuple(r) for r in landing.read_snapshot(spark, out).collect()}
    batch = {tuple(r) for r in A.type_counts(orders, columns=TEXT_COLUMNS["orders"]).collect()}
    assert got == batch
    # a new file lands: the next run adds it to the kept state
    S.write_text_table(orders.limit(10), os.path.join(folder, "more"), mode="overwrite")
    landing.profile_stream(spark, folder, TEXT_COLUMNS["orders"], out,
                           str(tmp_path / "ckpt")).awaitTermination()
    totals = {r["total"] for r in landing.read_snapshot(spark, out).collect()}
    assert totals == {orders.count() + 10}


def test_ingest_stream_restart_is_exactly_once(spark, tmp_path):
    orders = load(spark, SF001, "orders")
    folder = str(tmp_path / "landing")
    S.write_text_table(orders.filter("o_orderkey % 2 = 0"), folder + "/a", n_files=2)
    text = S.read_text_table(spark, folder, csv_only=True)
    pairs = R.schema_pairs(R.settled_schema(A.profile(text, mode="exclusive", already_text=True)))
    out, ckpt = str(tmp_path / "typed"), str(tmp_path / "ckpt")
    landing.ingest_stream(spark, folder + "/a", TEXT_COLUMNS["orders"], pairs, out, ckpt).awaitTermination()
    first = spark.read.parquet(out).count()
    # the same query restarted on its checkpoint: nothing is appended twice
    landing.ingest_stream(spark, folder + "/a", TEXT_COLUMNS["orders"], pairs, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == first == orders.filter("o_orderkey % 2 = 0").count()
    # a new file lands: only it is added
    S.write_text_table(orders.filter("o_orderkey % 2 = 1"), folder + "/a/more", n_files=1)
    landing.ingest_stream(spark, folder + "/a", TEXT_COLUMNS["orders"], pairs, out, ckpt).awaitTermination()
    typed = spark.read.parquet(out)
    assert typed.count() == orders.count()
    assert typed.exceptAll(orders.select(*typed.columns)).count() == 0


def test_streams_read_each_file_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name, text in {
            "a.csv": 'k,v,t\n1,2.5,"x, ""y""\nz"\n2,,\n3\n\n4,1.5\n5,6.5,t,more\n',
            "b.csv": "t,k,v\nu,6,3.5\n,7\nw\n",
            "c.csv": "v,k\n4.5,8\n,9\n",
            "d.csv": 'note,t,v,k\n"n,\n1",s,5.5,10\nn,r\n'}.items():
        (folder / name).write_text(text)
    want = S.read_text_table(spark, str(folder)).select("k", "v", "t")
    got = str(tmp_path / "rows")
    (landing.text_stream(spark, str(folder), ["k", "v", "t"]).writeStream.format("parquet")
     .option("checkpointLocation", str(tmp_path / "c0")).option("path", got)
     .trigger(availableNow=True).start().awaitTermination())
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    rows = order(spark.read.parquet(got).select("k", "v", "t"))
    assert rows == order(want) and len(rows) == 12
    assert ("1", "2.5", 'x, "y"\nz') in rows and ("3", None, None) in rows
    out = str(tmp_path / "counts")
    landing.profile_stream(spark, str(folder), ["k", "v", "t"], out,
                           str(tmp_path / "c1")).awaitTermination()
    batch = A.type_counts(want, columns=["k", "v", "t"], already_text=True)
    assert {tuple(r) for r in landing.read_snapshot(spark, out).collect()} == \
        {tuple(r) for r in batch.collect()}


def test_short_rows_are_written_by_many_tasks(spark):
    from ferrylake.queries import io_q
    lines = spark.read.text(io_q._short_rows(spark, SF001)).withColumn("f", F.input_file_name())
    per_file = lines.groupBy("f").agg(F.count_if(F.col("value").startswith("c_")).alias("n")).collect()
    assert [r.n for r in per_file] == [1] * 8
