"""The vote, its summary and settling it."""

import pytest
from pyspark.sql import functions as F

from ferrylake.operators import apply as R6
from ferrylake.operators import profile as A
from ferrylake.operators import resolve as R
from ferrylake.tables import TEXT_COLUMNS, load

from conftest import SF001


def _py_counts(rows, cols):
    from test_predicates import py_flags
    out = {}
    for i, c in enumerate(cols):
        n = [0] * 6
        for r in rows:
            v = r[i]
            n[0] += 1
            if v is None:
                n[5] += 1
                continue
            fi, ff, fb, ft = py_flags(v)
            n[1] += fi
            n[2] += ff
            n[3] += fb
            n[4] += ft
            n[5] += not ft
        out[c] = tuple(n)
    return out


@pytest.mark.parametrize("pre_group", [True, False])
def test_type_counts_brute_force(spark, pre_group):
    rows = [("1", "2.5", "yes", "2024-01-05", "x"), ("2", "nan", "no", "5-1-2024", ""),
            ("", "3", "1", "bad", None), (" 7 ", "1e3", "TRUE", "1/2/2024", "y"),
            ("1", "2.5", "yes", "2024-01-05", "x")] * 7
    cols = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    got = {r["column"]: (r["total"], r["n_int"], r["n_float"], r["n_bool"], r["n_timestamp"],
                         r["n_string"]) for r in A.type_counts(df, pre_group=pre_group).collect()}
    assert got == _py_counts(rows, cols)


def test_sensor_example_is_ambiguous(spark):
    # FIXTURES 2: ts is 60% timestamp, 40% text
    rows = [(str(i), f"{i}.5", "2024-01-0%d" % (i % 9 + 1) if i % 5 < 3 else "n/a") for i in range(20)]
    df = spark.createDataFrame(rows, "sensor_id string, reading string, ts string")
    prof = {r["column"]: r for r in A.profile(df).collect()}
    ts = prof["ts"]
    assert ts["p_timestamp"] == pytest.approx(0.6) and ts["p_string"] == pytest.approx(0.4)
    assert ts["type"] == "timestamp" and ts["ambiguous"]
    assert ts["reason"] == "Column contains mixed types: ['timestamp', 'string']"
    # overlap voting: an int column is int, float and string at once
    sid = prof["sensor_id"]
    assert (sid["type"], sid["confidence"], sid["ambiguous"]) == ("int", 1.0, True)
    # exclusive voting: clean columns are not ambiguous
    ex = {r["column"]: r for r in A.profile(df, mode="exclusive").collect()}
    assert (ex["sensor_id"]["type"], ex["sensor_id"]["ambiguous"]) == ("int", False)
    assert (ex["reading"]["type"], ex["reading"]["ambiguous"]) == ("float", False)


def test_describe_shares_rounds_half_even(spark):
    df = spark.createDataFrame([(8, 1, 0, 0, 0, 7)], "total long, n_int long, n_float long, "
                               "n_bool long, n_timestamp long, n_string long")
    df = A.type_shares(df.withColumn("n_blank", F.lit(0)))
    text = df.select(A.describe_shares(df)).first()[0]
    # 1/8 = 12.5% -> 12 (Python's format rounds half to even); 7/8 = 87.5% -> 88
    assert text == "string:88%, int:12%, float:0%, bool:0%, timestamp:0%"


def test_infer_schema_errors(spark):
    empty = spark.createDataFrame([], "a string")
    with pytest.raises(ValueError, match="no rows"):
        A.infer_schema(empty)


def test_infer_schema_sample(spark):
    part = load(spark, SF001, "part")
    res = A.infer_schema(part, sample="50", order_by=["p_partkey"], columns=TEXT_COLUMNS["part"])
    assert {c["Name"] for c in res.columns} == set(TEXT_COLUMNS["part"])
    assert res.profile.first()["total"] == 50


def test_resolve_and_open_columns(spark):
    rows = [(str(i), f"{i}.5" if i % 2 else "n/a", "x") for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    prof = A.profile(df)
    assert [r["column"] for r in R.open_columns(prof).collect()] == ["a", "b"]
    choices = R.choices_frame(spark, [("a", " Integer "), ("b", "number"), ("zz", "int")])
    bad = {(r["column"], r["problem"]) for r in R.invalid_choices(choices, prof).collect()}
    assert bad == {("b", "unknown type"), ("zz", "unknown column")}
    res = {r["column"]: r for r in R.resolve(prof, choices).collect()}
    assert (res["a"]["type"], res["a"]["confidence"], res["a"]["chosen"]) == ("int", 1.0, True)
    assert not R.is_resolved(prof, choices)
    assert [r["column"] for r in R.open_after_choices(prof, choices).collect()] == ["b"]
    more = R.choices_frame(spark, [("a", "int"), ("b", "DOUBLE")])
    assert R.is_resolved(prof, more)


def test_schema_or_resolved(spark, tmp_path):
    from ferrylake.sources.schema_store import save_schema
    with pytest.raises(ValueError):
        R.schema_or_resolved("INFERRED_SCHEMA", spark, str(tmp_path / "none"), "x")
    rows = spark.createDataFrame([(0, "a", "int", 1.0), (1, "b", "string", 0.5)],
                                 "pos int, name string, type string, confidence double")
    save_schema(rows, str(tmp_path / "store"), "ds")
    got = R.schema_or_resolved([], spark, str(tmp_path / "store"), "ds")
    assert [(c["Name"], c["Type"]) for c in got] == [("a", "int"), ("b", "string")]
    assert R.schema_or_resolved("x=int, y", spark) == [{"Name": "x", "Type": "int"},
                                                       {"Name": "y", "Type": "string"}]


def test_apply_and_rejects(spark):
    rows = [("1_000", "1.5", "yes", "2024-02-29"), ("x", "nan", "0", "2023-02-29"),
            ("", "", "", ""), ("99999999999999999999", "1d", "t", "5-1-2024")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    schema = [("a", "int"), ("b", "float"), ("c", "bool"), ("d", "timestamp")]
    typed = R6.apply_schema(df, schema)
    assert [f.dataType.simpleString() for f in typed.schema.fields] == \
        ["bigint", "double", "boolean", "timestamp_ntz"]
    got = typed.collect()
    assert got[0]["a"] == 1000 and got[0]["c"] is True and str(got[0]["d"]) == "2024-02-29 00:00:00"
    assert got[2]["a"] is None and got[2]["d"] is None
    rej = {(r["column"], r["value"]) for r in R6.rejects(df, schema).collect()}
    assert rej == {("a", "x"), ("a", "99999999999999999999"), ("b", "1d"), ("c", "t"),
                   ("d", "2023-02-29")}


def test_grouping_and_dealing_keep_counts(spark):
    # constant at first, unique later: the plan does not look at the first rows
    rows = [("c" if i < 200 else str(i), "x" if i % 3 else "2024-01-01") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v string")
    plain = {tuple(r) for r in A.type_counts(df).collect()}
    assert plain == {tuple(r) for r in A.type_counts(df, pre_group=True).collect()}
    assert plain == {tuple(r) for r in A.type_counts(df, pre_group=True, direct=["k"]).collect()}
    assert plain == {tuple(r) for r in A.type_counts(df, partitions=7).collect()}


def test_columns_without_text_are_named(spark):
    df = spark.sql("SELECT 1 AS a, array(1) AS b, map('k', 1) AS c, CAST('x' AS BINARY) AS d")
    with pytest.raises(ValueError, match="b, c, d"):
        A.type_counts(df)
    assert [r["column"] for r in A.type_counts(df, columns=["a"]).collect()] == ["a"]


def test_valid_choice_beside_an_unknown_type(spark):
    prof = A.profile(spark.createDataFrame([("1",), ("x",)], "c string"))
    assert prof.first()["ambiguous"]
    choices = R.choices_frame(spark, [("c", "int"), ("c", "varchar")])
    r = R.resolve(prof, choices).first()
    assert (r["type"], r["chosen"], r["ambiguous"]) == ("int", True, False)
    assert R.is_resolved(prof, choices)
    assert R.contradictions(choices).count() == 0
    both = R.choices_frame(spark, [("c", "int"), ("c", "float"), ("d", "int")])
    assert [(x["column"], x["types"]) for x in R.contradictions(both).collect()] == [
        ("c", ["float", "int"])]
    named = {(x["column"], x["problem"]) for x in R.invalid_choices(both, ["c"]).collect()}
    assert named == {("d", "unknown column")}


@pytest.mark.parametrize("mode", ["overlap", "exclusive"])
def test_many_tables_equal_one_by_one(spark, mode):
    names = ["region", "nation", "orders", "documents"]
    tables = {t: load(spark, SF001, t) for t in names}
    together = {tuple(r) for r in A.type_counts_tables(
        tables, mode=mode, columns={t: TEXT_COLUMNS[t] for t in names},
        direct={"documents": ["text"]}).collect()}
    alone = set()
    for t in names:
        for r in A.type_counts(tables[t], mode=mode, columns=TEXT_COLUMNS[t]).collect():
            alone.add((t, *tuple(r)))
    assert together == alone
