"""Scalar functions, and F3/F8 as inverses."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrylake.functions import scalars as S
from ferrylake.functions.schema_text import parse_schema_texts
from ferrylake.plans.catalog import catalog_type, slug_name

SCHEMA_TEXTS = {  # FIXTURES 3
    "Index=int\nPrice=float": [("Index", "int"), ("Price", "float")],
    "Name string\nPrice float": [("Name", "string"), ("Price", "float")],
    "Index=int, Price=float": [("Index", "int"), ("Price", "float")],
    "a, b int": [("a", "string"), ("b", "int")],
    "a=int not null": [("a", "int not null")],
    "a int not null": [("a", "int")],
    "a=decimal(10,2)": [("a", "decimal(10"), ("2)", "string")],
    "a=int,\nb": [("a", "int,"), ("b", "string")],
    "": [],
    "  \n ": [],
}


def test_schema_texts(spark):
    texts = list(SCHEMA_TEXTS)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = parse_schema_texts(df, "text", ["id"]).collect()
    for i, t in enumerate(texts):
        got = [(r["name"], r["type"]) for r in sorted((r for r in rows if r["id"] == i),
                                                      key=lambda r: r["pos"])]
        assert got == SCHEMA_TEXTS[t], t


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.from_regex(r"[A-Za-z_][A-Za-z0-9_]{0,8}", fullmatch=True),
                          st.sampled_from(["int", "float", "bool", "timestamp", "string"])),
                min_size=1, max_size=8))
def test_schema_text_roundtrip(spark, cols):
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(cols)],
                                 "pos int, name string, type string")
    text = S.schema_text(rows)
    back = parse_schema_texts(text, "schema_text").orderBy("pos").collect()
    assert [(r["name"], r["type"]) for r in back] == cols


def test_slugify_and_types(spark):
    names = [" My Table-Name ", "!!!", None, "__x y", "A" * 200, "Ünïcode name", "a--b  c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(S.slugify("n", "tbl")).collect()]
    assert got == [slug_name(n, "tbl") for n in names]
    assert got[0] == "my_table_name" and got[3] == "x_y" and len(got[4]) == 120
    assert got[1].startswith("tbl_") and len(got[1]) == 12
    types = ["int", " Integer ", "long", "REAL", "date", "bool", "decimal(10,2)", "", None]
    tdf = spark.createDataFrame([(t,) for t in types], "t string")
    mapped = [r[0] for r in tdf.select(S.map_column_type("t")).collect()]
    assert mapped == [catalog_type(t) for t in types]
    assert mapped == ["int", "int", "bigint", "double", "timestamp", "boolean", "string",
                      "string", "string"]
    norm = [r[0] for r in tdf.select(S.normalize_type("t")).collect()]
    assert norm[:6] == ["int", "int", "long", "real", "date", "bool"]


def test_keys(spark):
    keys = ["en/474.html", "fr/825?page=2&ref=x", ".bashrc", "a.", "..a", "x/y.tar.gz", "D.CSV"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    pk = [r[0] for r in df.select(S.parquet_key("key")).collect()]
    import os
    assert pk == [os.path.join("processed/", os.path.basename(os.path.splitext(k)[0] + ".parquet"))
                  for k in keys]
    dk = df.select(S.dest_key(F.concat(F.lit("/r/"), "key"), "/r", "raw/")).collect()
    assert [r[0] for r in dk] == ["raw/" + k for k in keys]
    inv = df.withColumn("container", F.lit("c"))
    assert S.first_csv(inv).first()["first_csv"] == "D.CSV"


def test_json(spark):
    df = spark.createDataFrame([('{"k": 87, "b": "x"}',), ("{broken",), ("[1]",)], "p string")
    rows = df.select(S.json_args("p").alias("m")).collect()
    assert rows[0]["m"] == {"k": "87", "b": "x"} and rows[1]["m"] == {} and rows[2]["m"] == {}
    j = df.select(S.to_json_row(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))).first()[0]
    assert j == '{"a":1,"b":null}'
