"""Physical plans: pruning, pushdown and join shapes that the scale design
relies on."""

from ferrylake.operators import apply as R6
from ferrylake.operators import objects as O
from ferrylake.operators import profile as A
from ferrylake.sources.schema_store import load_schema, save_schema
from ferrylake.tables import load

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vote_reads_only_profiled_columns(spark):
    li = load(spark, SF001, "lineitem")
    plan = _plan(A.type_counts(li, columns=["l_returnflag", "l_shipdate"]))
    assert "ReadSchema: struct<l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "l_orderkey" not in plan.split("ReadSchema")[1].split(">")[0]


def test_schema_store_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "int", 1.0)], "pos int, name string, type string, "
                                 "confidence double")
    store = str(tmp_path / "store")
    save_schema(rows, store, "x")
    save_schema(rows, store, "y")
    df = load_schema(spark, store, "y")
    assert "PartitionFilters: [isnotnull(dataset" in _plan(df)
    assert df.count() == 1


def test_key_checks_are_semi_and_anti_joins(spark):
    req = spark.createDataFrame([("c", "a")], "container string, key string")
    inv = spark.createDataFrame([("c", "a")], "container string, key string")
    assert "LeftSemi" in _plan(O.keys_present(req, inv))
    assert "LeftAnti" in _plan(O.keys_missing(req, inv))


def test_batches_never_window_a_whole_container(spark):
    df = spark.createDataFrame([("c", f"k{i}") for i in range(50)], "container string, key string")
    plan = _plan(O.delete_batches(df, size=7))
    # the only window runs over per-(container, partition) counts
    assert "RangePartitioning" in plan or "ReusedExchange" in plan or "Scan ExistingRDD" in plan
    assert "row_number" not in plan


def test_vote_has_no_exchange_before_its_partial_counts(spark):
    li = load(spark, SF001, "lineitem")
    plan = _plan(A.type_counts(li))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    below = plan[plan.index("Exchange"):]
    assert "partial_sum" in below or "partial_" in below


def test_typed_read_is_map_only(spark):
    text = A.as_text(load(spark, SF001, "orders"))
    typed = R6.apply_schema(text, [("o_orderkey", "int"), ("o_orderdate", "timestamp")])
    assert "Exchange" not in _plan(typed)
