"""Registered queries against their DuckDB oracle at sf0.01 (a fast subset by
default; FERRYLAKE_FULL_ORACLE=1 runs them all)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ferrylake.tables import TABLE_NAMES

from conftest import SF01

FAST = ["type_counts_customer", "type_shares_orders", "ambiguous_columns_events",
        "sample_profile_part", "describe_shares_mixed", "resolve_choices", "invalid_choices",
        "open_after_choices", "rejects_events", "timestamp_formats", "slugify_names",
        "parse_schema_texts", "map_types", "dest_keys", "suffix_keys", "parquet_keys",
        "json_props", "container_counts", "keys_present", "keys_missing", "copy_plan",
        "move_plan", "delete_plan", "delete_batches", "outcome_summary", "csv_roundtrip",
        "registered_table_scan", "bulk_copy_ledger"]
NAMES = list(E.oracle_sql()) if os.environ.get("FERRYLAKE_FULL_ORACLE") else FAST


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and df.columns[:2] == ["pos", "column"]


def test_every_query_has_a_runner():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 45
