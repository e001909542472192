"""Profile queries: P1-P6, A1-A6, F7, S2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylake.functions import predicates as P
from ferrylake.operators import profile as A
from ferrylake.queries import cores, register
from ferrylake.queries.sqlgen import (counts_sql, describe_sql, lit, long_sql,
                                      profile_sql, q)
from ferrylake.sources.text import sample_rows
from ferrylake.tables import TABLE_NAMES, TEXT_COLUMNS, load

COUNT_OUT = ["pos", "column", "total", "n_blank", *A.COUNT_COLS]


def _counts(spark, sf_dir, table):
    df = load(spark, sf_dir, table)
    return A.type_counts(df, columns=TEXT_COLUMNS[table], partitions=cores(df.sparkSession))


def _sql_counts(table):
    return counts_sql(long_sql(table))


@register("type_counts_lineitem", _sql_counts("lineitem"))
def type_counts_lineitem(spark, sf_dir):
    return _counts(spark, sf_dir, "lineitem")


@register("type_counts_customer", _sql_counts("customer"))
def type_counts_customer(spark, sf_dir):
    return _counts(spark, sf_dir, "customer")


@register("type_counts_documents", _sql_counts("documents"))
def type_counts_documents(spark, sf_dir):
    return _counts(spark, sf_dir, "documents")


@register("type_counts_exclusive_lineitem",
          counts_sql(long_sql("lineitem"), mode="exclusive"))
def type_counts_exclusive_lineitem(spark, sf_dir):
    return A.type_counts(load(spark, sf_dir, "lineitem"), mode="exclusive",
                         columns=TEXT_COLUMNS["lineitem"], partitions=cores(spark))


_SHARES_OUT = ["pos", "column", "total", *A.SHARE_COLS]


@register("type_shares_orders",
          f"SELECT pos, {q('column')}, total, "
          + ", ".join(f"p_{t}" for t in P.TYPE_ORDER)
          + f" FROM ({profile_sql(long_sql('orders'))}) AS x")
def type_shares_orders(spark, sf_dir):
    return A.type_shares(_counts(spark, sf_dir, "orders")).select(*_SHARES_OUT)


def _all_profiles(spark, sf_dir, mode="overlap"):
    tables = {t: load(spark, sf_dir, t) for t in TABLE_NAMES}
    return A.profile_tables(tables, mode=mode, columns=TEXT_COLUMNS, partitions=cores(spark))


def _all_profiles_sql(mode="overlap"):
    return "\nUNION ALL ".join(
        f"SELECT {lit(t)} AS {q('table')}, * FROM ({profile_sql(long_sql(t), mode)}) AS p{i}"
        for i, t in enumerate(TABLE_NAMES))


@register("best_type_all_tables",
          f"SELECT {q('table')}, pos, {q('column')}, type, confidence, ambiguous "
          f"FROM ({_all_profiles_sql()}) AS a")
def best_type_all_tables(spark, sf_dir):
    return _all_profiles(spark, sf_dir).select(
        "table", "pos", "column", "type", "confidence", "ambiguous")


@register("best_type_exclusive_all_tables",
          f"SELECT {q('table')}, pos, {q('column')}, type, confidence, ambiguous "
          f"FROM ({_all_profiles_sql('exclusive')}) AS a")
def best_type_exclusive_all_tables(spark, sf_dir):
    return _all_profiles(spark, sf_dir, mode="exclusive").select(
        "table", "pos", "column", "type", "confidence", "ambiguous")


@register("ambiguous_columns_events",
          f"SELECT pos, {q('column')}, type, confidence, reason, "
          + ", ".join(f"p_{t}" for t in P.TYPE_ORDER)
          + f" FROM ({profile_sql(long_sql('events'))}) AS x WHERE ambiguous")
def ambiguous_columns_events(spark, sf_dir):
    prof = A.profile(load(spark, sf_dir, "events"), columns=TEXT_COLUMNS["events"],
                     partitions=cores(spark))
    return A.ambiguous_columns(prof).select(
        "pos", "column", "type", "confidence", "reason", *A.SHARE_COLS)


@register("needs_help_by_table",
          f"SELECT {q('table')}, coalesce(bool_or(ambiguous), false) AS needs_help, "
          f"CAST(count(*) AS BIGINT) AS n_columns, "
          f"CAST(sum(CAST(ambiguous AS INTEGER)) AS BIGINT) AS n_ambiguous "
          f"FROM ({_all_profiles_sql()}) AS a GROUP BY {q('table')}")
def needs_help_by_table(spark, sf_dir):
    return A.needs_help(_all_profiles(spark, sf_dir), by=["table"]).select(
        "table", "needs_help", "n_columns", F.col("n_ambiguous").cast("bigint"))


_PART = TEXT_COLUMNS["part"]


@register("sample_profile_part",
          counts_sql(long_sql("(SELECT * FROM part ORDER BY p_partkey LIMIT 500)", _PART)))
def sample_profile_part(spark, sf_dir):
    # The 500-row sample is the feature under test (the reference profiles
    # the first 500 rows); ordered by key so the sample is repeatable.
    sample = sample_rows(load(spark, sf_dir, "part"), 500, ["p_partkey"])
    return A.type_counts(sample, columns=_PART)


# events.value with every 4th event's value replaced by a word, so the column
# holds both floats and words.
def _mixed_events(df):
    return df.select(
        "event_id", F.col("ts").cast("string").alias("ts"), "event_type",
        F.when(F.col("event_id") % 4 == 0, F.lit("n/a"))
        .otherwise(F.col("value").cast("string")).alias("value"))


_MIXED_SQL = ("(SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type, "
              "CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value "
              "FROM events)")


@register("describe_shares_mixed",
          f"SELECT pos, {q('column')}, type, ambiguous, {describe_sql()} AS shares "
          f"FROM ({profile_sql(long_sql(_MIXED_SQL, ['event_id', 'ts', 'event_type', 'value']))}) AS b")
def describe_shares_mixed(spark, sf_dir):
    mixed = _mixed_events(load(spark, sf_dir, "events"))
    prof = A.profile(mixed, columns=["event_id", "ts", "event_type", "value"])
    return prof.select("pos", "column", "type", "ambiguous",
                       A.describe_shares(prof).alias("shares"))
