"""Resolve / apply queries: R1-R7 (and P5 through the timestamp cast)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylake.functions import predicates as P
from ferrylake.functions.scalars import VALID_CHOICES
from ferrylake.operators import apply as R6
from ferrylake.operators import profile as A
from ferrylake.operators import resolve as R
from ferrylake.queries import cores, register
from ferrylake.queries.sqlgen import (long_sql, normalize_type_sql, profile_sql, q,
                                      values_sql)
from ferrylake.tables import TEXT_COLUMNS, load

# Choices a user gave for customer's columns: aliases, odd case and blanks,
# an unknown type and an unknown column among them.
CUSTOMER_CHOICES = [
    ("c_custkey", "integer"),
    ("c_custkey", "varchar"),
    ("c_acctbal", " Double "),
    ("c_mktsegment", "STRING"),
    ("c_name", "varchar"),
    ("c_phone", "int"),
    ("c_nationkey", "number"),
    ("c_mktsegment", "Boolean"),
]

_VALID = ", ".join(f"'{t}'" for t in VALID_CHOICES)
_CH = values_sql(CUSTOMER_CHOICES, ["column", "type"])
_VALID_CH = (f"(SELECT {q('column')}, max(choice) AS choice FROM (SELECT {q('column')}, "
             f"{normalize_type_sql('type')} AS choice FROM {_CH} AS c0) AS c1 "
             f"WHERE choice IN ({_VALID}) GROUP BY {q('column')})")
_CUST_PROFILE = profile_sql(long_sql("customer"))


def _customer_profile(spark, sf_dir):
    return A.profile(load(spark, sf_dir, "customer"), columns=TEXT_COLUMNS["customer"])


@register("resolve_choices",
          f"SELECT p.pos, p.{q('column')}, coalesce(v.choice, p.type) AS type, "
          f"CASE WHEN v.choice IS NOT NULL THEN 1.0 ELSE p.confidence END AS confidence, "
          f"(p.ambiguous AND v.choice IS NULL) AS ambiguous, v.choice IS NOT NULL AS chosen "
          f"FROM ({_CUST_PROFILE}) AS p LEFT JOIN {_VALID_CH} AS v ON p.{q('column')} = v.{q('column')}")
def resolve_choices(spark, sf_dir):
    choices = R.choices_frame(spark, CUSTOMER_CHOICES)
    return R.resolve(_customer_profile(spark, sf_dir), choices).select(
        "pos", "column", "type", "confidence", "ambiguous", "chosen")


@register("invalid_choices",
          f"SELECT {q('column')}, type, 'unknown type' AS problem FROM {_CH} AS c "
          f"WHERE {normalize_type_sql('type')} NOT IN ({_VALID}) "
          f"UNION ALL SELECT c.{q('column')}, c.type, 'unknown column' AS problem FROM {_CH} AS c "
          f"WHERE {normalize_type_sql('c.type')} IN ({_VALID}) AND c.{q('column')} NOT IN "
          f"(SELECT {q('column')} FROM ({_CUST_PROFILE}) AS p)")
def invalid_choices(spark, sf_dir):
    choices = R.choices_frame(spark, CUSTOMER_CHOICES)
    return R.invalid_choices(choices, load(spark, sf_dir, "customer").columns)


@register("open_after_choices",
          f"SELECT pos, {q('column')} FROM ({_CUST_PROFILE}) AS p WHERE ambiguous AND "
          f"{q('column')} NOT IN (SELECT {q('column')} FROM {_VALID_CH} AS v)")
def open_after_choices(spark, sf_dir):
    choices = R.choices_frame(spark, CUSTOMER_CHOICES)
    return R.open_after_choices(_customer_profile(spark, sf_dir), choices)


# Orders read as text, typed by its own exclusive profile, aggregated.
def typed_from_text(df, columns, mode="exclusive"):
    text = A.as_text(df, columns)
    prof = A.profile(text, mode=mode, already_text=True)
    schema = R.settled_schema(prof)
    return R6.apply_schema(text, schema)


_ORDERS_AGG_SQL = (
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS sum_custkey, "
    "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sum_price_cents, "
    "min(o_orderdate) AS min_date, max(o_orderdate) AS max_date, "
    "CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_priorities FROM orders GROUP BY o_orderstatus")


@register("apply_schema_orders", _ORDERS_AGG_SQL)
def apply_schema_orders(spark, sf_dir):
    typed = typed_from_text(load(spark, sf_dir, "orders"), TEXT_COLUMNS["orders"])
    return typed.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("sum_custkey"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("bigint").alias("sum_price_cents"),
        F.min("o_orderdate").alias("min_date"), F.max("o_orderdate").alias("max_date"),
        F.count_distinct("o_orderpriority").alias("n_priorities"))


# Events rendered as text with spoiled values.
EVENTS_SCHEMA = [("event_id", "int"), ("ts", "timestamp"), ("user_id", "int"),
                 ("event_type", "string"), ("value", "float"), ("props", "string")]


def spoiled_events(df):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    eid = F.col("event_id")
    return df.select(
        eid.cast("string").alias("event_id"),
        F.when(eid % 11 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso).alias("ts"),
        F.when(eid % 7 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .otherwise(F.col("user_id").cast("string")).alias("user_id"),
        "event_type",
        F.when(eid % 5 == 0, F.concat(F.col("value").cast("string"), F.lit("x")))
        .otherwise(F.col("value").cast("string")).alias("value"),
        "props")


_SPOILED_SQL = (
    "(SELECT CAST(event_id AS VARCHAR) AS event_id, "
    "CASE WHEN event_id % 11 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, "
    "CASE WHEN event_id % 7 = 0 THEN 'u' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS user_id, "
    "event_type, CASE WHEN event_id % 5 = 0 THEN CAST(value AS VARCHAR) || 'x' "
    "ELSE CAST(value AS VARCHAR) END AS value, props FROM events)")


def _reject_sql(col, kind):
    f = P.sql_flags(col)
    bad = f"NOT {f['blank']} AND NOT {f[kind]}"
    return (f"SELECT '{col}' AS {q('column')}, {col} AS value, CAST(count(*) AS BIGINT) AS n "
            f"FROM {_SPOILED_SQL} AS s WHERE {bad} GROUP BY {col}")


REJECTS_EVENTS_SQL = "\nUNION ALL ".join([
    _reject_sql("event_id", "int"), _reject_sql("ts", "timestamp"),
    _reject_sql("user_id", "int"), _reject_sql("value", "float")])


@register("rejects_events", REJECTS_EVENTS_SQL)
def rejects_events(spark, sf_dir):
    return R6.rejects(spoiled_events(load(spark, sf_dir, "events")), EVENTS_SCHEMA)


@register("typed_events_roundtrip",
          "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(ts) AS BIGINT) AS n_ts, "
          "min(ts) AS min_ts, max(ts) AS max_ts, CAST(count(user_id) AS BIGINT) AS n_user, "
          "CAST(count(value) AS BIGINT) AS n_value "
          "FROM (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts, "
          "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, "
          "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events) AS e "
          "GROUP BY event_type")
def typed_events_roundtrip(spark, sf_dir):
    typed = R6.apply_schema(spoiled_events(load(spark, sf_dir, "events")), EVENTS_SCHEMA)
    return typed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_ts"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.count("user_id").alias("n_user"), F.count("value").alias("n_value"))


# P5a-f: orders.o_orderdate rendered in the six formats, one per o_orderkey % 6,
# voted and parsed back.
_FMT_SPARK = ["yyyy-M-d", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
              "yyyy-MM-dd'T'HH:mm:ss.SSS", "d-M-yyyy", "M/d/yyyy"]
_FMT_DUCK = ["%Y-%-m-%-d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
             "%Y-%m-%dT%H:%M:%S.%g", "%-d-%-m-%Y", "%-m/%-d/%Y"]


@register("timestamp_formats",
          "SELECT fmt, CAST(count(*) AS BIGINT) AS n, "
          f"CAST(sum(CASE WHEN {P.sql_flags('txt')['timestamp']} THEN 1 ELSE 0 END) AS BIGINT) AS n_timestamp, "
          "CAST(count(*) AS BIGINT) AS n_roundtrip FROM (SELECT CAST(o_orderkey % 6 AS INTEGER) AS fmt, "
          "CASE " + " ".join(f"WHEN o_orderkey % 6 = {i} THEN strftime(o_orderdate, '{f}')"
                             for i, f in enumerate(_FMT_DUCK)) +
          " END AS txt FROM orders) AS t GROUP BY fmt")
def timestamp_formats(spark, sf_dir):
    o = load(spark, sf_dir, "orders").repartition(cores(spark))
    k = (F.col("o_orderkey") % 6).cast("int")
    txt = None
    for i, f in enumerate(_FMT_SPARK):
        e = F.date_format("o_orderdate", f)
        txt = F.when(k == i, e) if txt is None else txt.when(k == i, e)
    t = o.select(k.alias("fmt"), txt.alias("txt"), "o_orderdate")
    t = R6.apply_schema(t.withColumn("back", F.col("txt")), [("back", "timestamp")])
    return t.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(P.is_timestamp("txt").cast("int")).cast("bigint").alias("n_timestamp"),
        F.sum((F.col("back") == F.col("o_orderdate")).cast("int")).cast("bigint").alias("n_roundtrip"))
