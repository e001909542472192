"""Object queries: A7, A8, R9, B1-B4, B9 over the driver's tables as objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylake.operators import objects as O
from ferrylake.queries import register
from ferrylake.queries.scalar_q import PAGE_OBJECTS_SQL, page_objects
from ferrylake.tables import load


@register("container_counts",
          "SELECT container, CAST(count(*) AS BIGINT) AS objects, "
          "CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes "
          f"FROM {PAGE_OBJECTS_SQL} AS o GROUP BY container")
def container_counts(spark, sf_dir):
    return O.container_counts(page_objects(load(spark, sf_dir, "pages")))


# Every page key is requested; the inventory holds the pages whose url
# carries no query string.
_INV_SQL = f"(SELECT container, key FROM {PAGE_OBJECTS_SQL} AS o WHERE NOT contains(key, '?'))"


def _requested_and_inventory(spark, sf_dir):
    objs = page_objects(load(spark, sf_dir, "pages"))
    return objs.select("container", "key", "page_id"), \
        objs.filter(~F.col("key").contains("?")).select("container", "key")


@register("keys_present",
          f"SELECT container, key, page_id FROM {PAGE_OBJECTS_SQL} AS o "
          f"WHERE (container, key) IN (SELECT (container, key) FROM {_INV_SQL} AS i)")
def keys_present(spark, sf_dir):
    req, inv = _requested_and_inventory(spark, sf_dir)
    return O.keys_present(req, inv)


@register("keys_missing",
          f"SELECT container, key, page_id FROM {PAGE_OBJECTS_SQL} AS o "
          f"WHERE (container, key) NOT IN (SELECT (container, key) FROM {_INV_SQL} AS i)")
def keys_missing(spark, sf_dir):
    req, inv = _requested_and_inventory(spark, sf_dir)
    return O.keys_missing(req, inv)


# B1/B2: https pages are copied (moved) into container 'archive' under
# '<host>/<key>'; the archive already holds the http pages the same way.
def _split_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    objs = page_objects(pages).withColumn("https", pages_https())
    src = objs.filter("https").drop("https")
    dst = objs.filter(~F.col("https")).select(
        F.lit("archive").alias("container"),
        F.concat("container", F.lit("/"), "key").alias("key"))
    return src, dst


def pages_https():
    return F.lower(F.col("url")).startswith("https://")


_OBJ_HTTPS = (f"(SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS container, "
              f"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*/?(.*)$', 1) AS key, "
              f"CAST(strlen(html) AS BIGINT) AS size, starts_with(lower(url), 'https://') AS https FROM pages)")
_COPY_SQL = (
    "SELECT s.container, s.key, s.size, 'archive' AS dst_container, "
    "s.container || '/' || s.key AS dst_key, "
    "EXISTS (SELECT 1 FROM " + _OBJ_HTTPS + " AS d WHERE NOT d.https AND "
    "d.container || '/' || d.key = s.container || '/' || s.key) AS overwrites "
    f"FROM {_OBJ_HTTPS} AS s WHERE s.https")


@register("copy_plan", _COPY_SQL)
def copy_plan(spark, sf_dir):
    src, dst = _split_pages(spark, sf_dir)
    return O.plan_copy(src.select("container", "key", "size"), "archive", dst,
                       keep_container=True)


@register("move_plan",
          "SELECT container, CAST(count(*) AS BIGINT) AS would_move, "
          "CAST(count(*) FILTER (WHERE overwrites) AS BIGINT) AS overwrites, "
          "CAST(sum(size) AS BIGINT) AS bytes, min(action) AS action "
          f"FROM (SELECT *, 'move' AS action FROM ({_COPY_SQL}) AS c0) AS c GROUP BY container")
def move_plan(spark, sf_dir):
    src, dst = _split_pages(spark, sf_dir)
    plan = O.plan_move(src.select("container", "key", "size"), "archive", dst,
                       keep_container=True)
    return plan.groupBy("container").agg(
        F.count(F.lit(1)).alias("would_move"), F.count_if("overwrites").alias("overwrites"),
        F.sum("size").cast("bigint").alias("bytes"), F.min("action").alias("action"))


@register("delete_plan",
          "SELECT container, CAST(count(*) AS BIGINT) AS objects_found, "
          "CAST(count(*) AS BIGINT) AS would_delete, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes "
          f"FROM {PAGE_OBJECTS_SQL} AS o GROUP BY container")
def delete_plan(spark, sf_dir):
    return O.plan_delete_many(page_objects(load(spark, sf_dir, "pages")))


# Documents as objects of their source, deleted in key order in batches.
@register("delete_batches",
          "SELECT source AS container, doc_id AS key, "
          "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS seq, "
          f"CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / {O.DELETE_BATCH}) AS BIGINT) AS batch "
          "FROM documents")
def delete_batches(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(
        F.col("source").alias("container"), F.col("doc_id").alias("key"))
    return O.delete_batches(docs).select("container", "key", "seq", "batch")


# Events as a ledger of one user's operations; an 'error' event failed.
@register("outcome_summary",
          "SELECT 'user-' || CAST(user_id AS VARCHAR) AS container, "
          "CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS done, "
          "CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed, "
          "CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE event_type = 'error') = 0 AS success "
          "FROM events GROUP BY user_id")
def outcome_summary(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    ledger = ev.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("container"),
        F.col("event_id").cast("string").alias("key"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok")).alias("status"))
    return O.outcome_summary(ledger)


# B4 with one hot container over many batches: orders as objects, every third one
# of container 'hot', some of no container at all.
_HOT = ("CASE WHEN o_orderkey % 3 = 0 THEN 'hot' WHEN o_orderkey % 31 = 1 THEN NULL "
        "ELSE 'c' || CAST(o_custkey % 10 AS VARCHAR) END")


@register("delete_batches_hot_container",
          "SELECT container, key, "
          "CAST(row_number() OVER (PARTITION BY container ORDER BY key) AS BIGINT) AS seq, "
          f"CAST(floor((row_number() OVER (PARTITION BY container ORDER BY key) - 1) / {O.DELETE_BATCH}) AS BIGINT) AS batch "
          f"FROM (SELECT {_HOT} AS container, o_orderkey AS key FROM orders) AS d")
def delete_batches_hot_container(spark, sf_dir):
    keys = load(spark, sf_dir, "orders").select(
        F.expr(_HOT.replace("VARCHAR", "STRING")).alias("container"), F.col("o_orderkey").alias("key"))
    return O.delete_batches(keys).select("container", "key", "seq", "batch")


# B1/B2: pages of all hosts moved into one container. By their path alone some hosts'
# pages name one target; by their first folder alone most pages do.
_DISTINCT = (f"(SELECT container, key, max(size) AS size FROM {PAGE_OBJECTS_SQL} AS o "
             "GROUP BY container, key)")
_RIVALS = ("SELECT *, row_number() OVER (PARTITION BY key ORDER BY container) AS nth, "
           f"CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS rivals FROM {_DISTINCT} AS d")
_FOLDER = r"regexp_extract(key, '^[^/?#]*', 0)"


@register("move_collisions",
          f"SELECT container, key, size, {_FOLDER} || CASE WHEN nth = 1 THEN '' ELSE '~' || "
          "substring(sha256(container || chr(10) || key), 1, 16) END || '.html' AS dst_key, "
          "rivals, false AS refused FROM (SELECT *, "
          f"row_number() OVER (PARTITION BY {_FOLDER} ORDER BY container, key) AS nth, "
          f"CAST(count(*) OVER (PARTITION BY {_FOLDER}) AS BIGINT) AS rivals FROM {_DISTINCT} AS d)")
def move_collisions(spark, sf_dir):
    # one target named by most rows; all but its first row are renamed.
    plan = O.plan_move(_distinct_pages(spark, sf_dir), "archive").withColumn(
        "dst_key", F.concat(F.regexp_extract("key", "^[^/?#]*", 0), F.lit(".html")))
    return O.settle_targets(plan, "rename").select(
        "container", "key", "size", "dst_key", "rivals", "refused")


def _distinct_pages(spark, sf_dir):
    return page_objects(load(spark, sf_dir, "pages")).groupBy("container", "key").agg(
        F.max("size").alias("size"))


@register("copy_refusals",
          "SELECT container, CAST(count(*) AS BIGINT) AS objects, "
          "CAST(count(*) FILTER (WHERE rivals > 1) AS BIGINT) AS refused, "
          "CAST(count(*) FILTER (WHERE rivals > 1 AND nth > 1) AS BIGINT) AS refused_after_first "
          f"FROM ({_RIVALS}) AS r GROUP BY container")
def copy_refusals(spark, sf_dir):
    # B1: the same plan by the two other rules.
    objs = _distinct_pages(spark, sf_dir)
    all_of = O.plan_copy(objs, "archive", collisions="refuse")
    later = O.plan_copy(objs, "archive", collisions="first").select(
        "container", "key", F.col("refused").alias("later"))
    return all_of.join(later, ["container", "key"]).groupBy("container").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if("refused").alias("refused"),
        F.count_if("later").alias("refused_after_first"))
