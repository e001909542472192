"""Source/sink, catalog, bulk-job, ingest and streaming queries (S1-S8,
T1-T7, B5-B8, I1-I2). Each writes what it needs under the shared scratch
folder (``spark.checkpoint.dir``) from the driver's tables, then reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylake.functions.scalars import has_suffix
from ferrylake.operators import apply as R6
from ferrylake.operators import profile as A
from ferrylake.operators import resolve as R
from ferrylake.operators.file_votes import vote_files
from ferrylake.plans import bulk as B
from ferrylake.plans import catalog as T
from ferrylake.plans.ingest import ingest
from ferrylake.plans.publish import publish, versions
from ferrylake.queries import register
from ferrylake.queries.profile_q import _sql_counts
from ferrylake.queries.resolve_q import (_ORDERS_AGG_SQL, REJECTS_EVENTS_SQL, spoiled_events,
                                        typed_from_text)
from ferrylake.queries.sqlgen import long_sql, profile_sql, q
from ferrylake.session import scratch_path
from ferrylake.sources import text as S
from ferrylake.sources.inventory import object_inventory
from ferrylake.sources.schema_store import load_schema, save_schema
from ferrylake.streaming import landing
from ferrylake.tables import TEXT_COLUMNS, load

_CUSTOMER_SQL = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                 "c_acctbal, c_mktsegment FROM customer")


def _customer_csv(spark, sf_dir, n_files=4):
    out = scratch_path(spark, "customer-csv")
    S.write_text_table(load(spark, sf_dir, "customer"), out, n_files=n_files)
    return out


@register("csv_roundtrip", _CUSTOMER_SQL)
def csv_roundtrip(spark, sf_dir):
    # Customer written as CSV text, read back as text, typed by its vote.
    text = S.read_text_table(spark, _customer_csv(spark, sf_dir))
    return typed_from_text(text, TEXT_COLUMNS["customer"])


@register("parquet_convert", _CUSTOMER_SQL)
def parquet_convert(spark, sf_dir):
    # S5 then S4: the typed table written as Parquet and scanned.
    typed = typed_from_text(S.read_text_table(spark, _customer_csv(spark, sf_dir)),
                            TEXT_COLUMNS["customer"])
    out = S.convert_to_parquet(typed, scratch_path(spark, "customer-parquet"))
    return S.scan_parquet_table(spark, out)


# Two files of one folder with their columns in opposite orders, each read by
# its own header.
@register("csv_mixed_headers", _CUSTOMER_SQL)
def csv_mixed_headers(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    out = scratch_path(spark, "customer-mixed")
    S.write_text_table(c.filter("c_custkey % 2 = 0"), out, n_files=2)
    S.write_text_table(c.filter("c_custkey % 2 = 1").select(*reversed(c.columns)), out,
                       mode="append", n_files=2)
    return typed_from_text(S.read_text_table(spark, out), TEXT_COLUMNS["customer"])


def _short_rows(spark, sf_dir, n_files=8):
    """Customers as CSV files, each with its header, of rows that end before their
    last field and others whose last field is empty."""
    c = load(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 3
    cells = [F.col(x).cast("string") for x in ("c_custkey", "c_acctbal")]
    line = F.concat_ws(",", *cells, F.when(kind == 1, F.lit("")).when(
        kind == 2, F.col("c_mktsegment")))

    def headed(batches):
        import pandas as pd
        yield pd.DataFrame({"value": ["c_custkey,c_acctbal,c_mktsegment"]})
        yield from batches

    out = scratch_path(spark, "customer-short")
    c.select(line.alias("value")).repartition(n_files).mapInPandas(
        headed, "value string").write.text(out)
    return out


# Rows that end before their last field, others whose last field is empty.
@register("csv_short_rows",
          "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS sum_custkey, "
          "CAST(count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) AS BIGINT) AS n_absent, "
          "CAST(count(CASE WHEN c_custkey % 3 = 1 THEN 1 END) AS BIGINT) AS n_blank, "
          "CAST(count(CASE WHEN c_custkey % 3 = 2 AND c_mktsegment <> '' THEN 1 END) AS BIGINT) "
          "AS n_full FROM customer")
def csv_short_rows(spark, sf_dir):
    t = S.read_text_table(spark, _short_rows(spark, sf_dir))
    seg = F.col("c_mktsegment")
    return t.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col("c_custkey").cast("long")).alias("sum_custkey"),
                 F.count_if(seg.isNull()).alias("n_absent"), F.count_if(seg == "").alias("n_blank"),
                 F.count_if(seg != "").alias("n_full"))


# Texts with line breaks, separators and quotes, in fewer files than tasks read
# them: borders of the byte ranges lie inside quoted values.
@register("csv_quoted_breaks",
          "SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(coalesce(text, '')) AS n_chars, "
          "sha256(coalesce(text, '')) AS text_sha256, lang, true AS more_tasks_than_files "
          "FROM documents")
def csv_quoted_breaks(spark, sf_dir):
    out = scratch_path(spark, "documents-csv")
    S.write_text_table(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), out,
                       n_files=2, file_bytes=S.FILE_BYTES)
    files, size = object_inventory(spark, out).filter(has_suffix("key")).agg(
        F.count(F.lit(1)), F.max("size")).first()
    t = S.read_text_table(spark, out, range_bytes=max(1, size // 16))
    tasks = t.select(F.spark_partition_id().alias("p")).distinct().count()
    return t.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    F.sha2("text", 256).alias("text_sha256"), "lang",
                    F.lit(tasks > files).alias("more_tasks_than_files"))


# Rows that are equal to their file's header, in files of two column orders.
_HEADERED = ("CASE WHEN c_custkey % 5 = 0 THEN '{0}' ELSE CAST({0} AS {1}) END")


@register("csv_header_rows",
          "SELECT k, s, CAST(count(*) AS BIGINT) AS n FROM (SELECT "
          + _HEADERED.format("c_custkey", "VARCHAR") + " AS k, "
          + _HEADERED.format("c_mktsegment", "VARCHAR") + " AS s FROM customer) AS c GROUP BY k, s")
def csv_header_rows(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    names = ["c_custkey", "c_mktsegment"]
    out = scratch_path(spark, "customer-headers")
    rows = c.select(F.col("c_custkey").alias("id"), *[
        F.expr(_HEADERED.format(x, "STRING")).alias(x) for x in names])
    S.write_text_table(rows.filter("id % 2 = 0").select(*names), out, n_files=2)
    S.write_text_table(rows.filter("id % 2 = 1").select(*reversed(names)), out, mode="append",
                       n_files=2)
    return S.read_text_table(spark, out).groupBy(
        F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s")).agg(
        F.count(F.lit(1)).alias("n"))


# The first 500 rows of CSV files as they stand (orders in key order over files
# that are named in that order), and their vote.
_FIRST_SQL = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500"


@register("first_rows_orders",
          "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS "
          f"o_custkey, o_orderstatus, o_orderpriority FROM ({_FIRST_SQL}) AS f")
def first_rows_orders(spark, sf_dir):
    out = scratch_path(spark, "orders-sorted")
    text = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    text.repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").write.options(
        **S.CSV_WRITE).csv(out)
    return S.first_rows(spark, out, 500, range_bytes=4096)


# A folder voted, then voted again after more files have landed and one has left.
@register("vote_more_files",
          f"SELECT c.*, CAST(3 AS BIGINT) AS files_read, CAST(2 AS BIGINT) AS files_kept "
          f"FROM ({_sql_counts('orders')}) AS c")
def vote_more_files(spark, sf_dir):
    root = scratch_path(spark, "orders-arriving")
    folder, store = f"{root}/files", f"{root}/votes"
    orders = load(spark, sf_dir, "orders")
    S.write_text_table(orders.filter("o_orderkey % 2 = 0"), folder, n_files=2)
    S.write_text_table(orders.filter("o_orderkey % 5 = 0"), f"{folder}/leaves", n_files=1)
    vote_files(spark, folder, store, csv_only=True)
    B.delete_tree(spark, f"{folder}/leaves", dry_run=False)
    S.write_text_table(orders.filter("o_orderkey % 2 = 1").select(*reversed(orders.columns)),
                       f"{folder}/z", n_files=3)
    vote = vote_files(spark, folder, store, csv_only=True)
    return vote.counts.select("*", F.lit(vote.read).cast("bigint").alias("files_read"),
                              F.lit(vote.kept).cast("bigint").alias("files_kept"))


def _page_tree(spark, sf_dir):
    """The pages as a tree of objects ``<host>/<page_id>.html``."""
    pages = load(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    root = scratch_path(spark, "page-tree")
    B.put_objects(pages.select(F.concat(host, F.lit("/"), F.col("page_id").cast("string"),
                                        F.lit(".html")).alias("key"),
                               F.col("html").alias("body")), root)
    return root


@register("object_texts_read",
          "SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS host, "
          "CAST(count(*) AS BIGINT) AS n_objects, CAST(sum(length(html)) AS BIGINT) AS n_chars "
          "FROM pages GROUP BY 1")
def object_texts_read(spark, sf_dir):
    # Every page stored as its own object <host>/<page_id>.html, each
    # object read back whole.
    texts = S.object_texts(spark, _page_tree(spark, sf_dir))
    h = F.regexp_extract("path", r"/([^/]*)/[^/]*$", 1)
    return texts.groupBy(h.alias("host")).agg(
        F.count(F.lit(1)).alias("n_objects"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@register("schema_store",
          f"SELECT pos, {q('column')} AS name, type, confidence FROM ({profile_sql(long_sql('customer'))}) AS p")
def schema_store(spark, sf_dir):
    # customer's settled schema saved next to another dataset's, loaded back.
    prof = A.profile(load(spark, sf_dir, "customer"), columns=TEXT_COLUMNS["customer"])
    store = scratch_path(spark, "schema-store")
    save_schema(R.settled_schema(prof), store, "lake.customer")
    other = A.profile(load(spark, sf_dir, "nation"), columns=TEXT_COLUMNS["nation"])
    save_schema(R.settled_schema(other), store, "lake.nation")
    return load_schema(spark, store, "lake.customer")


@register("registered_table_scan",
          "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, "
          "CAST(c_nationkey AS INTEGER) AS c_nationkey, CAST(c_acctbal AS FLOAT) AS c_acctbal, "
          "c_mktsegment FROM customer")
def registered_table_scan(spark, sf_dir):
    # T1 + T4 + S3: customer's CSV registered as an external table with its
    # vote's types mapped to catalog types (int, float ... as the reference
    # registers them), scanned through the catalog.
    loc = _customer_csv(spark, sf_dir)
    prof = A.profile(S.read_text_table(spark, loc), mode="exclusive")
    cols = [{"Name": n, "Type": t} for n, t in R.schema_pairs(R.settled_schema(prof))]
    db = "lake_" + loc.rsplit("-", 1)[-1]
    res = T.register_table(spark, db, "Customer Raw", loc, cols, fmt="csv")
    if not res["success"]:
        raise RuntimeError(res["error"])
    return spark.table(f"{res['database']}.{res['table']}")


def _catalog_session(spark, sf_dir):
    loc = _customer_csv(spark, sf_dir)
    db = "cat_" + loc.rsplit("-", 1)[-1]
    cols = [{"Name": c, "Type": "string"} for c in TEXT_COLUMNS["customer"]]
    T.create_database(spark, db, "scratch catalog")
    for name in ("customer raw", "customer-copy", "Customer Raw"):  # the last one exists already
        T.register_table(spark, db, name, loc, cols)
    T.register_table(spark, db, "dropped", loc, cols)
    T.drop_table(spark, db, "dropped")
    return db


_SEGMENT_SLUG = "regexp_replace(lower(trim(c_mktsegment)), '[ \\-]+', '_', 'g')"


@register("list_tables", f"SELECT DISTINCT {_SEGMENT_SLUG} AS \"tableName\" FROM customer")
def list_tables(spark, sf_dir):
    # One table per market segment, registered twice; another dropped.
    db, loc, cols = _segment_tables(spark, sf_dir)
    T.register_table(spark, db, "dropped", loc, cols)
    T.drop_table(spark, db, "dropped")
    return T.list_tables(spark, db).select("tableName")


def _segment_tables(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    loc = _customer_csv(spark, sf_dir)
    db = "cat_" + loc.rsplit("-", 1)[-1]
    cols = [{"Name": x, "Type": "string"} for x in TEXT_COLUMNS["customer"]]
    T.create_database(spark, db, "scratch catalog")
    for r in c.select("c_mktsegment").distinct().collect() * 2:
        T.register_table(spark, db, r["c_mktsegment"], loc, cols)
    return db, loc, cols


@register("describe_table",
          f"SELECT pos, {q('column')} AS col_name, CASE type WHEN 'bool' THEN 'boolean' "
          f"ELSE type END AS data_type FROM ({profile_sql(long_sql('customer'), 'exclusive')}) AS p")
def describe_table(spark, sf_dir):
    # T5: the columns of a table registered with customer's own vote.
    prof = A.profile(load(spark, sf_dir, "customer"), mode="exclusive",
                     columns=TEXT_COLUMNS["customer"])
    cols = [{"Name": n, "Type": t} for n, t in R.schema_pairs(R.settled_schema(prof))]
    loc = _customer_csv(spark, sf_dir)
    db = "cat_" + loc.rsplit("-", 1)[-1]
    T.register_table(spark, db, "voted", loc, cols)
    place = {c["Name"]: i for i, c in enumerate(cols)}
    rows = T.describe_table(spark, db, "voted").filter(F.col("col_name").isin(*place))
    at = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])
    return rows.select(at[F.col("col_name")].alias("pos"), "col_name", "data_type")


# ------------------------------------------------------------ bulk jobs
_PAGE_KEYS_SQL = ("SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) "
                  "|| '/' || CAST(page_id AS VARCHAR) || '.html' AS key, "
                  "CAST(strlen(html) AS BIGINT) AS bytes, 'ok' AS status FROM pages")


@register("land_folder",
          "SELECT 'raw/' || key AS key, bytes, status FROM (" + _PAGE_KEYS_SQL + ") AS p")
def land_folder(spark, sf_dir):
    tree = _page_tree(spark, sf_dir)
    ledger = B.land_folder(spark, tree, scratch_path(spark, "lake"), "raw/")
    return ledger.select(F.col("dst_key").alias("key"), "bytes", "status")


# A landed tree whose source then loses, changes and gains objects (by page_id % 4).
@register("land_sync",
          "SELECT 'raw/' || CAST(page_id AS VARCHAR) || '.html' AS key, "
          "CASE page_id % 4 WHEN 0 THEN 'unchanged' WHEN 2 THEN 'remove' ELSE 'copy' END AS action, "
          "CASE page_id % 4 WHEN 1 THEN CAST(strlen(url) AS BIGINT) WHEN 2 THEN NULL "
          "ELSE CAST(strlen(html) AS BIGINT) END AS bytes, 'ok' AS status FROM pages")
def land_sync(spark, sf_dir):
    key = F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("key")
    pages = load(spark, sf_dir, "pages").select("page_id", key, "html", "url")
    src, lake = scratch_path(spark, "sync-source"), scratch_path(spark, "sync-lake")

    def put(where, body):
        B.put_objects(pages.filter(where).select("key", F.col(body).alias("body")), src)

    put("page_id % 4 <> 3", "html")
    B.land_folder(spark, src, lake, "raw/", sync=True)
    put("page_id % 4 = 1", "url")
    put("page_id % 4 = 3", "html")
    gone = object_inventory(spark, src).filter(
        F.substring_index("key", ".", 1).cast("long") % 4 == 2)
    B.run_delete(spark, B.write_plan(gone.select("container", "key")))
    ledger = B.land_folder(spark, src, lake, "raw/", sync=True)
    there = object_inventory(spark, lake).select("key", F.col("size").alias("bytes"))
    return ledger.select(F.col("dst_key").alias("key"), "action", "status").join(
        there, "key", "full").select("key", "action", "bytes", "status")


@register("bulk_copy_ledger", _PAGE_KEYS_SQL)
def bulk_copy_ledger(spark, sf_dir):
    tree = _page_tree(spark, sf_dir)
    from ferrylake.operators import objects as O
    mirror = scratch_path(spark, "mirror")
    plan = O.plan_copy(object_inventory(spark, tree), mirror)
    ledger = B.run_copy(spark, B.write_plan(plan))
    # what the destination itself has, not what the ledger says of it
    there = object_inventory(spark, mirror).select("key", F.col("size").alias("bytes"))
    return ledger.select("key", "status").join(there, "key", "full").select(
        "key", "bytes", "status")


# Pages copied in parts of 1 KB, each page by several tasks; what the destination has.
@register("bulk_copy_parts",
          "SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) || '/' "
          "|| CAST(page_id AS VARCHAR) || '.html' AS key, CAST(strlen(html) AS BIGINT) AS bytes, "
          "sha256(html) AS checksum, 'ok' AS status FROM pages")
def bulk_copy_parts(spark, sf_dir):
    from ferrylake.operators import objects as O
    tree, mirror = _page_tree(spark, sf_dir), scratch_path(spark, "mirror")
    plan = O.plan_copy(object_inventory(spark, tree), mirror)
    ledger = B.run_copy(spark, B.write_plan(plan), part_bytes=1024)
    there = B.with_checksums(object_inventory(spark, mirror)).select(
        "key", F.col("size").alias("bytes"), "checksum")
    return ledger.select("key", "status").join(there, "key", "full").select(
        "key", "bytes", "checksum", "status")


@register("bulk_move_ledger",
          "SELECT key, bytes, status, true AS deleted, 0 AS left_behind FROM (" + _PAGE_KEYS_SQL + ") AS p")
def bulk_move_ledger(spark, sf_dir):
    tree = _page_tree(spark, sf_dir)
    from ferrylake.operators import objects as O
    plan = O.plan_move(object_inventory(spark, tree), scratch_path(spark, "archive"))
    ledger = B.run_move(spark, B.write_plan(plan))
    left = object_inventory(spark, tree).count()
    return ledger.select("key", "bytes", "status", "deleted", F.lit(left).cast("int").alias("left_behind"))


@register("bulk_move_refusals",
          "SELECT CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'archive' END AS place, "
          "CAST(page_id AS VARCHAR) || '.html' AS key, CAST(strlen(html) AS BIGINT) AS bytes, "
          "CASE WHEN page_id % 3 = 0 THEN 'refused' ELSE 'ok' END AS status FROM pages "
          "UNION ALL SELECT 'b', CAST(page_id AS VARCHAR) || '.html', "
          "CAST(strlen(url) AS BIGINT), 'refused' FROM pages WHERE page_id % 3 = 0")
def bulk_move_refusals(spark, sf_dir):
    # Two containers moved into one; where both have a key, both keep their object.
    from ferrylake.operators import objects as O
    pages = load(spark, sf_dir, "pages")
    key = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    root = scratch_path(spark, "move-refusals")
    a, b, archive = (f"{root}/{x}" for x in ("a", "b", "archive"))
    B.put_objects(pages.select(key.alias("key"), F.col("html").alias("body")), a)
    B.put_objects(pages.filter("page_id % 3 = 0").select(
        key.alias("key"), F.col("url").alias("body")), b)
    both = object_inventory(spark, a).unionByName(object_inventory(spark, b))
    ledger = B.run_move(spark, B.write_plan(O.plan_move(both, archive)))
    # what is where afterwards, beside what the ledger says of it
    there = object_inventory(spark, root).select(
        F.substring_index("key", "/", 1).alias("place"),
        F.substring_index("key", "/", -1).alias("key"), F.col("size").alias("bytes"))
    said = ledger.select(
        F.when(F.col("status") == "ok", "archive").otherwise(
            F.substring_index("container", "/", -1)).alias("place"), "key", "status")
    return there.join(said, ["place", "key"], "full").select("place", "key", "bytes", "status")


@register("bulk_delete_ledger",
          "SELECT key, status, 0 AS left_behind FROM (" + _PAGE_KEYS_SQL + ") AS p")
def bulk_delete_ledger(spark, sf_dir):
    tree = _page_tree(spark, sf_dir)
    from ferrylake.operators import objects as O
    plan = O.plan_delete(object_inventory(spark, tree))
    ledger = B.run_delete(spark, B.write_plan(plan))
    left = object_inventory(spark, tree).count()
    return ledger.select("key", "status", F.lit(left).cast("int").alias("left_behind"))


# ---------------------------------------------------------------- ingest
def _orders_landing(spark, sf_dir):
    folder = scratch_path(spark, "orders-landing")
    S.write_text_table(load(spark, sf_dir, "orders"), folder, n_files=4, file_bytes=S.FILE_BYTES)
    return folder


def _orders_mixed(spark, sf_dir):
    """A landing folder of files with their columns in opposite orders."""
    folder = scratch_path(spark, "orders-mixed")
    orders = load(spark, sf_dir, "orders")
    S.write_text_table(orders.filter("o_orderkey % 2 = 0"), folder, n_files=2)
    S.write_text_table(orders.filter("o_orderkey % 2 = 1").select(*reversed(orders.columns)),
                       folder, mode="append", n_files=2)
    return folder


def _orders_agg(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("sum_custkey"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("bigint").alias("sum_price_cents"),
        F.min("o_orderdate").alias("min_date"), F.max("o_orderdate").alias("max_date"),
        F.count_distinct("o_orderpriority").alias("n_priorities"))


@register("ingest_flagship", _ORDERS_AGG_SQL)
def ingest_flagship(spark, sf_dir):
    # Orders landed as CSV files -> voted -> typed Parquet table -> catalog.
    folder = _orders_landing(spark, sf_dir)
    run = ingest(spark, folder, scratch_path(spark, "lake"), database="lake_orders",
                 table="orders " + folder.rsplit("-", 1)[-1])
    if not run.success or not run.parquet_table:
        raise RuntimeError(f"ingest failed: {run.errors or run.next}")
    return _orders_agg(spark.table(f"{run.database}.{run.parquet_table}"))


_STEPS = ["land", "infer_schema", "create_database", "create_table_raw", "write_parquet",
          "create_table_parquet", "save_schema"]
_LEDGER_SQL = " UNION ALL ".join(
    [f"SELECT 1 AS run, {i} AS seq, '{s}' AS step, true AS success, "
     + ("(SELECT CAST(count(*) AS BIGINT) FROM orders)" if s == "write_parquet"
        else "CAST(NULL AS BIGINT)") + " AS n_rows" for i, s in enumerate(_STEPS)]
    + [f"SELECT 2, {i}, '{s}', true, CAST(NULL AS BIGINT)"
       for i, s in enumerate(["land", "infer_schema", "disambiguate"])]
    + ["SELECT 3, 0, 'land', false, CAST(NULL AS BIGINT)"])


@register("ingest_ledger", _LEDGER_SQL)
def ingest_ledger(spark, sf_dir):
    # The ordered steps of an ingest run with the rows it wrote, of a run stopped
    # by an open column (overlap voting leaves numeric columns ambiguous), and of one
    # whose source is missing.
    folder = _orders_landing(spark, sf_dir)
    lake, ledgers = scratch_path(spark, "lake"), scratch_path(spark, "runs")
    runs = [ingest(spark, folder, lake, database="lake_orders", ledger_root=ledgers,
                   table="orders " + folder.rsplit("-", 1)[-1]),
            ingest(spark, folder, lake, database="lake_orders", mode="overlap",
                   ledger_root=ledgers),
            ingest(spark, folder + "-missing", lake, ledger_root=ledgers)]
    order = F.create_map(*[x for i, r in enumerate(runs)
                           for x in (F.lit(r.run_id), F.lit(i + 1))])
    return spark.read.parquet(ledgers).select(
        order[F.col("run_id")].alias("run"), "seq", "step", "success",
        F.get_json_object("detail", "$.rows").cast("bigint").alias("n_rows"))


@register("ingest_two_datasets",
          "SELECT 'orders' AS dataset, CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS t, "
          "o_totalprice AS v FROM orders UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), "
          "c_name, c_acctbal FROM customer")
def ingest_two_datasets(spark, sf_dir):
    # Two datasets of different columns in one lake and database.
    lake = scratch_path(spark, "lake")
    tables = {}
    for name, folder in (("orders", _orders_landing(spark, sf_dir)),
                         ("customer", _customer_csv(spark, sf_dir))):
        run = ingest(spark, folder, lake, database="lake_two",
                     table=f"{name} {lake.rsplit('-', 1)[-1]}")
        if not run.success or not run.parquet_table:
            raise RuntimeError(f"ingest failed: {run.errors or run.next}")
        tables[name] = spark.table(f"{run.database}.{run.parquet_table}")
    o, c = tables["orders"], tables["customer"]
    return o.select(F.lit("orders").alias("dataset"), F.col("o_orderkey").alias("k"),
                    F.col("o_orderstatus").alias("t"), F.col("o_totalprice").alias("v")).union(
        c.select(F.lit("customer"), "c_custkey", "c_name", "c_acctbal"))


@register("ingest_after_removal",
          "SELECT *, CAST(2 AS BIGINT) AS files_removed FROM (" + _ORDERS_AGG_SQL.replace(
              "FROM orders", "FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) AS orders")
          + ") AS a")
def ingest_after_removal(spark, sf_dir):
    # A second ingest after a part of the source has left: its rows are gone.
    folder, lake = scratch_path(spark, "orders-parts"), scratch_path(spark, "lake")
    orders = load(spark, sf_dir, "orders")
    for k in (0, 1):
        S.write_text_table(orders.filter(F.col("o_orderkey") % 2 == k), f"{folder}/part{k}",
                           n_files=2)
    where = dict(database="lake_orders", table="orders " + folder.rsplit("-", 1)[-1])
    ingest(spark, folder, lake, **where)
    B.delete_tree(spark, f"{folder}/part1", dry_run=False)
    run = ingest(spark, folder, lake, **where)
    if not run.success or not run.parquet_table:
        raise RuntimeError(f"ingest failed: {run.errors or run.next}")
    left = object_inventory(spark, run.locations["raw"]).filter(has_suffix("key")).count()
    return _orders_agg(spark.table(f"{run.database}.{run.parquet_table}")).withColumn(
        "files_removed", F.lit(4 - left).cast("bigint"))


@register("publish_versions",
          "SELECT c_custkey, c_name, c_acctbal, false AS third_published, 2 AS n_versions "
          "FROM customer WHERE c_custkey % 2 = 0")
def publish_versions(spark, sf_dir):
    # Two versions of a table, and a third whose write fails on its last rows.
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    root = scratch_path(spark, "versions")
    db, tbl = "ver_" + root.rsplit("-", 1)[-1], "customer"
    half = c.filter("c_custkey % 2 = 0")
    broken = c.withColumn("c_name", F.when(
        F.col("c_custkey") % 97 == 96, F.raise_error(F.lit("no more")).cast("string"))
        .otherwise(F.col("c_name")))
    for df in (c, half):
        res = publish(df, root, db, tbl)
        if not res["success"]:
            raise RuntimeError(res["error"])
    third = publish(broken, root, db, tbl)
    return spark.table(f"{db}.{tbl}").select(
        "*", F.lit(third["success"]).alias("third_published"),
        F.lit(len(versions(spark, root))).alias("n_versions"))


# T4: partitions that land after the first registration, and one that leaves.
@register("late_partitions",
          "SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 'kept' "
          "WHEN 'P' THEN 'gone' ELSE 'new' END AS state, CAST(count(CASE WHEN o_orderstatus <> 'P' "
          "THEN 1 END) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def late_partitions(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    loc = scratch_path(spark, "orders-by-status")
    db = "par_" + loc.rsplit("-", 1)[-1]

    def land(which):
        S.convert_to_parquet(orders.filter(which), loc, mode="append",
                             partition_by=["o_orderstatus"])

    def register_it():
        res = T.register_table(spark, db, "orders", loc,
                               [("o_orderkey", "bigint"), ("o_custkey", "bigint")],
                               partition_keys=[("o_orderstatus", "string")], fmt="parquet")
        if not res["success"]:
            raise RuntimeError(res["error"])

    land("o_orderstatus IN ('F', 'P')")
    register_it()
    land("o_orderstatus NOT IN ('F', 'P')")
    B.delete_tree(spark, f"{loc}/o_orderstatus=P", dry_run=False)
    state = T.partition_diff(spark, db, "orders").select(
        F.substring_index("partition", "=", -1).alias("status"), "state").checkpoint()
    register_it()
    n = spark.table(f"{db}.orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    return state.join(n, "status", "left").select(
        "status", "state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# T4: a table per market segment over files of its own; registered again over the same
# place and over another one's.
@register("register_other_location",
          "SELECT c_mktsegment AS segment, true AS again, false AS elsewhere, "
          "CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")
def register_other_location(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    root = scratch_path(spark, "customer-segments")
    S.convert_to_parquet(c.withColumn("segment", F.col("c_mktsegment")), root,
                         partition_by=["segment"])
    db = "loc_" + root.rsplit("-", 1)[-1]
    segments = [r["c_mktsegment"] for r in c.select("c_mktsegment").distinct().collect()]
    rows, tables = [], None
    for k, s in enumerate(segments):
        own, other = (f"{root}/segment={x}" for x in (s, segments[k - 1]))
        first, again, elsewhere = (T.register_table(spark, db, s, x, None, fmt="parquet")
                                   for x in (own, own, other))
        rows.append((s, again["success"], elsewhere["success"]))
        t = spark.table(f"{first['database']}.{first['table']}")
        tables = t if tables is None else tables.unionByName(t)
    said = spark.createDataFrame(rows, "segment string, again boolean, elsewhere boolean")
    return tables.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n")).join(said, "segment").select(
        "segment", "again", "elsewhere", "n")


@register("raw_against_typed", _ORDERS_AGG_SQL)
def raw_against_typed(spark, sf_dir):
    # T4 + R6: the raw table of an ingest holds texts; read with the settled types
    # it is the typed table (rows that differ would stay in the second half).
    folder = _orders_landing(spark, sf_dir)
    run = ingest(spark, folder, scratch_path(spark, "lake"), database="lake_orders",
                 table="orders " + folder.rsplit("-", 1)[-1])
    raw = spark.table(f"{run.database}.{run.table}")
    typed = spark.table(f"{run.database}.{run.parquet_table}")
    cast = R6.apply_schema(raw, [(f.name, f.dataType.simpleString()) for f in typed.schema])
    return _orders_agg(cast.unionByName(typed.exceptAll(cast)).unionByName(
        cast.exceptAll(typed)))


@register("apply_stored_schema_orders", _ORDERS_AGG_SQL)
def apply_stored_schema_orders(spark, sf_dir):
    # A placeholder instead of a column list means the settled schema in the store.
    text = A.as_text(load(spark, sf_dir, "orders"), TEXT_COLUMNS["orders"])
    store = scratch_path(spark, "schema-store")
    save_schema(R.settled_schema(A.profile(text, mode="exclusive", already_text=True)), store,
                "lake.orders")
    columns = R.schema_or_resolved("INFERRED_SCHEMA", spark, store, "lake.orders")
    return _orders_agg(R6.apply_schema(text, columns))


# ------------------------------------------------------------- streaming
@register("stream_type_counts_orders", _sql_counts("orders"))
def stream_type_counts_orders(spark, sf_dir):
    # A1 as a stream: CSV files arriving in a landing folder, counts kept as
    # streaming state; the final snapshot equals the batch vote.
    folder = _orders_mixed(spark, sf_dir)
    out = scratch_path(spark, "stream-counts")
    landing.profile_stream(spark, folder, TEXT_COLUMNS["orders"], out,
                           scratch_path(spark, "stream-ckpt")).awaitTermination()
    return landing.read_snapshot(spark, out)


@register("stream_ingest_orders", _ORDERS_AGG_SQL)
def stream_ingest_orders(spark, sf_dir):
    # R6 as a stream: each arriving CSV file is typed with the settled schema
    # and appended to a Parquet table (exactly once through the checkpoint).
    folder = _orders_mixed(spark, sf_dir)
    text = S.read_text_table(spark, folder)
    prof = A.profile(text, mode="exclusive", already_text=True)
    pairs = R.schema_pairs(R.settled_schema(prof))
    out = scratch_path(spark, "stream-typed")
    landing.ingest_stream(spark, folder, TEXT_COLUMNS["orders"], pairs, out,
                          scratch_path(spark, "stream-ckpt")).awaitTermination()
    return _orders_agg(spark.read.parquet(out))


# S3: customer's CSV read as an external CSV table with a declared schema in
# which c_name is declared int: values that do not fit read as null.
_DECLARED = "c_custkey bigint, c_name int, c_nationkey int, c_acctbal double, c_mktsegment string"


@register("scan_csv_declared",
          "SELECT c_custkey, TRY_CAST(c_name AS INTEGER) AS c_name, c_nationkey, c_acctbal, "
          "c_mktsegment FROM customer")
def scan_csv_declared(spark, sf_dir):
    return S.scan_csv_table(spark, _customer_csv(spark, sf_dir), _DECLARED)


@register("infer_schema_lineitem",
          f"SELECT pos, {q('column')} AS name, type, confidence, ambiguous "
          f"FROM ({profile_sql(long_sql('lineitem'))}) AS p")
def infer_schema_lineitem(spark, sf_dir):
    # The whole inference of lineitem read back as CSV text.
    folder = scratch_path(spark, "lineitem-csv")
    S.write_text_table(load(spark, sf_dir, "lineitem"), folder, n_files=8,
                       file_bytes=S.FILE_BYTES)
    res = A.infer_schema(S.read_text_table(spark, folder))
    return res.profile.select("pos", F.col("column").alias("name"), "type", "confidence",
                              "ambiguous")


@register("list_databases",
          "SELECT DISTINCT replace(lower(trim(r_name)), ' ', '_') AS database FROM region WHERE r_regionkey % 2 = 0")
def list_databases(spark, sf_dir):
    # T2 after T1 and T3: a database per region, those of odd keys dropped again.
    suffix = "_" + scratch_path(spark, "db").rsplit("-", 1)[-1]
    rows = load(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    for r in rows:
        T.create_database(spark, r["r_name"] + suffix)
    for r in rows:
        if r["r_regionkey"] % 2:
            T.drop_database(spark, r["r_name"] + suffix)
    dbs = T.list_databases(spark)
    name = F.col(dbs.columns[0])
    return dbs.filter(name.endswith(suffix)).select(
        F.substring_index(name, suffix, 1).alias("database"))


# I1 + R7: events with spoiled values landed as CSV; the ingest votes their
# types (exclusive), writes the typed table and reports what did not fit -
# the same rejects as declaring the events' schema by hand.
@register("ingest_rejects_events", REJECTS_EVENTS_SQL)
def ingest_rejects_events(spark, sf_dir):
    folder = scratch_path(spark, "events-landing")
    S.write_text_table(spoiled_events(load(spark, sf_dir, "events")), folder, n_files=4)
    run = ingest(spark, folder, scratch_path(spark, "lake"), database="lake_events",
                 table="events " + folder.rsplit("-", 1)[-1], report_rejects=True)
    if not run.success or "rejects" not in run.locations:
        raise RuntimeError(f"ingest failed: {run.errors or run.next}")
    return spark.read.parquet(run.locations["rejects"])
