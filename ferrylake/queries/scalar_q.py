"""Scalar-function queries: F1-F6, F8-F10, R3 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrylake.functions import predicates as P
from ferrylake.functions import scalars as S
from ferrylake.functions.schema_text import LINE_BREAKS, parse_schema_texts
from ferrylake.queries import register
from ferrylake.queries.sqlgen import map_type_sql, normalize_type_sql, q, strip_sql
from ferrylake.queries.profile_q import _all_profiles, _all_profiles_sql
from ferrylake.tables import load

# ---------------------------------------------------------------- F1 slugify


def _slug_sql(x: str, prefix: str) -> str:
    s = f"lower({strip_sql(x)})"
    s = f"regexp_replace({s}, '[ \\-]+', '_', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9_]', '', 'g')"
    s = f"regexp_replace({s}, '^_+', '')"
    return (f"CASE WHEN {x} IS NULL OR {x} = '' OR {s} = '' THEN "
            f"'{prefix}_' || substring(md5(coalesce({x}, '')), 1, 8) "
            f"ELSE substring({s}, 1, {S.IDENTIFIER_MAX_LEN}) END")


@register("slugify_names",
          f"SELECT 'p_name' AS kind, p_partkey AS id, {_slug_sql('p_name', 'tbl')} AS slug FROM part "
          f"UNION ALL SELECT 'p_type', p_partkey, {_slug_sql('p_type', 'db')} FROM part "
          f"UNION ALL SELECT 'url', page_id, {_slug_sql('url', 'tbl')} FROM pages")
def slugify_names(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    pages = load(spark, sf_dir, "pages")
    return (part.select(F.lit("p_name").alias("kind"), F.col("p_partkey").alias("id"),
                        S.slugify("p_name", "tbl").alias("slug"))
            .unionByName(part.select(F.lit("p_type").alias("kind"), F.col("p_partkey").alias("id"),
                                     S.slugify("p_type", "db").alias("slug")))
            .unionByName(pages.select(F.lit("url").alias("kind"), F.col("page_id").alias("id"),
                                      S.slugify("url", "tbl").alias("slug"))))


# ------------------------------------------------- F3 schema texts from part
# One text per part row, in one of four forms chosen by p_partkey % 4: lines of
# name=type, comma form, name-type words with extras and blank lines, and a
# decimal declaration whose comma splits it.


def part_schema_texts(part):
    nl = F.lit("\n")
    k = F.col("p_partkey") % 4
    text = (F.when(k == 0, F.concat("p_name", F.lit("=int"), nl, "p_brand", F.lit(" float")))
            .when(k == 1, F.concat("p_brand", F.lit("="), "p_type", F.lit(", "), "p_name"))
            .when(k == 2, F.concat("p_name", F.lit(" "), "p_type", F.lit(" not null"), nl, nl,
                                   F.lit("  "), "p_brand"))
            .otherwise(F.concat("p_type", F.lit("=decimal("), F.col("p_size").cast("string"),
                                F.lit(",2)"))))
    return part.select(F.col("p_partkey").alias("id"), text.alias("text"))


_TEXT_SQL = ("CASE p_partkey % 4 WHEN 0 THEN p_name || '=int' || chr(10) || p_brand || ' float' "
             "WHEN 1 THEN p_brand || '=' || p_type || ', ' || p_name "
             "WHEN 2 THEN p_name || ' ' || p_type || ' not null' || chr(10) || chr(10) || '  ' || p_brand "
             "ELSE p_type || '=decimal(' || CAST(p_size AS VARCHAR) || ',2)' END")


def parse_sql(texts: str, keep: str) -> str:
    ws = f"{P.STRIP_WS}+"
    words = f"regexp_split_to_array(part, '{ws}')"
    return (
        f"SELECT {keep}, CAST(pos AS INTEGER) AS pos, "
        f"CASE WHEN contains(part, '=') THEN {strip_sql('substring(part, 1, instr(part, chr(61)) - 1)')} "
        f"ELSE {words}[1] END AS name, "
        f"CASE WHEN contains(part, '=') THEN {strip_sql('substring(part, instr(part, chr(61)) + 1)')} "
        f"WHEN len({words}) >= 2 THEN {words}[2] ELSE 'string' END AS type "
        f"FROM (SELECT {keep}, unnest(ps) AS part, unnest(range(0, len(ps))) AS pos FROM ("
        f"SELECT {keep}, list_filter(list_transform(CASE WHEN contains(text, ',') AND NOT contains(text, chr(10)) "
        f"THEN string_split(text, ',') ELSE regexp_split_to_array(text, '{LINE_BREAKS}') END, "
        f"lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps FROM ({texts}) AS t0) AS t1) AS t2")


_PARSE_PART_SQL = parse_sql(f"SELECT p_partkey AS id, {_TEXT_SQL} AS text FROM part", "id")


@register("parse_schema_texts", _PARSE_PART_SQL)
def parse_schema_texts_q(spark, sf_dir):
    return parse_schema_texts(part_schema_texts(load(spark, sf_dir, "part")), "text", ["id"])


@register("map_types",
          f"SELECT id, pos, type, {map_type_sql('type')} AS catalog_type, "
          f"{normalize_type_sql('type')} AS normalized FROM ({_PARSE_PART_SQL}) AS x")
def map_types(spark, sf_dir):
    parsed = parse_schema_texts(part_schema_texts(load(spark, sf_dir, "part")), "text", ["id"])
    return parsed.select("id", "pos", "type", S.map_column_type("type").alias("catalog_type"),
                         S.normalize_type("type").alias("normalized"))


@register("schema_text_roundtrip",
          f"SELECT {q('table')}, pos, {q('column')} AS name, type FROM ({_all_profiles_sql()}) AS a")
def schema_text_roundtrip(spark, sf_dir):
    # F8 then F3: the settled schema of every table written as text and parsed back.
    settled = _all_profiles(spark, sf_dir).select(
        "table", "pos", F.col("column").alias("name"), "type")
    texts = S.schema_text(settled, by=["table"])
    return parse_schema_texts(texts, "schema_text", ["table"])


# ------------------------------------------------ F4-F6 on pages as objects
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
URL_KEY = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?(.*)$"


def page_objects(pages):
    """pages as objects: container = host, key = the rest of the url,
    size = bytes of the html."""
    return pages.select(
        F.regexp_extract("url", URL_HOST, 1).alias("container"),
        F.regexp_extract("url", URL_KEY, 1).alias("key"),
        F.octet_length("html").cast("bigint").alias("size"), "page_id", "url")


PAGE_OBJECTS_SQL = (f"(SELECT regexp_extract(url, '{URL_HOST}', 1) AS container, "
                    f"regexp_extract(url, '{URL_KEY}', 1) AS key, "
                    f"CAST(strlen(html) AS BIGINT) AS size, page_id FROM pages)")


def _dest_sql(path: str, root: str, prefix: str) -> str:
    rel = (f"CASE WHEN starts_with({path}, '{root}/') THEN substring({path}, {len(root) + 2}) "
           f"ELSE {path} END")
    joined = (f"'{prefix}' || {rel}" if prefix.endswith("/") or prefix == ""
              else f"'{prefix}/' || {rel}")
    return f"replace({joined}, '\\', '/')"


@register("dest_keys",
          f"SELECT container, key, {_dest_sql(chr(39) + '/landing/' + chr(39) + ' || container || ' + chr(39) + '/' + chr(39) + ' || key', '/landing', 'raw/')} AS dest "
          f"FROM {PAGE_OBJECTS_SQL} AS o")
def dest_keys(spark, sf_dir):
    o = page_objects(load(spark, sf_dir, "pages"))
    path = F.concat(F.lit("/landing/"), "container", F.lit("/"), "key")
    return o.select("container", "key", S.dest_key(path, "/landing", "raw/").alias("dest"))


@register("suffix_keys",
          "SELECT container, CAST(count(*) AS BIGINT) AS n_keys, "
          "CAST(count(*) FILTER (WHERE lower(key) LIKE '%.html') AS BIGINT) AS n_html, "
          "min(key) FILTER (WHERE lower(key) LIKE '%.html') AS first_html "
          f"FROM {PAGE_OBJECTS_SQL} AS o GROUP BY container")
def suffix_keys(spark, sf_dir):
    o = page_objects(load(spark, sf_dir, "pages"))
    html = S.has_suffix("key", ".HTML")
    return o.groupBy("container").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(html).alias("n_html"),
        F.min(F.when(html, F.col("key"))).alias("first_html"))


@register("parquet_keys",
          "SELECT container, key, 'processed/' || regexp_replace(regexp_extract(key, '([^/]*)$', 1), "
          "'^(\\.*[^.].*)\\.[^.]*$', '\\1') || '.parquet' AS parquet_key "
          f"FROM {PAGE_OBJECTS_SQL} AS o")
def parquet_keys(spark, sf_dir):
    o = page_objects(load(spark, sf_dir, "pages"))
    return o.select("container", "key", S.parquet_key("key").alias("parquet_key"))


# ------------------------------------------------------ F9/F10 on events.props
@register("json_props",
          "SELECT event_id, k, n_keys, '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"k\":' || "
          "CASE WHEN k IS NULL THEN 'null' ELSE CAST(to_json(k) AS VARCHAR) END || '}' AS args_json FROM ("
          "SELECT event_id, json_extract_string(CASE WHEN ok THEN TRY_CAST(p AS JSON) END, '$.k') AS k, "
          "CAST(coalesce(len(json_keys(CASE WHEN ok THEN TRY_CAST(p AS JSON) END)), 0) AS INTEGER) AS n_keys FROM ("
          "SELECT event_id, p, coalesce(json_type(TRY_CAST(p AS JSON)) = 'OBJECT', false) AS ok FROM ("
          "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substring(props, 1, length(props) - 1) "
          "WHEN event_id % 7 = 1 THEN replace(props, '\"', chr(39)) "
          "WHEN event_id % 7 = 2 THEN props || ' trailing' "
          "ELSE props END AS p FROM events) AS e0) AS e1) AS e2")
def json_props(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    kind = F.col("event_id") % 7              # cut short, single quotes, text after the object
    p = F.when(kind == 0, F.expr("substring(props, 1, length(props) - 1)")) \
        .when(kind == 1, F.replace("props", F.lit('"'), F.lit("'"))) \
        .when(kind == 2, F.concat("props", F.lit(" trailing"))).otherwise(F.col("props"))
    m = S.json_args(p)
    out = ev.select("event_id", m.alias("m")).select(
        "event_id", F.col("m")["k"].alias("k"), F.size("m").alias("n_keys"))
    return out.select("event_id", "k", "n_keys",
                      S.to_json_row(F.col("event_id"), F.col("k")).alias("args_json"))
