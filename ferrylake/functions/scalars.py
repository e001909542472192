"""Scalar column functions.

All are native expressions (no Python UDF); each maps a Column to a Column
and runs inside whole-stage codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.predicates import strip_ws

# ---------------------------------------------------------------------------
# These must equal the reference's for equal results.
# ---------------------------------------------------------------------------
IDENTIFIER_MAX_LEN = 120
VALID_CHOICES = ("int", "float", "string", "bool", "timestamp")
CHOICE_ALIASES = {"boolean": "bool", "double": "float", "integer": "int"}
CATALOG_TYPE_GROUPS = [
    ("int", ("int", "integer", "tinyint", "smallint")),
    ("bigint", ("bigint", "long")),
    ("float", ("float",)),
    ("double", ("double", "real")),
    ("boolean", ("boolean", "bool")),
    ("timestamp", ("timestamp", "ts", "datetime", "date")),
]
CATALOG_DEFAULT = "string"
PARQUET_PREFIX = "processed/"
# what a slug replaces, in order (F1): (pattern, replacement)
SLUG_STEPS = ((r"[ \-]+", "_"), (r"[^a-z0-9_]", ""), (r"^_+", ""))
# ---------------------------------------------------------------------------


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def slugify(name, prefix: str = "obj") -> Column:
    """a catalog-safe identifier.

    strip, lower; runs of blanks/hyphens -> ``_``; keep ``[a-z0-9_]``; no
    leading ``_``; at most 120 characters. An empty result becomes
    ``<prefix>_<8 hex>``; the hex digits come from ``md5(name)`` so a re-run
    gives the same name.
    """
    n = _col(name)
    s = F.lower(strip_ws(n))
    for pattern, new in SLUG_STEPS:
        s = F.regexp_replace(s, pattern, new)
    fallback = F.concat(F.lit(f"{prefix}_"),
                        F.substring(F.md5(F.coalesce(n, F.lit(""))), 1, 8))
    return (F.when(n.isNull() | (n == "") | (s == ""), fallback)
            .otherwise(F.substring(s, 1, IDENTIFIER_MAX_LEN)))


def map_column_type(t) -> Column:
    """a declared or inferred type name -> catalog type (default string)."""
    tt = F.lower(strip_ws(_col(t)))
    out = None
    for target, names in CATALOG_TYPE_GROUPS:
        cond = tt.isin(*names)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return F.when(_col(t).isNull(), F.lit(CATALOG_DEFAULT)).otherwise(
        out.otherwise(F.lit(CATALOG_DEFAULT)))


def normalize_type(t) -> Column:
    """Strip, lower, aliases (boolean->bool, double->float, integer->int);
    other names pass through unchanged; null -> string."""
    tt = F.lower(strip_ws(_col(t)))
    out = tt
    for alias, target in reversed(list(CHOICE_ALIASES.items())):
        out = F.when(tt == F.lit(alias), F.lit(target)).otherwise(out)
    return F.coalesce(out, F.lit("string"))


def is_valid_choice(t) -> Column:
    return normalize_type(t).isin(*VALID_CHOICES)


def _join_key(prefix, rel: Column) -> Column:
    """``os.path.join(prefix, rel)`` for a literal or column prefix."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (F.when(p == "", rel)
            .when(p.endswith("/"), F.concat(p, rel))
            .otherwise(F.concat(p, F.lit("/"), rel)))


def dest_key(path, root, prefix) -> Column:
    """``path`` relative to ``root``, put under ``prefix``, ``\\`` -> ``/``."""
    p = _col(path)
    r = F.lit(root) if isinstance(root, str) else root
    r_slash = F.when(r.endswith("/"), r).otherwise(F.concat(r, F.lit("/")))
    rel = F.when(p.startswith(r_slash), p.substr(F.length(r_slash) + 1, F.lit(1 << 30))).otherwise(p)
    return F.replace(_join_key(prefix, rel), F.lit("\\"), F.lit("/"))


def has_suffix(key, suffix: str = ".csv") -> Column:
    """case-blind suffix test."""
    return F.lower(_col(key)).endswith(suffix.lower())


def first_csv(inventory: DataFrame, by: Sequence[str] = ("container",)) -> DataFrame:
    """first CSV key per container (key order; the reference takes its
    directory-walk order)."""
    return (inventory.filter(has_suffix("key"))
            .groupBy(*by).agg(F.min("key").alias("first_csv")))


def parquet_key(key, prefix: str = PARQUET_PREFIX) -> Column:
    """base name with its extension replaced by ``.parquet``, under
    ``prefix`` (``os.path.splitext`` rules: a leading dot starts no extension)."""
    base = F.substring_index(_col(key), "/", -1)
    stem = F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.replace(_join_key(prefix, F.concat(stem, F.lit(".parquet"))),
                     F.lit("\\"), F.lit("/"))


def schema_text(rows: DataFrame, by: Sequence[str] = (), pos: str = "pos",
                name: str = "name", type_: str = "type") -> DataFrame:
    """F8: ``Name=Type`` per line, in column order (inverse of F3).

    The group is one table's columns, bounded by its width."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                             F.concat(F.col(name), F.lit("="), F.col(type_)).alias("l")))),
        lambda x: x["l"])
    return rows.groupBy(*by).agg(F.array_join(lines, "\n").alias("schema_text"))


def to_json_row(*cols) -> Column:
    """a result row as JSON text; nulls are written, not dropped."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def json_args(col) -> Column:
    """JSON object text -> map<string,string>; broken text (also single-quoted
    names or anything after the object) -> empty map."""
    none = F.create_map().cast("map<string,string>")
    # inside an array, the parser meets what follows the object and refuses it
    whole = F.from_json(F.concat(F.lit("["), _col(col), F.lit("]")), "array<map<string,string>>",
                        {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.coalesce(F.when((F.size(whole) == 1) & F.ltrim(_col(col)).startswith("{")
                             & F.rtrim(_col(col)).endswith("}"),
                             F.get(whole, 0)), none)
