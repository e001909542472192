"""Read a text table with its settled types (R6) and list what does not fit.

Each cast is guarded by the matching predicate, so a cast is never looser
than the vote (``try_cast`` alone would take ``1d``, ``t`` or ``2024``) and
never stricter (``1_000`` and ``5-1-2024`` are parsed). Integers beyond
64 bits, which Python accepts, become rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions import predicates as P
from ferrylake.operators.resolve import schema_pairs

# Settled or declared type name -> Spark type of the typed table (wide types).
SPARK_TYPES = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "long": "bigint",
    "smallint": "bigint", "tinyint": "bigint",
    "float": "double", "double": "double", "real": "double",
    "bool": "boolean", "boolean": "boolean",
    "timestamp": "timestamp_ntz", "ts": "timestamp_ntz", "datetime": "timestamp_ntz",
    "date": "timestamp_ntz",
    "string": "string",
}


def spark_type(type_name: str | None) -> str:
    t = (type_name or "string").strip().lower()
    return SPARK_TYPES.get(t, "string")


def _empty(v: Column) -> Column:
    return v.isNull() | P.is_blank(v)


# Each cast is built in two projections: the first computes the stripped text,
# the guard and (for timestamps) the digit groups once per value; the second
# assembles the typed value from them. Spark keeps the two projections apart
# when a value is used more than once, so nothing is evaluated twice.

def _helpers(v: Column, st: str) -> dict[str, Column]:
    s = P.strip_ws(P.ascii_digits(v)) if st in ("bigint", "double") else P.strip_ws(v)
    if st == "bigint":
        return {"e": _empty(v), "ok": P._int_match(v),
                "s": F.replace(s, F.lit("_"), F.lit(""))}
    if st == "double":
        return {"e": _empty(v), "ok": P._int_match(v) | P._float_match(v),
                "s": F.lower(F.replace(s, F.lit("_"), F.lit("")))}
    if st == "boolean":
        return {"e": _empty(v), "s": F.lower(s)}
    if st == "timestamp_ntz":
        ok = P._ts_match(v)
        return {"e": _empty(v), "ok": ok, "mdy": s.contains("/"),
                "g": F.when(ok, F.regexp_extract_all(P.ascii_digits(s), F.lit(r"(\d+)"), 1))}
    return {}


def _typed(h: dict[str, Column], st: str, v: Column) -> Column:
    if st == "bigint":
        return F.when(h["e"], F.lit(None)).when(h["ok"], h["s"].try_cast("bigint"))
    if st == "double":
        num = F.when(h["s"].rlike(r"^[+-]?nan$"), F.lit(float("nan"))) \
            .otherwise(h["s"].try_cast("double"))
        return F.when(h["e"], F.lit(None).cast("double")).when(h["ok"], num)
    if st == "boolean":
        return F.when(h["s"].isin(*P.BOOL_WORDS), h["s"].isin("true", "yes", "1"))
    if st == "timestamp_ntz":
        g, mdy = h["g"], h["mdy"]
        first4 = F.length(F.get(g, 0)) == 4
        year = F.when(first4, F.get(g, 0)).otherwise(F.get(g, 2)).cast("int")
        month = F.when(mdy, F.get(g, 0)).otherwise(F.get(g, 1)).cast("int")
        day = F.when(mdy, F.get(g, 1)).when(first4, F.get(g, 2)).otherwise(F.get(g, 0)).cast("int")
        hour = F.coalesce(F.get(g, 3), F.lit("0")).cast("int")
        minute = F.coalesce(F.get(g, 4), F.lit("0")).cast("int")
        frac = F.rpad(F.coalesce(F.get(g, 6), F.lit("")), 6, "0")
        sec = F.concat(F.coalesce(F.get(g, 5), F.lit("0")), F.lit("."), frac).cast("decimal(16,6)")
        ts = F.make_timestamp_ntz(year, month, day, hour, minute, sec)
        return F.when(h["e"], F.lit(None).cast("timestamp_ntz")).when(h["ok"], ts)
    return v.cast("string")


def cast_text(v, type_name: str) -> Column:
    """A text column read as its settled type; blank -> null (one expression;
    ``apply_schema`` uses the two-projection form)."""
    col = F.col(v) if isinstance(v, str) else v
    st = spark_type(type_name)
    return _typed(_helpers(col, st), st, col)


def _typed_frame(df: DataFrame, types: dict[str, str], keep_text: bool) -> tuple[DataFrame, dict]:
    """``df`` plus, per typed column, its typed value ``__t<i>``."""
    helper_cols, refs = [], {}
    for i, c in enumerate(df.columns):
        if c not in types:
            continue
        st = spark_type(types[c])
        hs = _helpers(F.col(f"`{c}`"), st)
        names = {k: f"__h{i}_{k}" for k in hs}
        helper_cols += [e.alias(names[k]) for k, e in hs.items()]
        refs[c] = (st, {k: F.col(n) for k, n in names.items()}, i)
    staged = df.select("*", *helper_cols)
    typed = [_typed(h, st, F.col(f"`{c}`")).cast(st).alias(f"__t{i}")
             for c, (st, h, i) in refs.items()]
    out = staged.select(*[F.col(f"`{c}`") for c in df.columns], *typed)
    return out, {c: f"__t{i}" for c, (_, _, i) in refs.items()}


def apply_schema(df: DataFrame, schema) -> DataFrame:
    """The table with its settled types, in its own column order; columns
    the schema does not name stay text. A projection: nothing is shuffled."""
    types = dict(schema_pairs(schema))
    staged, typed = _typed_frame(df, types, keep_text=False)
    return staged.select([F.col(typed[c]).alias(c) if c in typed else F.col(f"`{c}`")
                          for c in df.columns])


def rejects(df: DataFrame, schema) -> DataFrame:
    """``(column, value, n)`` for each non-blank text value its column's
    type cannot hold (the reference's tables read them as null silently).

    Per row, the bad values go into one small array that is exploded; the
    count per (column, value) aggregates partially before the shuffle, so a
    hot bad value costs one row per map task."""
    types = dict(schema_pairs(schema))
    checked = [c for c in df.columns if c in types and spark_type(types[c]) != "string"]
    if not checked:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    staged, typed = _typed_frame(df.select(*[F.col(f"`{c}`") for c in checked]),
                                 {c: types[c] for c in checked}, keep_text=True)
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"),
                 (~_empty(F.col(f"`{c}`")) & F.col(typed[c]).isNull()).alias("bad"))
        for c in checked])
    bad = staged.select(F.explode(F.filter(items, lambda x: x["bad"])).alias("r"))
    return bad.groupBy(F.col("r.column").alias("column"), F.col("r.value").alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
