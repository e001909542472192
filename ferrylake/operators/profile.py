"""Type profile of a text table.

Plan shape (``type_counts``), the same at every size:

    scan (only the profiled columns) -> cast to text -> unpivot (inline
    generator, no shuffle) -> classify each value -> partial sum per column ->
    one tiny shuffle of #columns rows per map task.

No value crosses the network, so neither a hot value nor a near-unique column
matters. ``pre_group=True`` is an explicit choice for wide tables of few
distinct values: it counts equal values first, inside each map task and then
over a shuffle of distinct values, and classifies each distinct value once;
columns in ``direct`` are left out of that. ``partitions=n`` deals the rows of
an input with too few splits (one small file, one row group) over n tasks; it is
never implied. The counts are exact whatever is chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrylake.functions import predicates as P

AMBIGUITY_THRESHOLD = 0.20  # fixed value: "more than 20%" (strictly greater)
COUNT_COLS = [f"n_{t}" for t in P.TYPE_ORDER]
SHARE_COLS = [f"p_{t}" for t in P.TYPE_ORDER]


def text_columns(df: DataFrame) -> list[str]:
    """All columns; an error if one has no text form (nested or binary): name the
    columns to profile instead, so that none is left out unseen."""
    skip = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, skip)]
    if nested:
        raise ValueError(f"columns without a text form: {', '.join(nested)}; "
                         "pass columns= to choose the others")
    return df.columns


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every (chosen) column cast to string: the table as the CSV reader sees it."""
    cols = list(columns) if columns is not None else text_columns(df)
    # one selectExpr: a single call to the JVM for any number of columns
    return df.selectExpr(*[f"CAST({_ident(c)} AS STRING) AS {_ident(c)}" for c in cols])


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dealt(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt round-robin over ``partitions`` tasks, if the caller says so."""
    return df.repartition(partitions) if partitions and not df.isStreaming else df


def _unpivot(text: DataFrame, cols: Sequence[str], table: str | None = None) -> DataFrame:
    """(table?, column, value) rows; a generator over one array per row (no shuffle).

    ``inline`` rather than ``unpivot``: Spark's code generation fails on
    ``Expand`` followed by the classifier's shared subexpressions and falls
    back to interpreted evaluation."""
    label = f"{_sql_str(table)} AS `table`, " if table is not None else ""
    pairs = ", ".join(f"struct({label}{_sql_str(c)} AS `column`, {_ident(c)} AS `value`)"
                      for c in cols)
    return text.selectExpr(f"inline(array({pairs}))")


def _counts(long: DataFrame, weight: Column, mode: str, keys: Sequence[str]) -> DataFrame:
    v = F.col("value")
    if mode == "overlap":
        flags = {
            "blank": P.is_blank(v),
            "int": P.is_int(v),
            "float": P.is_float(v),
            "bool": P.is_bool(v),
            "timestamp": P.is_timestamp(v),
        }
        flags["string"] = ~flags["timestamp"]
        classified = long.select(
            *keys, weight.alias("w"),
            *[f.alias(f"f_{k}") for k, f in flags.items()])
        aggs = [F.sum(F.when(F.col(f"f_{k}"), F.col("w")).otherwise(F.lit(0)))
                .cast("bigint").alias(f"n_{k}") for k in flags]
    elif mode == "exclusive":
        classified = long.select(*keys, weight.alias("w"),
                                 P.narrowest_type(v).alias("t"))
        aggs = [F.sum(F.when(F.col("t").isNull(), F.col("w")).otherwise(F.lit(0)))
                .cast("bigint").alias("n_blank")]
        aggs += [F.sum(F.when(F.col("t") == F.lit(t), F.col("w")).otherwise(F.lit(0)))
                 .cast("bigint").alias(f"n_{t}") for t in P.TYPE_ORDER]
    else:
        raise ValueError(f"unknown profile mode {mode!r}")
    return classified.groupBy(*keys).agg(
        F.sum("w").cast("bigint").alias("total"), *aggs)


def _vote(longs_grouped: list[DataFrame], longs_direct: list[DataFrame], mode: str,
          pre_group: bool, keys: Sequence[str]) -> DataFrame:
    parts = []
    if longs_grouped:
        long = _union(longs_grouped)
        if pre_group:
            long = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_w"))
            parts.append(_counts(long, F.col("_w"), mode, keys))
        else:
            parts.append(_counts(long, F.lit(1).cast("bigint"), mode, keys))
    if longs_direct:
        parts.append(_counts(_union(longs_direct), F.lit(1).cast("bigint"), mode, keys))
    return _union(parts)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def type_counts(df: DataFrame, mode: str = "overlap", pre_group: bool = False,
                direct: Iterable[str] = (), columns: Sequence[str] | None = None,
                already_text: bool = False, partitions: int | None = None) -> DataFrame:
    """A1: per column ``(pos, column, total, n_blank, n_int, n_float, n_bool,
    n_timestamp, n_string)``.

    ``overlap`` (default) is the reference's vote: a value adds to every type
    it parses as, and string means "not a timestamp". ``exclusive`` gives each
    non-blank value only its narrowest type.
    """
    cols = list(columns) if columns is not None else text_columns(df)
    if not cols:
        raise ValueError("table has no columns to profile")
    # deal the typed columns (smaller than their text), then cast
    picked = dealt(df.select(*[F.col(f"`{c}`") for c in cols]), partitions)
    text = picked if already_text else as_text(picked, cols)
    direct = [c for c in direct if c in cols] if pre_group else []
    grouped = [c for c in cols if c not in direct]
    out = _vote([_unpivot(text, grouped)] if grouped else [],
                [_unpivot(text, direct)] if direct else [], mode, pre_group, ["column"])
    pos_map = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return out.select(
        pos_map[F.col("column")].alias("pos"), "column", "total", "n_blank",
        *COUNT_COLS)


def type_counts_tables(tables: dict[str, DataFrame], mode: str = "overlap",
                       pre_group: bool = False,
                       direct: dict[str, Sequence[str]] | None = None,
                       columns: dict[str, Sequence[str]] | None = None,
                       partitions: int | None = None) -> DataFrame:
    """A1 over many tables in one plan: ``(table, pos, column, ...counts)``.

    All tables' values flow through the same aggregations (one tiny shuffle of
    counts, with ``pre_group`` also one of distinct values) instead of one
    chain of stages per table."""
    direct = {t: list(v) for t, v in (direct or {}).items()}
    columns = columns or {}
    grouped, straight, pos_entries = [], [], []
    for name, df in tables.items():
        cols = list(columns.get(name) or text_columns(df))
        text = as_text(dealt(df.select(*[F.col(f"`{c}`") for c in cols]), partitions), cols)
        d = [c for c in direct.get(name, ()) if c in cols] if pre_group else []
        g = [c for c in cols if c not in d]
        if g:
            grouped.append(_unpivot(text, g, name))
        if d:
            straight.append(_unpivot(text, d, name))
        pos_entries += [(name, c, i) for i, c in enumerate(cols)]
    out = _vote(grouped, straight, mode, pre_group, ["table", "column"])
    pos_map = F.create_map(*[x for t, c, i in pos_entries
                             for x in (F.lit(f"{t}\u0000{c}"), F.lit(i))])
    key = F.concat(F.col("table"), F.lit("\u0000"), F.col("column"))
    return out.select("table", pos_map[key].alias("pos"), "column", "total", "n_blank",
                      *COUNT_COLS)


def type_shares(counts: DataFrame, mode: str = "overlap") -> DataFrame:
    """A2: share of each type; 0 when there is nothing to divide by.

    ``overlap`` divides by all values; ``exclusive`` by the non-blank ones.
    """
    base = F.col("total") if mode == "overlap" else F.col("total") - F.col("n_blank")
    shares = [F.when(base > 0, F.col(f"n_{t}") / base).otherwise(F.lit(0.0))
              .alias(f"p_{t}") for t in P.TYPE_ORDER]
    return counts.select("*", *shares)


def best_type(shares: DataFrame) -> DataFrame:
    """A3: arg-max share, ties to the first of int, float, bool, timestamp, string."""
    top = F.greatest(*[F.col(c) for c in SHARE_COLS])
    pick = F.when(F.col("p_int") == top, F.lit("int"))
    for t in P.TYPE_ORDER[1:]:
        pick = pick.when(F.col(f"p_{t}") == top, F.lit(t))
    return shares.select("*", pick.alias("type"), top.alias("confidence"))


def ambiguity(best: DataFrame, threshold: float = AMBIGUITY_THRESHOLD) -> DataFrame:
    """A4: more than one type with a share strictly above ``threshold``; the
    reason text lists them the way the reference prints a Python list."""
    th = F.lit(float(threshold))
    high = [F.when(F.col(f"p_{t}") > th, F.lit(f"'{t}'")) for t in P.TYPE_ORDER]
    # fixed value: the text before the list is part of the compared output
    n_high = sum((F.when(F.col(f"p_{t}") > th, 1).otherwise(0) for t in P.TYPE_ORDER),
                 F.lit(0))
    amb = n_high > 1
    reason = F.when(amb, F.concat(F.lit("Column contains mixed types: ["),
                                  F.concat_ws(", ", *high), F.lit("]")))
    return best.select("*", amb.alias("ambiguous"), reason.alias("reason"))


def profile(df: DataFrame, mode: str = "overlap", threshold: float = AMBIGUITY_THRESHOLD,
            **count_kwargs) -> DataFrame:
    """A1-A4 in one lazy plan: one row per column."""
    counts = type_counts(df, mode=mode, **count_kwargs)
    return ambiguity(best_type(type_shares(counts, mode)), threshold)


def profile_tables(tables: dict[str, DataFrame], mode: str = "overlap",
                   threshold: float = AMBIGUITY_THRESHOLD, **count_kwargs) -> DataFrame:
    """A1-A4 for many tables in one plan: one row per (table, column)."""
    counts = type_counts_tables(tables, mode=mode, **count_kwargs)
    return ambiguity(best_type(type_shares(counts, mode)), threshold)


def ambiguous_columns(prof: DataFrame) -> DataFrame:
    """The open columns, in column order."""
    return prof.filter(F.col("ambiguous")).orderBy("pos")


def needs_help(prof: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: does any column need a choice (per group ``by``)."""
    agg = F.coalesce(F.bool_or("ambiguous"), F.lit(False)).alias("needs_help")
    return prof.groupBy(*by).agg(agg, F.count(F.lit(1)).alias("n_columns"),
                                 F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"))


def describe_shares(prof: DataFrame) -> Column:
    """``"float:60%, string:40%, ..."`` by falling share, ties in type order;
    percent rounded half-to-even like Python's ``format(x, '.0f')``."""
    entries = F.array(*[
        F.struct((-F.col(f"p_{t}")).alias("k"), F.lit(i).alias("i"),
                 F.lit(t).alias("t"), F.col(f"p_{t}").alias("p"))
        for i, t in enumerate(P.TYPE_ORDER)])
    text = F.transform(F.array_sort(entries), lambda e: F.concat(
        e["t"], F.lit(":"),
        F.bround(e["p"] * 100, 0).cast("bigint").cast("string"), F.lit("%")))
    return F.array_join(text, ", ")


@dataclass
class InferResult:
    """A6 outcome: the profile (small, one row per column) and its summary."""
    profile: DataFrame
    columns: list[dict] = field(default_factory=list)
    ambiguous: list[dict] = field(default_factory=list)
    needs_user_help: bool = False


def infer_schema(df: DataFrame, mode: str = "overlap",
                 threshold: float = AMBIGUITY_THRESHOLD, sample: int | None = None,
                 order_by: Sequence[str] | None = None, **count_kwargs) -> InferResult:
    """Profile a text table; error when it has no header or no data rows.

    ``sample`` keeps the first ``sample`` rows by ``order_by`` (S2); the
    default profiles the whole table.
    """
    if not df.columns:
        raise ValueError("the table has no columns: is there a header row?")
    if sample is not None:
        from ferrylake.sources.text import sample_rows
        df = sample_rows(df, sample, order_by)
    prof = profile(df, mode=mode, threshold=threshold, **count_kwargs)
    # One action; the result has one row per column, never per data row.
    rows = prof.orderBy("pos").collect()
    if not rows or rows[0]["total"] == 0:
        raise ValueError("the table has a header but no rows")
    spark = df.sparkSession
    small = spark.createDataFrame(rows, prof.schema)
    cols = [{"Name": r["column"], "Type": r["type"], "Confidence": r["confidence"]}
            for r in rows]
    amb = [{"column": r["column"],
            "detected_types": {t: r[f"p_{t}"] for t in P.TYPE_ORDER},
            "reason": r["reason"]} for r in rows if r["ambiguous"]]
    return InferResult(small, cols, amb, bool(amb))
