"""Builders for the oracle SQL text (DuckDB dialect)."""

from __future__ import annotations

from typing import Sequence

from ferrylake.functions import predicates as P
from ferrylake.operators.profile import AMBIGUITY_THRESHOLD
from ferrylake.tables import TEXT_COLUMNS


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def long_sql(table: str, cols: Sequence[str] | None = None,
             exprs: dict[str, str] | None = None) -> str:
    """Unpivot ``table`` to ``(pos, column, value)`` with every value as text."""
    cols = list(cols) if cols is not None else TEXT_COLUMNS[table]
    exprs = exprs or {}
    parts = [
        f"SELECT {i} AS pos, {lit(c)} AS {q('column')}, "
        f"CAST({exprs.get(c, q(c))} AS VARCHAR) AS value FROM {table}"
        for i, c in enumerate(cols)]
    return "\nUNION ALL ".join(parts)


def counts_sql(long: str, mode: str = "overlap") -> str:
    v = "value"
    if mode == "overlap":
        f = P.sql_flags(v)
        cases = {k: f[k] for k in ["blank", *P.TYPE_ORDER]}
        sums = ", ".join(
            f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n_{k}"
            for k, cond in cases.items())
        return (f"SELECT pos, {q('column')}, CAST(count(*) AS BIGINT) AS total, {sums} "
                f"FROM ({long}) AS l GROUP BY pos, {q('column')}")
    blank = P.sql_match(v, "blank")
    a = P.sql_ascii_digits(v)
    narrow = (f"CASE WHEN {v} IS NULL OR {blank} THEN NULL "
              f"WHEN {P.sql_match(a, 'int')} THEN 'int' "
              f"WHEN {P.sql_match(a, 'float')} THEN 'float' "
              f"WHEN {P.sql_match(v, 'bool')} THEN 'bool' "
              f"WHEN {P.sql_match(v, 'timestamp_shape')} AND {P.sql_match(a, 'timestamp')} "
              f"THEN 'timestamp' ELSE 'string' END")
    sums = [f"CAST(sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_blank"]
    sums += [f"CAST(sum(CASE WHEN t = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}"
             for t in P.TYPE_ORDER]
    return (f"SELECT pos, {q('column')}, CAST(count(*) AS BIGINT) AS total, {', '.join(sums)} "
            f"FROM (SELECT pos, {q('column')}, {narrow} AS t FROM ({long}) AS l0) AS l "
            f"GROUP BY pos, {q('column')}")


def profile_sql(long: str, mode: str = "overlap",
                threshold: float = AMBIGUITY_THRESHOLD) -> str:
    """Counts, shares, best type, confidence, ambiguity and reason."""
    base = "total" if mode == "overlap" else "(total - n_blank)"
    shares = ", ".join(
        f"CASE WHEN {base} > 0 THEN n_{t} / {base} ELSE 0.0 END AS p_{t}"
        for t in P.TYPE_ORDER)
    top = "greatest(" + ", ".join(f"p_{t}" for t in P.TYPE_ORDER) + ")"
    pick = "CASE " + " ".join(f"WHEN p_{t} = {top} THEN '{t}'" for t in P.TYPE_ORDER) + " END"
    th = f"CAST({threshold!r} AS DOUBLE)"
    n_high = " + ".join(f"(CASE WHEN p_{t} > {th} THEN 1 ELSE 0 END)" for t in P.TYPE_ORDER)
    high = ", ".join(f"CASE WHEN p_{t} > {th} THEN '''{t}''' END" for t in P.TYPE_ORDER)
    return (
        f"SELECT *, ({n_high}) > 1 AS ambiguous, "
        f"CASE WHEN ({n_high}) > 1 THEN 'Column contains mixed types: [' || "
        f"concat_ws(', ', {high}) || ']' END AS reason FROM ("
        f"SELECT *, {pick} AS type, {top} AS confidence FROM ("
        f"SELECT *, {shares} FROM ({counts_sql(long, mode)}) AS c) AS s) AS b")


def describe_sql(prof_alias: str = "b") -> str:
    """F7 in SQL: list of 'type:NN%' by falling share, ties in type order."""
    entries = ", ".join(
        f"{{'k': -p_{t}, 'i': {i}, 't': '{t}', 'p': p_{t}}}"
        for i, t in enumerate(P.TYPE_ORDER))
    return (f"array_to_string(list_transform(list_sort([{entries}]), "
            f"lambda e: e.t || ':' || CAST(CAST(round_even(e.p * 100, 0) AS BIGINT) AS VARCHAR) || '%'),"
            f" ', ')")


def strip_sql(x: str) -> str:
    """Python ``str.strip()`` in DuckDB."""
    return f"regexp_replace({x}, '^{P.STRIP_WS}+|{P.STRIP_WS}+$', '', 'g')"


def normalize_type_sql(x: str) -> str:
    from ferrylake.functions.scalars import CHOICE_ALIASES
    t = f"lower({strip_sql(x)})"
    cases = " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in CHOICE_ALIASES.items())
    return f"coalesce(CASE {cases} ELSE {t} END, 'string')"


def map_type_sql(x: str) -> str:
    from ferrylake.functions.scalars import CATALOG_DEFAULT, CATALOG_TYPE_GROUPS
    t = f"lower({strip_sql(x)})"
    cases = " ".join(
        f"WHEN {t} IN ({', '.join(lit(n) for n in names)}) THEN '{target}'"
        for target, names in CATALOG_TYPE_GROUPS)
    return f"CASE WHEN {x} IS NULL THEN '{CATALOG_DEFAULT}' {cases} ELSE '{CATALOG_DEFAULT}' END"


def values_sql(rows, names) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(q(n) for n in names)}))"
