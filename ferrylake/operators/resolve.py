"""Settle disputed columns from a table of choices.

Profiles and choices both have one row per column of a table, so every join
here is between two inputs bounded by the table's width; AQE sees their
runtime size and broadcasts them itself.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import VALID_CHOICES, normalize_type

PLACEHOLDERS = ("", "INFERRED_SCHEMA", "INFERED_SCHEMA", "inferred_schema", "[]",
                "null", "None")  # fixed values: texts that mean "use the settled schema"


def open_columns(prof: DataFrame) -> DataFrame:
    """Columns awaiting a choice, in column order."""
    return prof.filter(F.col("ambiguous")).select("pos", "column").orderBy("pos")


def _valid_choices(choices: DataFrame) -> DataFrame:
    """One valid normalized choice per column: choices outside the five types are
    set aside first; of the others the last wins if there is a ``seq`` column,
    else the last type by name (``contradictions`` lists such columns)."""
    c = choices.select(F.col("column"), normalize_type(F.col("type")).alias("choice"),
                       *(["seq"] if "seq" in choices.columns else []))
    c = c.filter(F.col("choice").isin(*VALID_CHOICES))
    if "seq" in c.columns:
        return c.groupBy("column").agg(F.max_by("choice", "seq").alias("choice"))
    return c.groupBy("column").agg(F.max("choice").alias("choice"))


def contradictions(choices: DataFrame) -> DataFrame:
    """Columns with more than one valid type among their choices."""
    c = choices.select("column", normalize_type(F.col("type")).alias("choice")).filter(
        F.col("choice").isin(*VALID_CHOICES))
    return c.groupBy("column").agg(F.sort_array(F.collect_set("choice")).alias("types")).filter(
        F.size("types") > 1)


def invalid_choices(choices: DataFrame, names: DataFrame | Sequence[str] | None = None
                    ) -> DataFrame:
    """Choices that cannot be applied: a type outside the five, or (with the
    table's column names, or a profile that has them) a column it does not have."""
    c = choices.select("column", F.col("type"), normalize_type(F.col("type")).alias("choice"))
    bad_type = c.filter(~F.col("choice").isin(*VALID_CHOICES)).select(
        "column", "type", F.lit("unknown type").alias("problem"))
    if names is None:
        return bad_type
    known = c.filter(F.col("choice").isin(*VALID_CHOICES))
    known = known.join(names.select("column"), "column", "left_anti") \
        if isinstance(names, DataFrame) else known.filter(~F.col("column").isin(*names))
    unknown = known.select(
        "column", "type", F.lit("unknown column").alias("problem"))
    return bad_type.unionByName(unknown)


def resolve(prof: DataFrame, choices: DataFrame) -> DataFrame:
    """R2: a valid choice replaces the guessed type with confidence 1.0; the
    column is then no longer open."""
    valid = _valid_choices(choices)
    j = prof.join(valid, "column", "left")
    chosen = F.col("choice").isNotNull()
    cols = [c for c in prof.columns if c not in ("type", "confidence", "ambiguous")]
    return j.select(
        *cols,
        F.coalesce(F.col("choice"), F.col("type")).alias("type"),
        F.when(chosen, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("ambiguous") & ~chosen).alias("ambiguous"),
        chosen.alias("chosen"))


def open_after_choices(prof: DataFrame, choices: DataFrame) -> DataFrame:
    """Open columns that no valid choice settles (left anti join)."""
    valid = _valid_choices(choices)
    return open_columns(prof).join(valid.select("column"), "column", "left_anti") \
        .select("pos", "column")


def is_resolved(prof: DataFrame, choices: DataFrame) -> bool:
    """No open column is left."""
    return open_after_choices(prof, choices).isEmpty()


def settled_schema(resolved: DataFrame) -> DataFrame:
    """``(pos, name, type, confidence)`` rows of a resolved profile."""
    return resolved.select("pos", F.col("column").alias("name"), "type", "confidence")


def schema_or_resolved(columns, spark: SparkSession | None = None, store: str | None = None,
                       dataset: str | None = None) -> list[dict]:
    """An explicit column list, or - for an empty/placeholder argument - the
    settled schema from the store; an error if there is none."""
    placeholder = columns is None or (isinstance(columns, str) and columns in PLACEHOLDERS) \
        or (isinstance(columns, (list, tuple)) and len(columns) == 0)
    if not placeholder:
        if isinstance(columns, str):
            from ferrylake.functions.schema_text import parse_schema_texts
            if spark is None:
                raise ValueError("a schema text needs a session to parse")
            df = spark.createDataFrame([(columns,)], "text string")
            rows = parse_schema_texts(df, "text").orderBy("pos").collect()
            return [{"Name": r["name"], "Type": r["type"]} for r in rows]
        return [dict(c) for c in columns]
    if spark is None or store is None or dataset is None:
        raise ValueError("no settled schema is stored for this dataset: infer and settle it first")
    from ferrylake.sources.schema_store import load_schema
    rows = load_schema(spark, store, dataset).orderBy("pos").collect()
    if not rows:
        raise ValueError("no settled schema is stored for this dataset: infer and settle it first")
    return [{"Name": r["name"], "Type": r["type"], "Confidence": r["confidence"]} for r in rows]


def schema_pairs(schema) -> list[tuple[str, str]]:
    """(name, type) pairs from a list of dicts, pairs, or a small schema DataFrame."""
    if isinstance(schema, DataFrame):
        cols = schema.columns
        name = "name" if "name" in cols else "column"
        order = ["pos"] if "pos" in cols else []
        return [(r[name], r["type"]) for r in schema.orderBy(*order).collect()]
    out = []
    for c in schema:
        if isinstance(c, dict):
            out.append((c.get("Name") or c.get("name"), c.get("Type") or c.get("type") or "string"))
        else:
            out.append((c[0], c[1]))
    return out


def choices_frame(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "column string, type string")
