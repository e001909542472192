"""schema texts -> rows ``(pos, name, type)``.

Accepted forms (one text may hold many columns):

* ``Index=int\\nPrice=float`` - one column per line, ``name=type``;
* ``Name string\\nPrice float`` - ``name type`` (more words are ignored);
* ``Index=int, Price=float`` - comma-separated, only when the text has no
  ``\\n``;
* a lone name gets type ``string``; blank lines and blank parts are skipped.

A part with ``=`` splits at its first ``=`` and keeps the whole right side
(``a=int not null`` -> type ``int not null``); otherwise the first two words.
Lines break where Python's ``str.splitlines`` breaks them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.functions.predicates import STRIP_WS, strip_ws

LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def schema_parts(text: Column) -> Column:
    """The non-blank, stripped parts of a schema text, in order."""
    comma_form = text.contains(",") & ~text.contains("\n")
    parts = F.when(comma_form, F.split(text, ",")).otherwise(F.split(text, LINE_BREAKS))
    return F.filter(F.transform(parts, strip_ws), lambda p: p != "")


def part_name(part: Column) -> Column:
    words = F.split(part, f"{STRIP_WS}+")
    return F.when(part.contains("="), strip_ws(F.substring_index(part, "=", 1))) \
        .otherwise(F.get(words, 0))


def part_type(part: Column) -> Column:
    words = F.split(part, f"{STRIP_WS}+")
    after_eq = part.substr(F.instr(part, "=") + 1, F.lit(1 << 30))
    return (F.when(part.contains("="), strip_ws(after_eq))
            .when(F.size(words) >= 2, F.get(words, 1))
            .otherwise(F.lit("string")))


def parse_schema_texts(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*keep, pos, name, type)``, one per declared column.

    Each text is exploded on its own row, so any number of texts is parsed in
    parallel with no shuffle."""
    exploded = df.select(*keep, F.posexplode(schema_parts(F.col(text_col))).alias("pos", "part"))
    part = F.col("part")
    return exploded.select(*keep, F.col("pos").cast("int").alias("pos"),
                           part_name(part).alias("name"), part_type(part).alias("type"))
