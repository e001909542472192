"""Fill-in-the-middle: texts cut in three and put in another order.

``regexp_count`` gives a text's number of units n. The two cuts a <= b come from a
hash of the id, and one match of a pattern made for the row, possessive groups
``unit{a}`` and ``unit{b-a}`` and the rest, catches prefix, middle and suffix; its
replacement text is the output, so nothing is cut out piece by piece. Possessive
counted groups never go back and are walked in a loop, so long texts need no stack.

All is a projection: no shuffle, no Python. A unit is a code point by default; any
pattern whose matches, taken left to right, cover a text from its start can be one
(words with the blanks behind them); what the last unit leaves belongs to the suffix.

Cases: null text is empty text, which stays plain; a text that holds one of the marks
stays plain; a null id hashes as the empty string; repeated rows have equal ids, so
equal outputs; cuts may coincide (empty prefix, middle or suffix); very long texts
are matched whole; an empty table gives an empty result; further columns stay, except
that the operator's own names replace equal ones.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "(?s:.)"


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle."""
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        # pieces hold no mark; a mark could still begin in a piece and end in the mark
        # behind it, or the other way round, if one's end were another's beginning
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("marks must be three different strings")
        for a, b in itertools.product(marks, marks):
            if (a != b and a in b) or any(b.startswith(a[-k:]) for k in range(1, len(a))):
                raise ValueError(f"the end of {a!r} must not begin or be in {b!r}")

    def any(self) -> str:
        return "|".join(map(re.escape, (self.prefix, self.suffix, self.middle)))


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a whole number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _replacement(text: str) -> str:
    """A string that a replacement text gives back as it is."""
    return re.sub(r"([\\$])", r"\\\1", text)


def transform(docs: DataFrame, marks: Marks = Marks(), unit: str = CODE_POINT, seed: int = 1,
              fim_percent: int = 90, spm_percent: int = 20, id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (code points, null if plain) and ``output``.

    Of 100 documents about ``fim_percent`` change their order, and of those
    ``spm_percent`` to suffix, prefix, middle, the others to prefix, suffix, middle."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    # steps of their own: each column below is read more than once by the next
    d = docs.withColumn("_fim_text", t).withColumn(
        "_fim_hash", F.sha2(F.concat(F.lit(f"{seed}:"), name), 256))
    d = d.withColumn("n", F.regexp_count("_fim_text", F.lit(unit)).cast("long"))
    h = [_number(F.col("_fim_hash"), k) for k in range(4)]
    cuts = [h[k] % (F.col("n") + 1) for k in range(2)]
    d = d.withColumns({
        "_fim_a": F.least(*cuts), "_fim_b": F.greatest(*cuts),
        "form": F.when((F.col("_fim_text") == "") | F.col("_fim_text").rlike(marks.any())
                       | (h[2] % 100 >= fim_percent), "plain")
        .when(h[3] % 100 < spm_percent, "spm").otherwise("psm")})
    pattern = F.format_string(r"\A((?:%s){%%d}+)((?:%s){%%d}+)((?s:.)*+)\z"
                              % ((unit.replace("%", "%%"),) * 2),
                              F.col("_fim_a"), F.col("_fim_b") - F.col("_fim_a"))
    p, s, m = map(_replacement, (marks.prefix, marks.suffix, marks.middle))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    d = d.withColumn("output", F.when(F.col("form") == "plain", F.col("_fim_text")).otherwise(
        F.regexp_replace(F.col("_fim_text"), pattern, order)))
    if unit == CODE_POINT:
        sizes = F.col("_fim_a"), F.col("_fim_b") - F.col("_fim_a")
    else:
        after = F.when(F.col("form") == "psm", marks.suffix).otherwise(marks.middle)
        sizes = (_between(F.col("output"), F.lit(marks.prefix), after),
                 F.length("output") - F.instr("output", marks.middle) - len(marks.middle) + 1)
    shaped = F.col("form") != "plain"
    d = d.withColumns({"prefix_chars": F.when(shaped, sizes[0].cast("long")),
                       "middle_chars": F.when(shaped, sizes[1].cast("long"))})
    return d.drop("_fim_text", "_fim_hash", "_fim_a", "_fim_b")


def _between(text: Column, start: Column, stop: Column) -> Column:
    """Number of code points between two marks."""
    at, to = (F.call_function("instr", text, mark) for mark in (start, stop))
    return to - at - F.length(start)


def restore(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output of ``transform`` came from."""
    p, s, m = map(re.escape, (marks.prefix, marks.suffix, marks.middle))
    psm = rf"\A{p}((?s:.)*?){s}((?s:.)*?){m}((?s:.)*+)\z"
    spm = rf"\A{s}((?s:.)*?){p}((?s:.)*?){m}((?s:.)*+)\z"
    return (F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, spm, "$2$3$1"))
            .otherwise(output))
