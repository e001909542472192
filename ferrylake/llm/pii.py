"""Personal data: patterns propose spans, checksums confirm them, words nearby
adjust the score.

Everything is a DataFrame expression on the text column; a document is handled
in its own row. Positions are code points. Java's matcher gives matches
(``regexp_extract_all``) and what stands between them (``split``); a span's
start is the summed length of all before it, in time linear in the text.

Cases: null text is empty text (no spans); repeated rows each get their result;
very long runs of digits or name characters take time linear in their length
(patterns start only where a run starts and never give back); an empty table
gives an empty result; other columns are ignored (``redacted`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import let, pick


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap test a text must pass for the pattern to be tried;
    ``valid`` confirms a match; ``score`` is its score alone and ``bonus`` what a
    word of ``near`` within the neighbouring characters adds. Kinds of the base
    contract are kept whatever their score, others from ``KEEP`` on.
    """

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    near: str
    score: float
    bonus: float
    base: bool = True


KEEP = 0.5
BEFORE, AFTER = 40, 20        # neighbouring characters looked at


def _yes(m: Column) -> Column:
    return F.lit(True)


def luhn(digits: Column) -> Column:
    """The Luhn check of a text of digits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    return let(F.regexp_replace(m, r"[\x20-]", ""),
               lambda d: F.length(d).between(12, 19) & luhn(d))


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


def mod97(code: Column) -> Column:
    """ISO 7064 mod 97-10 as IBANs use it: first four characters last, letters as
    10 to 35, remainder 1."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 65, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def _iban(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")),
               lambda c: F.length(c).between(15, 34) & mod97(c))


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGIT = "[0-9]"

# The base patterns are those of the contract. A run is entered only at its start
# (or where the last match ended) and taken whole: later starts in the same run
# would end at the same place and fail alike, so the matches are the same.
KINDS = [
    Kind("email",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), _yes,
         r"(?i)\b(?:e-?mail|mail|contact|write|reply)\b", 0.9, 0.1),
    Kind("ip",
         r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
         r"(?i)\b(?:ip|host|server|address|login)\b", 0.7, 0.2),
    Kind("card",
         r"[0-9](?:[\x20-]?[0-9])++",
         lambda t: t.rlike(_DIGIT), _card,
         r"(?i)\b(?:card|visa|credit|debit|payment|account)\b", 0.6, 0.3),
    Kind("phone",
         r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: t.contains("+"), _phone,
         r"(?i)\b(?:phone|tel|call|mobile|fax|ring)\b", 0.7, 0.2),
    Kind("iban",
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
         r"(?![A-Za-z0-9])",
         lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), _iban,
         r"(?i)\b(?:iban|bank|account|transfer)\b", 0.8, 0.2, base=False),
    Kind("local_phone",
         r"(?<![0-9+()-])\(?[0-9]{2,4}\)?[\x20-][0-9]{3}[\x20-][0-9]{4}(?![0-9-])",
         lambda t: t.rlike(r"[0-9]{3}[\x20-][0-9]{4}"), _phone,
         r"(?i)\b(?:phone|tel|call|mobile|fax|ring)\b", 0.3, 0.3, base=False),
    Kind("secret",
         r"(?<=(?i:token|password|passwd|secret|api.?key)[\x20\x22]{0,2}[=:][\x20\x22]{0,2})"
         r"[A-Za-z0-9_+/-]{12,}",
         lambda t: t.rlike(r"(?i)(?:token|password|passwd|secret|api.?key)[\x20\x22]{0,2}[=:]"),
         lambda m: m.rlike("[0-9]"),
         r"(?i)(?:token|password|passwd|secret|key)", 0.4, 0.4, base=False),
]
BASE = [k.name for k in KINDS if k.base]

_CHUNK = 256
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def running_sums(steps: Column) -> Column:
    """For each place the sum of all steps before it; chunk-wise, so that long
    arrays do not take quadratic time."""
    def chunks(s: Column) -> Column:
        n = F.floor((F.size(s) + _CHUNK - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1),
                           lambda c: _sum(F.slice(s, c * _CHUNK + 1, F.lit(_CHUNK))))

    def bases(s: Column) -> Column:
        return let(chunks(s), lambda sums: F.transform(
            sums, lambda _, c: _sum(F.slice(sums, F.lit(1), c))))

    def sums(s: Column) -> Column:
        return let(bases(s), lambda b: F.transform(s, lambda _, i: F.get(
            b, F.floor(i / _CHUNK).cast("int")) + _sum(F.slice(
                s, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))))

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(
        let(steps, sums))


def kind_spans(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind, with scores."""
    pattern = F.lit(kind.pattern)

    def spans(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(between, i)))
                            .cast("long"))

        def one(m: Column, i: Column, before: Column) -> Column:
            left, right = F.get(between, i), F.get(between, i + 1)
            start = before + F.length(left)
            near = (F.substring(left, -BEFORE, BEFORE).rlike(kind.near)
                    | F.substring(right, 1, AFTER).rlike(kind.near))
            score = F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0.0)
            return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"),
                            (start + F.length(m)).cast("long").alias("end"),
                            F.lit(kind.name).alias("kind"), score.alias("score"))

        placed = let(running_sums(steps), lambda before: F.transform(
            found, lambda m, i: F.when(kind.valid(m), one(m, i, F.get(before, i)))))
        return F.filter(placed, lambda s: s.isNotNull()
                        & ((F.lit(kind.base)) | (s["score"] >= KEEP)))

    proposed = let(F.regexp_extract_all(text, pattern, 0), lambda m: F.when(
        F.size(m) > 0, let(F.split(text, kind.pattern, -1), lambda b: spans(m, b))))
    none = F.array().cast(_SPAN)
    return F.coalesce(F.when(kind.hint(text), proposed).otherwise(none), none).cast(_SPAN)


def all_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.array_sort(F.concat(
        *[kind_spans(t, k, i) for i, k in enumerate(KINDS)])))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the spans of every row, found once."""
    d = pick(docs, doc_id=id, text=text)
    # a generator keeps the spans from being evaluated again for each use of them
    return d.select("doc_id", F.explode(F.array(all_spans(F.col("text")))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"),
                        spelled(F.col("spans")).alias("spans"))


def redact(text: Column) -> Column:
    """The text with each confirmed match of every kind replaced by its kind in
    brackets, one kind after the other; null stays null."""
    def step(t: Column, kind: Kind) -> Column:
        tag = F.lit(f"[{kind.name.upper()}]")

        def rebuilt(m: Column, b: Column) -> Column:
            def part(x: Column, i: Column) -> Column:
                left, right = F.get(b, i), F.get(b, i + 1)
                near = (F.substring(left, -BEFORE, BEFORE).rlike(kind.near)
                        | F.substring(right, 1, AFTER).rlike(kind.near))
                sure = F.lit(kind.base) | (F.lit(kind.score) + F.when(near, kind.bonus)
                                           .otherwise(0.0) >= KEEP)
                return F.concat(left, F.when(kind.valid(x) & sure, tag).otherwise(x))
            return F.concat(F.array_join(F.transform(m, part), ""), F.element_at(b, -1))

        proposed = let(F.regexp_extract_all(t, F.lit(kind.pattern), 0), lambda m: F.when(
            F.size(m) > 0, let(F.split(t, kind.pattern, -1), lambda b: rebuilt(m, b))))
        return F.coalesce(F.when(kind.hint(t), proposed), t)

    def then(t: Column, rest: list[Kind]) -> Column:
        if not rest:
            return t
        return then(let(t, lambda x: step(x, rest[0])), rest[1:])

    return then(text, KINDS)


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` masked, and the
    column ``length`` (if there is one) brought up to date."""
    d = docs.select(*[F.explode(F.array(redact(F.col(f"`{text}`")))).alias(c) if c == text
                      else F.col(f"`{c}`") for c in docs.columns])
    if length in docs.columns:
        kind = docs.schema[length].dataType
        d = d.withColumn(length, F.length(F.col(f"`{text}`")).cast(kind))
    return d
