"""Text-value predicates (P1-P6): does a text value parse as int, float, bool or
timestamp under Python's own parsing rules?

Every predicate is a native ``Column -> Column`` expression: ``trim``/``isin``
for blank and bool, ``rlike`` with a literal pattern (compiled once per task)
for int, float and timestamp, each behind a cheap guard on the first
character, so it stays inside whole-stage codegen. The same pattern text runs
unchanged in DuckDB (RE2), which is what the oracle SQL in
``ferrylake.queries`` uses.

Python semantics being reproduced:

* ``int(v)``: optional sign, ASCII digits with single ``_`` between digits,
  surrounding white space (the characters of ``str.isspace`` except
  U+001C..U+001F, which ``int``/``float`` do not strip).
* ``float(v)``: the same, plus ``1.``, ``.5``, exponents, ``nan``, ``inf``,
  ``infinity`` in any letter case.
* ``v.strip().lower() in BOOL_WORDS``.
* ``datetime.strptime(v.strip(), fmt)`` for one of ``TIMESTAMP_FORMATS``;
  ``strptime`` matches case-insensitively, turns a blank in the format into
  ``\\s+`` and rejects impossible calendar dates, year 0 and second 60/61.
* blank (``v.strip() == ""``) counts as int, float and timestamp, not as bool.

Unicode decimal digits count as in Python: for int and float anywhere (they
are mapped to ASCII digits first), for timestamps only where ``strptime``'s
own groups take them (``%Y``, the second digit of ``%d``, ``%H``, ``%M``,
``%S``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's rules for equal results.
# ---------------------------------------------------------------------------
BOOL_WORDS = ("true", "false", "yes", "no", "0", "1")
FLOAT_SPECIAL_WORDS = ("nan", "inf", "infinity")
TIMESTAMP_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%dT%H:%M:%S.%f",
    "%d-%m-%Y",
    "%m/%d/%Y",
)
TYPE_ORDER = ("int", "float", "bool", "timestamp", "string")
# ---------------------------------------------------------------------------

# White space as Python's str.isspace() sees it (str.strip, re's \s).
STRIP_WS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# White space that int() and float() strip: the same minus U+001C..U+001F.
NUM_WS = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _ci(word: str) -> str:
    """ASCII-only case-insensitive text for ``word`` ([Tt][Rr]...).

    Written out instead of ``(?i)`` because RE2 folds case over Unicode
    (``ſ`` matches ``s``) while Python's ``lower()`` and Java do not.
    """
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _alt(words) -> str:
    return "(?:" + "|".join(_ci(w) for w in words) + ")"


_DIGITS = r"\d(?:_?\d)*"

BLANK_RE = rf"^{STRIP_WS}*$"
INT_RE = rf"^{NUM_WS}*[+-]?{_DIGITS}{NUM_WS}*$"
FLOAT_RE = (
    rf"^{NUM_WS}*[+-]?(?:{_alt(sorted(FLOAT_SPECIAL_WORDS, key=len, reverse=True))}"
    rf"|(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)"
    rf"{NUM_WS}*$"
)
BOOL_RE = rf"^{STRIP_WS}*{_alt(BOOL_WORDS)}{STRIP_WS}*$"

# Calendar pieces, following strptime's %Y %m %d %H %M %S %f groups. The
# month/day combinations are spelled out so that an impossible date (April 31,
# February 30, February 29 of a common year, year 0) never matches: the check
# needs no cast and is the same in Spark and DuckDB.
_YEAR = r"(?:[1-9]\d{3}|0[1-9]\d\d|00[1-9]\d|000[1-9])"
_LEAP = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
_M31 = r"(?:0?[13578]|1[02])"
_M30 = r"(?:0?[469]|11)"
_M2 = r"0?2"
_D31 = r"(?:3[01]|[12]\d|0?[1-9]| [1-9])"
_D30 = r"(?:30|[12]\d|0?[1-9]| [1-9])"
_D28 = r"(?:2[0-8]|1\d|0?[1-9]| [1-9])"
_TIME = r"(?:2[0-3]|[01]?\d):(?:[0-5]?\d):(?:[0-5]?\d)"

_YMD = (
    rf"(?:{_YEAR}-(?:{_M31}-{_D31}|{_M30}-{_D30}|{_M2}-{_D28})|{_LEAP}-{_M2}-29)"
)
_DMY = (
    rf"(?:(?:{_D31}-{_M31}|{_D30}-{_M30}|{_D28}-{_M2})-{_YEAR}|29-{_M2}-{_LEAP})"
)
_MDY = (
    rf"(?:(?:{_M31}/{_D31}|{_M30}/{_D30}|{_M2}/{_D28})/{_YEAR}|{_M2}/29/{_LEAP})"
)
TIMESTAMP_RE = (
    rf"^{STRIP_WS}*(?:{_YMD}(?:{STRIP_WS}+{_TIME}|[Tt]{_TIME}(?:\.\d{{1,6}})?)?"
    rf"|{_DMY}|{_MDY}){STRIP_WS}*$"
)

# The shape strptime itself accepts, where its own groups use \d (any Unicode
# decimal digit): %Y, the second digit of %d, %H, %M, %S. Month, the first
# digit of day and %f are ASCII. A non-ASCII text is a timestamp when it has
# this shape AND its digits, mapped to ASCII, pass TIMESTAMP_RE (the calendar).
_U = r"\p{Nd}"
_SY = rf"{_U}{{4}}"
_SM = r"(?:1[0-2]|0[1-9]|[1-9])"
_SD = rf"(?:3[01]|[12]{_U}|0[1-9]|[1-9]| [1-9])"
_STIME = rf"(?:2[0-3]|[01]{_U}|{_U}):(?:[0-5]{_U}|{_U}):(?:6[01]|[0-5]{_U}|{_U})"
TIMESTAMP_SHAPE_RE = (
    rf"^{STRIP_WS}*(?:{_SY}-{_SM}-{_SD}(?:{STRIP_WS}+{_STIME}|[Tt]{_STIME}(?:\.[0-9]{{1,6}})?)?"
    rf"|{_SD}-{_SM}-{_SY}|{_SM}/{_SD}/{_SY}){STRIP_WS}*$"
)

PATTERNS = {
    "blank": BLANK_RE,
    "int": INT_RE,
    "float": FLOAT_RE,
    "bool": BOOL_RE,
    "timestamp": TIMESTAMP_RE,
    "timestamp_shape": TIMESTAMP_SHAPE_RE,
}


# The same white space as literal characters, for Spark's trim(str, chars),
# which strips any of them from both ends without a regex.
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
NUM_STRIP_CHARS = "".join(c for c in STRIP_CHARS if not "\x1c" <= c <= "\x1f")


# int() and float() read any Unicode decimal digit (category Nd) as its
# value; these two strings map each such digit to its ASCII digit (built from
# the Unicode database by rule, 680 characters).
import unicodedata as _ud  # noqa: E402

_ND = [chr(c) for c in range(0x110000) if _ud.category(chr(c)) == "Nd"]
UNICODE_DIGITS = "".join(c for c in _ND if not "0" <= c <= "9")
ASCII_OF_DIGITS = "".join(str(_ud.digit(c)) for c in UNICODE_DIGITS)


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def ascii_digits(v) -> Column:
    """Unicode decimal digits replaced by ASCII digits (no-op, and no copy,
    for pure-ASCII text: its byte length equals its character length)."""
    c = _col(v)
    return F.when(F.length(c) == F.octet_length(c), c) \
        .otherwise(F.translate(c, UNICODE_DIGITS, ASCII_OF_DIGITS))


def _match(v, pattern: str) -> Column:
    # rlike(null) is null; a null value (short CSV row) matches nothing.
    return F.coalesce(_col(v).rlike(pattern), F.lit(False))


def is_blank(v) -> Column:
    """``v.strip() == ""``; null is not blank."""
    return F.coalesce(strip_ws(v) == F.lit(""), F.lit(False))


# Cheap necessary conditions, checked before a regex runs: the first
# character after stripping (a substring of Spark's own string, no copy of a
# long text) must be able to start the form at all.
_INT_START = tuple("0123456789+-")
_FLOAT_START = tuple("0123456789+-.nNiI")
_DIGIT_START = tuple("0123456789")


def _first(v) -> Column:
    """First character after stripping, a Unicode digit shown as its ASCII
    digit (a one-character translate, whatever the length of the text)."""
    return F.translate(F.substring(strip_ws(v), 1, 1), UNICODE_DIGITS, ASCII_OF_DIGITS)


def _never(c: Column, *chars: str) -> Column:
    out = None
    for ch in chars:
        e = ~c.contains(ch)
        out = e if out is None else out & e
    return out


def _int_match(v) -> Column:
    # int() never takes '.', ':' or '/'
    c = _col(v)
    return F.when(_first(c).isin(*_INT_START) & _never(c, ".", ":", "/"),
                  _match(ascii_digits(c), INT_RE)).otherwise(F.lit(False))


def _float_match(v) -> Column:
    # float() never takes ':' or '/'
    c = _col(v)
    return F.when(_first(c).isin(*_FLOAT_START) & _never(c, ":", "/"),
                  _match(ascii_digits(c), FLOAT_RE)).otherwise(F.lit(False))


def is_int(v) -> Column:
    """Blank, or Python ``int(v)`` succeeds."""
    return _int_match(v) | is_blank(v)


def is_float(v) -> Column:
    """Blank, or Python ``float(v)`` succeeds (every int text is a float text)."""
    return F.when(is_int(v), F.lit(True)).otherwise(_float_match(v))


def is_bool(v) -> Column:
    """Stripped, lower-cased value is a bool word; blank is not bool.

    No regex: ``lower(trim(v))`` against the word list (Java's lower case of
    a non-ASCII letter never yields one of these ASCII words)."""
    s = strip_ws(v)
    return F.when(F.length(s) <= 5, F.coalesce(F.lower(s).isin(*BOOL_WORDS), F.lit(False))) \
        .otherwise(F.lit(False))


def _ts_match(v) -> Column:
    # Every format has a '-' or a '/' and (in ASCII) starts with a digit: the
    # regex only runs on such values. Non-ASCII text must have strptime's
    # shape and a valid calendar once its digits are mapped to ASCII.
    c = _col(v)
    return (F.when(~(c.contains("-") | c.contains("/")), F.lit(False))
            .when(~_first(c).isin(*_DIGIT_START), F.lit(False))
            .when(F.length(c) == F.octet_length(c), _match(c, TIMESTAMP_RE))
            .otherwise(_match(c, TIMESTAMP_SHAPE_RE)
                       & _match(ascii_digits(c), TIMESTAMP_RE)))


def is_timestamp(v) -> Column:
    """P5: blank, or one of the six strptime formats gives a real date."""
    return is_blank(v) | _ts_match(v)


def is_string(v) -> Column:
    """Everything that is not a timestamp (null included)."""
    return ~is_timestamp(v)


def strip_ws(v) -> Column:
    """Python ``str.strip()``: ``trim`` with every white-space character
    (plain ``trim`` removes only blanks)."""
    return F.trim(_col(v), F.lit(STRIP_CHARS))


def narrowest_type(v) -> Column:
    """Exclusive vote: the first of int, float, bool, timestamp that holds for a
    non-blank value, else string; null for null or blank values."""
    return (
        F.when(_col(v).isNull() | is_blank(v), F.lit(None).cast("string"))
        .when(_int_match(v), F.lit("int"))
        .when(_float_match(v), F.lit("float"))
        .when(is_bool(v), F.lit("bool"))
        .when(_ts_match(v), F.lit("timestamp"))
        .otherwise(F.lit("string"))
    )


# SQL text of the same predicates, for oracle queries (DuckDB) over a column
# expression ``x``.
def sql_match(x: str, kind: str) -> str:
    return f"coalesce(regexp_matches({x}, '{PATTERNS[kind]}'), false)"


def sql_ascii_digits(x: str) -> str:
    return f"translate({x}, '{UNICODE_DIGITS}', '{ASCII_OF_DIGITS}')"


def sql_flags(x: str) -> dict[str, str]:
    blank = sql_match(x, "blank")
    a = sql_ascii_digits(x)
    ts = f"({blank} OR ({sql_match(x, 'timestamp_shape')} AND {sql_match(a, 'timestamp')}))"
    return {
        "blank": blank,
        "int": f"({blank} OR {sql_match(a, 'int')})",
        "float": f"({blank} OR {sql_match(a, 'int')} OR {sql_match(a, 'float')})",
        "bool": sql_match(x, "bool"),
        "timestamp": ts,
        "string": f"(NOT {ts})",
    }
