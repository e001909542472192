"""P1-P6 against Python's own parsing (the reference's rules), in Spark and
in DuckDB with the same pattern text."""

import random
from datetime import datetime

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrylake.functions import predicates as P

FIXTURE = {  # value: (int, float, bool, timestamp)  -- FIXTURES.md section 5
    "2024-1-5": (0, 0, 0, 1), "2024-02-30": (0, 0, 0, 0), "2023-02-29": (0, 0, 0, 0),
    "2024-02-29": (0, 0, 0, 1), "0000-01-01": (0, 0, 0, 0), "2024-01-01 24:00:00": (0, 0, 0, 0),
    "2024-01-01 23:59:60": (0, 0, 0, 0), "2024-01-01  1:2:3": (0, 0, 0, 1),
    "2024-01-01T01:02:03.1234567": (0, 0, 0, 0), "2024-01-01T01:02:03.12": (0, 0, 0, 1),
    "5-1-2024": (0, 0, 0, 1), "31-04-2024": (0, 0, 0, 0), "13/01/2024": (0, 0, 0, 0),
    "1/2/2024": (0, 0, 0, 1), "2024-01-01 01:02:03.5": (0, 0, 0, 0),
    "2024-01-01T01:02:03Z": (0, 0, 0, 0), "2024-01- 5": (0, 0, 0, 1), "12024-01-01": (0, 0, 0, 0),
    "20240101": (1, 1, 0, 0), "1_000": (1, 1, 0, 0), " 12 ": (1, 1, 0, 0), "+5": (1, 1, 0, 0),
    "1__0": (0, 0, 0, 0), "_1": (0, 0, 0, 0), "1.0": (0, 1, 0, 0), "1e5": (0, 1, 0, 0),
    "0x10": (0, 0, 0, 0), "--1": (0, 0, 0, 0), "00": (1, 1, 0, 0), "nan": (0, 1, 0, 0),
    "+inf": (0, 1, 0, 0), "Infinity": (0, 1, 0, 0), "1.": (0, 1, 0, 0), ".5": (0, 1, 0, 0),
    ".": (0, 0, 0, 0), "1e": (0, 0, 0, 0), "1_0.5": (0, 1, 0, 0), "1e+5": (0, 1, 0, 0),
    "1.5f": (0, 0, 0, 0), "1d": (0, 0, 0, 0), "": (1, 1, 0, 1), " ": (1, 1, 0, 1),
    "yes": (0, 0, 1, 0), "No ": (0, 0, 1, 0), "TRUE": (0, 0, 1, 0), "t": (0, 0, 0, 0),
    "0": (1, 1, 1, 0), "1": (1, 1, 1, 0), "abc": (0, 0, 0, 0), " 2024-03-01 ": (0, 0, 0, 1),
    "2024-13-01": (0, 0, 0, 0), "2024-00-10": (0, 0, 0, 0), "2024-1-0": (0, 0, 0, 0),
    "100/1/2024": (0, 0, 0, 0), "01-02-2024": (0, 0, 0, 1),
}


def py_flags(v):
    """The reference's rule, stated in plain Python."""
    def ok(f):
        try:
            f()
            return True
        except Exception:
            return False
    blank = v.strip() == ""
    i = blank or ok(lambda: int(v))
    fl = blank or ok(lambda: float(v))
    b = v.strip().lower() in ("true", "false", "yes", "no", "0", "1")
    ts = blank or any(ok(lambda f=f: datetime.strptime(v.strip(), f)) for f in P.TIMESTAMP_FORMATS)
    return (i, fl, b, ts)


def _values():
    vals = list(FIXTURE)
    for v in list(FIXTURE):
        for w in (" ", "\t", "\n", "\x1c", "　"):
            vals += [w + v, v + w]
    rng = random.Random(7)
    alphabet = "0123456789+-_.eE/:T tn"
    vals += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for y in ("2024", "2023", "1900", "2000"):
        for m in range(0, 14):
            for d in (0, 1, 28, 29, 30, 31, 32):
                vals += [f"{y}-{m}-{d}", f"{d}-{m}-{y}", f"{m}/{d}/{y}"]
    return sorted(set(vals))


def _spark_flags(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", P.is_int("v").alias("i"), P.is_float("v").alias("f"),
                     P.is_bool("v").alias("b"), P.is_timestamp("v").alias("t"),
                     P.is_string("v").alias("s")).collect()
    return {r["v"]: (r["i"], r["f"], r["b"], r["t"], r["s"]) for r in rows}


def test_fixture_values_match_table(spark):
    got = _spark_flags(spark, list(FIXTURE))
    for v, exp in FIXTURE.items():
        assert got[v][:4] == tuple(bool(x) for x in exp), v
        assert got[v][:4] == py_flags(v), v


def test_spark_agrees_with_python(spark):
    values = _values()
    got = _spark_flags(spark, values)
    bad = [v for v in values if got[v][:4] != py_flags(v)]
    assert not bad, bad[:10]
    assert all(got[v][4] == (not got[v][3]) for v in values)


def test_duckdb_agrees_with_python():
    values = _values()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    f = P.sql_flags("v")
    rows = con.execute(f"SELECT v, {f['int']}, {f['float']}, {f['bool']}, {f['timestamp']} FROM t").fetchall()
    bad = [r[0] for r in rows if tuple(r[1:]) != py_flags(r[0])]
    assert not bad, bad[:10]


def test_null_is_string_only(spark):
    df = spark.createDataFrame([(None,)], "v string")
    r = df.select(P.is_int("v"), P.is_float("v"), P.is_bool("v"), P.is_timestamp("v"),
                  P.is_string("v"), P.is_blank("v")).first()
    assert tuple(r) == (False, False, False, False, True, False)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-_.eE/:Tt \tnaifyrsu", max_size=14), min_size=1, max_size=30))
def test_property_random_text(spark, values):
    got = _spark_flags(spark, values)
    for v in values:
        assert got[v][:4] == py_flags(v), repr(v)


UNICODE_NUMBERS = ["١٢٣", " ١_٢ ", "𝟏.𝟓", "٣e٢", "١٢٣٤٥٦٧٨٩٠١٢٣٤٥٦٧٨٩٠١", "１２", "٣.", "-٧",
                   "١٢a", "१२३", "٣:٤", "١/٢"]


def test_unicode_digits_int_float(spark):
    got = _spark_flags(spark, UNICODE_NUMBERS)
    for v in UNICODE_NUMBERS:
        assert got[v][:2] == py_flags(v)[:2], repr(v)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in UNICODE_NUMBERS])
    f = P.sql_flags("v")
    for v, i, fl in con.execute(f"SELECT v, {f['int']}, {f['float']} FROM t").fetchall():
        assert (i, fl) == py_flags(v)[:2], repr(v)


def test_unicode_digits_cast(spark):
    from ferrylake.operators.apply import apply_schema
    df = spark.createDataFrame([(v, v) for v in UNICODE_NUMBERS], "a string, b string")
    rows = apply_schema(df, [("a", "int"), ("b", "float")]).collect()
    for v, r in zip(UNICODE_NUMBERS, rows):
        try:
            exp_i = int(v)
            exp_i = exp_i if -2**63 <= exp_i < 2**63 else None
        except ValueError:
            exp_i = None
        try:
            exp_f = float(v)
        except ValueError:
            exp_f = None
        assert r["a"] == exp_i and r["b"] == exp_f, repr(v)


UNICODE_TIMES = ["٢٠٢٤-01-05", "2024-٠١-05", "2024-1٥-05", "2024-01-1٥", "2024-01-3٠",
                 "2024-01-05 1٢:3٠:٠٥", "2024-01-05 1٢:3٠:0٥", "٥-1-٢٠٢٤", "1/2/٢٠٢٤",
                 "2024-02-2٩", "٢٠٢٣-02-29", "2024-01-05T٢:3:4.5", "2024-01-05T2:3:4.٥",
                 "１２３４-01-01", "2024-01-05　"]


def test_unicode_digits_timestamps(spark):
    rng = random.Random(11)
    alphabet = "0123456789٠١٢٣٤٥٦٧٨٩-/: T."
    values = UNICODE_TIMES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 19)))
                              for _ in range(3000)]
    values += [f"20{a}{b}-0{c}-1{d}" for a in "2٢" for b in "4٤" for c in "2٢" for d in "9٩"]
    values = sorted(set(values))
    got = _spark_flags(spark, values)
    bad = [v for v in values if got[v][:4] != py_flags(v)]
    assert not bad, bad[:10]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    f = P.sql_flags("v")
    rows = con.execute(f"SELECT v, {f['timestamp']} FROM t").fetchall()
    bad = [r[0] for r in rows if r[1] != py_flags(r[0])[3]]
    assert not bad, bad[:10]
    from ferrylake.operators.apply import cast_text
    df = spark.createDataFrame([(v,) for v in UNICODE_TIMES], "v string")
    for v, ts in df.select("v", cast_text("v", "timestamp").alias("ts")).collect():
        if py_flags(v)[3]:
            for fmt in P.TIMESTAMP_FORMATS:
                try:
                    exp = datetime.strptime(v.strip(), fmt)
                    break
                except ValueError:
                    continue
            assert ts == exp, v
        else:
            assert ts is None, v
