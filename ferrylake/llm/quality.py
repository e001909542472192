"""Host-level quality rules: rule failures are added up per host, each host's
failure rates are shrunk towards all hosts by an empirical beta prior, and the
host verdicts are joined back to the documents.

Cases: a null or empty text has no words (all counts 0, so it fails the base
rule); a null host is a host of its own; repeated rows are each judged and each
count; an empty table gives an empty result; columns other than the named ones
are ignored, whatever their names. No row is dropped here: ``kept`` says it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import bounded_join, pick, ship_package, written
from ferrylake.llm.words import WordHashes, space_words, window_hashes

# Fixed values of the base contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5

MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, "
            "n_dup_lines long, n_repeat_words long")


@dataclass(frozen=True)
class HostRules:
    """Rule limits. A document fails a rule on its own counts; a host is
    rejected when the shrunk rate of one rule among its documents reaches
    ``host_cut``."""

    min_words: int = 10
    max_repeat_pct: int = 20          # percent of words in repeated windows
    max_symbol_pct: int = 10          # symbols per 100 words
    max_dup_line_pct: int = 50        # repeated lines per 100 lines (host rate only)
    host_cut: float = 0.6
    prior_min: float = 2.0            # bounds of alpha + beta
    prior_max: float = 1000.0


def measure_text(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``MEASURES``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = space_words(text)
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > WINDOW:
        keys = window_hashes(hashes.of(words), WINDOW)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for i in range(WINDOW):
            covered[i:i + len(keys)] |= twice
        repeated = int(covered.sum())
    return n, word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def measures(text: Column) -> Column:
    """A struct of the counts of each text (Arrow batches; one row at a time in
    memory beyond the batch)."""

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        hashes = WordHashes()
        rows = [measure_text(t, hashes) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")],
                            dtype="int64")

    return run(text)


def rule_columns(rules: HostRules) -> dict[str, Column]:
    """Rule name -> failed, from the measure columns."""
    n = F.col("n_words")
    return {
        "few_words": n < rules.min_words,
        "repeats": F.col("n_repeat_words") * 100 > n * rules.max_repeat_pct,
        "symbols": F.col("n_symbols") * 100 > n * rules.max_symbol_pct,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * rules.max_dup_line_pct,
    }


def base_failed(rules: HostRules) -> Column:
    r = rule_columns(rules)
    return r["few_words"] | r["repeats"]


def own_failed(rules: HostRules) -> Column:
    """What a document's own counts decide, whatever its host."""
    r = rule_columns(rules)
    return r["few_words"] | r["repeats"] | r["symbols"]


def measured(docs: DataFrame, text: str = "text", host: str = "source",
             keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``host`` and the counts; the text goes no further."""
    ship_package(docs.sparkSession)
    d = pick(docs, **{c: c for c in keep}, _host=host, _text=text)
    return (d.withColumn("_m", measures(F.col("_text")))
            .select(*keep, F.col("_host").alias("host"), "_m.*"))


def host_verdicts(m: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One row per host: documents, failures and shrunk rate per rule, ``rejected``.

    Counts are added up map-side first, so a host with a third of all rows
    reaches its reducer as one row per task. The prior of each rule is fitted by
    moments over all hosts (two sums per rule; one row comes to the driver).
    """
    cols = rule_columns(rules)
    per_host = written(m.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in cols.items()]), "host-rates")
    sums = per_host.agg(
        F.sum("n_docs").alias("n"),
        *[F.sum(f"f_{r}").alias(f"f_{r}") for r in cols],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"q_{r}")
          for r in cols]).first()
    total = sums["n"] or 0
    rates = []
    for r in cols:
        mean = (sums[f"f_{r}"] or 0) / total if total else 0.0
        spread = max((sums[f"q_{r}"] or 0.0) / total - mean * mean, 1e-12) if total else 1.0
        weight = min(max(mean * (1 - mean) / spread - 1, rules.prior_min), rules.prior_max)
        rates.append(((F.col(f"f_{r}") + F.lit(mean * weight))
                      / (F.col("n_docs") + F.lit(weight))).alias(f"rate_{r}"))
    out = per_host.select("*", *rates)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in cols])
    return out.withColumn("rejected", worst >= rules.host_cut)


def judge(m: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Every row of ``measured`` with ``base_failed`` and ``kept``. ``m`` is read
    twice (rates, verdicts), so pass a written table."""
    bad = written(host_verdicts(m, rules).filter("rejected")
                  .select(F.col("host").alias("_bad"), F.lit(True).alias("_rejected")),
                  "bad-hosts")
    j = bounded_join(m, bad, F.col("host").eqNullSafe(F.col("_bad")), "left")
    return (j.withColumn("base_failed", base_failed(rules))
            .withColumn("kept", F.col("_rejected").isNull() & ~own_failed(rules))
            .drop("_bad", "_rejected"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text",
              host: str = "source") -> DataFrame:
    """The rows of ``docs`` (all columns) that pass their own rules and whose
    host is not rejected. Texts are read twice and never shuffled."""
    m = measured(docs, text, host, keep=())
    bad = written(host_verdicts(m, rules).filter("rejected")
                  .select(F.col("host").alias("_bad")), "bad-hosts")
    names = docs.columns
    d = docs.withColumn("_measures_of_text", measures(F.col(f"`{text}`")))
    m_fields = [c.split()[0] for c in MEASURES.split(", ")]
    cond = own_failed(rules)
    flags = d.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)],
                     *[F.col("_measures_of_text")[f].alias(f) for f in m_fields])
    good = flags.filter(~cond)
    key = f"_in_{names.index(host)}"
    good = bounded_join(good, bad, F.col(key).eqNullSafe(F.col("_bad")), "left_anti")
    return good.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)])
