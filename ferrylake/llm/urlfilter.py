"""URL filter by the likelihood ratio of two character models.

Rules on host and path decide what they cover. The URLs they accept and reject
train two variable-order Markov models of characters: the probability of a
character after a context of up to ``order`` characters is its count there
mixed with the probability after the context without its first character, down
to a uniform one (Witten-Bell weights). A URL without a rule is blocked if the
difference of the two log-likelihoods per character is above a threshold, which
is calibrated on labelled URLs held out from the counts.

All steps are DataFrame operations. Counts are kept per distinct context and
character; a model has at most alphabet^(order+1) rows, so its join is broadcast
only behind a count. Each distinct gram of the URLs is looked up once, and sums
per URL follow.

Cases: a null URL or one without ``://`` has an empty host and path, no rule,
and the method judges its characters (an empty URL scores 0: allow unless the
threshold is below); repeated rows are each judged and each count; without
labelled URLs of both kinds every score is 0 and everything without a rule is
allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import bounded_join, checkpointed, pick, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the contract.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

ORDER = 5                    # longest context, in characters
ALPHABET = 256               # size of the uniform distribution below all contexts
FOLDS, HELD = 5, 0           # labelled URLs of this fold calibrate the threshold
STEP = 0.01                  # width of the calibration's score classes
START = "\u0002"             # stands before the first character


def host_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The name of the longest rule that fits, else null."""
    best = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.lit(r.name)).otherwise(best)
    return best


def ruled(pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict)."""
    d = pick(pages, page_id=id, url=url)
    host, path = host_path(F.col("url"))
    d = d.select("page_id", "url", host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdict)
    return d.withColumn("rule_verdict", verdict)


def grams(urls: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """``keep`` columns and one ``gram`` per character of ``url``: the character
    and the up to ``order`` before it."""
    text = F.concat(F.lit(START), F.coalesce("url", F.lit("")))
    ends = F.sequence(F.lit(2), F.length("_t"))
    return (urls.withColumn("_t", text).filter(F.length("_t") > 1)
            .select(*keep, F.explode(F.transform(ends, lambda e: F.substring(
                F.col("_t"), F.greatest(e - order, F.lit(1)),
                F.least(e, F.lit(order + 1))))).alias("gram")))


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(gram, bad, good): how often each gram of each length ends in rejected and
    accepted URLs."""
    whole = (grams(labelled, order, ["is_bad"]).groupBy("gram")
             .agg(F.sum(F.col("is_bad").cast("long")).alias("bad"),
                  F.sum((~F.col("is_bad")).cast("long")).alias("good")))
    n = F.length("gram")
    each = whole.select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(
        F.col("gram"), n - k + 1, k))).alias("gram"), "bad", "good")
    return written(each.groupBy("gram").agg(F.sum("bad").alias("bad"),
                                            F.sum("good").alias("good")), "gram-counts")


def gram_ratios(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log p(last character | rest) under the rejected minus under
    the accepted URLs, for each wanted gram."""
    context = F.expr("left(gram, length(gram) - 1)")
    contexts = checkpointed(counts.select(
        context.alias("ctx"), "bad", "good").groupBy("ctx").agg(
            F.sum("bad").alias("n_bad"), F.sum("good").alias("n_good"),
            F.sum((F.col("bad") > 0).cast("long")).alias("t_bad"),
            F.sum((F.col("good") > 0).cast("long")).alias("t_good")))
    w = wanted.select("gram", F.lit(1.0 / ALPHABET).alias("p_bad"),
                      F.lit(1.0 / ALPHABET).alias("p_good"))
    for k in range(order + 1):                  # from the empty context to the longest
        part = F.expr(f"right(gram, {k + 1})")
        w = w.withColumn("_g", F.when(F.length("gram") > k, part))
        w = w.withColumn("_c", F.expr("left(_g, length(_g) - 1)"))
        w = bounded_join(w, counts.select(F.col("gram").alias("_g"), "bad", "good"), "_g", "left")
        w = bounded_join(w, contexts.withColumnRenamed("ctx", "_c"), "_c", "left")
        for side in ("bad", "good"):
            n, t = F.coalesce(f"n_{side}", F.lit(0)), F.coalesce(f"t_{side}", F.lit(0))
            c = F.coalesce(side, F.lit(0))
            w = w.withColumn(f"p_{side}", F.when(n > 0, (c + t * F.col(f"p_{side}")) / (n + t))
                             .otherwise(F.col(f"p_{side}")))
        w = w.select("gram", "p_bad", "p_good")
    return written(w.select("gram", (F.log("p_bad") - F.log("p_good")).alias("ratio")),
                   "gram-ratios")


def scores(urls: DataFrame, counts: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """``keep`` columns (which name a row) and ``score``: the log-likelihood
    difference per character."""
    g = grams(urls, order, keep)
    ratios = gram_ratios(counts, g.select("gram").distinct(), order)
    summed = (bounded_join(g, ratios, "gram").groupBy(*keep)
              .agg((F.sum("ratio") / F.count(F.lit(1))).alias("score")))
    return summed


def threshold(held: DataFrame) -> float:
    """The score above which blocking gives the highest balanced accuracy on
    labelled URLs (score, is_bad), in the middle between the score classes it
    parts; only one row per score class is gathered."""
    bins = (held.groupBy(F.floor(F.col("score") / STEP).alias("bin"))
            .agg(F.sum(F.col("is_bad").cast("long")).alias("bad"),
                 F.sum((~F.col("is_bad")).cast("long")).alias("good")))
    least, most = -int(60 / STEP), int(60 / STEP)
    bins = (bins.withColumn("bin", F.greatest(F.least("bin", F.lit(most)), F.lit(least)))
            .groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    rows = sorted(bins.collect(), key=lambda r: r["bin"])       # at most 12,001 rows
    bad, good = sum(r["bad"] for r in rows), sum(r["good"] for r in rows)
    if not bad or not good:
        return 0.0
    best, cut, passed_bad, passed_good, below = -1.0, 0.0, 0, 0, rows[0]["bin"] - 1
    for r in rows:
        accuracy = ((bad - passed_bad) / bad + passed_good / good) / 2
        if accuracy > best:                   # the middle of the gap below this class
            best, cut = accuracy, (below + 1 + r["bin"]) / 2 * STEP
        passed_bad += r["bad"]
        passed_good += r["good"]
        below = r["bin"]
    return cut


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES,
          order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per row of ``pages``;
    score is null where a rule decides."""
    r = written(ruled(pages, id, url, rules).withColumn("name", F.xxhash64("url")), "ruled")
    # equal URLs are scored once; counts weigh each row
    is_bad = (F.col("rule_verdict") == "block").alias("is_bad")
    fold = F.pmod(F.col("name"), F.lit(FOLDS))
    labelled = r.filter("rule is not null")
    counts = gram_counts(labelled.filter(fold != HELD).select("url", is_bad), order)
    both = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not (both[0] and both[1]):
        scored = r.limit(0).select("name", F.lit(0.0).alias("score"))
        cut = 0.0
    else:
        held = labelled.filter(fold == HELD).groupBy("name").agg(
            F.first("url").alias("url"), F.first(is_bad).alias("is_bad"),
            F.count(F.lit(1)).alias("n"))
        open_ = r.filter("rule is null").groupBy("name").agg(
            F.first("url").alias("url"), F.lit(None).cast("boolean").alias("is_bad"),
            F.count(F.lit(1)).alias("n"))
        both_kinds = written(held.union(open_), "to-score")
        all_scores = written(scores(both_kinds, counts, order, ["name", "is_bad"]), "scores")
        cut = threshold(all_scores.filter("is_bad is not null"))
        scored = all_scores.filter("is_bad is null").select("name", "score")
    j = r.join(scored, "name", "left")
    own = F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0.0)))
    return j.select("page_id", "host", "path", "rule",
                    F.coalesce("rule_verdict", F.when(own > cut, "block").otherwise("allow"))
                    .alias("verdict"), own.alias("score"))
