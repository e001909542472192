"""The dealt operators as registered queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.llm import (align, chat, decontaminate, fim, htmltext, lm, neardup, packing, pii,
                           quality, sharding, urlfilter, warc)
from ferrylake.llm.common import load, written

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its near-duplicate class."""
    return neardup.classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.contaminated(load(spark, sf_dir, "documents"),
                                       load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE["op2_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+9], ' ') AS k, least(len(ws), 10) AS n
       FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i+n-1], ' ') AS k
       FROM d, sizes, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS u(i)
       WHERE len(ws) >= n),
f AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit
      FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM f) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM f) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""


@query
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    t = htmltext.texts(load(spark, sf_dir, "pages"))
    return t.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(pii.find(load(spark, sf_dir, "documents")))


@query
def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    return packing.packed(load(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under the host rules."""
    m = written(quality.measured(load(spark, sf_dir, "documents")), "measures")
    return quality.judge(m).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


ORACLE["op6_host_quality"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t
           FROM documents),
w AS (SELECT rid, doc_id, source, t,
             list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS k
      FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g),
p AS (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS pos FROM c WHERE n > 1),
r AS (SELECT rid, count(*) AS n_rep FROM p GROUP BY rid),
m AS (SELECT rid, doc_id, source, len(ws) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_rep, 0) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 AS f1, n_repeat_words * 100 > n_words * 20 AS f2,
             n_symbols * 100 > n_words * 10 AS f3, n_dup_lines * 100 > n_lines * 50 AS f4 FROM m),
l AS (SELECT source, rule, count(*) AS n, sum(x) AS fails FROM (
        SELECT source, unnest([1, 2, 3, 4]) AS rule,
               unnest([f1::INT, f2::INT, f3::INT, f4::INT]) AS x FROM f) GROUP BY ALL),
s AS (SELECT rule, sum(fails) / sum(n) AS mean,
             greatest(sum(fails * fails / n) / sum(n) - power(sum(fails) / sum(n), 2), 1e-12) AS v
      FROM l GROUP BY rule),
a AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / v - 1, 2.0), 1000.0) AS wt FROM s),
b AS (SELECT source, max((fails + mean * wt) / (n + wt)) >= 0.6 AS bad
      FROM l JOIN a USING (rule) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed,
       NOT (f1 OR f2 OR f3 OR bad) AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""


@query
def op7_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urlfilter.judge(load(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response behind every not-modified revisit of records made from all
    pages, with its merged headers. Times are microseconds."""
    records = warc.captures_of_pages(load(spark, sf_dir, "pages"), others=True)
    r = warc.resolve(warc.parse_records(records))
    headers = F.array_sort(F.map_entries("headers"))
    lines = F.transform(headers, lambda h: F.concat_ws(": ", h["key"], h["value"]))
    return r.select("record_id", F.floor(F.col("record_id") / 10).alias("page_id"), "curl", "ts",
                    "status", F.floor(F.col("original_id") / 10).alias("original_page_id"),
                    "original_ts", F.array_join(lines, "\n").alias("headers"))


@query
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    s = sharding.shards(sharding.sized(load(spark, sf_dir, "documents")))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm.score(load(spark, sf_dir, "documents"))


@query
def op11_fim_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at code points and put in its form."""
    t = fim.transform(load(spark, sf_dir, "documents"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                    F.sha2("output", 256).alias("output_sha256"),
                    F.sha2(fim.restore(F.col("output"), F.col("form")), 256)
                    .alias("restored_sha256"))


ORACLE["op11_fim_regex"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
           FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [('0x' || h[8*k+1:8*k+8])::BIGINT for k in range(4)] AS g
      FROM d),
c AS (SELECT doc_id, t, n, least(g[1] % (n + 1), g[2] % (n + 1)) AS a,
             greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR g[3] % 100 >= 90 THEN 'plain'
                  WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s
      FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                        ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

# Fixed value of the contract: the text of both turns of conversation -1.
_CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query
def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows of every conversation, and of one more that says control
    strings, give back."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CONTROL_TEXT).alias("text"))
    w = chat.windows(turns.unionByName(more), tokenizer_path("byte_bpe_50k.json"))
    return chat.digests(w)


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return align.report(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                        tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
