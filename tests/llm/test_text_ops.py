"""Quality rules, personal data, decontamination, shards, packing, scores."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from fixture_tables import table  # noqa: F401
from pyspark.sql import functions as F

from ferrylake.llm import decontaminate, lm, packing, pii, quality, sharding
from ferrylake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_texts(n, seed=0, words=("alpha", "Beta", "gamma,", "ÉCOLE", "x#", "d.", "12", "e\tf")):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice((" ", " ", "\n", "  "))
                    for _ in range(rng.randrange(60))) for _ in range(n)]


def cases():
    texts = [None, "", " ", "\n\n", "one", "a b c d e f g h i j k"] + random_texts(40)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    return rows + [(None, "null id here", None), (7, texts[7], "s1"), (7, texts[7], "s1"),
                   (900, "word " * 30_000, "s0")]


# --- quality -----------------------------------------------------------------

def counts_by_hand(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    many = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_quality_counts_and_verdicts(spark, table):
    rows = cases()
    out = quality.judge(quality.measured(table(rows, DOCS))).collect()
    assert len(out) == len(rows)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                               r.n_repeat_words) for r in out)
    assert got == collections.Counter((d, *counts_by_hand(t)) for d, t, _ in rows)
    for r in out:
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == base and not (base and r.kept)


def test_bad_host_goes_good_host_and_null_host_stay(spark, table):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "short", "bad") for i in range(60)] + [(100, clean, "bad")]
    rows += [(200 + i, clean + f" {i}", "good") for i in range(80)] + [(300, clean, None)]
    df = table(rows, DOCS)
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {200 + i for i in range(80)} | {300}
    assert quality.keep_good(df).columns == df.columns
    judged = {r.doc_id: r.kept for r in quality.judge(quality.measured(df)).collect()}
    assert {k for k, v in judged.items() if v} == kept


def test_quality_empty_table(spark, table):
    assert quality.judge(quality.measured(table([], DOCS))).count() == 0
    assert quality.keep_good(table([], DOCS)).count() == 0


# --- personal data -----------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4)
               for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_spans_equal_brute_force(spark, table):
    rng = random.Random(3)
    texts = [None, "", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 000.1.2.3 256.1.1.1 é 😀1.1.1.1",
             "+49 (151) 123-4567, 4111 1111 1111 1111 and 4111-1111-1111-1112",
             "a" * 30_000 + "@" + "b." * 9_000, "1" * 40_000 + ".", "1 " * 3_000 + "x@y.z"]
    texts += ["".join(rng.choice("ab1 9.@+-()_%é😀0123456789 ") for _ in range(rng.randrange(150)))
              for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (3, texts[3])]
    out = pii.report(pii.find(table(rows, "doc_id long, text string"))).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for d, t in rows:
        want, r = base_spans(t), by[d]
        said = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t[:100]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(x[3] == k for x in want) for k in PATTERNS]
        assert {x for x in said.split(",") if x} <= set(r.spans.split(","))


def test_pii_checksums_and_context(spark, table):
    rows = [(1, "my IBAN GB82 WEST 1234 5698 7654 32."), (2, "IBAN GB82 WEST 1234 5698 7654 33."),
            (3, "call 020 555 1234 now"), (4, "numbers 020 555 1234 here"),
            (5, 'token = "24be64439e3e49cf46b2"')]
    spans = {r.doc_id: r.spans for r in
             pii.report(pii.find(table(rows, "doc_id long, text string"))).collect()}
    assert spans == {1: "iban:8:35", 2: "", 3: "local_phone:5:17", 4: "", 5: "secret:9:29"}


def test_redaction_leaves_clean_text_alone(spark, table):
    rows = [(1, "write to a.b@c.de, host 10.0.0.1 or +49 151 1234567", "s"), (2, "clean, 1 2 3", "s"),
            (3, None, None), (4, "", "s"), (2, "clean, 1 2 3", "s")]
    df = table(rows, DOCS)
    out = pii.redacted(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(
        [(1, "write to [EMAIL], host [IP] or [PHONE]"), (2, "clean, 1 2 3"), (3, None), (4, ""),
         (2, "clean, 1 2 3")], key=lambda x: (x[0], x[1] or ""))


# --- decontamination ---------------------------------------------------------

def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contamination(docs, items, size=10):
    wins = collections.defaultdict(set)
    for k, (item, t) in enumerate(items):
        w = words(t)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            wins[tuple(w[i:i + size])].add((k, item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        ids = ",".join(sorted(str(i) for _, i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit)))
    return collections.Counter(out)


def test_decontamination_equals_brute_force(spark, table):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Zürich", "ÉA", "éa", "x1", "b", "c", "D"]
    item = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(12)]
    items = [(k, t) for k, t in enumerate(item)] + [(50, "b c b"), (51, None), (52, "--"),
                                                   (3, item[3]), (None, "ÉA x1 x1 x1 ÉA éa")]
    docs = [(i, rng.choice(("", "x ", "c, ")) + ("! ".join(rng.sample(item, 2)) if i % 2 else
             " ".join(rng.choice(vocabulary) for _ in range(60)))) for i in range(40)]
    docs += [(100, None), (101, ""), (None, item[0]), (5, docs[5][1]), (5, docs[5][1]),
             (102, "the " * 5_000)]
    d, b = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    out = decontaminate.contaminated(d, b).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256,
                               r.contaminated) for r in out)
    assert got == contamination(docs, items)
    clean = decontaminate.without_contaminated(d, b)
    assert clean.columns == d.columns
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(
        {k[0]: n for k, n in contamination(docs, items).items() if not k[5]})


def test_decontamination_empty_tables(spark, table):
    d, b = table([], "doc_id long, text string"), table([], "item_id long, text string")
    full = table([(1, "a b"), (2, None)], "doc_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0
    assert {(r.doc_id, r.n_words, r.contaminated)
            for r in decontaminate.contaminated(full, b).collect()} == {(1, 2, False),
                                                                         (2, 0, False)}


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_proximity_equals_brute_force(spark, table, distance):
    rng = random.Random(21)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(25))))
            for i in range(40)]
    docs += [(100, "rare and then some odd words"), (101, "rare x x x x x x odd"),
             (102, "odd and rare"), (103, None), (104, "solo")]
    items = [(1, "rare and odd"), (2, "a b c"), (3, "g f e d"), (4, "solo"), (5, "a a"),
             (6, "never a"), (7, "c d e f g a b c d e f")]
    d, b = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    distinct, _ = decontaminate.windows(b)
    terms = decontaminate.term_table(distinct)
    index = decontaminate.postings(d, terms)
    texts = {r.key: (r.text or "").split() for r in
             decontaminate.with_key(d, "doc_id", "text").collect()}
    windows = {r.window: r.words for r in distinct.collect()}
    rarest = {r.window: (r.term, r.offset) for r in decontaminate.anchors(
        distinct, terms, index).filter("rank = 0").collect()}
    names = {r.term: r.word for r in terms.collect()}
    want = set()
    for w, (term, offset) in rarest.items():
        for key, ws in texts.items():
            for p, x in enumerate(ws):
                s = p - offset
                if x == names[term] and all(
                        t in ws[max(s + k - distance, 0):max(s + k + distance + 1, 0)]
                        for k, t in enumerate(windows[w])):
                    want.add((key, w, s, len(windows[w])))
    got = decontaminate.proximity_matches(d, distinct, terms, index, distance).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want
    if distance == 0:
        _, exact = decontaminate.search(d, distinct)
        assert {tuple(r) for r in exact.collect()} == want


# --- shards ------------------------------------------------------------------

def test_shards_are_contiguous_and_even(spark, table):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(300)) for i in range(3_000)]
    rows += [(None, None), (5, rows[5][1]), (5, rows[5][1]), (None, "")]
    out = sharding.shards(sharding.sized(table(rows, "doc_id long, text string"))).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == \
        collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
                            for d, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    total = sum(r.size for r in out)
    assert sorted(by) == list(range(24))
    for k, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 24) <= 608
    ends = [(min(r.doc_id or -1 for r in by[k]), max(r.doc_id or -1 for r in by[k])) for k in range(24)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_shards_equal_prefix_sums_by_hand(spark, table):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(90)) for i in rng.sample(range(10**6), 700)]
    out = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(
        sharding.sized(table(rows, "doc_id long, text string")), partitions=7).collect()}
    sizes = sorted((i, len(t.encode()) + 8) for i, t in rows)
    total, end, slots = sum(n for _, n in sizes), 0, collections.Counter()
    for i, n in sizes:
        end += n
        shard = min(23, (2 * end - n) * 24 // (2 * total))
        assert out[i] == (shard, slots[shard])
        slots[shard] += 1


def test_bounded_join_measures_bytes(spark):
    from ferrylake.llm import common
    big = spark.range(100)
    for small, wide in ((spark.range(5).withColumn("x", F.lit("y")), False),
                        (spark.range(5).withColumn("x", F.repeat(F.lit("y"), 10_000_000)), True)):
        small = small.checkpoint()
        joined = common.bounded_join(big, small, "id", "left")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (not wide)
    assert common.bounded_join(big, small.limit(0).checkpoint(), "id", "left").count() == 100


def test_shards_hot_id_and_empty(spark, table):
    rows = [(7, f"t{i % 5}") for i in range(2_000)]
    out = sharding.shards(sharding.sized(table(rows, "doc_id long, text string"))).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2
    assert sharding.shards(sharding.sized(table([], "doc_id long, text string"))).count() == 0


# --- packing -----------------------------------------------------------------

def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["", "Hello, world.", "a.,b  c\td\r\ne", "ΟΔΟΣ, ΟΔΟΣ. İstanbul ǅ", "e\u0301 \u0301x ñ",
             "<|endoftext|> x<|startoftext|>", "it's they'll 'S", "1,234.5 ½ ²", "\u00a0a\u2003b\x1cc",
             "ﬁ Ａ K Å"] + random_texts(50, 2)
    ours = packing.Tokens(tokenizer_path(), limit=20)
    for _ in range(2):
        for t, ids in zip(texts, ours.batch(texts), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_token_ids_of_letters_that_normalise_to_more(spark):
    """Every letter or mark whose composed or lower-cased form is another one or longer,
    before a comma, a full stop and another letter, and inside words and sign runs."""
    import unicodedata

    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    odd = [c for c in map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)])
           if unicodedata.category(c)[0] in "LM" and (
               unicodedata.category(c)[0] == "M" or unicodedata.normalize("NFC", c) != c
               or len(c.lower()) > 1 or len(unicodedata.normalize("NFC", c.lower())) > 1)]
    assert {"\u0130", "\u0958", "\u095c", "\ufb2a"} <= set(odd)
    texts = [f"{c}, {c}. {c}{c}b a{c}, B{c}*1 x{c}" for c in odd + ["\u03a3", "\u03c2", "_", "\u00bd"]]
    ours = packing.Tokens(tokenizer_path(), limit=2000)
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x.tolist() for k in range(0, len(texts), 500) for x in ours.batch(texts[k:k + 500])]
    assert [t for t, x, y in zip(texts, got, want) if x != y] == []


def test_token_ids_of_random_mixtures(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(12)
    bits = ["a", "B", "Σ", "İ", "क़", "é", "'s", "'", "n't", "<|endoftext|>", "<|", "1", "٣", "½",
            "_", "-", "***", "ß", "ﬁ", "가", "가", "中", "🙂", "\u200d", ".", " ", ",", "\n",
            "\xa0", "I'LL", "É", "Ǆ", "\u0338", "=", "<", ">"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(5000)]
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    ours = packing.Tokens(tokenizer_path(), limit=100)
    got = [x.tolist() for k in range(0, len(texts), 50) for x in ours.batch(texts[k:k + 50])]
    assert got == want


def test_packing_round_trip(spark, table):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(d, t) for d, t, _ in cases()]
    out = packing.packed(table(rows, "doc_id long, text string"), tokenizer_path(), size=64,
                         group_pieces=50).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[s:s + 64], "<u4").tobytes()
            want[d, k, s, len(part) // 4, zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
                               for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(table([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_local_search_improves_a_poor_packing(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 60) for _ in range(150)]
    poor = [[i] for i in range(len(lengths))]
    bins = packing.local_search(lengths, 100, poor, steps=5_000)
    assert sorted(i for b in bins for i in b) == list(range(150))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    bound = -(-sum(lengths) // 100)
    assert len(bins) <= 1.08 * bound           # from one item a bin, by search alone
    assert len(packing.local_search(lengths, 100)) <= bound + 1


def test_full_pieces_stay_out_of_the_groups(spark):
    from pyspark.sql import functions as F
    rows = spark.range(0, 4_000, 1, 8).select(
        F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("int").alias("piece"),
        (F.col("id") * 2048).alias("start"),
        F.when(F.col("id") < 3_999, 2048).otherwise(5).cast("long").alias("length"),
        F.col("id").alias("ids_crc32"))
    out = packing.pack(rows).cache()
    full = out.filter("length = 2048")
    assert full.select(F.spark_partition_id()).distinct().count() == 8    # not one task's frame
    assert out.select("sequence_id").distinct().count() == out.count() == 4_000
    assert out.filter("offset <> 0").count() == 0


def test_search_goes_on_to_its_end():
    lengths = np.random.default_rng(1).integers(300, 1_400, packing.GROUP_PIECES).tolist()
    bins = packing.local_search(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= packing.SEQUENCE for b in bins)
    assert len(bins) < len(packing.local_search(lengths, steps=1_000))
    # nothing is left to do
    assert len(packing.local_search(lengths, bins=bins)) == len(bins)


# --- scores ------------------------------------------------------------------

def scores_by_hand(rows, order=2, prior=lm.PRIOR):
    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["</s>"]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    seen = collections.Counter()                  # n-grams of all orders, as tuples
    for (d, t), h in zip(rows, held, strict=True):
        if not h:
            w = ["<s>"] + toks(t)
            for i in range(1, len(w)):
                for k in range(min(order, i + 1)):
                    seen[tuple(w[i - k:i + 1])] += 1
    one = {k[0]: c for k, c in seen.items() if len(k) == 1}
    n, v = sum(one.values()), len(one)
    seen["<s>",] = one.get("</s>", 0)

    def prob(history, x):
        if not history:
            return (one.get(x, 0) + .1) / (n + .1 * (v + 1))
        p = prob(history[1:], x)
        c = seen[history]
        return (seen[(*history, x)] + prior * p) / (c + prior) if c else p

    out = []
    for (d, t), h in zip(rows, held, strict=True):
        w = ["<s>"] + toks(t)
        base = sum(math.log10(prob((), x)) for x in w[1:])
        score = sum(math.log10(prob(tuple(w[max(0, i - order + 1):i]), w[i]))
                    for i in range(1, len(w)))
        out.append((d, h, len(w) - 1, sum(x in one for x in w[1:]), n, round(base, 6),
                    round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_tokens, order", [(50, 2), (1_000_000, 2), (70, 3)])
def test_lm_scores_equal_brute_force(spark, table, block_tokens, order):
    rows = [(d, t) for d, t, _ in cases()]
    out = lm.score(table(rows, "doc_id long, text string"), block_tokens=block_tokens,
                   order=order, range_keys=700).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6), round(r.score, 6)) for r in out),
                  key=repr) == scores_by_hand(rows, order)


def test_lm_orders_sum_to_one(spark, table):
    """Over the seen vocabulary and one unseen word, with V + 1 words in all."""
    rows = [(1, "a b a c"), (2, "b a"), (3, "a")]
    vocabulary = ["a", "b", "c", "zzz"]
    # texts "x" and "x y" for all x, y: p(y | x) = p(x y ...) / p(x ...); none of them trains
    ask, k = [], 10
    while len(ask) < len(vocabulary) ** 2:
        k += 1
        if zlib.crc32(str(k).encode()) % 10 == 0:
            ask.append(k)
    pairs = [(x, y) for x in vocabulary for y in vocabulary]
    train = [(i, t) for i, (_, t) in zip([i for i in range(1, 9)
                                          if zlib.crc32(str(i).encode()) % 10], rows)]
    blk = lm.blocks(table(train + [(d, f"{x} {y}") for d, (x, y) in zip(ask, pairs)],
                          "doc_id long, text string").coalesce(1))
    row = next(blk.toPandas().itertuples(index=False))
    g, ends, _ = lm._open(row, 2)
    train_mask = np.repeat(~np.asarray(row.held), np.diff(ends, prepend=0))
    counts = {1: g.counts(1, train_mask).astype(int), 2: g.counts(2, train_mask).astype(int)}
    n, v = counts[1].sum(), (counts[1] > 0).sum()
    model = lm.BackoffAutomaton(g, counts, n, v)
    first = [k for k in range(len(g.at[1])) if k in set(np.concatenate([[0], ends[:-1]]))]
    by = {}
    for d, s in zip(row.doc_ids, first):
        if d in ask:
            by[pairs[ask.index(d)]] = 10 ** model.read()[s + 1]
    unigram = {}
    for x in vocabulary:
        total = sum(by[x, y] for y in vocabulary)
        # what is missing is the end token's share
        assert total < 1 and total > 0.3
        unigram[x] = total
    assert set(unigram) == set(vocabulary)


def test_lm_empty_table(spark, table):
    assert lm.score(table([], "doc_id long, text string")).count() == 0
