"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often
they occur. Each unit of weight of an element is a region in which hashed darts
land at exponentially spaced ranks (a Poisson process that depends on the
element and the unit only). A signature of k coordinates keeps, for each
coordinate, the earliest of the darts that fall to it; only darts below a rank
that suits the document's weight are thrown, so the cost is weight + k log k.
Two signatures agree in a coordinate with the weighted Jaccard similarity.

Rows of equal words are one class from the start. Bands of the signature give
buckets of distinct texts; the members of a bucket are compared with its most
widely shared member first, exactly, and linked from ``threshold`` on. Buckets
whose members are then still in several classes are joined with themselves,
across classes only, and those pairs are compared exactly too. Two bounds keep that
join small: the shingles a text shares with any other text in question bound
what it can share with one (exact), and a one-bit sketch of the signatures must
allow the similarity. Classes are the connected components.

Cases: words are runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased; a text of one to four words is one shingle; rows without words
(null, empty) are each a class of their own; repeated rows share a class; null
ids are kept (they order after others as class names); an empty table gives an
empty result; other columns are ignored (``one_of_each`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import bounded_join, checkpointed, pick, ship_package, written
from ferrylake.llm.words import WordHashes, alnum_words, mix, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 8          # misses 0.3 % of pairs at 0.8 and less above
SKETCH_BITS = 256            # one bit of each coordinate
# Pairs at the threshold agree in 0.9 of the bits, give or take 0.019; four
# deviations below that a pair is not looked at.
SKETCH_MIN = 0.82
SIGN_TOGETHER = 150_000      # regions and coordinates that one throw handles (about 40 MB)

_SIGNED = "doc_id long, key long, bands array<long>, sketch array<long>"


def strips(words: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """One hash per unit of weight: (shingle, occurrence)."""
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    s = np.sort(window_hashes(w, n) if len(w) >= n else window_hashes(w, len(w)))
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(s + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def dart_signatures(regions: list[np.ndarray], k: int,
                    widths: list[np.ndarray] | None = None) -> np.ndarray:
    """k coordinates for each set of weighted regions, as hashes of the darts kept.

    ``regions`` are hashes of unit regions (none of the sets is empty);
    ``widths`` (all 1 if left out) the part of each that the weight fills: a dart
    counts if its place is below it. Sets are thrown at together; each has a
    rank limit that suits its weight, doubled while a coordinate has no dart.
    """
    sizes = np.array([len(r) for r in regions])
    weight = sizes.astype(float) if widths is None else np.array([w.sum() for w in widths])
    limit = (k * np.log(k) + 2 * k) / weight
    out = np.zeros((len(regions), k), np.uint64)
    todo = np.arange(len(regions))
    while len(todo):
        doc = np.repeat(np.arange(len(todo)), sizes[todo])
        h = np.concatenate([regions[i] for i in todo])
        wide = None if widths is None else np.concatenate([widths[i] for i in todo])
        time, most = np.zeros(len(h)), limit[todo]
        rank = np.full(len(todo) * k, np.inf)
        kept = np.zeros(len(todo) * k, np.uint64)
        while len(h):                          # the next dart of every region
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(_uniform(h))
            alive = time < most[doc]
            h, time, doc = h[alive], time[alive], doc[alive]
            dart = mix(h ^ np.uint64(0xA0761D6478BD642F))
            to = doc * k + (dart % np.uint64(k)).astype(np.int64)
            score = time
            if wide is not None:
                wide = wide[alive]
                score = np.where(_uniform(mix(dart)) < wide, time, np.inf)
            np.minimum.at(rank, to, score)
            first = (rank[to] == score) & (score < np.inf)
            kept[to[first]] = dart[first]
        full = np.isfinite(rank).reshape(-1, k).all(axis=1)
        out[todo[full]] = kept.reshape(-1, k)[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def dart_signature(regions: np.ndarray, k: int, widths: np.ndarray | None = None) -> np.ndarray:
    return dart_signatures([regions], k, None if widths is None else [widths])[0]


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band, with its number in it, for each row of signatures."""
    s = signatures[:, :bands * rows].reshape(-1, bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), s.shape[:2])
    for j in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return acc.view(np.int64)


def sketches(signatures: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    b = ((mix(signatures[:, :bits]) >> np.uint64(33)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(b, axis=1).view(np.int64)


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, text): key is a 64-bit name of the text."""
    d = pick(docs, doc_id=id, text=text)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.xxhash64("text").alias("key"), "text")


def signed(keyed_docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands, sketch) of each row; bands are null without words."""
    ship_package(keyed_docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            bs: list = [None] * len(b)
            sk: list = [None] * len(b)
            at, sets, total = [], [], 0

            def sign() -> None:
                if sets:
                    s = dart_signatures(sets, bands * rows)
                    for i, x, y in zip(at, band_hashes(s, bands, rows), sketches(s), strict=True):
                        bs[i], sk[i] = x, y
                at.clear()
                sets.clear()

            for i, t in enumerate(b["text"]):
                w = alnum_words(t)
                if w:
                    at.append(i)
                    sets.append(strips(w, hashes))
                    total += len(sets[-1]) + bands * rows
                if total > SIGN_TOGETHER:
                    sign()
                    total = 0
            sign()
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"],
                                "bands": bs, "sketch": sk})

    return keyed_docs.mapInPandas(run, _SIGNED)


def exact_strips(texts: DataFrame) -> DataFrame:
    """(key, strips): the weighted set of each text as sorted 32-bit names."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = [np.unique((strips(alnum_words(t), hashes) >> np.uint64(32))
                             .astype(np.uint32)).view(np.int32) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "strips": out})

    return texts.mapInPandas(run, "key long, strips array<int>")


def sets_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, strips) of the texts with the given keys; no other text is read whole."""
    used = checkpointed(keys.select("key").distinct())
    return written(exact_strips(bounded_join(texts, used, "key", "left_semi")), "strips")


def reach(sets: DataFrame) -> DataFrame:
    """(key, n, common): the size of each set and how many of its members any other
    of the sets has too. No two sets can share more than the smaller ``common``."""
    each = sets.select("key", F.explode("strips").alias("strip"))
    often = each.groupBy("strip").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    common = each.join(often, "strip").groupBy("key").agg(F.count(F.lit(1)).alias("common"))
    return sets.select("key", F.size("strips").alias("n")).join(common, "key").select(
        "key", "n", "common")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) key pairs whose weighted Jaccard similarity is ``threshold`` or
    more; a pair meets its two sets by key."""
    first = sets.select(F.col("key").alias("a"), F.col("strips").alias("_a"))
    second = sets.select(F.col("key").alias("b"), F.col("strips").alias("_b"))
    both = pairs.join(first, "a").join(second, "b")
    # sizes bound the similarity: the intersection is only taken where they allow it
    small, large = F.least(F.size("_a"), F.size("_b")), F.greatest(F.size("_a"), F.size("_b"))
    common, both_sizes = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    return both.filter((small >= large * threshold - 1e-9)
                       & (common * (1 + threshold) >= both_sizes * threshold - 1e-9)
                       ).select("a", "b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(key, class): the smallest key each key is connected with.

    Each round every key takes the smallest class among its neighbours and then
    the class of its class; stars settle in two rounds and chains in a number of
    rounds that grows with the logarithm of their length. The rounds end when
    nothing changes.
    """
    edges = checkpointed(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                         .union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
                         .distinct())
    label = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"))
                         .select(F.col("u").alias("key"), F.least("u", "m").alias("class")))
    for _ in range(most_rounds):
        seen = (edges.join(label.withColumnRenamed("key", "v"), "v")
                .groupBy("u").agg(F.min("class").alias("m")))
        hooked = (label.join(seen.withColumnRenamed("u", "key"), "key")
                  .select("key", F.col("class").alias("was"),
                          F.least("class", "m").alias("to")))
        # a class follows the smallest class any of its members has found
        moved = hooked.groupBy("was").agg(F.min("to").alias("best"))
        step = hooked.join(moved, "was").select("key", "was", F.least("to", "best").alias("to"))
        far = label.select(F.col("key").alias("to"), F.col("class").alias("far"))
        new = checkpointed(step.join(far, "to", "left").select(
            "key", "was", F.least("to", F.coalesce("far", "to")).alias("class")))
        changed = new.filter("was <> class").limit(1).count()
        label = new.select("key", "class")
        if not changed:
            return label
    raise RuntimeError(f"classes did not settle in {most_rounds} rounds")


def links(marks: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): verified links between distinct texts that connect all that share
    a bucket and are similar. ``marks`` has (key, bands, sketch), one row per text."""
    buckets = marks.select("key", F.explode("bands").alias("hash"))
    # buckets of one member go nowhere
    full = buckets.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = written(buckets.join(full, "hash"), "buckets")
    shared = member.groupBy("key").agg(F.sum("n").alias("shared"))
    centre = (member.join(shared, "key").groupBy("hash")
              .agg(F.max(F.struct("shared", "key")).alias("top"))
              .select("hash", F.col("top.key").alias("centre")))
    stars = written(
        member.join(centre, "hash").filter("key <> centre")
        .select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))
        .distinct(), "star-pairs")
    ends = stars.select(F.explode(F.array("a", "b")).alias("key"))
    good = written(verified(stars, sets_of(ends, texts), threshold), "star-links")
    # buckets with members of several classes: pairs across classes
    classed = written(
        member.select("key", "hash").join(components(good), "key", "left")
        .withColumn("class", F.coalesce("class", "key")), "classed")
    split = (classed.groupBy("hash").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .filter("lo <> hi").select("hash"))
    left = written(classed.join(split, "hash"), "split-buckets")
    # a text most of whose shingles no other text in question has cannot be similar
    sets = sets_of(left, texts)
    able = checkpointed(reach(sets).filter(F.col("common") >= F.col("n") * threshold - 1e-9))
    left = written(left.join(able, "key").join(marks, "key"), "able-buckets")
    x, y = (left.select("hash", *[F.col(c).alias(f"{s}_{c}") for c in
                                  ("key", "class", "sketch", "bands", "n", "common")])
            for s in "ab")
    most = F.least("a_common", "b_common") * (1 + threshold)
    differ = sum((F.bit_count(F.get("a_sketch", i).bitwiseXOR(F.get("b_sketch", i)))
                  for i in range(1, SKETCH_BITS // 64)),
                 F.bit_count(F.get("a_sketch", 0).bitwiseXOR(F.get("b_sketch", 0))))
    cross = (x.join(y, (x["hash"] == y["hash"]) & (F.col("a_key") < F.col("b_key"))
                    & (F.col("a_class") != F.col("b_class"))
                    & (most >= (F.col("a_n") + F.col("b_n")) * threshold - 1e-9)
                    & (differ <= int(SKETCH_BITS * (1 - SKETCH_MIN)))
                    # a pair that shares several buckets is made in the first of them
                    & (F.get(F.array_intersect("a_bands", "b_bands"), 0) == x["hash"]))
             .select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
             .join(stars, ["a", "b"], "left_anti"))
    more = verified(written(cross, "cross-pairs"), sets, threshold)
    return written(good.union(more), "links")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text",
            threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, class, class_id): one row per row of ``docs``. class names
    the class (null without words: a class of its own), class_id is its smallest
    doc_id."""
    known = keyed(docs, id, text)
    sig = written(signed(known, bands, rows), "signatures")
    marks = written(sig.filter("bands is not null").groupBy("key")
                    .agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
                    "marks")
    # equal texts meet before the shuffle, so a text with many copies is one row a task
    texts = known.groupBy("key").agg(F.first("text").alias("text"))
    found = checkpointed(components(links(marks, texts, threshold)))
    named = checkpointed(sig.select("doc_id", "key", F.col("bands").isNotNull().alias("_w"))
                         .join(found, "key", "left")
                         .select("doc_id", "key", F.when(F.col("_w"), F.coalesce("class", "key"))
                                 .alias("class")))
    least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return (named.join(least, "class", "left")
            .select("doc_id", "key", "class",
                    F.when(F.col("class").isNull(), F.col("doc_id"))
                    .otherwise(F.col("class_id")).alias("class_id")))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """All columns of one row of each class: the smallest id, then any of equal
    rows. Rows without words all stay."""
    named = checkpointed(classes(docs, id, text, threshold))
    ident = F.xxhash64(F.col("doc_id").cast("string"), F.col("key"))
    rows = named.filter("class is not null").withColumn("ident", ident)
    keep = (rows.groupBy("class").agg(F.min(F.struct(
        F.col("doc_id").isNull(), "doc_id", "key", "ident")).alias("k"))
        .select(F.col("k.ident").alias("_keep")))
    keep = checkpointed(keep.union(named.filter("class is null").select(ident).distinct()))
    names = docs.columns
    own = F.xxhash64(F.col(f"`{id}`").cast("long").cast("string"),
                     F.xxhash64(F.col(f"`{text}`")))
    d = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)],
                    own.alias("_own"))
    kept = bounded_join(d, keep, F.col("_own") == F.col("_keep"), "left_semi")
    # equal rows (same id, same text): one of them, and only these are regrouped
    again = checkpointed(rows.groupBy("ident").agg(F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select(F.col("ident").alias("_again")))
    once = bounded_join(kept, again, F.col("_own") == F.col("_again"), "left_anti")
    several = bounded_join(kept, again, F.col("_own") == F.col("_again"), "left_semi")
    out = once.unionByName(several.dropDuplicates(["_own"]))
    return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)])
