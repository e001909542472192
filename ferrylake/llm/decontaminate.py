"""Benchmark decontamination by a distributed positional inverted index.

The documents' postings (term, document, position) of all test terms are
stored as a table. Every test window is then looked up from its rarest terms:
their lists, moved back by the term's offset, are intersected, and the few
places that remain are checked word by word for the exact phrase. A proximity
search intersects the same lists within a distance instead.

All steps are DataFrame operations. The tables that are broadcast come from the
test set, behind a count; beyond it the same joins shuffle.

Cases: a null or empty text has no words; a null doc_id or item_id is kept (a
null item_id counts as an item and has no place in the digest); equal items each
count; repeated document rows each get their result; a window that occurs many
times hits each of its words once; empty tables give empty or clean results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import bounded_join, checkpointed, pick, written

# Fixed values of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A term no text can hold: its posting marks the end of a document.
END_TERM = "\u0001"
ANCHORS = 2                  # rarest terms whose lists are intersected


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that fast where the text has no other
    capital letters; the character map is for texts that have some."""
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def with_key(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc_id, text, key): the key names the id and text of a row."""
    d = pick(docs, doc_id=id, text=text)
    return d.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))


def windows(items: DataFrame, id: str = "item_id", text: str = "text",
            size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, words) with one row per distinct window, and (window, item,
    item_id): which item rows it comes from. An item of fewer words, but not
    none, is one window."""
    i = pick(items, item_id=id, _text=text)
    i = checkpointed(i.withColumn("item", F.monotonically_increasing_id())
                     .withColumn("_w", words(F.col("_text"))).drop("_text"))
    at = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    cut = (i.filter(F.size("_w") > 0)
           .select("item", "item_id", F.explode(F.transform(
               at, lambda k: F.slice(F.col("_w"), k, size))).alias("words")))
    cut = cut.withColumn("window", F.sha2(F.array_join("words", " "), 256))
    cut = checkpointed(cut)
    distinct = cut.groupBy("window").agg(F.first("words").alias("words"))
    return distinct, cut.select("window", "item", "item_id").distinct()


def postings(docs: DataFrame, terms: DataFrame, id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The stored index: (term, key, doc_id, pos) of every occurrence of the
    ``terms`` (term, word) in ``docs``, and an end posting per document row whose
    position is its number of words."""
    d = with_key(docs, id, text)
    all_words = F.concat(words(F.col("text")), F.array(F.lit(END_TERM)))
    placed = d.select("key", "doc_id", F.posexplode(all_words).alias("pos", "word"))
    end = terms.sparkSession.createDataFrame([(None, END_TERM)], "term long, word string")
    hit = bounded_join(placed, checkpointed(terms.union(end)), "word")
    return written(hit.select("term", "key", "doc_id", F.col("pos").cast("int").alias("pos")),
                   "postings")


def term_table(distinct: DataFrame) -> DataFrame:
    """(term, word): each distinct word of the windows with its 64-bit name."""
    w = distinct.select(F.explode("words").alias("word")).distinct()
    return checkpointed(w.select(F.xxhash64("word").alias("term"), "word"))


def anchors(distinct: DataFrame, terms: DataFrame, index: DataFrame,
            n: int = ANCHORS) -> DataFrame:
    """(window, term, offset, rank): the rarest terms of each window by their
    number of postings, the rarest first; windows with an unseen term are left out."""
    freq = index.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = (distinct.select("window", F.size("words").alias("len"),
                              F.posexplode("words").alias("offset", "word"))
              .join(terms, "word").join(freq, "term"))
    order = F.array_sort(F.collect_list(F.struct("n", "offset", "term")))
    ranked = (placed.groupBy("window", "len").agg(order.alias("_t"))
              .filter(F.size("_t") == F.col("len")))
    return checkpointed(
        ranked.select("window", F.least("len", F.lit(n)).alias("need"),
                      F.posexplode(F.slice("_t", 1, n)).alias("rank", "_t"))
        .select("window", "need", "rank", F.col("_t.term").alias("term"),
                F.col("_t.offset").alias("offset")))


def _anchor_hits(index: DataFrame, rare: DataFrame) -> DataFrame:
    """Postings of the anchor terms as the place where their window would start."""
    hit = bounded_join(index.filter("term is not null").select("term", "key", "pos"),
                       rare, "term")
    return hit.select("key", "window", "need", "rank",
                      (F.col("pos") - F.col("offset")).alias("start"))


def candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(key, window, start) where the anchor lists of a window, moved back by
    their offsets, all meet (merged by place, map-side first)."""
    merged = (_anchor_hits(index, rare).filter("start >= 0")
              .groupBy("key", "window", "start", "need")
              .agg(F.expr("bit_or(shiftleft(1, rank))").alias("_met")))
    return merged.filter("_met = shiftleft(1, need) - 1").select("key", "window", "start")


def proximity_matches(docs: DataFrame, distinct: DataFrame, terms: DataFrame, index: DataFrame,
                      distance: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, window, start, len): places where every word of a window stands within
    ``distance`` words of where the phrase would have it, reckoned from an occurrence of
    the window's rarest term; ``start`` is where the phrase would begin (it can lie before
    the document). Distance 0 gives the exact places.

    The lists of the two rarest terms are intersected within the distance (joined on
    blocks of so many positions, so a list meets neighbouring blocks only); at the places
    left all words are looked for. Windows with a term that no document has match nowhere.
    """
    moved = _anchor_hits(index, anchors(distinct, terms, index))
    width = max(distance, 1)
    first = moved.filter("rank = 0").select("key", "window", "need", "start")
    a = first.filter("need > 1").withColumn(
        "_b", F.explode(F.array(*[F.floor(F.col("start") / width) + k for k in (-1, 0, 1)])))
    b = (moved.filter("rank = 1").withColumn("_b", F.floor(F.col("start") / width))
         .select("key", "window", F.col("start").alias("_at"), "_b"))
    two = a.join(b, ["key", "window", "_b"]).filter(
        F.abs(F.col("_at") - F.col("start")) <= distance).select("key", "window", "start")
    places = two.union(first.filter("need = 1").select("key", "window", "start")).distinct()

    def near(words: Column, p: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(p["words"]) - 1)
        return F.forall(at, lambda k: F.array_contains(
            F.slice(words, F.greatest(p["start"] + k - distance, F.lit(0)) + 1,
                    F.greatest(p["start"] + k + distance + 1, F.lit(0))
                    - F.greatest(p["start"] + k - distance, F.lit(0))),
            F.get(p["words"], k)))

    return _checked(docs, written(places, "near-places"), distinct, near, id, text)


def exact_matches(docs: DataFrame, places: DataFrame, distinct: DataFrame,
                  id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, window, start, len): the places whose words are the window's.

    Only documents with a place have their words cut again; texts meet their
    places by key, which names a text, so equal rows need no care.
    """
    return _checked(docs, places, distinct, lambda words, p: F.slice(
        words, p["start"] + 1, F.size(p["words"])) == p["words"], id, text)


def _checked(docs: DataFrame, places: DataFrame, distinct: DataFrame,
             same: Callable[[Column, Column], Column], id: str, text: str) -> DataFrame:
    """The places at which ``same`` holds for the document's words."""
    known = bounded_join(places, checkpointed(distinct), "window")
    per_doc = known.groupBy("key").agg(
        F.collect_list(F.struct("window", "start", "words")).alias("places"))
    d = with_key(docs, id, text).select("key", "text").join(per_doc, "key")
    d = d.withColumn("_w", words(F.col("text")))
    kept = F.filter("places", lambda p: same(F.col("_w"), p))
    return (d.select("key", F.explode(kept).alias("p"))
            .select("key", "p.window", "p.start", F.size("p.words").alias("len"))
            .distinct())


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                 doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 size: int = WINDOW) -> DataFrame:
    """One row per document row: (key, doc_id, n_words, n_hit, n_items, item_ids,
    items_sha256, contaminated)."""
    distinct, of_item = windows(items, item_id, item_text, size)
    index, found = search(docs, distinct, doc_id, doc_text)
    return report(index, found, of_item)


def search(docs: DataFrame, distinct: DataFrame, id: str = "doc_id",
           text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` and the exact matches of the windows in it."""
    terms = term_table(distinct)
    index = postings(docs, terms, id, text)
    places = written(candidates(index, anchors(distinct, terms, index)), "places")
    return index, written(exact_matches(docs, places, distinct, id, text), "matches")


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                         doc_text: str = "text", item_id: str = "item_id",
                         item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no window of an item occurs."""
    distinct, _ = windows(items, item_id, item_text, size)
    _, found = search(docs, distinct, doc_id, doc_text)
    hit = checkpointed(found.select(F.col("key").alias("_hit")).distinct())
    names = docs.columns
    own = F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{doc_text}`"))
    d = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(names)],
                    own.alias("_own"))
    kept = bounded_join(d, hit, F.col("_own") == F.col("_hit"), "left_anti")
    return kept.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(names)])


def report(index: DataFrame, found: DataFrame, of_item: DataFrame) -> DataFrame:
    covered = F.array_distinct(F.flatten(F.transform(
        F.collect_set(F.struct("start", "len")),
        lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    hits = found.groupBy("key").agg(F.size(covered).cast("long").alias("n_hit"))
    by_item = bounded_join(found.select("key", "window").distinct(), checkpointed(of_item),
                           "window").select("key", "item", "item_id").distinct()
    names = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    per_item = by_item.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"),
                                          names.alias("item_ids"))
    ends = index.filter("term is null").select("key", "doc_id", F.col("pos").cast("long")
                                            .alias("n_words"))
    out = ends.join(hits.join(per_item, "key"), "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), ids.alias("item_ids"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))
