"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is a path of block
elements with their presentation (tag, class, id and role words). Its importance
has two parts. Presentation: the entropy of the child sequences seen there (a
branch that always looks the same is layout). Content: one minus the mean
entropy of its texts over the pages (a text that all pages repeat carries
nothing). Parts are combined from the leaves up, and branches below a threshold
are removed from every page, unless they hold most of its text or are plain
blocks right inside the article. What names itself a menu, header, footer,
sidebar, notice, advert, form or comment is removed before that, also on hosts
with too few pages for statistics; inside the article a word in a longer name
(``related-work``, ``social-history``) only proposes a block, which goes if most of
its text is links or the site's tree finds it unimportant. What is left of the
article (or of ``main``, or of the page where neither is marked) is the text.

Pages of a host with the same text are one page to the statistics: a copy, a
mirror or another spelling of a URL says nothing about the layout. Copies that
differ in a word are pages of their own.

Cases: null or empty html gives an empty text; a null or hostless url shares one
host; repeated pages each give their row and count once; a page's own marks hold at any
depth, the site's statistics judge blocks of up to 64 levels (deeper text counts as
its ancestor's there, and goes or stays with it); very long pages take linear time;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import bounded_join, checkpointed, pick, ship_package, written
from ferrylake.llm.dom import MAX_DEPTH, Node, Page, parse, words_of

GAMMA = 0.9              # how much of a node's importance its branches decide
LOW = 0.3                # branches below this importance are removed
MIN_PAGES = 5            # a host's node must be on so many pages to be judged

# Elements that are never main text.
_NEVER = frozenset("head script style noscript template svg math iframe object nav footer aside "
                   "form button select textarea menu dialog canvas audio video map".split())
# Words in class, id or role that name page furniture, whatever stands beside them ...
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies "
    "consent gdpr popup modal overlay sidebar nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs masthead topbar toolbar comments commentlist disqus share sharing "
    "newsletter subscribe signup login widget widgets pagination pager complementary "
    "contentinfo recommended".split())
# ... and words that an article's own parts may have in a longer name.
_MAYBE = frozenset(
    "banner promotion notice notices alert footer header comment reply replies respond social "
    "related recommendations subscription search".split())
_WORDS = _FURNITURE | _MAYBE
LINKED = 0.5             # a proposed block with so much of its text in links is furniture
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = _HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
_MAIN = frozenset(("article", "main"))

_NODES = ("key long, host string, same long, path long, parent long, depth int, style long, "
          "feats array<long>, feat_n array<int>")


@dataclass
class View:
    """What of a page is main text before the site's statistics. ``proposed``: blocks
    that a word of their name puts in doubt."""

    page: Page
    gone: list[bool]
    roots: list[int]
    proposed: list[bool]


def _is_main(node: Node) -> bool:
    return node.tag in _MAIN or "articlebody" in node.tokens or (
        "main" in node.tokens and "content" in node.tokens)


def _only_furniture(name: str) -> bool:
    words = words_of(name)
    return bool(words) and all(w in _WORDS for w in words)


def _named(node: Node, in_article: bool) -> tuple[bool, bool]:
    """(is furniture by its name, may be).

    Outside the article any such word tells. Inside it a block is furniture if a whole
    name of its class or role, or its whole id, is made of such words; a word that
    always means furniture tells for a wrapper, and only proposes a heading, paragraph,
    list or table; other words only propose."""
    if not node.tokens & _WORDS or node.tag in ("html", "body"):
        return False, False
    if not in_article:
        return True, False
    if node.tag in _HEADINGS:
        return any(map(_only_furniture, node.names)), True
    if any(map(_only_furniture, node.names)) or (
            node.tag not in _PLAIN and _only_furniture(node.ident)):
        return True, False
    return bool(node.tokens & _FURNITURE) and node.tag not in _PLAIN \
        and not _only_ident(node), True


def _only_ident(node: Node) -> bool:
    """The words are in the id alone, which may name a part of the article."""
    return not any(w in _FURNITURE for name in node.names for w in words_of(name))


def _link_share(page: Page) -> list[float]:
    size, linked = [0] * len(page.nodes), [0] * len(page.nodes)
    for k, t in page.segments:
        size[k] += len(t)
    for k, n in page.linked.items():
        linked[k] += n
    for k in range(len(size) - 1, 0, -1):
        size[page.nodes[k].parent] += size[k]
        linked[page.nodes[k].parent] += linked[k]
    return [x / n if n else 0.0 for x, n in zip(linked, size, strict=True)]


def view(text: str) -> View:
    page = parse(text)
    nodes = page.nodes
    in_main = [False] * len(nodes)
    own = [False] * len(nodes)
    soft = [False] * len(nodes)          # a header inside the article: headings stay
    proposed = [False] * len(nodes)
    dense: list[float] = []
    for k, node in enumerate(nodes):
        up = node.parent
        inner = up >= 0 and in_main[up]
        in_main[k] = inner or _is_main(node)
        named, maybe = _named(node, inner)
        header = node.tag == "header" or (named and not node.tokens & _WORDS - {"header"})
        if node.tag in _NEVER or node.hidden:
            own[k] = True
        elif header and inner:
            own[k] = soft[k] = True
        elif header or named:
            own[k] = True
        elif maybe:
            dense = dense or _link_share(page)
            proposed[k] = True
            own[k] = dense[k] >= LINKED

    def spread() -> tuple[list[bool], list[int]]:
        gone = [False] * len(nodes)
        for k, node in enumerate(nodes):
            up = node.parent
            gone[k] = own[k] or (up >= 0 and gone[up])
            if gone[k] and not own[k] and node.tag in _HEADINGS and up >= 0 and soft[up]:
                gone[k] = nodes[up].parent >= 0 and gone[nodes[up].parent]
        return gone, [k for k, node in enumerate(nodes) if _is_main(node) and not gone[k]]

    gone, mains = spread()
    if not mains:
        # a wrapper may name a furniture word and yet hold the article
        first = next((k for k, x in enumerate(nodes) if _is_main(x) and not own[k]), None)
        holder = first if first is not None else _holder(page, own)
        while holder is not None and holder >= 0:
            if nodes[holder].tag not in _NEVER:
                own[holder] = False
            holder = nodes[holder].parent
        gone, mains = spread()
    filled = Counter(k for k, _ in page.segments if not gone[k])
    has = [filled[k] > 0 for k in range(len(nodes))]
    for k in range(len(nodes) - 1, 0, -1):
        has[nodes[k].parent] |= has[k]
    mains = [k for k in mains if has[k]]
    articles = [k for k in mains if nodes[k].tag == "article"]
    return View(page, gone, articles or mains or [0], proposed)


def _holder(page: Page, own: list[bool]) -> int | None:
    """The deepest removed block with more than half of the page's text."""
    size = [0] * len(page.nodes)
    for k, t in page.segments:
        if page.nodes[k].tag not in _NEVER:
            size[k] += len(t)
    for k in range(len(size) - 1, 0, -1):
        if page.nodes[k].tag not in _NEVER:
            size[page.nodes[k].parent] += size[k]
    big = [k for k in range(1, len(size)) if own[k] and 2 * size[k] > size[0]]
    return big[-1] if big else None


def inside(v: View) -> list[bool]:
    """Which nodes are in a root and not gone."""
    nodes, roots = v.page.nodes, set(v.roots)
    ok = [False] * len(nodes)
    for k, node in enumerate(nodes):
        ok[k] = (k in roots or (node.parent >= 0 and ok[node.parent])) and not v.gone[k]
    for k, node in enumerate(nodes):     # headings kept in an article's header
        if not v.gone[k] and node.tag in _HEADINGS and node.parent >= 0 and not ok[k]:
            up = nodes[node.parent].parent
            ok[k] = up >= 0 and ok[up] and v.gone[node.parent]
    return ok


def main_text(text: str | None, low: frozenset[int] = frozenset()) -> str:
    """The main text of a page; ``low`` are the paths its site found unimportant."""
    if not text:
        return ""
    v = view(text)
    ok, nodes = inside(v), v.page.nodes
    if low:
        size = [0] * len(nodes)
        for k, t in v.page.segments:
            if ok[k]:
                size[k] += len(t)
        for k in range(len(nodes) - 1, 0, -1):
            size[nodes[k].parent] += size[k]
        whole = size[0]
        cut = [False] * len(nodes)
        for k, node in enumerate(nodes):
            up = node.parent
            plain = (node.tag in _PLAIN and up >= 0 and nodes[up].tag in _MAIN
                     and not v.proposed[k])
            cut[k] = (up >= 0 and cut[up]) or (
                node.path in low and not plain and k not in v.roots and 2 * size[k] <= whole)
        ok = [a and not b for a, b in zip(ok, cut, strict=True)]
    return "\n".join(t for k, t in v.page.segments if ok[k])


def page_nodes(text: str) -> list[tuple]:
    """(text hash of the page, path, parent path, depth, style, features, their
    counts) of each distinct path of a page that its own marks do not remove, down
    to ``MAX_DEPTH``."""
    v = view(text)
    ok, nodes = inside(v), v.page.nodes
    judged = list(range(len(nodes)))     # the node that a node's text counts for
    for k, node in enumerate(nodes):
        if node.depth > MAX_DEPTH:
            judged[k] = judged[node.parent]
    feats: dict[int, Counter] = {}
    whole = xxhash.xxh64()
    for k, t in v.page.segments:
        if ok[k]:
            whole.update(t + "\n")
            feats.setdefault(nodes[judged[k]].path, Counter())[xxhash.xxh64_intdigest(t) >> 1] += 1
    same = whole.intdigest() >> 1
    out, seen = [], set()
    for k, node in enumerate(nodes):
        if ok[k] and judged[k] == k and node.path not in seen:
            seen.add(node.path)
            f = feats.get(node.path, {})
            parent = nodes[node.parent].path if node.parent >= 0 else 0
            style = xxhash.xxh64_intdigest("|".join(node.children)) >> 1
            out.append((same, node.path, parent, node.depth, style, list(f), list(f.values())))
    return out


def tree_nodes(pages: DataFrame) -> DataFrame:
    """One row per page and path from (key, host, html)."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _NODES.split(", ")]
        for b in batches:
            rows = [(key, host, *x)
                    for key, host, t in zip(b["key"], b["host"], b["html"], strict=True) if t
                    for x in page_nodes(t)]
            for at in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[at:at + 20_000], columns=names)

    return pages.select("key", "host", "html").mapInPandas(run, _NODES)


def distinct_pages(nodes: DataFrame) -> DataFrame:
    """One row per path of the distinct texts of each host, copies merged map-side."""
    one = F.max(F.struct("parent", "depth", "style", "feats", "feat_n")).alias("n")
    return nodes.groupBy("host", "same", "path").agg(one).select("host", "path", "n.*")


def importance(nodes: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, path, pages, importance): the merged tree of each host, combined
    from the leaves up, one depth at a time, from ``distinct_pages``. All steps add
    up map-side first."""
    log_m = F.log(F.col("pages").cast("double"))
    styles = nodes.groupBy("host", "path", "parent", "depth", "style").agg(
        F.count(F.lit(1)).alias("c"))
    shape = (styles.groupBy("host", "path", "parent", "depth")
             .agg(F.sum("c").alias("pages"),
                  F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"))
             .withColumn("looks", F.when(F.col("pages") > 1, (
                 log_m - F.col("clogc") / F.col("pages")) / log_m).otherwise(F.lit(1.0))))
    each = nodes.select("host", "path", F.explode(F.arrays_zip("feats", "feat_n")).alias("f"))
    n = F.col("f.feat_n").cast("double")
    per_text = each.groupBy("host", "path", "f.feats").agg(
        F.sum(n).alias("t"), F.sum(n * F.log(n)).alias("s"))
    spread = per_text.groupBy("host", "path").agg(
        F.avg(F.log("t") - F.col("s") / F.col("t")).alias("nats"))
    tree = checkpointed(
        shape.join(spread, ["host", "path"], "left")
        .withColumn("content", F.when(F.col("nats").isNull(), F.lit(None))
                    .when(F.col("pages") > 1, 1 - F.least(F.col("nats") / log_m, F.lit(1.0)))
                    .otherwise(F.lit(1.0)))
        .select("host", "path", "parent", "depth", "pages", "looks", "content"))
    deepest = tree.agg(F.max("depth")).first()[0]
    done = None
    below = tree.limit(0).select("host", F.col("parent").alias("path"),
                                 F.lit(0.0).alias("kids"), F.lit(0).cast("long").alias("n_kids"))
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.filter(F.col("depth") == depth).join(below, ["host", "path"], "left")
        n_parts = F.coalesce("n_kids", F.lit(0)) + F.col("content").isNotNull().cast("long")
        parts = (F.coalesce("kids", F.lit(0.0)) + F.coalesce("content", F.lit(0.0))) / n_parts
        weight = F.pow(F.lit(gamma), n_parts)
        value = F.when(n_parts == 0, F.col("looks")).when(
            F.coalesce("n_kids", F.lit(0)) == 0, F.col("content")).otherwise(
            (1 - weight) * F.col("looks") + weight * parts)
        level = checkpointed(level.select("host", "path", "parent", "pages",
                                          value.alias("importance")))
        done = level if done is None else done.union(level)
        below = level.groupBy("host", F.col("parent").alias("_p")).agg(
            F.sum("importance").alias("kids"), F.count(F.lit(1)).alias("n_kids")
        ).withColumnRenamed("_p", "path")
    if done is None:
        done = tree.select("host", "path", "parent", "pages", F.lit(0.0).alias("importance"))
    return done.select("host", "path", "pages", "importance")


def texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
          low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text): one row per row of ``pages``."""
    ship_package(pages.sparkSession)
    p = pick(pages, page_id=id, url=url, html=html)
    p = p.withColumn("key", F.xxhash64(F.col("page_id").cast("string"), "url", "html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    nodes = written(tree_nodes(p.withColumn("host", host)), "tree-nodes")
    pages_once = written(distinct_pages(nodes), "tree-pages")
    weak = checkpointed(importance(pages_once).filter(
        (F.col("importance") < low) & (F.col("pages") >= min_pages)).select("host", "path"))
    # a page's list of weak paths is as long as the page's tree at most
    lists = checkpointed(bounded_join(nodes.select("key", "host", "path"), weak,
                                      ["host", "path"], "left_semi")
                         .groupBy("key").agg(F.collect_set("path").alias("weak")))
    joined = bounded_join(p, lists, "key", "left")

    @F.pandas_udf("string")
    def run(html: pd.Series, weak: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, frozenset() if w is None else frozenset(w))
                          for t, w in zip(html, weak, strict=True)], dtype="object")

    return joined.select("page_id", "url", run("html", "weak").alias("text"))
