"""Near duplicates, pages, URLs, revisits."""

import collections
import random

import numpy as np
import pytest
from fixture_tables import table  # noqa: F401
from pyspark.sql import functions as F

from ferrylake.llm import htmltext, neardup, urlfilter, warc
from ferrylake.llm.words import WordHashes, alnum_words

DOCS = "doc_id long, text string, source string"


# --- near duplicates ---------------------------------------------------------

def weighted_sets(rows):
    out = []
    for _, t in rows:
        w = alnum_words(t)
        g = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 \
            else collections.Counter([tuple(w)] if w else [])
        out.append(frozenset((x, i) for x, n in g.items() for i in range(n)))
    return out


def classes_by_hand(rows, threshold=0.8):
    sets, up = weighted_sets(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(rows)]


def family(rng, n, length, edits):
    base = [f"w{rng.randrange(5_000)}" for _ in range(length)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(length)] = f"e{rng.randrange(10 ** 6)}"
        yield " ".join(copy)


def test_classes_equal_brute_force(spark, table):
    rng = random.Random(4)
    texts = [None, "", "...", "a b", "A, b!", "a b", "one two three four five"]
    for k in range(12):
        texts += list(family(rng, 8, 60 + 20 * k, 12))
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(80)) for _ in range(60)]
    texts += ["spam line here now again " * 200, "spam line here now again " * 190, "x " * 40_000]
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, texts[9]), (None, texts[20])]
    got = neardup.classes(table(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = classes_by_hand(rows)
    wrong = collections.Counter((r.doc_id, r.class_id) for r in got) - collections.Counter(want)
    # a link is missed in three of a thousand pairs right at the threshold
    assert sum(wrong.values()) <= 1, wrong


def test_one_of_each(spark, table):
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, "s"), (1, long, "s"), (2, long + " more", "s"), (1, long, "s"), (4, None, "s"),
            (5, "", "s"), (6, " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(50)), None),
            (None, "nobody knows this text at all", "s")]
    df = table(rows, DOCS)
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 4, 5, 6]


def test_near_dup_empty(spark, table):
    assert neardup.classes(table([], "doc_id long, text string")).count() == 0
    assert neardup.one_of_each(table([], DOCS)).count() == 0


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        k = int(900 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2 ** 63, 900 - k).astype(np.uint64)])
        x, y = neardup.dart_signature(a, 2_048), neardup.dart_signature(b, 2_048)
        assert abs((x == y).mean() - k / (1_800 - k)) < 0.05
    # real weights: a region filled to a half keeps half of its darts
    half = np.full(900, 0.5)
    x, y = neardup.dart_signature(a, 2_048), neardup.dart_signature(a, 2_048, half)
    assert abs((x == y).mean() - 0.5) < 0.05


def test_long_and_short_documents_share_darts():
    h = WordHashes()
    words = [b"w%d" % i for i in range(30_000)]
    x = neardup.dart_signature(neardup.strips(words, h), 256)
    y = neardup.dart_signature(neardup.strips(words[:29_000], h), 256)
    assert (x == y).mean() > 0.9


def test_components_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200)]
    out = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert {r.key: r["class"] for r in out} == want


# --- pages -------------------------------------------------------------------

def site_page(k, body):
    return (f"<html><body><div class='top'><p>Our shop since 1999</p><p>Call us today</p></div>"
            f"<div class='story'><p>{body}</p><p>Second part {k} of {body}</p></div>"
            f"<div class='bottom'><p>All rights are ours</p></div></body></html>")


def test_site_tree_removes_repeated_branches(spark, table):
    rows = [(k, f"http://a.example.com/{k}", site_page(k, f"story {k} tells of thing {k}"))
            for k in range(12)]
    rows += [(50, None, None), (51, "", ""), (52, "http://b.example.com/", site_page(1, "alone")),
             (3, rows[3][1], rows[3][2]), (None, "no scheme", "<p>x  &amp;\n y</p>")]
    df = table(rows, "page_id long, url string, html string")
    out = htmltext.texts(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.text for r in out}
    for k in range(12):
        assert by[k] == f"story {k} tells of thing {k}\nSecond part {k} of story {k} tells of thing {k}"
    assert by[50] == "" and by[51] == "" and by[None] == "x & y"
    assert by[52].startswith("Our shop")           # one page says nothing about its host


def test_copies_of_an_article_keep_its_text(spark, table):
    page = "<article><h1>Same title</h1><p>Same words.</p></article><footer>f</footer>"
    rows = [(k, "http://c.example.com/x", page) for k in range(20)]
    out = htmltext.texts(table(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Same title\nSame words."}


@pytest.mark.parametrize("page", [
    "<article><h1>T</h1><div class=entry><p>One of {0}.</p><p>Two.</p><p>Three.</p></div></article>",
    "<article><h1>T</h1><section><p>One of {0}.</p></section><section><p>Two.</p></section>"
    "<section><p>Three.</p></section></article>",
    "<body><div><h1>T</h1><p>One of {0}.</p><p>Two.</p><p>Three.</p></div></body>",
])
def test_copies_in_a_wrapper_keep_their_text(spark, table, page):
    rows = [(k, f"http://c.example.com/?v={k}", f"<head><!--{k}--></head>" + page.format("all"))
            for k in range(20)]
    # groups of copies, and one page many times
    rows += [(100 + k, f"http://d.example.com/{k}", page.format(k % 3)) for k in range(30)]
    rows += [(200, "http://e.example.com/", page.format("e"))] * 8
    out = htmltext.texts(table(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        n = "all" if r.page_id < 100 else "e" if r.page_id == 200 else (r.page_id - 100) % 3
        assert r.text == f"T\nOne of {n}.\nTwo.\nThree."


def test_copies_do_not_hide_the_layout(spark, table):
    rows = [(k, f"http://a.example.com/{k}", site_page(k % 12, f"story {k % 12} tells of it"))
            for k in range(60)]
    out = htmltext.texts(table(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {
        f"story {k} tells of it\nSecond part {k} of story {k} tells of it" for k in range(12)}


def test_pages_empty_table(spark, table):
    assert htmltext.texts(table([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<body class='no-sidebar'><header><h1>Site</h1></header><div class='with-sidebar'>"
     "<main><article><header><h1>T &amp; u</h1><p>by X</p></header><p>First <b>bold</b>"
     "<p>Second<br>line<ul><li>one<li>two</ul><div class='ad'>Buy</div><aside>s</aside>"
     "<form><p>mail</p></form><section class='comments'><article class='comment'><p>Nice!</p>"
     "</article></section></article></main><div id='sidebar'><p>links</p></div></div>"
     "<div class='cookieNotice'>We use cookies</div><footer>f</footer>",
     "T & u\nFirst bold\nSecond line\none\ntwo"),
    ("<p>a < b &lt; c<script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> -->", "a < b < c"),
    ("plain &eacute;&nbsp;text", "plain é text"),
    ("<div>" * 3_000 + "deep" + "</div>" * 3_000, "deep"),
    ("<a href=\"x" * 2_000, ""),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_marks_hold_below_the_depth_of_the_statistics(spark, table):
    deep = "<div>" * 100
    page = (f"{deep}<nav>menu</nav><div class='advert'>Buy</div><div hidden>no</div>"
            "<p>outside</p><article><h1>T</h1><p>Words.</p><form>mail</form>"
            "<section class='comments'>Nice!</section></article><footer>f</footer>")
    assert htmltext.main_text(page) == "T\nWords."
    plain = f"{deep}<nav>menu</nav><p>Words.</p><footer>f</footer>"
    assert htmltext.main_text(plain) == "Words."
    assert max(n[3] for n in htmltext.page_nodes(plain)) == htmltext.MAX_DEPTH
    # deep text counts for the last block that the statistics judge
    assert [n[3] for n in htmltext.page_nodes(plain) if n[5]] == [htmltext.MAX_DEPTH]
    # and an article below the statistics is the page's text
    rows = [(k, f"http://deep.example.com/{k}", page.replace("Words", f"Words {k}"))
            for k in range(8)]
    out = htmltext.texts(table(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {f"T\nWords {k}." for k in range(8)}


# --- URLs --------------------------------------------------------------------

def test_url_rules(spark, table):
    rows = [(1, "http://A.b.NET/x"), (2, "https://m.example.net/en/1?q"), (3, "http://example.com/de/"),
            (4, "http://example.com/dé"), (5, "http://x.org/fr/1#t"), (6, "http://notexample.com/de/1"),
            (7, None), (8, "nothing"), (9, "http://net"), (10, "http://q.example.net/fr/"),
            (1, "http://A.b.NET/x"), (11, ""), (12, "x://" + "a" * 20_000)]
    out = urlfilter.judge(table(rows, "page_id long, url string")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule) for r in out}
    assert by[1] == ("a.b.net", "/x", "net/") and by[2] == ("m.example.net", "/en/1", "example.net/en/")
    assert by[3] == ("example.com", "/de/", "example.com/de/") and by[4][2] is None
    assert by[5] == ("x.org", "/fr/1", "org/fr/") and by[6][2] is None
    assert by[7] == by[8] == by[11] == ("", "", None)
    assert by[9] == ("net", "", None) and by[10][2] == "net/"
    verdicts = {r.page_id: r.verdict for r in out}
    assert (verdicts[1], verdicts[2], verdicts[3], verdicts[5]) == ("block", "allow", "block", "allow")


def test_url_model_tells_kinds_apart(spark, table):
    rng = random.Random(2)
    def name(chars):
        return "".join(rng.choice(chars) for _ in range(10))
    rows = []
    for k in range(300):
        rows += [(4 * k, f"http://h.net/{name('xyzq')}"), (4 * k + 1, f"http://h.org/fr/{name('abcd')}"),
                 (4 * k + 2, f"http://h.info/{name('xyzq')}"), (4 * k + 3, f"http://h.info/fr/{name('abcd')}")]
    out = urlfilter.judge(table(rows, "page_id long, url string")).collect()
    right = [(r.verdict == "block") == (r.page_id % 4 == 2) for r in out if r.rule is None]
    assert len(right) == 600 and sum(right) >= 580


def test_url_ratio_equals_brute_force(spark, table):
    import math
    bad, good = ["abab", "abc"], ["bcb", "ccc", "ab"]
    rows = [(u, True) for u in bad] + [(u, False) for u in good]
    labelled = spark.createDataFrame(rows, "url string, is_bad boolean")
    counts = urlfilter.gram_counts(labelled, 2)
    ask = spark.createDataFrame([("abcx", 1), ("cab", 2)], "url string, name long")
    got = {r.name: r.score for r in urlfilter.scores(ask, counts, 2, ["name"]).collect()}

    def prob(texts, ctx, c, order=2):
        p = 1 / urlfilter.ALPHABET
        for k in range(min(order, len(ctx)) + 1):
            h = ctx[len(ctx) - k:]
            after = collections.Counter()
            for t in texts:
                t = urlfilter.START + t
                for i in range(1, len(t)):
                    if i >= k and t[i - k:i] == h:
                        after[t[i]] += 1
            n, kinds = sum(after.values()), len(after)
            if n:
                p = (after[c] + kinds * p) / (n + kinds)
        return p
    for name, url in ((1, "abcx"), (2, "cab")):
        t = urlfilter.START + url
        want = sum(math.log(prob(bad, t[:i], t[i])) - math.log(prob(good, t[:i], t[i]))
                   for i in range(1, len(t))) / len(url)
        assert abs(got[name] - want) < 1e-9


def test_url_empty_table(spark, table):
    assert urlfilter.judge(table([], "page_id long, url string")).count() == 0


# --- revisits ----------------------------------------------------------------

CAPTURES = ("record_id long, type string, profile string, url string, ts long, "
            "headers map<string,string>")


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1#x", "https://example.com/a?a=1&b=2&utm_source=y",
            "http://user@example.com/a/?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()} == {"example.com/a?a=1&b=2"}


def resolved_by_hand(rows, canon):
    out = []
    for rid, kind, profile, url, ts, headers in rows:
        if kind != "revisit" or not (profile or "").endswith("server-not-modified"):
            continue
        before = [r for r in rows if r[1] == "response" and r[3] is not None and r[4] is not None
                  and url is not None and ts is not None and canon[r[3]] == canon[url] and r[4] <= ts]
        if not before:
            out.append((rid, "orphan", None))
            continue
        last = max(before, key=lambda r: (r[4], r[0]))
        out.append((rid, warc.check_validators(last[5] or {}, headers or {}), last[0]))
    return collections.Counter(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_resolution_equals_brute_force(spark, partitions):
    rng = random.Random(9)
    urls = ["http://a.com/x", "https://www.a.com/x/", "http://b.com/", "http://c.com/?q=1", None]
    rows = []
    for k in range(400):
        tag = {"etag": f'"{rng.randrange(3)}"', "content-type": "text/html"}
        kind = rng.choice(("response", "revisit", "revisit", "request"))
        profile = warc.NOT_MODIFIED if rng.random() < 0.9 else "identical-payload-digest"
        url = urls[0] if k % 3 == 0 else rng.choice(urls)
        rows.append((k, kind, profile if kind == "revisit" else None, url,
                     rng.choice((None, *range(0, 500, 5))), rng.choice((tag, {}, None))))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, CAPTURES).repartition(4)
    canon = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in urls], "u string")
             .select("u", warc.canonical_url(F.col("u"))).collect()}
    got = warc.resolve(df, partitions).collect()
    assert collections.Counter((r.record_id, r.status, r.original_id) for r in got) == \
        resolved_by_hand(rows, canon)
    assert all((r.headers is not None) == (r.status == "resolved") for r in got)


def test_headers_merge_only_what_may_change():
    stored = {"content-type": "text/html", "etag": '"1"', "cache-control": "a", "x": "1"}
    told = {"content-type": "x", "etag": 'W/"1"', "cache-control": "b", "connection": "x", "x": "2"}
    assert warc.check_validators(stored, told) == "resolved"
    assert warc.merged_headers(stored, told) == {"content-type": "text/html", "etag": 'W/"1"',
                                                 "cache-control": "b", "x": "1"}


def test_records_from_pages_round_trip(spark, table):
    pages = [(k, f"http://h{k % 5}.example.com/p{k}", f"<p>{k}\r\n\r\n</p>") for k in range(60)]
    pages += [(60, None, None)]
    df = table(pages, "page_id long, url string, html string")
    caps = warc.parse_records(warc.captures_of_pages(df)).cache()
    bodies = {r.record_id: r.body for r in caps.filter("type = 'response'").collect()}
    assert bodies == {10 * k: h or "" for k, _, h in pages}
    out = warc.resolve(caps).collect()
    assert len(out) == caps.filter("type = 'revisit'").count() > 60
    assert {r.status for r in out} >= {"resolved", "mismatch"}
    with_body = warc.with_bodies(warc.resolve(caps), caps).collect()
    assert all(r.body == bodies[r.original_id] for r in with_body)
    empty = df.limit(0)
    assert warc.resolve(warc.parse_records(warc.captures_of_pages(empty))).count() == 0


@pytest.mark.parametrize("date, iso", [
    ("2020", "2020-01-01T00:00:00"), ("2020-05", "2020-05-01T00:00:00"),
    ("2020-05-06", "2020-05-06T00:00:00"), ("2020-05-06T07:08Z", "2020-05-06T07:08:00"),
    ("2020-05-06T07:08:09Z", "2020-05-06T07:08:09"),
    ("2020-05-06T07:08:09.5Z", "2020-05-06T07:08:09.500000"),
    ("2020-05-06T07:08:09.123456789Z", "2020-05-06T07:08:09.123456"),
    ("2020-05-06T07:08:09+02", "2020-05-06T05:08:09"),
    ("2020-05-06T07:08+0230", "2020-05-06T04:38:00"),
    ("2020-05-06T07:08:09.25-01:00", "2020-05-06T08:08:09.250000"),
    ("2020-13-06T07:08:09Z", None), ("2020-05-06T07:08:09", None), ("yesterday", None), ("", None),
])
def test_warc_dates(spark, date, iso):
    from datetime import datetime, timedelta, timezone
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {date}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    df = spark.createDataFrame([(1, record)], "record_id long, record string")
    since = datetime(1970, 1, 1, tzinfo=timezone.utc)
    want = iso and (datetime.fromisoformat(iso + "+00:00") - since) // timedelta(microseconds=1)
    row = warc.parse_records(df).first()
    assert (row.ts, row.http_status) == (want, 200)


def test_only_full_answers_carry_forward(spark):
    def record(kind, date, head):
        profile = f"WARC-Profile: {warc.NOT_MODIFIED}\r\n" if kind == "revisit" else ""
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\n{profile}WARC-Target-URI: http://a.com/\r\n"
                f"WARC-Date: {date}\r\n\r\n{head}\r\n\r\n")
    rows = [(1, record("response", "2020-01-01T00:00:00.100Z", 'HTTP/1.1 200 OK\r\nETag: "a"')),
            (2, record("revisit", "2020-01-01T00:00:00.050Z", 'HTTP/1.1 304 X\r\nETag: "a"')),
            (3, record("revisit", "2020-01-01T00:00:00.200Z", 'HTTP/1.1 304 X\r\nETag: "a"'))]
    for k, line in enumerate(("HTTP/1.1 206 Partial Content", "HTTP/1.1 304 Not Modified",
                              "HTTP/1.1 404 Not Found", "HTTP/2 500", "X-No-Status: line")):
        rows.append((10 + k, record("response", f"2020-01-01T00:0{k + 1}Z", line + '\r\nETag: "b"')))
    rows.append((4, record("revisit", "2020-01-02", 'HTTP/1.1 304 X\r\nETag: "a"')))
    df = spark.createDataFrame(rows, "record_id long, record string")
    got = {r.record_id: (r.status, r.original_id)
           for r in warc.resolve(warc.parse_records(df)).collect()}
    assert got == {2: ("orphan", None), 3: ("resolved", 1), 4: ("resolved", 1)}


def test_other_answers_of_pages_change_nothing(spark, table):
    pages = [(k, f"http://h{k % 5}.example.com/p{k}", f"<p>{k}</p>") for k in range(200)]
    df = table(pages, "page_id long, url string, html string")
    plain = warc.parse_records(warc.captures_of_pages(df))
    more = warc.parse_records(warc.captures_of_pages(df, others=True)).cache()
    assert {r[0] for r in more.filter("type = 'response'").select("http_status").collect()} == {
        200, 206, 304, 404, 500}
    assert more.filter("ts is null").count() == 0 < more.filter("ts % 1000000 > 0").count()
    short = warc.captures_of_pages(df).filter(F.col("record").rlike(r"WARC-Date: [^\r]*T\d\d:\d\dZ"))
    assert short.count() > 0
    def rows(caps):
        return sorted((r.record_id, r.ts, r.status, r.original_id or 0, r.original_ts or 0)
                      for r in warc.resolve(caps).collect())
    assert rows(more) == rows(plain)


# --- names inside an article -------------------------------------------------

_KEPT = ['<div style="overflow:hidden"><p>{}</p></div>', '<p title="the hidden truth">{}</p>',
         '<div data-id="banner-7"><p>{}</p></div>', '<div data-src="/p?id=search"><p>{}</p></div>',
         '<h2 id="search-trees">{}</h2>', '<section id="related-work"><p>{}</p></section>',
         '<p class="social-history">{}</p>', '<div aria-hidden="false"><p>{}</p></div>',
         '<div class="display none"><p>{}</p></div>', "<p data-x='a>b hidden'>{}</p>"]
_DROPPED = ['<div style="display:none">{}</div>', "<div hidden>{}</div>", "<p HIDDEN=''>{}</p>",
            '<div style="color:red; DISPLAY : none !important">{}</div>',
            '<div class="ad-slot">{}</div>', '<section id="comments"><p>{}</p></section>',
            '<div class="related"><p>{}</p></div>',
            '<div class="related-posts"><a href=x>{}</a></div>',
            '<ul class="breadcrumb"><li>{}</li></ul>', '<p class="advert">{}</p>',
            '<div class="shareButtons share">{}</div>', "<aside>{}</aside>",
            '<div class="comment-list"><div class=comment>{}</div></div>']


def article_with(block):
    p = "<p>one two three four five six seven eight nine ten</p>"
    return (f"<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1>{p}{block}{p}</article>"
            "<div class='sidebar'>side</div></body></html>")


@pytest.mark.parametrize("block", _KEPT + _DROPPED)
def test_blocks_of_an_article_by_their_attributes(block):
    text = htmltext.main_text(article_with(block.format("the text")))
    assert ("the text" in text) == (block in _KEPT)
    assert text.count("one two") == 2 and "side" not in text and "Home" not in text


def test_site_decides_on_blocks_that_a_name_only_proposes(spark, table):
    """The same ``notice-box`` words on every page of a host are layout, a text of each
    page's own in a block of that name is not."""
    def page(host, k):
        same = host == "same.example"
        said = "Read our terms before use" if same else f"Finding {k}: sample {k * 7} was late"
        own = " ".join(f"w{k}x{i}" for i in range(60))
        return (k, f"http://{host}/{k}",
                f"<body><article><h1>Page {k}</h1><p>{own}</p><div class='notice-box'>"
                f"<p>{said}</p></div></article></body>")
    rows = [page(h, k + 100 * i) for i, h in enumerate(("same.example", "own.example"))
            for k in range(8)]
    out = {r.page_id: r.text for r in htmltext.texts(
        table(rows, "page_id long, url string, html string")).collect()}
    for k, url, _ in rows:
        assert ("terms" in out[k] or "Finding" in out[k]) == ("own." in url), (url, out[k])
