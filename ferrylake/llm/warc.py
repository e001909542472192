"""Not-modified revisits of web archives, resolved by an as-of join.

A capture is a WARC record: ``response`` with status 200 (a full answer; a part
(206), an error or a 304 has no body that a 304 could stand for) or ``revisit`` with
the server-not-modified profile (a 304 answer without a body). Each revisit is joined
to the latest earlier full response of the same canonical URL; its validators
(ETag, else Last-Modified) must agree with the response's, and the headers that
a 304 may update are merged into the stored ones.

Captures are sorted by (canonical URL, time) over range partitions, so one URL
with any number of captures is spread over many tasks. A task reads its captures
in order and carries the last full response; what a task needs from the ones
before it is one row a partition. Bodies are not sorted or moved: a resolved
record names the response whose body it has.

Order within a URL is time, then full responses before revisits of the same
instant (they count as earlier), then record id. Cases: a null URL is a URL of
its own that nothing resolves; a null time sorts first and has no earlier
response; a response without a status line is not a full answer; null or broken headers are empty ones; repeated rows each give their
row; a revisit with no validator in common is ``unverified``; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import checkpointed, let, pick, ship_package, written

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

# Header fields that a 304 must not change in a stored response
# (they describe the body or the connection), RFC 9111 section 3.2.
KEPT_FIELDS = frozenset(("connection", "content-encoding", "content-length", "content-range",
                         "content-type", "keep-alive", "proxy-authenticate",
                         "proxy-authentication-info", "proxy-connection", "te", "trailer",
                         "transfer-encoding", "upgrade"))
# Query parameters that only track a visit.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid",
            "fbclid")

_RESOLVED = ("record_id long, curl string, ts long, status string, original_id long, "
             "original_ts long, headers map<string,string>")


def canonical_url(url: Column) -> Column:
    """One form for URLs of one resource: no scheme, user, ``www.``, default port
    or fragment, host in lower case, no tracking parameters, the others sorted,
    no slash at the end."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""),
                            "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""),
                                             ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~F.lower(
        F.regexp_extract(q, "^[^=]*", 0)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(
        kept, "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """Lower-cased field names to values of an HTTP header block (its first line is
    the status line); a repeated field's values are joined by a comma."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"),
                     lambda x: x.rlike("^[!#$%&'*+.^_`|~0-9A-Za-z-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.lower(F.substring_index(x, ":", 1)).alias("k"),
        F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))

    def merged(ps: Column) -> Column:
        return let(F.array_distinct(F.transform(ps, lambda p: p["k"])),
                   lambda names: F.map_from_arrays(names, F.transform(
                       names, lambda n: F.array_join(F.transform(F.filter(
                           ps, lambda p: p["k"] == n), lambda p: p["v"]), ", "))))

    return let(pairs, merged)


def http_status(block: Column) -> Column:
    """The status code of an HTTP header block's first line, or null."""
    code = F.regexp_extract(F.coalesce(block, F.lit("")), r"^HTTP/\d+(?:\.\d+)? +(\d{3})\b", 1)
    return F.nullif(code, F.lit("")).cast("int")


def warc_micros(date: Column) -> Column:
    """Microseconds since 1970 of a WARC-Date: a year, month, day or minute (its
    first instant in UTC), or a second with any number of decimals; else null."""
    d = F.regexp_replace(F.regexp_replace(date, r"^(\d{4})$", "$1-01"), r"^(\d{4}-\d\d)$", "$1-01")
    d = F.regexp_replace(d, r"^(\d{4}-\d\d-\d\d)$", "$1T00:00Z")
    d = F.regexp_replace(d, r"(T\d\d:\d\d)(Z|[+-])", "$1:00$2")
    d = F.regexp_replace(d, r"([+-]\d\d)(\d\d)?$", "$1:$2")      # a colon in the zone
    d = F.regexp_replace(d, r"([+-]\d\d:)$", "$100")
    whole = d.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.when(whole, F.unix_micros(d.try_cast("timestamp")))


def parse_records(raw: DataFrame, id: str = "record_id", record: str = "record") -> DataFrame:
    """Captures from the text of uncompressed WARC records: (record_id, type,
    profile, url, ts, http_status, headers, body). Times are microseconds since 1970.
    The body is cut from the text only where it is used."""
    d = pick(raw, record_id=id, _r=record)
    r, gap = F.coalesce(F.col("_r"), F.lit("")), "\r\n\r\n"
    head = F.substring_index(r, gap, 2)
    both = let(F.split(head, gap), lambda p: F.struct(
        header_map(F.get(p, 0)).alias("w"), header_map(F.get(p, 1)).alias("h"),
        http_status(F.get(p, 1)).alias("s")))
    body = F.substring(r, F.length(head) + len(gap) + 1, F.length(r))
    # a generator keeps the maps from being made again for each use of them
    d = d.select("record_id", body.alias("body"), F.explode(F.array(both)).alias("_m"))

    def field(name: str) -> Column:
        return F.element_at(F.col("_m.w"), F.lit(name))

    return d.select(
        "record_id", F.lower(field("warc-type")).alias("type"),
        field("warc-profile").alias("profile"), field("warc-target-uri").alias("url"),
        warc_micros(field("warc-date")).alias("ts"), F.col("_m.s").alias("http_status"),
        F.col("_m.h").alias("headers"), "body")


def _weak(tag: str | None) -> str | None:
    if tag is None:
        return None
    return tag[2:] if tag.startswith(("W/", "w/")) else tag


def check_validators(stored: dict[str, str], told: dict[str, str]) -> str:
    """``resolved``, ``mismatch`` or ``unverified`` (no validator in common)."""
    for name in ("etag", "last-modified"):
        a, b = _weak(stored.get(name)), _weak(told.get(name))
        if a is not None and b is not None:
            return "resolved" if a == b else "mismatch"
    return "unverified"


def merged_headers(stored: dict[str, str], told: dict[str, str]) -> dict[str, str]:
    """Stored headers updated by those a 304 may change."""
    named = {x.strip().lower() for x in told.get("connection", "").split(",")}
    return stored | {k: v for k, v in told.items() if k not in KEPT_FIELDS and k not in named}


def _follow(rows, last):
    """(out row or None, last) over captures in order; last = (curl, id, ts, headers)."""
    for r in rows:
        curl, ts = r.curl, None if pd.isna(r.ts) else int(r.ts)
        if curl is None or ts is None:
            if r.full == 0:
                yield (r.record_id, curl, ts, "orphan", None, None, None), last
            continue
        if r.full == 1:
            last = (curl, int(r.record_id), ts, dict(r.headers or {}))
            yield None, last
        elif last is None or last[0] != curl:
            yield (r.record_id, curl, ts, "orphan", None, None, None), last
        else:
            told = dict(r.headers or {})
            status = check_validators(last[3], told)
            merged = merged_headers(last[3], told) if status == "resolved" else None
            yield (r.record_id, curl, ts, status, last[1], last[2], merged), last


def resolve(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """(record_id, curl, ts, status, original_id, original_ts, headers): one row per
    not-modified revisit; status is resolved, mismatch, unverified or orphan.

    ``captures`` has (record_id, type, profile, url, ts, headers) and http_status;
    without that column every response counts as a full one. ts may have any unit.
    Other records than full responses and not-modified revisits are left out.
    """
    spark = captures.sparkSession
    ship_package(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.col("http_status") == 200 if "http_status" in captures.columns else F.lit(True)
    c = captures.select(F.col("record_id").cast("long").alias("record_id"), "type", "profile",
                        canonical_url(F.col("url")).alias("curl"),
                        F.col("ts").cast("long").alias("ts"), "headers",
                        F.coalesce(whole, F.lit(False)).alias("whole"))
    full = (F.col("type") == "response") & F.col("whole")
    revisit = (F.col("type") == "revisit") & F.col("profile").endswith("server-not-modified")
    c = c.filter(full | revisit).select(
        "record_id", "curl", "ts", F.when(full, 1).otherwise(0).alias("full"),
        F.when(full, 0).otherwise(1).alias("rank"), "headers")
    c = written(c, "captures")                # small rows; the ranges are sampled from them
    tie = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    order = ["curl", "ts", "rank", "record_id", "_tie"]
    ranged = in_order(c.withColumn("_tie", tie), parts, order)

    def last_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for b in batches:
            if len(b):
                at = int(b["part"].iat[0])
            f = b[(b["full"] == 1) & b["curl"].notna() & b["ts"].notna()]
            if len(f):
                last = f.iloc[-1]
        if last is not None:
            yield pd.DataFrame([(at, last["curl"], int(last["record_id"]), int(last["ts"]),
                                 dict(last["headers"] or {}))],
                               columns=["part", "curl", "record_id", "ts", "headers"])

    carried = (ranged.mapInPandas(last_of, "part int, curl string, record_id long, ts long, "
                                           "headers map<string,string>")
               .orderBy("part").collect())                 # one row a partition at most
    before: dict[int, tuple] = {}
    last, k = None, 0
    for p in range(ranged.rdd.getNumPartitions()):
        if last:
            before[p] = last
        if k < len(carried) and carried[k]["part"] == p:
            r = carried[k]
            last, k = (r["curl"], r["record_id"], r["ts"], dict(r["headers"] or {})), k + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun = None, False
        for b in batches:
            if not begun and len(b):
                last, begun = before.get(int(b["part"].iat[0])), True
            out = []
            for row, last in _follow(b.itertuples(index=False), last):
                if row is not None:
                    out.append(row)
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _RESOLVED.split(", ")])
            yield frame.astype({"record_id": "Int64", "ts": "Int64", "original_id": "Int64",
                                "original_ts": "Int64"})

    return ranged.mapInPandas(run, _RESOLVED)


def in_order(c: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """Range-partitioned and sorted rows with their partition number, cut from
    their lineage so that both passes see the same ranges."""
    return checkpointed(c.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                        .withColumn("part", F.spark_partition_id()))


def with_bodies(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response (joined by record id)."""
    body = captures.filter(F.col("type") == "response").select(
        F.col("record_id").alias("original_id"), "body")
    return resolved.filter("status = 'resolved'").join(body, "original_id")


def captures_of_pages(pages: DataFrame, id: str = "page_id", url: str = "url",
                      html: str = "html", others: bool = False) -> DataFrame:
    """(record_id, record): WARC records derived from a table of pages, for trying
    the join on real volumes. Each page is a full response at a time that its id
    gives; ids also decide how many revisits follow, under which spelling of the
    URL, whether their validators still agree, and in which form times are written.
    record_id is 10 page_id for the response and 10 page_id + 1 to 3 for its revisits.
    ``others`` adds responses that are not full answers (206, 304, 404, 500), half an
    hour after some full ones, as 10 page_id + 4."""
    p = pick(pages, page_id=id, url=url, html=html)
    h = F.pmod(F.xxhash64(F.col("page_id")), F.lit(1_000_000))
    start = F.lit(1_600_000_000) + h * 30
    etag = F.concat(F.lit('"'), F.hex(F.xxhash64("html")), F.lit('"'))
    eol = "\r\n"

    def stamp(seconds: Column) -> Column:
        t = F.timestamp_seconds(seconds)
        return (F.when(h % 4 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.250001Z'"))
                .when(h % 4 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm'Z'"))
                .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")))

    def http_date(seconds: Column) -> Column:
        return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")

    response = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: response{eol}WARC-Target-URI: "),
        F.coalesce("url", F.lit("")), F.lit(f"{eol}WARC-Date: "), stamp(start),
        F.lit(f"{eol}{eol}HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}"
              f"Content-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit(f"{eol}Cache-Control: max-age=60{eol}ETag: "), F.coalesce(etag, F.lit('""')),
        F.lit(f"{eol}Last-Modified: "), http_date(start - 86_400), F.lit(eol + eol),
        F.coalesce("html", F.lit("")))
    k = F.col("k")
    spelled = F.when(k == 1, F.col("url")).when(
        k == 2, F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"),
                         F.lit("utm_source=feed"))).otherwise(
        F.regexp_replace("url", "^http:", "https:"))
    told = (F.when((h + k) % 7 == 0, F.lit(f'ETag: "changed"{eol}'))
            .when((h + k) % 5 == 0, F.concat(F.lit("Last-Modified: "), http_date(start - 86_400),
                                             F.lit(eol)))
            .when((h + k) % 11 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("ETag: W/"), F.coalesce(etag, F.lit('""')), F.lit(eol))))
    when = start + k * 3_600 - F.when(h % 13 == 0, 4 * 3_600).otherwise(0)
    revisit = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: revisit{eol}WARC-Profile: {NOT_MODIFIED}{eol}"
              "WARC-Target-URI: "), F.coalesce(spelled, F.lit("")),
        F.lit(f"{eol}WARC-Date: "), stamp(when),
        F.lit(f"{eol}{eol}HTTP/1.1 304 Not Modified{eol}Content-Length: 0{eol}"
              f"Cache-Control: max-age="), (h % 600).cast("string"), F.lit(eol), told, F.lit(eol))
    own = p.select((F.col("page_id") * 10).alias("record_id"), response.alias("record"))
    again = (p.withColumn("k", F.explode(F.sequence(F.lit(0), (h % 4).cast("int"))))
             .filter("k > 0")
             .select((F.col("page_id") * 10 + k).alias("record_id"), revisit.alias("record")))
    if not others:
        return own.union(again)
    line = F.element_at(F.array(*map(F.lit, (
        "206 Partial Content", "304 Not Modified", "404 Not Found", "500 Internal Server Error"))),
        (h % 4 + 1).cast("int"))
    other = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: response{eol}WARC-Target-URI: "),
        F.coalesce("url", F.lit("")), F.lit(f"{eol}WARC-Date: "), stamp(start + 1_800),
        F.lit(f"{eol}{eol}HTTP/1.1 "), line,
        F.lit(f'{eol}Content-Type: text/html{eol}ETag: "other"{eol}{eol}not the page'))
    return own.union(again).union(p.filter(h % 3 == 0).select(
        (F.col("page_id") * 10 + 4).alias("record_id"), other.alias("record")))
