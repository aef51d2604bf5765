"""WARC records, and not-modified revisits resolved to the responses they stand for.

A revisit is joined as of its time, by canonical URL, to the latest full response before it. Time is cut into periods: within
a period a window finds the base, and what earlier periods end with comes from a window over one row for each URL and
period, so a URL with very many captures is never sorted in one task. Validators are compared, and the headers that a
not-modified reply may change are merged over the stored ones.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

#: Headers of a not-modified reply that do not replace stored ones (fixed values: they describe the reply's own body or connection).
KEPT_FROM_RESPONSE = ("connection", "content-encoding", "content-length", "content-range", "content-type", "set-cookie", "transfer-encoding")
#: Query parameters that do not tell pages apart.
TRACKING = "ref|fbclid|gclid|sessionid|utm_[a-z]+"
PERIOD_S = 86_400
_HEADERS = "array<struct<name:string,value:string>>"


# ---------------------------------------------------------------- files


def format_record(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own unless told otherwise. Content-Length is added."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a plain or gzipped file. A cut-off last record ends the file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers.get("content-length", 0))
            block = stream.read(size)
            if len(block) < size:
                return
            yield headers, block
    except EOFError:
        return


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers, body) of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    status = first.split(" ")[1] if first.startswith("HTTP/") and " " in first else ""
    pairs = [(a.strip().lower(), b.strip()) for a, _, b in (x.partition(":") for x in lines) if a.strip()]
    return int(status) if status.isdigit() else None, pairs, body


_RECORD = f"record_id string, warc_type string, url string, ts string, status int, headers {_HEADERS}, digest string, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files (plain or gzipped) under a path that Spark reads; ts in epoch seconds."""

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for h, block in parse_records(content):
                    if h.get("warc-type") in ("response", "revisit"):
                        status, headers, body = split_http(block)
                        rows.append({"record_id": h.get("warc-record-id"), "warc_type": h["warc-type"], "url": h.get("warc-target-uri"), "ts": h.get("warc-date"), "status": status, "headers": [{"name": k, "value": v} for k, v in headers], "digest": h.get("warc-payload-digest"), "body": body})
                kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
                schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("status", pa.int32()), ("headers", kind), ("digest", pa.string()), ("body", pa.binary())])
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    files = prepare(spark).read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _RECORD).withColumn("ts", F.unix_timestamp(F.try_to_timestamp("ts")))


# ---------------------------------------------------------------- resolution


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port; no scheme, fragment, tracking parameters or slash at the end; parameters sorted. Null is ''."""
    u = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(u, "^([^/?]*)", 1)
    rest = F.substring(u, F.length(host) + 1, F.lit(2**31 - 1))
    plain = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/+$", "")
    query = F.substring(rest, F.length(F.regexp_extract(rest, "^([^?]*)", 1)) + 2, F.lit(2**31 - 1))
    kept = F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(f"^({TRACKING})(=.*)?$"))
    return F.concat(plain, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """First value of a header, or null."""
    return F.get(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"]), F.lit(0))


def resolve_revisits(records: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """records: record_id, warc_type, url, ts (epoch seconds), status, headers, digest; more columns are left out.

    Returns a row for each revisit: record_id, url_key, ts, outcome, base_id, status, headers, digest. outcome is `resolved`;
    `no-base` without an earlier full response (status 200, or null, of type response; of equal times the larger record_id);
    `changed` if validators differ; `unchecked` if the two share no validator. Validators in order: ETag (weak comparison),
    Last-Modified, payload digest. Only resolved rows have the base's status and digest and merged headers, sorted by
    name. Records without a time are never a base, and a revisit without one has no base. Records without a URL (null, blank, or
    nothing but a scheme) are no one's base and have none. Repeated rows stay repeated. Headers of any length are kept whole.
    An empty table gives an empty result.
    """
    prepare(records.sparkSession)
    lower = F.transform(F.coalesce(F.col("headers"), F.from_json(F.lit("[]"), _HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    base = F.struct("ts", "record_id", "status", "headers", "digest")
    rows = records.select("record_id", "warc_type", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"), lower.alias("headers"), "digest")
    bare = rows.where("url_key = '' and warc_type = 'revisit'")
    rows = rows.where("url_key <> ''")
    full = (F.col("warc_type") == "response") & (F.coalesce("status", F.lit(200)) == 200) & F.col("ts").isNotNull()
    rows = rows.withColumn("period", F.floor(F.col("ts") / period_s)).withColumn("base", F.when(full, base)).where(full | (F.col("warc_type") == "revisit"))
    ends = rows.where(full).groupBy("url_key", "period").agg(F.max("base").alias("end"))
    revisited = rows.where(F.col("warc_type") == "revisit").select("url_key", "period").distinct()
    line = ends.unionByName(revisited.withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))).groupBy("url_key", "period").agg(F.max("end").alias("end"))
    line = line.select("url_key", "period", F.max("end").over(Window.partitionBy("url_key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy("url_key", "period").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("near", F.when(F.col("ts").isNotNull(), F.max("base").over(before))).where(F.col("warc_type") == "revisit")
    met = own.join(line, ["url_key", "period"], "left").withColumn("b", F.coalesce("near", "carried"))
    met = met.unionByName(bare, allowMissingColumns=True)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    mine, theirs = F.col("headers"), F.col("b.headers")
    checks = [(weak(header(mine, "etag")), weak(header(theirs, "etag"))), (header(mine, "last-modified"), header(theirs, "last-modified")), (F.col("digest"), F.col("b.digest"))]
    same = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in checks])
    outcome = F.when(F.col("b").isNull(), "no-base").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    out = met.withColumn("outcome", outcome)
    fresh = F.filter(mine, lambda h: ~h["name"].isin(*KEPT_FROM_RESPONSE))
    names = F.transform(fresh, lambda h: h["name"])
    merged = F.array_sort(F.concat(F.filter(theirs, lambda h: ~F.array_contains(names, h["name"])), fresh))
    ok = F.col("outcome") == "resolved"
    return out.select(
        "record_id", "url_key", "ts", "outcome", F.when(F.col("outcome") != "no-base", F.col("b.record_id")).alias("base_id"),
        F.when(ok, F.coalesce("b.status", F.lit(200))).alias("status"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("b.digest")).alias("digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl made of the pages table: a response for each page, a minute apart, and a later visit that found it not modified.

    Every fifth page's visit sends another ETag, every fifth from 1 only Last-Modified, from 2 a weak ETag, and from 3 no validator.
    """
    html = F.coalesce("html", F.lit(""))
    tag, digest = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"')), F.concat(F.lit("md5:"), F.md5(html))
    page, kind = F.col("page_id").cast("long"), F.pmod(F.col("page_id").cast("long"), F.lit(5))
    at = page * 60 + 1_704_067_200
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    modified = F.concat(F.lit("day "), (page % 7).cast("string"))
    stored = F.array(pair("Content-Type", F.lit("text/html")), pair("ETag", tag), pair("Last-Modified", modified), pair("Cache-Control", F.lit("max-age=60")), pair("Date", at.cast("string")))
    sent = F.when(kind == 0, F.array(pair("ETag", F.lit('"other"')))).when(kind == 1, F.array(pair("Last-Modified", modified))).when(kind == 2, F.array(pair("ETag", F.concat(F.lit("W/"), tag)))).when(kind == 3, F.from_json(F.lit("[]"), _HEADERS)).otherwise(F.array(pair("ETag", tag)))
    later = at + 2_592_000 + 30
    common = F.array(pair("Cache-Control", F.lit("max-age=120")), pair("Content-Length", F.lit("0")), pair("Date", later.cast("string")), pair("Set-Cookie", F.lit("s=1")))
    response = pages.select(F.concat(F.lit("r"), page).alias("record_id"), F.lit("response").alias("warc_type"), "url", at.alias("ts"), F.lit(200).alias("status"), stored.alias("headers"), digest.alias("digest"))
    revisit = pages.select(F.concat(F.lit("v"), page).alias("record_id"), F.lit("revisit").alias("warc_type"), "url", later.alias("ts"), F.lit(304).alias("status"), F.concat(sent, common).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return out.select("record_id", "url_key", "ts", "outcome", "base_id", "status", lines.alias("headers"), "digest")


OP3_SQL = rf"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS id, trim(coalesce(url, '')) AS url, md5(coalesce(html, '')) AS m, CAST(page_id AS BIGINT) * 60 + 1704067200 AS tm FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM p),
h AS (SELECT *, regexp_extract(u, '^([^/?]*)', 1) AS host FROM u),
r AS (SELECT *, substr(u, length(host) + 1) AS rest FROM h),
q AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS path, substr(rest, length(regexp_extract(rest, '^([^?]*)', 1)) + 2) AS query FROM r),
k AS (SELECT *, list_sort([x for x in string_split(query, '&') if length(x) > 0 AND NOT regexp_matches(x, '^({TRACKING})(=.*)?$')]) AS kept FROM q),
c AS (SELECT id, m, tm, regexp_replace(regexp_replace(lower(host), '^www[0-9]*[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM k),
v AS (SELECT *, tm + 2592030 AS ts FROM c),
b AS (SELECT v.id, v.url_key, v.ts, v.m, max(struct_pack(tm := s.tm, rid := 'r' || s.id, m := s.m, day := s.id % 7)) AS base
      FROM v LEFT JOIN c s ON s.url_key = v.url_key AND v.url_key <> '' AND s.tm < v.ts GROUP BY ALL),
o AS (SELECT *, CASE WHEN base IS NULL OR base.rid IS NULL THEN 'no-base'
   WHEN id % 5 = 3 THEN 'unchecked' WHEN id % 5 = 0 THEN 'changed'
   WHEN id % 5 = 1 THEN CASE WHEN base.day = id % 7 THEN 'resolved' ELSE 'changed' END
   WHEN substr(base.m, 1, 16) = substr(m, 1, 16) THEN 'resolved' ELSE 'changed' END AS outcome FROM b)
SELECT 'v' || id AS record_id, url_key, ts, outcome, CASE WHEN outcome <> 'no-base' THEN base.rid END AS base_id,
  CASE WHEN outcome = 'resolved' THEN 200 END AS status,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
    || 'etag: ' || CASE WHEN id % 5 = 2 THEN 'W/' ELSE '' END || '"' || substr(base.m, 1, 16) || '"' || chr(10) || 'last-modified: day ' || base.day END AS headers,
  CASE WHEN outcome = 'resolved' THEN 'md5:' || base.m END AS digest
FROM o
"""
