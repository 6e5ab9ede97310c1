"""WARC: revisit records that say "not modified" get the response that they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import col, table

#: Headers of a "not modified" answer that do not replace those of the stored response: of the connection and of the content.
KEPT = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type")
#: Parameters of a URL that say where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Columns of a record that resolving needs.
COLUMNS = ("record_id", "warc_type", "url", "ts", "status", "headers", "digest", "length")


def canonical_url(url: Column) -> Column:
    """Without scheme, www. and standard port, fragment, tracking parameters and a last slash; host in lower case; parameters sorted.

    Null for null. What is no URL is treated alike, so that equal strings stay equal.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that then are equal the last by name counts."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(entries, lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), F.lower(e["key"])) == 0)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """A row for each revisit: (record_id, canonical, ts, outcome, refers_to, refers_to_ts, digest, length, headers).

    A revisit is a record of type revisit, or a response of status 304; a full response has type response and
    status 200. Each revisit is joined as of its time to the latest full response of the same canonical URL
    that is earlier (at equal times the lesser record_id is the earlier), and only to that one. outcome:

    - no_response: there is none, or the revisit has no URL or time;
    - mismatch: an ETag (compared weakly), else Last-Modified, or a payload digest that both have differs;
    - unvalidated: the revisit carries no such validator that the response has too;
    - resolved: otherwise.

    refers_to is the response joined, null with no_response. Only a resolved revisit gets its digest, length and
    headers: the response's, with those of the revisit put over them but for KEPT; names in lower case, as a map.
    Null headers count as none. Only these columns are read, never a payload; records that are wholly equal
    count each. An empty table gives an empty one.

    One window over canonical URL and time answers all revisits: the records shuffle once, without a join.
    """
    r = records.select(*[col(c) for c in COLUMNS])
    r = r.withColumn("canonical", canonical_url(F.col("url")))
    none = F.create_map().cast("map<string,string>")
    r = r.withColumn("headers", F.coalesce(_lower_keys(F.col("headers")), none))
    revisit = (F.col("warc_type") == "revisit") | (F.coalesce(F.col("status"), F.lit(0)) == 304)
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    r = r.where(revisit | full).withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    answer = F.when(~F.col("revisit"), F.struct("record_id", "ts", "headers", "digest", "length"))
    before = Window.partitionBy("canonical").orderBy(F.col("ts").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("found", F.last(answer, ignorenulls=True).over(before)).where("revisit")
    found = F.when(F.col("ts").isNotNull() & F.col("canonical").isNotNull(), F.col("found"))
    r = r.withColumn("found", found)
    weak = lambda e: F.regexp_replace(F.trim(e), "^W/", "")
    etag = (weak(_header(F.col("headers"), "etag")), weak(_header(F.col("found.headers"), "etag")))
    modified = (_header(F.col("headers"), "last-modified"), _header(F.col("found.headers"), "last-modified"))
    digest = (F.col("digest"), F.col("found.digest"))
    have = lambda p: p[0].isNotNull() & p[1].isNotNull()
    wrong = F.when(have(etag), etag[0] != etag[1]).when(have(modified), modified[0] != modified[1]).otherwise(False) | (have(digest) & F.coalesce(digest[0] != digest[1], F.lit(False)))
    outcome = F.when(F.col("found").isNull(), "no_response").when(wrong, "mismatch").when(~(have(etag) | have(modified) | have(digest)), "unvalidated").otherwise("resolved")
    r = r.withColumn("outcome", outcome)
    new = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    old = F.map_filter("found.headers", lambda k, v: ~F.map_contains_key(new, k))
    good = F.col("outcome") == "resolved"
    return r.select(
        "record_id", "canonical", "ts", "outcome", F.col("found.record_id").alias("refers_to"), F.col("found.ts").alias("refers_to_ts"),
        F.when(good, F.col("found.digest")).alias("digest"), F.when(good, F.col("found.length")).alias("length"), F.when(good, F.map_concat(old, new)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The crawl that the table of pages stands for: of each page two versions a few days apart, visits around them, an error.

    By day, from minute page_id on: -1 a visit that knows the first digest; 0 the first version; 1 a visit with its
    ETag as a weak one; 2 one with Last-Modified only, which for pages whose digest begins with 0 to 3 is not the
    page's; 3 the second version; 4 a visit with its ETag, or with the first one's for pages whose digest begins with
    0 to 7; 5 an error 404; 6 a visit that carries no validator.
    """
    p = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("length")).withColumn("second", F.md5(F.concat("digest", F.lit("-2"))))
    header = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*[v if isinstance(v, Column) else F.lit(v) for v in kv[1::2]]))
    record = lambda k, kind, day, status, headers, digest: F.struct(
        (F.col("page_id") * 8 + k).alias("record_id"), F.lit(kind).alias("warc_type"), (F.col("page_id") + day * 1440).alias("ts"), F.lit(status).alias("status"), headers.alias("headers"), digest.alias("digest")
    )
    none = F.lit(None).cast("string")
    quoted = lambda d: F.concat(F.lit('"'), F.substring(d, 1, 16), F.lit('"'))
    full = lambda k, day, d, m, date: record(k, "response", day, 200, header("Content-Type", "text/html", "Content-Length", F.col("length").cast("string"), "ETag", quoted(d), "Last-Modified", F.concat(F.lit(m), F.col("page_id")), "Date", date, "Cache-Control", "no-cache"), F.col(d))
    other = F.concat(F.lit("m-"), F.col("page_id"), F.when(F.substring("digest", 1, 1) < "4", "-changed").otherwise(""))
    made = F.array(
        record(0, "revisit", -1, 304, header("Date", "before"), F.col("digest")),
        full(1, 0, "digest", "m-", "first"),
        record(2, "revisit", 1, 304, header("ETag", F.concat(F.lit("W/"), quoted("digest")), "Content-Length", "0", "Date", "second", "Cache-Control", "max-age=60"), none),
        record(3, "revisit", 2, 304, header("Last-Modified", other, "Date", "third", "Connection", "close", "Expires", "never"), none),
        full(4, 3, "second", "m2-", "fourth"),
        record(5, "response", 4, 304, header("ETag", F.when(F.substring("digest", 1, 1) < "8", quoted("digest")).otherwise(quoted("second")), "Date", "fifth"), none),
        record(6, "response", 5, 404, header("ETag", '"none"'), none),
        record(7, "revisit", 6, 304, header("Date", "seventh"), none),
    )
    return p.select("url", "length", F.explode(made).alias("r")).select("url", F.when(F.col("r.status") == 200, F.col("length")).alias("length"), "r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of all pages; -1 and empty texts stand for nulls, headers are lines in order of name."""
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    text = {"digest": F.col("digest"), "headers": F.array_join(lines, "\n")}
    numbers = {c: F.coalesce(F.col(c), F.lit(-1).cast("long")) for c in ("refers_to", "refers_to_ts", "length")}
    return out.withColumns(numbers | {k: F.coalesce(v, F.lit("")) for k, v in text.items()})


QUERIES = {"op1_warc_revisits": op1_warc_revisits}
SQL = {
    "op1_warc_revisits": f"""
        WITH u AS (
            SELECT page_id, md5(html) AS digest, strlen(html)::BIGINT AS length,
                regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
        c AS (
            SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)'))) AS q FROM u),
        p AS (
            SELECT page_id, digest, length, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '')
                || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
                || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
        full_ AS (
            SELECT page_id * 8 + 1 AS id, canonical, page_id AS ts, digest, length, 'm-' || page_id AS modified FROM p
            UNION ALL SELECT page_id * 8 + 4, canonical, page_id + 4320, md5(digest || '-2'), length, 'm2-' || page_id FROM p),
        visits AS (
            SELECT page_id * 8 AS record_id, canonical, page_id - 1440 AS ts, NULL AS etag, NULL AS modified, digest, 0 AS k FROM p
            UNION ALL SELECT page_id * 8 + 2, canonical, page_id + 1440, substr(digest, 1, 16), NULL, NULL, 2 FROM p
            UNION ALL SELECT page_id * 8 + 3, canonical, page_id + 2880, NULL,
                'm-' || page_id || CASE WHEN substr(digest, 1, 1) < '4' THEN '-changed' ELSE '' END, NULL, 3 FROM p
            UNION ALL SELECT page_id * 8 + 5, canonical, page_id + 5760,
                substr(CASE WHEN substr(digest, 1, 1) < '8' THEN digest ELSE md5(digest || '-2') END, 1, 16), NULL, NULL, 5 FROM p
            UNION ALL SELECT page_id * 8 + 7, canonical, page_id + 8640, NULL, NULL, NULL, 7 FROM p),
        j AS (
            SELECT v.*, f.id AS refers_to, f.ts AS refers_to_ts, f.digest AS f_digest, f.length AS f_length, f.modified AS f_modified FROM visits v
            LEFT JOIN full_ f ON f.canonical = v.canonical AND (f.ts < v.ts OR f.ts = v.ts AND f.id < v.record_id)
            QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC NULLS LAST, f.id DESC) = 1),
        o AS (
            SELECT *, CASE WHEN refers_to IS NULL THEN 'no_response' WHEN k = 7 THEN 'unvalidated'
                WHEN k = 0 AND digest <> f_digest OR k IN (2, 5) AND etag <> substr(f_digest, 1, 16) OR k = 3 AND modified <> f_modified THEN 'mismatch'
                ELSE 'resolved' END AS outcome FROM j)
        SELECT record_id, canonical, ts, outcome, coalesce(refers_to, -1) AS refers_to, coalesce(refers_to_ts, -1) AS refers_to_ts,
            CASE WHEN outcome = 'resolved' THEN f_digest ELSE '' END AS digest, CASE WHEN outcome = 'resolved' THEN f_length ELSE -1 END AS length,
            CASE WHEN outcome = 'resolved' THEN
                'cache-control: ' || CASE k WHEN 2 THEN 'max-age=60' ELSE 'no-cache' END || chr(10)
                || 'content-length: ' || f_length || chr(10) || 'content-type: text/html' || chr(10)
                || 'date: ' || CASE k WHEN 0 THEN 'before' WHEN 2 THEN 'second' WHEN 3 THEN 'third' ELSE 'fifth' END || chr(10)
                || 'etag: ' || CASE k WHEN 2 THEN 'W/' ELSE '' END || '"' || substr(f_digest, 1, 16) || '"' || chr(10)
                || CASE k WHEN 3 THEN 'expires: never' || chr(10) ELSE '' END || 'last-modified: ' || f_modified ELSE '' END AS headers
        FROM o""",
}
