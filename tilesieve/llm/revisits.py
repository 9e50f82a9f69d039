"""WARC not-modified revisits, resolved by an as-of join.

A revisit record says that a server answered 304: the page is as it was captured before. It is
resolved by the latest earlier full response of the same canonical URL. Validators are checked (the
entity tag if both records have one, else the modification date if both have one); if they hold,
the record becomes the earlier response with those headers of the revisit that a 304 may update.

The join is a running last value over the records of a URL in order of time. Records are dealt by
ranges of URL, time and id, so that a URL that holds a third of all rows, even at one time, lies in as
many parts as it fills; the last response of each part is carried on to the URL's parts after it.
Only ids, validators and headers move; bodies stay where they are and are fetched by the id of the
record that was found.

Records are read from WARC bytes and written as such by `warc`. `crawl` makes a crawl of a table of
pages: four visits to each page, with addresses written in several ways, changed contents, revisits
before any response, weak, missing and outdated validators.

Defined results: a revisit without an earlier response is `unmatched`; one whose validators differ
is `changed`; one without comparable validators is `unchecked`, and resolved. Records with a null
URL match nothing. Of records of one URL and time, responses come before revisits, and of those the
largest id counts. A record with a null time is not earlier than any. Null header maps are empty.
Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilesieve.llm import warc
from tilesieve.llm.common import cut_lineage

#: Headers that a not-modified answer may update, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, leading `www.` or `m.`, port 80 or 443, tracking parameters, empty query and closing slashes; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_replace(bare, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([?&])&+", "$1"), r"[?&]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?]*", ""), r"/+$", "")
    return F.concat(host, rest)


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit of records: record_id, url_key, captured, status, source_id, headers (merged).

    records: record_id long, url string, captured long, kind string (`response` or `revisit`), etag
    string, modified string, headers map<string,string>.
    """
    known = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        canonical_url(F.col("url")).alias("url_key"),
        F.col("captured").cast("long").alias("captured"),
        (F.col("kind") == "revisit").alias("revisit"),
        "etag",
        "modified",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    ).where(F.col("kind").isin("response", "revisit"))
    by = ["url_key", "captured", "revisit", "record_id"]
    # written, so that a row's part is the same wherever it is read
    known = cut_lineage(known.repartitionByRange(*by)).withColumn("part", F.spark_partition_id())
    full = F.when(~F.col("revisit") & F.col("url_key").isNotNull() & F.col("captured").isNotNull(), F.struct("captured", "record_id", "etag", "modified", "headers"))
    known = known.withColumn("full", full)
    # of each part the last response, and of those the last one before the part
    plain = F.struct("full.captured", "full.record_id")
    ends = known.where(F.col("full").isNotNull()).groupBy("url_key", "part").agg(F.max_by("full", plain).alias("end"))
    order = W.partitionBy("url_key").orderBy("part")
    spans = known.where(F.col("captured").isNotNull() & F.col("url_key").isNotNull()).groupBy("url_key", "part").agg(F.lit(1).alias("_")).join(ends, ["url_key", "part"], "left")
    carried = spans.select("url_key", "part", F.last("end", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    within = W.partitionBy("url_key", "part").orderBy("captured", "revisit", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = known.where(F.col("url_key").isNotNull() & F.col("captured").isNotNull()).withColumn("near", F.last("full", ignorenulls=True).over(within)).where("revisit")
    found = seen.join(carried, ["url_key", "part"], "left").withColumn("hit", F.coalesce("near", "before"))
    none = known.where(F.col("revisit") & (F.col("url_key").isNull() | F.col("captured").isNull())).withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    cols = ["record_id", "url_key", "captured", "etag", "modified", "headers", "hit"]
    every = found.select(*cols).unionByName(none.select(*cols))
    both = lambda c: F.col(c).isNotNull() & F.col(f"hit.{c}").isNotNull()
    status = (
        F.when(F.col("hit").isNull(), "unmatched")
        .when(both("etag"), F.when(_weak("etag") == _weak("hit.etag"), "resolved").otherwise("changed"))
        .when(both("modified"), F.when(F.col("modified") == F.col("hit.modified"), "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    update = F.map_filter(_lower_names("headers"), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(_lower_names("hit.headers"), lambda k, _: ~F.array_contains(F.map_keys("update"), k))
    every = every.withColumn("status", status).withColumn("update", update).withColumn("ok", F.col("status").isin("resolved", "unchecked"))
    return every.select("record_id", "url_key", "captured", "status", F.when(F.col("ok"), F.col("hit.record_id")).alias("source_id"), F.when(F.col("ok"), F.map_concat(kept, "update")).alias("headers"))


def _lower_names(c: str) -> Column:
    """A header map with names in lower case; of names that differ by case alone, the last in code point order counts."""
    entries = F.array_sort(F.map_entries(F.col(c)))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(entries, lambda e, i: F.size(names) - F.array_position(F.reverse(names), F.lower(e["key"])) == i)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def _weak(c: str) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(F.col(c)), r"^W/", "")


def with_bodies(resolved: DataFrame, responses: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """resolved with the body of the response that each revisit stands for."""
    bodies = responses.select(F.col(f"`{id_col}`").cast("long").alias("_source"), F.col(f"`{body_col}`").alias("body"))
    return resolved.join(bodies, F.col("source_id") == F.col("_source"), "left").drop("_source")


#: A crawl visits every page so often, so many seconds apart, from this time on.
VISITS, APART, BEGIN = 4, 2_592_000, 1_700_000_000


def crawl(pages: DataFrame) -> DataFrame:
    """(record_id, warc): the WARC records, as bytes, of a crawl of pages (page_id, url, html).

    Record 4 x page_id + k is visit k. By page_id modulo 8: 0 is first answered in full at visit 2; 1 and
    2 have a new content at visit 1; 3 names an unknown content at visit 2; 4 has no validators; 5 has
    weak tags in revisits; 6 has modification dates only, another one at visit 3; 7 has no tag in
    revisits. Revisits of 1 name the first content at visit 3.
    """
    page, k, way = F.col("page_id").cast("long"), F.col("k"), F.pmod(F.col("page_id").cast("long"), F.lit(8))
    html = F.coalesce("html", F.lit(""))
    full = F.when(way == 0, k == 2).when(way.isin(1, 2), k <= 1).otherwise(k == 0)
    version = F.when(way.isin(1, 2) & (k >= 1), 1).otherwise(0)
    named = F.when((way == 3) & (k == 2), 9).when((way == 1) & (k == 3), 0).otherwise(version)
    tag = F.concat(F.lit('"'), F.md5(F.concat(html, F.lit("#"), named.cast("string")).cast("binary")), F.lit('"'))
    etag = F.when(way.isin(4, 6) | ((way == 7) & ~F.col("full")), None).when((way == 5) & ~F.col("full"), F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when(way.isin(6, 7), F.concat(F.lit("day "), F.when((way == 6) & (k == 3), 2).otherwise(1).cast("string")))
    start = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*", 0)
    url = F.when(k == 1, F.concat("url", F.lit("#again"))).when(k == 2, F.concat(F.upper(start), F.expr("substr(url, length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)) + 1)")))
    url = url.when(k == 3, F.concat("url", F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("utm_source=x"))).otherwise(F.col("url"))
    captured = F.lit(BEGIN) + k * APART + F.pmod(page, F.lit(APART))
    visits = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))).alias("k")).withColumn("full", full)
    body = F.when(F.col("full"), F.concat(html, F.when(version == 1, "<!-- 1 -->").otherwise("")))
    return visits.select((page * VISITS + k).alias("record_id"), _warc(page * VISITS + k, url, captured, F.col("full"), etag, modified, body).alias("warc"))


def _warc(record_id: Column, url: Column, captured: Column, full: Column, etag: Column, modified: Column, body: Column) -> Column:
    """The bytes of a response or of a server-not-modified revisit."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    # without a time zone, so that the session's doesn't matter
    when = F.concat(F.translate(F.timestamp_add("SECOND", captured, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))).cast("string"), " ", "T"), F.lit("Z"))
    http = F.concat(
        F.when(full, "HTTP/1.1 200 OK\r\n").otherwise("HTTP/1.1 304 Not Modified\r\n"),
        line("Date", captured.cast("string")),
        F.when(full, "Cache-Control: max-age=60\r\nContent-Type: text/html\r\nServer: origin\r\n").otherwise("Cache-Control: max-age=600\r\nServer: cache\r\n"),
        line("ETag", etag),
        line("Last-Modified", modified),
        F.lit("\r\n"),
        F.coalesce(body, F.lit("")),
    ).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(full, "response\r\n").otherwise(f"revisit\r\nWARC-Profile: {warc.NOT_MODIFIED}\r\n"),
        F.lit("WARC-Record-ID: <urn:record:"),
        record_id.cast("string"),
        F.lit(">\r\n"),
        line("WARC-Target-URI", url),
        line("WARC-Date", when),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.length(http).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return F.concat(head, http, F.lit(b"\r\n\r\n"))


def revisited_pages(pages: DataFrame) -> DataFrame:
    """Per revisit of a crawl of pages: record_id, page_id, url_key, captured, status, source_id, the merged headers, and bytes and MD5 of the body that it stands for."""
    # bodies are read once; of them only length and digest go on
    records = warc.parse(crawl(pages)).withColumns({"body_bytes": F.length("body").cast("long"), "body_md5": F.md5("body")})
    records = cut_lineage(records.drop("body"))
    found = resolve(records)
    bodies = records.where(F.col("kind") == "response").select("record_id", "body_bytes", "body_md5")
    joined = found.join(bodies.withColumnRenamed("record_id", "source_id"), "source_id", "left")
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return joined.select("record_id", F.expr(f"record_id div {VISITS}").alias("page_id"), "url_key", "captured", "status", "source_id", F.coalesce(headers, F.lit("")).alias("headers"), "body_bytes", "body_md5")
