import gzip
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tilesieve.llm import revisits as rv
from tilesieve.llm import warc

SCHEMA = "record_id long, url string, captured long, kind string, etag string, modified string, headers map<string,string>, span int"


def brute(rows, key):
    out = {}
    for rid, url, at, kind, etag, modified, *_ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and None not in (url, at, r[1], r[2]) and key[r[0]] == key[rid] and r[2] <= at]
        if not earlier:
            out[rid] = ("unmatched", None)
            continue
        hit = max(earlier, key=lambda r: (r[2], r[0]))
        if etag and hit[4]:
            status = "resolved" if etag.removeprefix("W/") == hit[4].removeprefix("W/") else "changed"
        elif modified and hit[5]:
            status = "resolved" if modified == hit[5] else "changed"
        else:
            status = "unchecked"
        out[rid] = (status, None if status == "changed" else hit[0])
    return out


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        url = "https://hot.example/page" if i % 3 == 0 else f"http://h{rng.randrange(5)}.example/p{rng.randrange(4)}"
        rows.append((i, url, rng.randrange(300), rng.choice(["response", "revisit"]), rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "1", "2"]), {"Date": str(i)}, 1))
    df = spark.createDataFrame(rows, SCHEMA)
    key = {r.record_id: r.k for r in df.select("record_id", rv.canonical_url(F.col("url")).alias("k")).collect()}
    want = brute(rows, key)
    for parts in (1, 4, 40):  # the hot address lies in several parts
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r.record_id: (r.status, r.source_id) for r in rv.resolve(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_many_records_at_one_time(spark):
    rows = [(i, "u", 5, "response" if i % 2 else "revisit", None, None, None, 0) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        assert {(r.status, r.source_id) for r in rv.resolve(spark.createDataFrame(rows, SCHEMA)).collect()} == {("unchecked", 2999)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_canonical_urls(spark):
    same = ["http://www.Site.example/a/b/?utm_source=x#top", "https://site.example:443/a/b", "site.example/a/b?ref=z", "http://m.site.example/a/b/?"]
    other = ["http://site.example/A/b", "http://site.example/a/b?page=2", "http://site.example/a/b?page=2&ref=x"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in same + other], "u string").select(rv.canonical_url(F.col("u")).alias("k")).collect()]
    assert set(got[:4]) == {"site.example/a/b"} and got[4] == "site.example/A/b" and got[5] == got[6] == "site.example/a/b?page=2"


def test_permitted_headers_are_merged(spark):
    rows = [(1, "u", 1, "response", '"x"', None, {"Content-Type": "text/html", "ETag": '"x"', "Date": "1"}, 0), (2, "u", 2, "revisit", '"x"', None, {"date": "2", "Server": "proxy", "DATE": "3", "Content-Length": "0"}, 0)]
    (r,) = rv.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.status == "resolved" and r.headers == {"content-type": "text/html", "etag": '"x"', "date": "2"}
    body = spark.createDataFrame([(1, b"hello"), (9, b"no")], "record_id long, body binary")
    assert bytes(rv.with_bodies(rv.resolve(spark.createDataFrame(rows, SCHEMA)), body).first().body) == b"hello"


def test_edges(spark):
    rows = [(1, None, 1, "response", None, None, None, 1), (2, None, 2, "revisit", None, None, None, 1), (3, "u", None, "revisit", None, None, None, 1), (4, "u", None, "response", None, None, None, 1), (5, "u", 5, "revisit", None, None, None, 1), (6, "v", 5, "response", None, None, None, 1), (7, "v", 5, "revisit", None, None, None, 1), (8, "v", 6, "request", None, None, None, 1), (7, "v", 5, "revisit", None, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.record_id, r.status, r.source_id) for r in rv.resolve(df).collect())
    assert got == [(2, "unmatched", None), (3, "unmatched", None), (5, "unmatched", None), (7, "unchecked", 6), (7, "unchecked", 6)]
    assert rv.resolve(df.limit(0)).count() == 0


def test_crawled_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = rv.revisited_pages(pages).collect()
    assert {r.page_id for r in rows} == {r.page_id for r in pages.collect()} and len({r.record_id for r in rows}) == len(rows)
    share = Counter(r.status for r in rows)
    assert set(share) == {"resolved", "changed", "unchecked", "unmatched"} and min(share.values()) >= 0.05 * len(rows)
    assert all(r.source_id < r.record_id and r.body_md5 for r in rows if r.status == "resolved" and r.source_id // 4 == r.page_id)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        if r.source_id is not None:
            page, k = divmod(r.source_id, 4)
            body = (html[page] + ("<!-- 1 -->" if page % 8 in (1, 2) and k else "")).encode()
            assert (r.body_bytes, r.body_md5) == (len(body), hashlib.md5(body).hexdigest()) and f"date: {r.captured}" in r.headers


def test_records_of_a_crawl_are_warc(spark):
    pages = spark.createDataFrame([(8, "http://a.example/x?y=1", "<p>ü</p>"), (9, "http://b.example", None), (12, "https://www.c.example/z/#t", "c" * 200_000)], "page_id long, url string, html string")
    raw = [bytes(r.warc) for r in rv.crawl(pages).orderBy("record_id").collect()]
    assert len(raw) == 12 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in raw)
    ((fields, block),) = list(warc.split(raw[2]))
    assert fields["WARC-Type"] == "response" and fields["WARC-Record-ID"] == "<urn:record:34>" and fields["WARC-Target-URI"] == "HTTP://A.EXAMPLE/x?y=1"
    headers, body = warc.http(block)
    assert body.decode() == "<p>ü</p>" and headers["ETag"].strip('"') == hashlib.md5("<p>ü</p>#0".encode()).hexdigest()
    ((fields, _),) = list(warc.split(raw[0]))
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Profile"] == warc.NOT_MODIFIED


def test_dates_in_any_time_zone(spark):
    pages = spark.range(0, 2_592_000, 1801).selectExpr("id AS page_id", "'http://a.example' AS url", "'x' AS html")
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert warc.parse(rv.crawl(pages)).selectExpr(f"bool_and(captured = {rv.BEGIN} + record_id % 4 * {rv.APART} + record_id div 4)").first()[0]


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = rv.crawl(pages)
    want = sorted(map(tuple, warc.parse(records).select("record_id", "url", "captured", "kind", "etag", "modified", "body").collect()))
    assert len(want) == 4 * pages.count() and all(w[2] == rv.BEGIN + w[0] % 4 * rv.APART + w[0] // 4 for w in want)
    parts = [bytes(r.member) for r in warc.members(records).collect()]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(parts[: len(parts) // 2]))
    (tmp_path / "w" / "b.warc").write_bytes(b"".join(map(gzip.decompress, parts[len(parts) // 2 :])))
    got = warc.read(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, got.select("record_id", "url", "captured", "kind", "etag", "modified", "body").collect())) == want
    assert rv.resolve(got.drop("body")).count() == sum(w[3] == "revisit" for w in want)


def test_odd_records(spark):
    ok = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\nX: a\r\n  b\r\n\r\nabc\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 30\r\n\r\nabc"
    rows = [(b"",), (None,), (b"junk",), (ok + cut,), (ok + ok,), (b"WARC/1.0\r\nContent-Length: x\r\n\r\n",)]
    got = warc.parse(spark.createDataFrame(rows, "warc binary")).collect()
    assert len(got) == 3 and all((r.kind, r.record_id, r.captured, r.url, bytes(r.body), r.headers) == ("request", None, None, None, b"abc", {}) for r in got)
    assert warc._fields([b"X: a", b"  b", b"no colon", b"Y:c"]) == {"X": "a b", "Y": "c"}
