import gzip
import hashlib

from graintide.llm.warc import op4_warc, parse, record, round_trip, url_key

SF = "/root/testdata/sf0.01"


def want(rows, least=1000):
    big = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= least and p is not None:
            big[raw] = max(big.get(raw, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        refers = big.get(raw)
        revisit = refers is not None and p != refers
        out.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert got(op4_warc(spark, SF)) == want(rows)


def test_odd_pages(spark):
    long = "é<p>x</p>" * 400
    rows = [(1, "http://a.example.com:8080/x?q=1", long), (5, "http://a.example.com/x y\n", long), (3, None, long), (None, "::bad::[", long), (7, "http://b.org", None), (8, "http://b.org", ""), (9, "http://b.org", "short"), (10, "http://b.org", "short"), (9, "http://b.org", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS payload", "3 AS offset")
    assert got(round_trip(df)) == want(rows)
    assert round_trip(df.limit(0)).collect() == []


def test_many_equal_payloads_and_small_blocks(spark):
    rows = [(i, f"https://h{i % 7}.example.org/p/{i % 50}", "body " * 300 if i % 3 == 0 else f"page {i} " * (i % 400)) for i in range(900)]
    assert got(round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))) == want(rows)


def test_record_and_key():
    fields, payload = parse(gzip.decompress(gzip.compress(record(4, "http://x.y/z", b"hi\r\n\r\nthere", None, False))))
    assert payload == b"hi\r\n\r\nthere" and fields["WARC-Type"] == "response"
    fields, payload = parse(record(4, "http://x.y/z", b"hello", 9, True))
    assert payload == b"" and fields["http-length"] == "5" and fields["X-Refers-To-Page"] == "9"
    assert url_key("https://www.Example.com:8443/a?b=c", 5) == "com,example,www:8443)/a?b=c 5"
