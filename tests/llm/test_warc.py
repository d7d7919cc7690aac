import base64
import gzip
import hashlib
import io

from trackmill.llm import warc as W


def brute(rows):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        original = first.get(html or "")
        revisit = original is not None and original != page
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((str(page), len(raw), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r[0]), *r[1:]) for r in W.archive_table(df).collect()), key=str)


def test_real_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.filter("page_id % 7 = 0").selectExpr("page_id + 100000 as page_id", "url", "html")
    pages = pages.select("page_id", "url", "html").unionByName(again)
    want = brute([(r.page_id, r.html) for r in pages.collect()])
    assert got(pages) == want
    assert {r[3] for r in want} == {"response", "revisit"}


def test_edge_rows(spark, edge_texts):
    rows = [(i, "http://x y/ü", t) for i, t in enumerate(edge_texts)]
    rows += [(90, None, "a b"), (None, "u", "a b"), (None, "u", "only null"), (None, None, "only null"), (4, "u", "a"), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, first int").repartition(3)
    assert got(pages) == brute([(r[0], r[2]) for r in rows])
    assert got(pages.limit(0)) == []


def test_archives_roll_over_and_small_payloads_stay(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 600)
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else f"body {i}") for i in range(40)], "page_id long, url string, html string")
    manifest = W.write_archives(pages, least=5)
    assert manifest.count() > 4
    records = W.read_archives(manifest).collect()
    assert len(records) == 40 and {r.record_type for r in records} == {"response"}


def test_record_round_trip():
    made = W.make_record(5, "http://a/", b"x\r\n\r\ny", "D", None, 6) + W.make_record(9, None, b"", "D", 5, 6)
    packed = io.BytesIO(gzip.compress(made))
    (a, x), (b, y) = W.read_records(gzip.GzipFile(fileobj=packed))
    assert a["warc-type"] == "response" and x.endswith(b"\r\n\r\nx\r\n\r\ny")
    assert b["warc-type"] == "revisit" and W.page_of(b["warc-refers-to"]) == 5 and W.page_of(b["warc-record-id"]) == 9
