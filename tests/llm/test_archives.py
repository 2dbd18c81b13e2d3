import hashlib

from spotweave.llm.warc import parse_record, read_records, write_archives
from spotweave.session import fresh_path

PAGES = "page_id long, url string, html string, digest string, offset int"


def test_round_trip_with_revisits(spark):
    long = "<p>" + "ü" * 300_000 + "</p>"
    same = "x" * 100
    rows = [(3, "http://a/\r\nX: 1", same), (1, None, same), (2, "u", same), (4, "u", "x" * 99), (5, "u", "x" * 99)]
    rows += [(6, "u", None), (7, "", ""), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20), (9, "ü", long), (None, "u", same), (None, None, None)]
    rows += [(10, "u", "r" * 200), (10, "u", "r" * 200)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)
    folder = fresh_path(spark, "warc-test")
    index = write_archives(pages, folder, roll_bytes=2000)
    assert index.count() == len(rows) and index.select("file").distinct().count() > 1
    got = read_records(index, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        data = (html or "").encode()
        for r in by_id[page_id]:
            if r.payload_bytes == len(data):
                assert r.payload_digest == hashlib.sha256(data).hexdigest()
                assert r.payload == (None if r.record_type == "revisit" else data)
    kind = lambda i: [(r.record_type, r.refers_to) for r in by_id[i]]
    assert kind(1) == [("response", None)] and kind(2) == kind(3) == [("revisit", 1)]
    assert ("revisit", 1) in kind(None) and ("response", None) in kind(None)
    assert kind(4) == kind(5) == kind(6) == kind(7) == [("response", None)]
    assert kind(10) == [("response", None)] * 2
    assert by_id[3][0].url == "http://a/%0D%0AX: 1"
    few = read_records(index.where("page_id in (2, 9)"), folder, with_payload=False).collect()
    assert sorted(r.page_id for r in few) == [2, 9] and all(r.payload is None for r in few)


def test_no_pages(spark):
    folder = fresh_path(spark, "warc-test")
    index = write_archives(spark.createDataFrame([], PAGES), folder)
    assert index.count() == 0 and read_records(index, folder).count() == 0


def test_parse_record():
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:0\r\nPayload-Length: 1\r\nContent-Length: 9\r\n\r\nHTTP\r\n\r\nx\r\n\r\n"
    assert parse_record(raw)["payload"] == b"x" and not parse_record(raw)["intact"]
