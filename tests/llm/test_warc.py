import hashlib

from eventmill.llm import warc

BIG = "<p>" + "x" * 1200 + "</p>"


def pages(spark):
    rows = [
        (1, "http://a/1", BIG, 3),
        (2, "http://a/2 b\r\nEvil: 1", BIG, 3),
        (3, None, BIG, 3),
        (4, "http://b", "tiny", 0),
        (5, "http://b", "tiny", 0),
        (6, "u", None, 0),
        (7, "u", "", 0),
        (8, "u", "é" * 600 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", 0),
        (None, "u", BIG, 0),
        (9, "u", BIG * 2, 0),
        (9, "u", BIG * 2, 0),
        (10, "u", "long " * 200_000, 0),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")


def test_round_trip(spark, tmp_path):
    source = pages(spark)
    path = str(tmp_path / "warc")
    warc.write_archives(warc.resolve_revisits(source), path, records_per_file=3)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == source.count()
    html = {r.page_id: (r.html or "").encode() for r in source.collect()}
    for r in got:
        payload = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    revisits = {(1, "revisit", 3), (2, "revisit", 3), (None, "revisit", 3)}
    assert set(kinds) == revisits | {(i, "response", None) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert kinds.count((9, "response", None)) == 2


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(warc.resolve_revisits(pages(spark).limit(0)), path)
    assert warc.read_archives(spark, path).count() == 0
