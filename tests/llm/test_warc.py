import hashlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from rosterloom.llm import registry, warc


def brute(rows):
    full = [(k, (h or "").encode()) for k, h in rows]
    latest = {}
    for k, b in full:
        if len(b) >= 1000 and k is not None:
            latest[b] = max(k, latest.get(b, k))
    out = Counter()
    for k, b in full:
        revisits = b in latest and latest[b] != k
        out[(k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisits else "response", latest[b] if revisits else None)] += 1
    return out


def test_supplied_pages(spark, small):
    t = pq.read_table(f"{small}/pages.parquet").to_pydict()
    got = registry.op9_warc(spark, small).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == brute(zip(t["page_id"], t["html"], strict=True))


def test_odd_pages(spark, tmp_path):
    long = "<p>é日😀 WARC/1.1\r\n\r\n" * 4000
    rows = [
        (1, "http://a/\n x", None, 0), (2, None, "", 0), (3, "u", "x" * 1000, 0), (4, "u", "x" * 1000, 0), (4, "u", "x" * 1000, 0), (None, "u", "x" * 1000, 0), (5, "u", "x" * 999, 0), (6, "u", "x" * 999, 0),
        (7, "u", long, 0), (8, "u", long + "!", 0), (8, "u", long + "!", 0), (9, "u", long, 0), (10, "u", "0\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 40, 0), (11, "u", "\n" * 3000, 0),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    for n, segment in enumerate((100, 1 << 14)):
        warc.write_archives(pages, f"{tmp_path}/{n}", segment_bytes=segment)
        got = warc.read_archives(spark, f"{tmp_path}/{n}").collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute([(k, h) for k, _, h, _ in rows])
        texts = {k: (h or "").encode() for k, _, h, _ in rows}
        assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    warc.write_archives(pages.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_framing_and_segments():
    for payload in (b"", b"a", b"x" * 5000, b"0\r\n\r\n" * 3000):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    parts = [(3, 9, b"ghi"), (1, None, b"abc"), (2, None, b"def")]
    assert warc.join_segments(parts) == (b"abcdefghi", 1)
    assert warc.join_segments(parts * 2) == (b"abcdefghi", 2)
    for broken in (parts[:2], parts[1:], [(3, 8, b"ghi"), *parts[1:]], [*parts, parts[0]]):
        with pytest.raises(ValueError):
            warc.join_segments(broken)
    for body in (b"5\r\nhell\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(body)
    with pytest.raises(ValueError):
        warc.page_payload("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "0" * 40)
