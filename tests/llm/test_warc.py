"""Archives: framing, segments out of order or damaged, and whole tables."""

import base64
import gzip
import hashlib
import io
import random
import time

import pytest
from corpus_audit.llm import warc as W


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 9, 10, 11, 100):
        payload = rng.randbytes(n)
        assert W.unchunked(W.chunked(payload, 10)) == payload
        assert W.http_payload(W.http_block(payload)) == payload
    assert W.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n", b"-6\r\n\r\n0\r\n\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b"0x3\r\nabc\r\n0\r\n\r\n", b"\r\n", b"1_0\r\n", b""):
        assert W.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + broken) is None
    assert W.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and W.http_payload(b"nothing") is None


def test_records_of_a_file():
    block = b"abc\r\n\r\nWARC/1.1\r\n" * 10
    data = b"".join(W.segments([("WARC-Type", "response")], "urn:uuid:1", block, 50))
    found = list(W.read_records(io.BytesIO(data)))
    assert b"".join(b for _, b in found) == block and len(found) == -(-len(block) // 50)
    assert [f["warc-segment-number"] for f, _ in found] == [str(k + 1) for k in range(len(found))]
    assert found[-1][0]["warc-segment-total-length"] == str(len(block)) and found[0][0]["warc-type"] == "response"
    assert all(f["warc-segment-origin-id"] == "<urn:uuid:1>" for f, _ in found[1:])


def test_reassembly(spark):
    def rows(origin, numbers, total):
        return [
            (origin, n, total if n == max(numbers) else None, "response" if n == 1 else "continuation", 5 if n == 1 else None, None, None, None, None, b"%d" % n * n)
            for n in numbers
        ]

    parts = rows("a", [3, 1, 2], 6) + rows("b", [1, 3], 4) + rows("c", [1, 2], 99) + rows("d", [2, 3], 5) + rows("e", [2, 1, 1], 3)
    parts += [("f", 1, 1, "response", 6, None, None, None, None, b"x"), ("f", 1, 1, "response", 6, None, None, None, None, b"y")]
    found = {r["origin"]: r for r in W.reassembled(spark.createDataFrame(parts, W._RECORD).repartition(4)).collect()}
    assert {k: r["complete"] for k, r in found.items()} == {"a": True, "b": False, "c": False, "d": False, "e": True, "f": False}
    assert bytes(found["a"]["block"]) == b"122333" and found["a"]["page_id"] == 5


@pytest.mark.parametrize("segment_bytes, file_bytes", [(16 << 10, 32 << 20), (300, 2000)])
def test_awkward_pages(spark, segment_bytes, file_bytes):
    big, small = "<p>é" * 800, "<p>" * 10
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nX: y", big + "x"), (3, "http://c/", big + "x"), (4, "d", small), (5, "e", small)]
    pages += [(6, "f", None), (7, "g", ""), (None, "h", big), (None, "i", None), (8, "j", "\r\n\r\n" * 900), (9, "k", "z" * 200_000)]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(3)
    got = W.read_archives(W.write_archives(df, segment_bytes=segment_bytes, file_bytes=file_bytes)).collect()
    last = {}
    for i, _, html in pages:
        if i is not None and html:
            last[html] = max(i, last.get(html, i))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        other = last.get(html) if len(data) >= 1000 else None
        revisit = other is not None and other != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None, True))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and r["page_id"]}
    assert all(payloads[i] == (html or "") for i, _, html in pages if i in payloads)
    assert W.read_archives(W.write_archives(df.limit(0))).count() == 0


def plain(fields, block):
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n")


def test_damaged_archives(spark, tmp_path):
    """Broken records are not complete; the records around them are read."""
    body = W.http_block(b"payload")
    sha1 = hashlib.sha1(b"payload").digest()

    def page(number, digest=None, length=len(body), block=body):
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{number}>"), ("X-Page-ID", number), ("WARC-Payload-Digest", digest or "sha1:" + base64.b32encode(sha1).decode())]
        return plain([*fields, *([("Content-Length", length)] if length is not None else [])], block)

    files = {
        "a": page(1, "sha1:" + sha1.hex()) + page(2, length=None) + page(3, length="-6") + page(4) + page(5, "sha1:@@") + page(6, "md5:00"),
        "b": page(7) + page(8)[:-30],
        "c": page(9) + page(10, length=10**6),
        "d": b"no archive at all",
        "e": page("x11") + gzip.compress(b"\r\njunk\r\n\r\n") + page(12, block=W.http_block(None) + b"-6\r\n", length=len(W.http_block(None)) + 4),
        "f": b"",
    }
    paths = []
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        paths.append((str(tmp_path / name),))
    rows = W.read_archives(spark.createDataFrame(paths, "path string")).collect()
    got = {r["page_id"]: (r["complete"], r["payload"] and bytes(r["payload"])) for r in rows}
    good = {1, 4, 7, 9, None}
    assert got == {**{k: (True, b"payload") for k in good}, **{k: (False, None) for k in (2, 3, 8, 10, 12)}, 5: (False, b"payload"), 6: (False, b"payload")}


def test_a_large_page_is_joined_in_linear_time(spark):
    def seconds(megabytes):
        html = "0123456789abcdef" * (megabytes << 16)
        df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
        archives = W.write_archives(df)
        start = time.perf_counter()
        (row,) = W.read_archives(archives).collect()
        assert row["complete"] and row["payload_bytes"] == len(html)
        return time.perf_counter() - start

    seconds(1)
    assert seconds(64) < 30
