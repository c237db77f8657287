import gzip

import pytest

from sparkmill.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, payload int"


def pages():
    long = "".join(f"<p>{i} é</p>\r\n\r\n" for i in range(4000))
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nx", "same"), (9, "http://c/", "same"), (1, None, None), (2, "http://e/", ""), (7, "u", long), (8, "v", long), (10, "w", "once"), (10, "w", "twice"), (None, "n", "same"), (None, "n", "lone"), (11, "q", "\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n")]
    return [(*r, "x", 1) for r in rows]


def expected(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        h = (h or "").encode()
        if len(h) >= least and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, u, h, *_ in rows:
        h = (h or "").encode()
        f = first.get(h) if len(h) >= least else None
        revisit = f is not None and f != i
        out.append((str(i), len(h), warc.payload_digest(h), "revisit" if revisit else "response", str(f) if revisit else "None", "None" if revisit else str(h)))
    return sorted(out)


@pytest.mark.parametrize(("least", "segment", "chunk"), [(0, 16_384, 4_096), (5, 100, 7), (0, 1_000_000, 1)])
def test_round_trip(spark, least, segment, chunk):
    rows = pages()
    out = warc.round_trip(spark.createDataFrame(rows, SCHEMA), min_payload=least, segment_bytes=segment, chunk_bytes=chunk).collect()
    assert {r.status for r in out} == {"ok"}
    got = sorted((str(r.page_id and int(r.page_id)), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), "None" if r.payload is None else str(bytes(r.payload))) for r in out)
    assert got == expected(rows, least)
    assert any(r.segments > 1 for r in out) == (segment < 100_000)


def test_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abcdefgh" * 50, 16)
    parts = warc.records("response", "urn:x-page:1:0", "u", block, 100)
    assert len(parts) > 3
    other = warc.records("response", "urn:x-page:2:0", "u", block, 100)[1:]
    bad = [warc.record("response", "urn:x-page:3:0", block[:-9]), warc.record("response", "urn:x-page:4:0", block, Payload_Digest="sha1:AAAA"), warc.record("metadata", "urn:m", b"x")]
    lost = warc.records("response", "urn:x-page:5:0", "u", block, 100)[:-1]
    late = parts[::-1]
    (tmp_path / "a.warc").write_bytes(b"".join(x + b"\r\n\r\n" for x in late + other))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x + b"\r\n\r\n") for x in bad + lost[:2] + lost[3:]))
    out = {r.page_id: (r.status, r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert out["1"] == ("ok", b"abcdefgh" * 50)
    assert {k: v[0] for k, v in out.items() if k != "1"} == {"2": "the first segment is missing", "3": "the framing is broken", "4": "the digest differs", "5": "segments are missing"}


@pytest.mark.parametrize("body", [b"5\r\nabc", b"zz\r\n", b"", b"3\r\nabcX\r\n0\r\n\r\n"])
def test_bad_framing(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
