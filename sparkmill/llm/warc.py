"""WARC archives: segmented, chunked writing with revisits, and reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm.shared import _written, materialize, small_batches
from sparkmill.sources.scratch import shared_folder

EOL = b"\r\n"
END = b"\r\n\r\n"
#: Records of a file; with the default segment size a file has at most 64 MB before compression.
RECORDS_PER_FILE = 4096
FIELDS = "record_id string, type string, uri string, origin string, number int, total long, digest string, refers string, block binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped. ValueError if it is cut or malformed."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = end + 2
        if body[at + n : at + n + 2] != EOL:
            raise ValueError("a chunk is cut")
        out.append(body[at : at + n])
        at += n + 2


def record(kind: str, record_id: str, block: bytes, **fields: str | int | None) -> bytes:
    """One record without the empty line that ends it."""
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block


def records(kind: str, record_id: str, uri: str, block: bytes, segment_bytes: int, **fields: str | None) -> list[bytes]:
    """A record, cut into a first segment and continuation records if its block is longer than a segment."""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    mime = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        return [record(kind, record_id, block, Target_URI=uri, Content_Type=mime, **fields)]
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record(kind, record_id, cuts[0], Target_URI=uri, Segment_Number=1, Content_Type=mime, **fields)]
    for n, cut in enumerate(cuts[1:], 2):
        last = len(block) if n == len(cuts) else None
        out.append(record("continuation", f"{record_id}/{n}", cut, Target_URI=uri, Segment_Origin_ID=f"<{record_id}>", Segment_Number=n, Segment_Total_Length=last))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record. ValueError if a record is cut."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {at} is cut")
        yield head, data[start:stop]
        at = stop + 4


def unpacked(data: bytes) -> bytes:
    """The bytes of a file with any number of gzip members, or of a plain one."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out += [z.decompress(data), z.flush()]
        data = z.unused_data
    return b"".join(out)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, segment_bytes: int = 16_384, chunk_bytes: int = 4_096) -> None:
    """Write a record per row of pages to gzip files in the folder `path`, by Spark's own writer.

    Of rows with equal payloads of at least min_payload bytes, the one with the smallest id is a response and the others
    are revisits that refer to it (repeated rows of that id are all responses; null ids come last). A null html is an empty
    payload, a null url an empty one. Only groups of two and more take part in the join, from a table written before it.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= min_payload, F.unhex(F.sha1("payload"))))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select(F.col("sha").alias("same"), "first"), "payloads")
    rows = rows.join(groups, F.col("sha") == F.col("same"), "left").select("id", "url", "payload", "first", F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for key, url, payload, first, row in zip(*[c.to_pylist() for c in b.columns]):
                digest, revisit = payload_digest(payload), first is not None and first != key
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                block = head + (b"Content-Length: %d\r\n\r\n" % len(payload) if revisit else b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes))
                name = f"urn:x-page:{'' if key is None else key}:{row}"
                more = {"Refers_To": f"<urn:x-page:{first}>", "Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if revisit else {}
                out += records("revisit" if revisit else "response", name, url, block, segment_bytes, Payload_Digest=f"sha1:{digest}", **more)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    written = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives in a folder: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, segments, status.

    Segments are grouped by the record that they continue, put in order of their numbers, and their total length is
    verified; then chunked framing is decoded and the digest of a response verified. status says ok or what is wrong, with
    a null payload then. Only segmented records are shuffled.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for h, block in parse(unpacked(data.as_py())):
                    get = lambda k, h=h: h.get(k, "").strip("<>") or None
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append((get("warc-record-id"), h["warc-type"], h.get("warc-target-uri", ""), get("warc-segment-origin-id"), number and int(number), total and int(total), get("warc-payload-digest"), get("warc-refers-to"), block))
                    if len(rows) == 1000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, FIELDS).where("type in ('response', 'revisit', 'continuation')")
    whole = found.where("number is null").select("record_id", "type", "uri", "digest", "refers", F.lit(None).cast("long").alias("total"), F.array(F.struct(F.lit(1).alias("number"), "block")).alias("parts"))
    origin = F.coalesce("origin", "record_id")
    cut = found.where("number is not null").groupBy(origin.alias("record_id")).agg(
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("type", "uri", "digest", "refers")], F.coalesce(F.max("total"), F.lit(-1).cast("long")).alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, kind, uri, digest, refers, total, parts in zip(*[c.to_pylist() for c in b.columns]):
                key = (name or "").removeprefix("urn:x-page:").rpartition(":")[0]
                digest, payload, n, status = (digest or "").removeprefix("sha1:"), None, None, "ok"
                block = b"".join(p["block"] for p in parts)
                if kind is None:
                    status = "the first segment is missing"
                elif [p["number"] for p in parts] != [*range(1, len(parts) + 1)] or total is not None and total != len(block):
                    status = "segments are missing"
                else:
                    head, _, body = block.partition(END)
                    fields = head.lower()
                    try:
                        if kind == "revisit":
                            n = int(fields.partition(b"content-length:")[2].split(EOL)[0])
                        else:
                            payload = dechunked(body) if b"transfer-encoding: chunked" in fields else body
                            n = len(payload)
                            if digest and payload_digest(payload) != digest:
                                payload, n, status = None, None, "the digest differs"
                    except ValueError:
                        payload, n, status = None, None, "the framing is broken"
                out.append((key or None, uri, kind, payload, n, digest or None, (refers or "").removeprefix("urn:x-page:") or None, len(parts), status))
            types = [pa.string()] * 3 + [pa.binary(), pa.int64()] + [pa.string()] * 2 + [pa.int32(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "segments", "status"])

    return whole.unionByName(cut).mapInArrow(decode, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, segments int, status string")


def round_trip(pages: DataFrame, **options: str | int) -> DataFrame:
    """write_warc to a new folder of the shared scratch, then read_warc of it."""
    path = f"{shared_folder(pages.sparkSession)}/mill-{uuid.uuid4().hex}-warc"
    _written.append(path)
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
