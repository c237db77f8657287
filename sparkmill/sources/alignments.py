"""BAM files: reading by compressed blocks in parallel, records across splits included, and writing."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.operators.abundance import trimmed_mean_of_intervals
from sparkmill.sources.scratch import dealt, stored

#: Start of every compressed block, the empty block at the end of a file, operations of a CIGAR, bytes of a tag's value
#: and the fixed fields of a record (fixed values of the format).
BLOCK = bytes.fromhex("1f8b08040000000000ff060042430200")
LAST_BLOCK = BLOCK + bytes.fromhex("1b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_FORMAT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
FIXED = np.dtype([("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
#: Which operations advance on the reference, cover it, and count as columns of the alignment.
ON_REFERENCE, COVERS, COLUMNS = (np.isin(np.arange(16), x) for x in ([0, 2, 3, 7, 8], [0, 7, 8], [0, 1, 2, 7, 8]))
#: Flags of unmapped, secondary and supplementary records.
LEFT_OUT = 0x4 | 0x100 | 0x800

ALIGNMENT = "ref_id int, pos long, flag int, mapq int, read string, edits long, aligned long, covered array<struct<start:long,end:long>>"
PARSED = f"file string, split long, kind string, piece binary, name string, length long, {ALIGNMENT}"


def inflated(block: bytes) -> bytes:
    """The content of a block whose first bytes, BLOCK, were cut off; its size and checksum are verified."""
    data = zlib.decompress(block[2:-8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)) or struct.unpack_from("<H", block)[0] + 1 != len(BLOCK) + len(block):
        raise ValueError("a damaged block")
    return data


def deflated(data: bytes) -> bytes:
    """data, at most 65,280 bytes, as a whole block."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return BLOCK + struct.pack("<H", len(BLOCK) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _tags(buf: bytes, at: int, end: int) -> tuple[int | None, np.ndarray | None]:
    """The edit distance (NM) among the tags, and the operations of a long CIGAR (CG)."""
    edits, words = None, None
    while at + 3 <= end:
        tag, kind = buf[at : at + 2], chr(buf[at + 2])
        at += 3
        if kind in "ZH":
            at = buf.index(b"\0", at) + 1
        elif kind == "B":
            sub, n = chr(buf[at]), struct.unpack_from("<i", buf, at + 1)[0]
            if tag == b"CG":
                words = np.frombuffer(buf, "<u4", n, at + 5)
            at += 5 + n * TAG_BYTES[sub]
        else:
            if tag == b"NM" and kind in TAG_FORMAT:
                edits = struct.unpack_from(TAG_FORMAT[kind], buf, at)[0]
            at += TAG_BYTES[kind]
    return edits, words


def parsed(buf: bytes) -> tuple[pa.RecordBatch, int]:
    """The whole records at the start of buf as columns of ALIGNMENT, and how many bytes they take."""
    at, starts, ends = 0, [], []
    while at + 4 <= len(buf):
        size = struct.unpack_from("<i", buf, at)[0]
        if size < 33:
            raise ValueError("not a record of an alignment")
        if at + 4 + size > len(buf):
            break
        starts.append(at + 4)
        at += 4 + size
        ends.append(at)
    raw, start = np.frombuffer(buf, np.uint8), np.array(starts, np.int64)
    fixed = np.ascontiguousarray(raw[start[:, None] + np.arange(32)]).view(FIXED).ravel() if starts else np.zeros(0, FIXED)
    l_name, n = fixed["l_name"].astype(np.int64), fixed["n_cigar"].astype(np.int64)
    names, edits, long = [], [], {}
    tags = start + 32 + l_name + 4 * n + (fixed["l_seq"].astype(np.int64) + 1) // 2 + fixed["l_seq"]
    for i, (s, k, t, e) in enumerate(zip(starts, l_name.tolist(), tags.tolist(), ends)):
        names.append(buf[s + 32 : s + 31 + k].decode())
        nm, words = _tags(buf, t, e)
        edits.append(nm)
        if words is not None:
            long[i] = words
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(start + 32 + l_name, n) + 4 * within
    words = np.ascontiguousarray(raw[place[:, None] + np.arange(4)]).view("<u4").ravel() if len(place) else np.zeros(0, np.uint32)
    if long:  # more operations than fit the field: they stand in a tag
        own = np.split(words, np.cumsum(n)[:-1])
        own = [long.get(i, w) for i, w in enumerate(own)]
        words, n = np.concatenate(own), np.array([len(w) for w in own], np.int64)
    op, length, owner = words & 15, (words >> 4).astype(np.int64), np.repeat(np.arange(len(n)), n)
    moved = np.where(ON_REFERENCE[op], length, 0)
    before = np.cumsum(moved) - moved
    first = np.concatenate([[0], np.cumsum(moved)])[np.cumsum(n) - n]
    begin = before - first[owner] + fixed["pos"].astype(np.int64)[owner]
    aligned = np.bincount(owner, np.where(COLUMNS[op], length, 0), len(n)).astype(np.int64)
    on = COVERS[op] & (length > 0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[on], minlength=len(n)))]).astype(np.int32)
    covered = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(begin[on]), pa.array(begin[on] + length[on])], ["start", "end"]))
    columns = {"ref_id": pa.array(fixed["ref_id"].astype(np.int32)), "pos": pa.array(fixed["pos"].astype(np.int64)), "flag": pa.array(fixed["flag"].astype(np.int32)), "mapq": pa.array(fixed["mapq"].astype(np.int32))}
    columns |= {"read": pa.array(names, pa.string()), "edits": pa.array(edits, pa.int64()), "aligned": pa.array(aligned), "covered": covered}
    return pa.record_batch(columns), at


def _plausible(buf: bytes, at: int) -> int:
    """Where the record that may start here ends; 0 if none can."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", buf, at)
    if not (33 <= size < 1 << 28 and ref >= -1 and pos >= -1 and l_name >= 2 and l_seq >= 0 and next_ref >= -1 and next_pos >= -1):
        return 0
    name = buf[at + 36 : at + 36 + l_name]
    ok = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size and len(name) == l_name and name[-1] == 0 and all(33 <= c < 127 for c in name[:-1])
    return at + 4 + size if ok else 0


def first_record(buf: bytes, is_all: bool) -> int | None:
    """The first place from which on two records or more seem to follow each other, or, if this is_all of a split, one that ends with it.

    A guess: what stands before it must turn out to complete what the split before left over, else reading fails.
    """
    for at in range(len(buf) - 36):
        end = _plausible(buf, at)
        k = 1
        while end and k < 16 and end + 36 <= len(buf):
            end, k = _plausible(buf, end), k + 1
        if end and (k >= 2 or (is_all and end == len(buf))):
            return at
    return None


def header_of(buf: bytes) -> tuple[list[str], list[int], int] | None:
    """Names and lengths of the references, and the header's size; None if buf doesn't hold all of it."""
    if not buf.startswith(b"BAM\1"[: len(buf)]):
        raise ValueError("not a BAM file")
    if len(buf) < 12:
        return None
    at = 8 + struct.unpack_from("<i", buf, 4)[0]
    if at + 4 > len(buf):
        return None
    names, lengths, n = [], [], struct.unpack_from("<i", buf, at)[0]
    at += 4
    for _ in range(n):
        if at + 4 > len(buf):
            return None
        k = struct.unpack_from("<i", buf, at)[0]
        if at + 8 + k > len(buf):
            return None
        names.append(buf[at + 4 : at + 3 + k].decode())
        lengths.append(struct.unpack_from("<i", buf, at + 4 + k)[0])
        at += 8 + k
    return names, lengths, at


def _row(kind: str, file: str, split: int, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of PARSED of one kind; what it doesn't have is null."""
    columns = {"file": pa.array([file] * n), "split": pa.array([split] * n, pa.int64()), "kind": pa.array([kind] * n), **columns}
    nested = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(f.split(" ")[0], kinds.get(f.split(" ")[1], nested)) for f in PARSED.split(", ")]
    return pa.record_batch([columns.get(f, pa.nulls(n, t)) for f, t in fields], names=[f for f, _ in fields])


class _Split:
    """What comes of the blocks of one split of a file, which are added one after the other."""

    def __init__(self, file: str, split: int) -> None:
        self.file, self.split, self.buf, self.synced, self.enough = file, split, bytearray(), False, 1 << 18

    def _piece(self, kind: str, data: bytes) -> pa.RecordBatch:
        return _row(kind, self.file, self.split, 1, {"piece": pa.array([data], pa.binary())})

    def _sync(self, is_all: bool) -> Iterator[pa.RecordBatch]:
        if self.split == 0:
            head = header_of(bytes(self.buf))
            if head:
                names, lengths, at = head
                for k in range(0, len(names), 10_000):
                    part = names[k : k + 10_000]
                    ids = pa.array(range(k, k + len(part)), pa.int32())
                    yield _row("reference", self.file, 0, len(part), {"ref_id": ids, "name": pa.array(part), "length": pa.array(lengths[k : k + 10_000], pa.int64())})
                self.synced = True
                del self.buf[:at]
            elif is_all:
                raise ValueError(f"the header of {self.file} is cut off or reaches beyond the first split: raise spark.sql.files.maxPartitionBytes")
        else:
            at = first_record(bytes(self.buf), is_all)
            if at is not None:
                yield self._piece("head", bytes(self.buf[:at]))
                self.synced = True
                del self.buf[:at]
        self.enough *= 1 if self.synced else 2

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        self.buf += data
        if len(self.buf) >= self.enough:
            if not self.synced:
                yield from self._sync(False)
            if self.synced:
                yield from self._records()

    def _records(self) -> Iterator[pa.RecordBatch]:
        rows, end = parsed(bytes(self.buf))
        del self.buf[:end]
        self.enough = len(self.buf) + (1 << 18)
        if rows.num_rows:
            yield _row("alignment", self.file, self.split, rows.num_rows, dict(zip(rows.schema.names, rows.columns)))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.synced:
            yield from self._sync(True)
        if self.synced:
            yield from self._records()
        yield self._piece("tail" if self.synced else "whole", bytes(self.buf))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Split | None = None
    for b in batches:
        for file, split, block in zip(b["file"].to_pylist(), b["split"].to_pylist(), (x.as_py() for x in b["block"])):
            if now is None or (now.file, now.split) != (file, split):
                if now:
                    yield from now.finish()
                now = _Split(file, split)
                if split == 0:  # the delimiter is the file's first bytes, so nothing stands before it
                    if block:
                        raise ValueError(f"{file} is not made of compressed blocks")
                    continue
            if not block:
                raise ValueError(f"a block of {file} is empty")
            yield from now.add(inflated(block))
    if now:
        yield from now.finish()


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie across splits, from their pieces in order."""
    for b in batches:
        for file, pieces in zip(b["file"].to_pylist(), b["pieces"].to_pylist()):
            data = b"".join(p["piece"] for p in pieces)
            rows, end = parsed(data)
            if end != len(data):
                raise ValueError(f"{file} is cut off, or its splits don't fit together")
            if rows.num_rows:
                yield _row("alignment", file, pieces[0]["split"], rows.num_rows, dict(zip(rows.schema.names, rows.columns)))


def read_alignments(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, references) of BAM files: (file, ref_id, pos, flag, mapq, read, edits, aligned, covered) and (file, ref_id, name, length).

    Files are split anywhere: Spark's text reader cuts them where a compressed block starts, each split finds its first record, and
    what it has before that is joined to what the split before left over. Pieces that don't make whole records are
    an error, so a wrong guess or a file that is cut off can't pass. pos and covered count from 0; covered are the runs on the
    reference that M, = and X take; aligned counts M, I, D, = and X; edits (NM) is null where not given. Of a file
    without records there are references only. The result is stored; sequences and qualities are not read.
    """
    rows = spark.read.option("lineSep", BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("block"))
    every = stored(rows.mapInArrow(_parse, PARSED))
    columns = ["file", *[f.split(" ")[0] for f in ALIGNMENT.split(", ")]]
    pieces = every.where(F.col("kind").isin("head", "whole", "tail")).select("file", "split", (F.col("kind") == "tail").cast("int").alias("last"), F.octet_length("piece").alias("n"), "piece")
    places = pieces.select("file", "split", "last")  # a row or two for each split
    before = Window.partitionBy("file").orderBy("split", "last").rowsBetween(Window.unboundedPreceding, 0)
    groups = places.withColumn("group", F.sum("last").over(before))  # what follows a tail up to the next one goes with it
    joined = pieces.where("n > 0").join(groups, ["file", "split", "last"]).groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("split", "last", "piece"))).alias("pieces"))
    across = joined.select("file", "pieces").mapInArrow(_rest, PARSED)
    records = every.where("kind = 'alignment'").unionByName(across).select(*columns)
    return records, every.where("kind = 'reference'").select("file", "ref_id", "name", "length")


def _encoded(ref_id: int, pos: int, flag: int, mapq: int, read: str, cigar: str, edits: int | None) -> bytes:
    """A record without sequence and qualities."""
    ops = [(int(n), OPERATIONS.index(op)) for n, op in re.findall(rf"(\d+)([{OPERATIONS}])", cigar)]
    if "".join(f"{n}{OPERATIONS[op]}" for n, op in ops) != cigar or len(ops) > 65_535 or not 0 < len(read.encode()) < 255:
        raise ValueError(f"not a record that can be written: {read}, {cigar}")
    end, name = pos + sum(n for n, op in ops if ON_REFERENCE[op]), read.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref_id, pos, len(name), mapq, _bin(pos, max(end, pos + 1)), len(ops), flag, 0, -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | op) for n, op in ops)
    if edits is not None:
        body += b"NMi" + struct.pack("<i", edits)
    return struct.pack("<i", len(body)) + body


def _bin(start: int, end: int) -> int:
    """The index bin of a half-open interval: the smallest of the nested 16 kb, 128 kb, 1 Mb, 8 Mb, 64 Mb ones that holds it, else 0."""
    for width in range(14, 29, 3):
        if start >> width == (end - 1) >> width:
            return ((1 << (29 - width)) - 1) // 7 + (start >> width)
    return 0


def write_alignments(records: DataFrame, references: DataFrame, path: str, files: int = 1, file: Column | None = None) -> None:
    """records (ref_id, pos, flag, mapq, read, cigar, edits) as a folder of BAM files, each with all references (ref_id, name, length), or with its own where these have a column file.

    file: the number, below `files`, of the file of a record, by default from a hash of read; files are named part-NUMBER. ref_id counts from 0 without gaps, in each file; records are sorted by it and pos within each file; one task writes a file. Columns beside these are not read.
    """
    names, numbers = ["file", "kind", "ref_id", "pos", "flag", "mapq", "read", "cigar", "edits"], records.sparkSession.range(files).select(F.col("id").cast("int").alias("file"))
    by = ["file"] * ("file" in references.columns)
    once = dealt(references.select(*by, "ref_id"), references.count(), *by, "ref_id").groupBy(*by, "ref_id").agg(F.count(F.lit(1)).alias("n"))
    counts = once.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"), F.max("ref_id").alias("last"))
    if counts.where("n <> different or (n > 0 and last <> n - 1)").limit(1).count():
        raise ValueError("references are not numbered from 0 without gaps")
    counts = numbers.join(counts.withColumn("file", F.col("file").cast("int")), "file", "left") if by else numbers.crossJoin(F.broadcast(counts))
    nothing = [F.lit(0).alias("flag"), F.lit(0).alias("mapq")]
    refs = references.select(F.col("file").cast("int") if by else F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("file"), F.lit(1).alias("kind"), F.col("ref_id").cast("int"), F.col("length").cast("long").alias("pos"), *nothing, F.col("name").alias("read"), F.lit("").alias("cigar"), F.lit(0).alias("edits"))
    head = counts.select("file", F.lit(0).alias("kind"), F.lit(0).alias("ref_id"), F.coalesce("n", F.lit(0)).cast("long").alias("pos"), *nothing, F.lit("").alias("read"), F.lit("").alias("cigar"), F.lit(0).alias("edits"))
    own = records.select((F.pmod(F.xxhash64("read"), F.lit(files)) if file is None else file).cast("int").alias("file"), F.lit(2).alias("kind"), F.col("ref_id").cast("int"), F.col("pos").cast("long"), F.col("flag").cast("int"), F.col("mapq").cast("int"), "read", "cigar", F.col("edits").cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf, size = bytearray(), 65_280
        out = lambda data: pa.record_batch([pa.array([b"".join(deflated(data[i : i + size]) for i in range(0, len(data), size))], pa.binary())], names=["value"])
        for b in batches:
            for _, kind, *x in zip(*[b[c].to_pylist() for c in names]):
                if kind == 0:
                    text = b"@HD\tVN:1.6\tSO:coordinate\n"
                    buf += b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", x[1])
                elif kind == 1:
                    name = x[4].encode() + b"\0"
                    buf += struct.pack("<i", len(name)) + name + struct.pack("<i", x[1])
                else:
                    buf += _encoded(*x)
                if len(buf) >= 16 * size:
                    yield out(bytes(buf[: 16 * size]))
                    del buf[: 16 * size]
        if buf:
            yield out(bytes(buf))

    rows = head.unionByName(refs).unionByName(own).repartitionById(files, F.col("file")).sortWithinPartitions("kind", "ref_id", "pos", "read").mapInArrow(pack, "value binary")
    # every row is followed by an empty block, so the last one ends the file as the format asks
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", LAST_BLOCK.decode("latin-1")).text(path)


#: Records of a file, and references that one lists, at most, where samples are written in files of bounded size.
FILE_RECORDS, FILE_REFERENCES = 400_000, 50_000


def write_samples(records: DataFrame, references: DataFrame, path: str, samples: int, file_records: int = FILE_RECORDS, file_references: int = FILE_REFERENCES) -> DataFrame:
    """records (sample, below `samples`, and what write_alignments reads) as BAM files of about file_records; (file, sample, first, again) of each file's number.

    A file lists the file_references references from `first` on, numbered from 0, and has records of a sample on these; where there
    are more than file_records, several files share them by a hash of read, all but the first of which are marked as `again`. So what a task sorts and writes doesn't
    grow with the sample, and references are not listed once for every file. records and references are read several times: store them.
    """
    chunk = F.floor(F.col("ref_id") / file_references)
    last = references.agg(F.coalesce(F.max("ref_id"), F.lit(0))).first()[0]
    every = records.sparkSession.range(last // file_references + 1).select(F.col("id").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    sizes = records.groupBy("sample", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("sample", "chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of a sample
    shares = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / file_records)).cast("int")
    sizes = every.join(sizes, ["sample", "chunk"], "left").select("sample", "chunk", shares.alias("shares"))
    sizes = stored(sizes.withColumn("start", F.coalesce(F.sum("shares").over(before), F.lit(0)).cast("int")))
    files = sizes.select(F.explode(F.sequence("start", F.col("start") + F.col("shares") - 1)).alias("file"), "sample", "chunk", "start")
    own_refs = references.withColumn("chunk", chunk).join(files.select("file", "chunk"), "chunk").withColumn("ref_id", (F.col("ref_id") % file_references).cast("int"))
    rows = records.withColumn("chunk", chunk).join(F.broadcast(sizes), ["sample", "chunk"]).withColumn("ref_id", (F.col("ref_id") % file_references).cast("int"))
    rows = rows.withColumn("file", F.col("start") + F.pmod(F.xxhash64("read"), F.col("shares")).cast("int"))
    write_alignments(rows, own_refs.drop("chunk"), path, files.count(), F.col("file"))
    return files.select("file", "sample", (F.col("chunk") * file_references).alias("first"), (F.col("file") > F.col("start")).alias("again"))


def of_samples(found: DataFrame, files: DataFrame) -> DataFrame:
    """What read_alignments found in files that write_samples wrote, with the sample as file and ref_id as it was given; `again` marks references that another file of the sample lists."""
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    rows = found.withColumn("number", number).join(F.broadcast(files.select(F.col("file").alias("number"), "sample", "first", "again")), "number")
    kept = [F.when(F.col("ref_id") >= 0, F.col("ref_id") + F.col("first")).otherwise(F.col("ref_id")).cast("int").alias(c) if c == "ref_id" else F.col("sample").alias(c) if c == "file" else F.col(c) for c in found.columns]
    return rows.select(*kept, "again")


def alignment_depths(records: DataFrame, references: DataFrame, min_identity: float = 0.0, trim: float = 0.1, ends: int = 75) -> DataFrame:
    """(file, ref_id, name, depth): trimmed mean depth of every reference of every file, 0 where nothing covers it.

    Unmapped, secondary and supplementary records don't count, nor do those of an identity (one less edits by aligned columns)
    below min_identity, of which 0.001 is the least; a mapped record without edits is an error. `ends` bases at both ends of a
    reference are left out; a reference that has no more than these has depth 0.
    """
    if not 0 <= min_identity <= 1:
        raise ValueError(f"not an identity: {min_identity}")
    identity = 1.0 - F.when(F.col("edits").isNull(), F.raise_error(F.concat(F.lit("no edit distance: "), "read")).cast("double")).otherwise(F.col("edits")) / F.col("aligned")
    good = records.where((F.col("flag").bitwiseAND(LEFT_OUT) == 0) & (F.col("ref_id") >= 0) & (F.col("aligned") > 0)).where(identity >= max(min_identity, 0.001))
    runs = good.select("file", "ref_id", F.explode("covered").alias("c")).select("file", "ref_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"))
    means = trimmed_mean_of_intervals(runs, references, ["file", "ref_id"], trim, ends)
    return references.select("file", "ref_id", "name").join(means, ["file", "ref_id"]).select("file", "ref_id", "name", "depth")
