import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmill.operators import abundance
from sparkmill.sources import alignments, scratch


def file_of(records, refs, cut):
    """A BAM file whose blocks end anywhere, records across them: cut tells the size of each block's content."""
    data = b"BAM\1" + struct.pack("<ii", 0, len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs) + b"".join(records)
    out, at = b"", 0
    while at < len(data):
        n = cut()
        out += alignments.deflated(data[at : at + n])
        at += n
    return out + alignments.LAST_BLOCK


def record(name, ref, pos, cigar, flag=0, seq=0, tags=b""):
    ops = [(int(n), alignments.OPERATIONS.index(op)) for n, op in cigar]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 9, 0, len(ops), flag, seq, -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", n << 4 | op) for n, op in ops) + bytes((seq + 1) // 2) + bytes([30] * seq) + tags
    return struct.pack("<i", len(body)) + body


NM = b"RGZgroup\0" + b"XAA!" + b"ZBBS" + struct.pack("<iHH", 2, 7, 9)


@pytest.mark.parametrize("split", [700, 5_000, 1 << 27])
def test_splits_anywhere_give_every_record_once(spark, tmp_path, split):
    rng = random.Random(split)
    refs = [("contig%d" % i, 10_000) for i in range(3)]
    records, expected = [], []
    for i in range(600):
        pos, a, b, e = rng.randrange(1000), rng.randrange(1, 90), rng.randrange(1, 90), rng.randrange(40)
        cigar = [(4, "S"), (a, "M"), (3, "I"), (2, "D"), (b, "="), (7, "N"), (1, "X")]
        records.append(record("read%d" % i, i % 3, pos, cigar, seq=rng.choice([0, 31, 4000 if i % 50 == 0 else 5]), tags=NM + b"NMC" + bytes([e])))
        covered = [(pos, pos + a), (pos + a + 2, pos + a + 2 + b), (pos + a + b + 9, pos + a + b + 10)]
        expected.append(("read%d" % i, i % 3, pos, e, a + b + 6, covered))
    (tmp_path / "one.bam").write_bytes(file_of(records, refs, lambda: rng.choice([1, 40, 300, 2000])))
    (tmp_path / "none.bam").write_bytes(file_of([], refs, lambda: 50))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found, names = alignments.read_alignments(spark, str(tmp_path))
        if split < 1 << 27:  # some tasks have begun in the middle of the file
            assert found.select("file").rdd.getNumPartitions() > 1
        rows = [(r["read"], r.ref_id, r.pos, r.edits, r.aligned, [tuple(c) for c in r.covered]) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == sorted(expected)
    assert sorted((r.file.rpartition("/")[2], r.ref_id, r.name, r.length) for r in names.collect()) == sorted((f, i, *x) for f in ("one.bam", "none.bam") for i, x in enumerate(refs))


def test_a_cigar_too_long_for_its_field_stands_in_a_tag(spark, tmp_path):
    words = [(5, 0), (2, 2), (6, 7)]
    tag = b"NMi" + struct.pack("<i", 3) + b"CGBI" + struct.pack("<i3I", 3, *[n << 4 | op for n, op in words])
    (tmp_path / "x").write_bytes(file_of([record("r", 0, 10, [(11, "S"), (13, "N")], seq=11, tags=tag), record("s", 0, 1, [(4, "M")])], [("c", 99)], lambda: 30))
    got = {r["read"]: ([tuple(c) for c in r.covered], r.aligned, r.edits) for r in alignments.read_alignments(spark, str(tmp_path))[0].collect()}
    assert got == {"r": ([(10, 15), (17, 23)], 13, 3), "s": ([(1, 5)], 4, None)}


@pytest.mark.parametrize("fault", ["cut", "block", "text"])
def test_damaged_files_are_errors(spark, tmp_path, fault):
    data = file_of([record("r%d" % i, 0, i, [(9, "M")]) for i in range(50)], [("c", 99)], lambda: 500)
    blocks = data.split(alignments.BLOCK)
    if fault == "cut":
        data = alignments.BLOCK.join(blocks[:-2])
    elif fault == "block":
        data = data[:-60] + bytes([data[-60] ^ 255]) + data[-59:]
    else:
        data = b"contig\t1\n"
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(Exception, match="cut off|damaged|not made of compressed blocks|decompressing"):
        alignments.read_alignments(spark, str(tmp_path))[0].collect()


def test_round_trip_and_depths_against_single_bases(spark, tmp_path):
    rng = random.Random(4)
    refs = [(0, "a", 900), (1, "b", 151), (2, "c", 150), (3, "bare", 400)]
    rows = []
    for i in range(300):
        ref, name, size = rng.choice(refs[:3])
        n = rng.randrange(1, 120)
        rows.append((ref, rng.randrange(size - n + 1), rng.choice([0, 16, 256, 2048, 4]), 60, "r%d" % i, "%dM" % n, rng.choice([0, 1, 5])))
    reads = spark.createDataFrame([(*r, "x") for r in rows], "ref_id int, pos long, flag int, mapq int, read string, cigar string, edits int, file string")
    contigs = spark.createDataFrame(refs, "ref_id int, name string, length int")
    alignments.write_alignments(reads, contigs, str(tmp_path / "out"), files=2)
    found, names = alignments.read_alignments(spark, str(tmp_path / "out"))
    got = sorted((r.ref_id, r.pos, r.flag, r.mapq, r["read"], "%dM" % r.aligned, r.edits) for r in found.collect())
    assert got == sorted(rows) and names.count() == 8
    one = names.withColumn("file", alignments.F.lit("all")).distinct()
    depths = {r.name: r.depth for r in alignments.alignment_depths(found.withColumn("file", alignments.F.lit("all")), one, 0.95).collect()}
    for ref, name, size in refs:
        per_base = np.zeros(size)
        for r in rows:
            n = int(r[5][:-1])
            if r[0] == ref and not r[2] & alignments.LEFT_OUT and 1 - r[6] / n >= 0.95:
                per_base[r[1] : r[1] + n] += 1
        inner = np.sort(per_base[75 : size - 75])
        cut = len(inner) // 10
        assert depths[name] == pytest.approx(inner[cut : len(inner) - cut].mean() if len(inner) else 0.0)
    with pytest.raises(Exception, match="no edit distance"):
        alignments.alignment_depths(found.withColumn("edits", alignments.F.lit(None).cast("long")), names).collect()
    with pytest.raises(ValueError, match="gaps"):
        alignments.write_alignments(reads, contigs.where("ref_id <> 1"), str(tmp_path / "no"))


@pytest.mark.parametrize("tile", [7, 1 << 16])
def test_depth_runs_against_single_bases(spark, tile):
    rng = random.Random(tile)
    rows = [(k, s, s + rng.choice([0, 1, 5, 60])) for k in "ab" for s in (rng.randrange(140) for _ in range(40))] + [("a", 0, 200), ("b", 199, 200)]
    intervals = spark.createDataFrame(rows, "k string, start long, end long")
    lengths = spark.createDataFrame([("a", 200), ("b", 200), ("c", 9), ("d", 0)], "k string, length int")
    got = {(r.k, r.depth): r.bases for r in abundance.depth_runs(intervals, lengths, ["k"], tile).collect()}
    expected = {("c", 0): 9}
    for k in "ab":
        per_base = np.zeros(200, int)
        for key, s, e in rows:
            if key == k:
                per_base[s:e] += 1
        expected |= {(k, int(d)): int(n) for d, n in zip(*np.unique(per_base, return_counts=True))}
    assert got == expected
    for bad in [("a", 190, 201), ("a", -1, 3), ("z", 0, 1)]:
        with pytest.raises(Exception, match="beyond its reference"):
            abundance.depth_runs(intervals.unionByName(spark.createDataFrame([bad], intervals.schema)), lengths, ["k"], tile).collect()


def test_a_long_contig_costs_its_events(spark):
    """A hundred million bases under a few intervals: a row for each depth, made from a handful of events."""
    intervals = spark.createDataFrame([("a", 0, 50_000_000), ("a", 20_000_000, 100_000_000)], "k string, start long, end long")
    lengths = spark.createDataFrame([("a", 100_000_000)], "k string, length long")
    assert {r.depth: r.bases for r in abundance.depth_runs(intervals, lengths, ["k"]).collect()} == {1: 70_000_000, 2: 30_000_000}
    assert abundance.trimmed_mean_of_intervals(intervals, lengths, ["k"]).first().depth == pytest.approx((60 + 2 * 20) / 80)


def test_files_and_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """A sample's records go to files of bounded size that list a range of references each, and sweeps to tasks by their number."""
    rng = random.Random(8)
    refs = spark.createDataFrame([(i, "c%d" % i, 400) for i in range(25)], "ref_id int, name string, length int")
    rows = [(rng.randrange(2), 3 if rng.random() < 0.5 else rng.randrange(25), rng.randrange(300), 0, 60, "r%d" % i, "90M", 0) for i in range(600)] + [(0, 24, 5, 4, 0, "last", "90M", 0)]
    reads = spark.createDataFrame(rows, "sample int, ref_id int, pos long, flag int, mapq int, read string, cigar string, edits int")
    files = alignments.write_samples(reads, refs, str(tmp_path / "parts"), 3, file_records=40, file_references=10)
    raw, _ = alignments.read_alignments(spark, str(tmp_path / "parts"))
    sizes = [r["count"] for r in raw.groupBy("file").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 80 and len(sizes) > 12
    found, names = (alignments.of_samples(x, files) for x in alignments.read_alignments(spark, str(tmp_path / "parts")))
    assert sorted((r.file, r.ref_id, r.pos, r["read"]) for r in found.collect()) == sorted((r[0], r[1], r[2], r[5]) for r in rows)
    names = names.where("not again")
    assert sorted((r.file, r.ref_id, r.name) for r in names.collect()) == [(k, i, "c%d" % i) for k in range(3) for i in range(25)]
    depths = {(r.file, r.ref_id): r.depth for r in alignments.alignment_depths(found, names).collect()}
    for k in range(3):
        for i in range(25):
            per_base = np.zeros(400)
            for r in rows:
                if r[:2] == (k, i) and not r[3]:
                    per_base[r[2] : r[2] + 90] += 1
            assert depths[k, i] == pytest.approx(np.sort(per_base[75:325])[25:225].mean())
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)
    runs = reads.select("ref_id", F.col("pos").alias("start"), (F.col("pos") + 90).alias("end"))
    assert abundance.depth_runs(runs, refs, ["ref_id"]).rdd.getNumPartitions() >= 2 * len(rows) / 50
