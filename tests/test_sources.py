import bz2
import gzip
import lzma
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import names, sequences
from sparkmill.sources import fasta, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


TEXT = ">ab some words\nTA\nT\n \t\nA\nNN\n>foo\r\nCyAmmkg\r\n>bar\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fna").write_text(TEXT)
    got = [(r.contig_idx, r.name, r.seq, r.length) for r in fasta.indexed(fasta.read_fasta(spark, str(tmp_path / "a.fna"))).collect()]
    assert sorted(got) == [(0, "ab", "TATANN", 6), (1, "foo", "CyAmmkg", 7), (2, "bar", "", 0)]
    assert rows(fasta.read_fasta(spark, str(tmp_path / "a.fna")), "name", "description") == [("ab", "some words"), ("bar", ""), ("foo", "")]
    assert rows(fasta.indexed(fasta.read_fasta(spark, str(tmp_path / "a.fna")), 7), "contig_idx", "name") == [(0, "foo")]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, bytes])
def test_compression_is_told_by_content(spark, tmp_path, pack):
    (tmp_path / "x.dat").write_bytes(pack(TEXT.encode()))
    assert rows(fasta.read_fasta(spark, str(tmp_path / "x.dat"), sniff=True), "name", "seq") == [("ab", "TATANN"), ("bar", ""), ("foo", "CyAmmkg")]


def test_gzip_by_name(spark, tmp_path):
    (tmp_path / "x.fna.gz").write_bytes(gzip.compress(TEXT.encode()))
    assert rows(fasta.read_fasta(spark, str(tmp_path / "x.fna.gz")), "name", "length") == [("ab", 6), ("bar", 0), ("foo", 7)]


@pytest.mark.parametrize("text", [">a\nTAQ\n", ">a\nTA\n# comment\n", ">*a\nT\n", ">\nT\n", "> a\nT\n"])
def test_bad_fasta(spark, tmp_path, text):
    (tmp_path / "a.fna").write_text(text)
    with pytest.raises(Exception, match="not a"):
        fasta.read_fasta(spark, str(tmp_path / "a.fna")).collect()


def test_text_before_the_first_record(spark, tmp_path):
    (tmp_path / "a.fna").write_text("TA\n>a\nTA\n")
    (tmp_path / "b.fna").write_text(">a\nTA\n")
    (tmp_path / "empty.fna").write_text("")
    assert fasta.headless_files(spark, str(tmp_path)).collect()[0].file.endswith("a.fna")
    with pytest.raises(Exception, match="does not start"):
        fasta.read_fasta(spark, str(tmp_path / "a.fna"), sniff=True).collect()
    assert fasta.read_fasta(spark, str(tmp_path / "empty.fna")).collect() == []


def test_bins(spark, tmp_path):
    contigs = spark.createDataFrame([("a", "ACGT" * 40), ("b", "TT"), ("c", "GG")], "name string, seq string")
    members = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("2", "c")], "bin string, name string")
    assert fasta.write_bins(members, contigs, str(tmp_path / "bins")) == (2, 3)
    back = fasta.read_fasta(spark, str(tmp_path / "bins" / "bin=1"))
    assert rows(back, "name", "length") == [("a", 160), ("b", 2)]
    assert max(map(len, "".join(p.read_text() for p in (tmp_path / "bins" / "bin=1").glob("*.txt")).split("\n"))) == 60
    with pytest.raises(ValueError):
        fasta.write_bins(members, contigs, str(tmp_path / "x"), max_bins=1)
    with pytest.raises(KeyError):
        fasta.write_bins(members, contigs.where("name <> 'b'"), str(tmp_path / "x"))


def test_clusters(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("clustername\tcontigname\n1\ta\n1\tb\n\n# note\n1\ta\n2\tc\n")
    assert rows(tables.read_clusters(spark, str(tmp_path / "c.tsv")), "cluster", "name") == [("1", "a"), ("1", "b"), ("2", "c")]
    got = tables.read_clusters(spark, str(tmp_path / "c.tsv"), 2)
    assert rows(got, "cluster", "name") == [("1", "a"), ("1", "b")]
    assert tables.write_clusters(got, str(tmp_path / "out")) == (1, 2)
    assert rows(tables.read_clusters(spark, str(tmp_path / "out")), "cluster", "name") == [("1", "a"), ("1", "b")]
    (tmp_path / "d.tsv").write_text("1\ta\n")
    with pytest.raises(ValueError):
        tables.read_clusters(spark, str(tmp_path / "d.tsv"))


def test_taxonomies(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("contigs\tpredictions\na\tx;y\nb\t\n")
    (tmp_path / "r.tsv").write_text("contigs\tpredictions\tscores\na\tx;y\t0.5;1.2\nb\n\n")
    (tmp_path / "bad.tsv").write_text("contigs\tpredictions\tscores\na\tx;y\t0.5\n")
    assert not tables.is_refined(spark, str(tmp_path / "t.tsv")) and tables.is_refined(spark, str(tmp_path / "r.tsv"))
    assert rows(tables.read_taxonomy(spark, str(tmp_path / "t.tsv")), "name", "ranks") == [("a", ["x", "y"]), ("b", [])]
    got = tables.read_predictions(spark, str(tmp_path / "r.tsv"))
    assert rows(got, "name", "ranks", "probs") == [("a", ["x", "y"], [0.5, 1.0]), ("b", [], [])]
    tables.write_predictions(got, str(tmp_path / "o"))
    assert rows(tables.read_predictions(spark, str(tmp_path / "o")), "name", "probs") == [("a", [0.5, 1.0]), ("b", [])]
    with pytest.raises(Exception, match="not as many"):
        tables.read_predictions(spark, str(tmp_path / "bad.tsv")).collect()


def test_abundance(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("contigname\ts1\ts2\na\t1\t2.5\nb\t0\t3\n")
    long, samples = tables.read_abundance(spark, str(tmp_path / "a.tsv"))
    assert samples == ["s1", "s2"]
    assert rows(long, "name", "sample", "depth") == [("a", 0, 1.0), ("a", 1, 2.5), ("b", 0, 0.0), ("b", 1, 3.0)]
    with pytest.raises(ValueError):
        tables.read_abundance(spark, str(tmp_path / "a.tsv"), spark.createDataFrame([("a",), ("c",)], "name string"))
    for bad in ("name\ts\na\t1\n", "contigname\na\n"):
        (tmp_path / "b.tsv").write_text(bad)
        with pytest.raises(ValueError):
            tables.read_abundance(spark, str(tmp_path / "b.tsv"))
    for bad in ("a\t1\t2\n", "a\tx\n", "a\t-1\n", "a\tnan\n"):
        (tmp_path / "b.tsv").write_text("contigname\ts\n" + bad)
        with pytest.raises(Exception, match="not a"):
            tables.read_abundance(spark, str(tmp_path / "b.tsv"))[0].collect()


def test_depth_files(spark, tmp_path):
    for k, text in enumerate(("a\t1\nb\t0\n", "b\t2\textra\na\t3\n")):
        (tmp_path / f"{k}.aemb.tsv").write_text(text)
    wide, samples = tables.merge_depth_files(tables.read_depth_files(spark, str(tmp_path)))
    assert samples == ["0", "1"] and rows(wide, *wide.columns) == [("a", 1.0, 3.0), ("b", 0.0, 2.0)]
    (tmp_path / "2.aemb.tsv").write_text("a\t1\n")
    with pytest.raises(ValueError):
        tables.merge_depth_files(tables.read_depth_files(spark, str(tmp_path)))


def test_small_tables(spark, tmp_path):
    (tmp_path / "e.csv").write_text("r,a\na, b\n\n")
    assert rows(tables.read_edges(spark, str(tmp_path / "e.csv")), "parent", "child") == [("a", "b"), ("r", "a")]
    (tmp_path / "q.tsv").write_text("Name\tCompleteness\tContamination\tmore\nb1\t95.5\t1\tx\n")
    assert rows(tables.read_quality(spark, str(tmp_path / "q.tsv")), "bin", "completeness", "contamination") == [("b1", 95.5, 1.0)]
    (tmp_path / "h.txt").write_text("SN:a\tLN:100\nSN:b\tLN:300\n")
    assert rows(tables.read_sam_header(spark, str(tmp_path / "h.txt"), 200), "name", "length", "kept") == [("a", 100, False), ("b", 300, True)]
    text = tables.markers_json(spark.createDataFrame([(0, 2), (0, 1), (2, 1)], "contig_idx long, marker int"), 3, [["x"], ["y"], ["z"]], "ff")
    got, found = tables.read_markers(spark, text, "ff")
    assert rows(got, "contig_idx", "marker") == [(0, 1), (0, 2), (2, 1)] and found == [["x"], ["y"], ["z"]]
    with pytest.raises(ValueError):
        tables.read_markers(spark, text, "00")
    ids = tables.marker_ids(spark.createDataFrame([("TIGR00388",), ("TIGR00389",), ("A",)], "model string"))
    assert rows(ids, "model", "marker_id") == [("A", 0), ("TIGR00388", 1), ("TIGR00389", 1)]


@pytest.mark.parametrize(("name", "ok"), [("a", True), ("a#=*", True), ("x.1|y", True), ("#a", False), ("*a", False), ("=a", False), ("a,b", False), ("a(b", False), ("é", False)])
def test_identifiers(spark, name, ok):
    got = spark.createDataFrame([(name + " rest",)], "h string").select(sequences.identifier(F.col("h"))).first()[0]
    assert got == (name if ok else None)


def test_binsplit_names(spark):
    df = spark.createDataFrame([("S1C2C3",), ("C1",), ("S1C",), ("S1",)], "n string")
    got = df.select(names.sample_of(F.col("n"), "C"), names.rest_of(F.col("n"), "C"), names.splits(F.col("n"), "C")).collect()
    assert [tuple(r) for r in got] == [("S1", "2C3", True), ("", "1", False), ("S1", "", False), ("S1", "", False)]


def test_stream(spark, tmp_path):
    from sparkmill.streaming.depths import depth_stream, sample_totals

    for k in range(3):
        (tmp_path / f"{k}.tsv").write_text("a\t1\nb\t%d\n" % k)
    q = sample_totals(depth_stream(spark, str(tmp_path), 1)).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("totals"), "file", "total", "n_contigs") == [("0.tsv", 1.0, 2), ("1.tsv", 2.0, 2), ("2.tsv", 3.0, 2)]


def test_archives(spark, tmp_path):
    from sparkmill.sources import arrays

    latent = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "contig_idx long, v array<float>")
    arrays.save_latent(latent, str(tmp_path / "l.npz"))
    assert rows(arrays.load_latent(spark, str(tmp_path / "l.npz")), "contig_idx", "v") == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    contigs = spark.createDataFrame([(0, "a", 300), (1, "b", 400)], "contig_idx long, name string, length int")
    arrays.save_composition(contigs, latent.withColumnRenamed("v", "tnf"), str(tmp_path / "c.npz"), 250)
    c, t = arrays.load_composition(spark, str(tmp_path / "c.npz"))
    assert rows(c, "name", "length") == [("a", 300), ("b", 400)] and rows(t, "tnf") == [([1.0, 2.0],), ([3.0, 4.0],)]
    depths = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "contig_idx long, sample int, depth double")
    arrays.save_abundance(depths, ["x", "y"], str(tmp_path / "a.npz"), "ff")
    d, samples = arrays.load_abundance(spark, str(tmp_path / "a.npz"), "ff")
    assert samples == ["x", "y"] and rows(d, "contig_idx", "sample", "depth") == rows(depths, "contig_idx", "sample", "depth")
    with pytest.raises(ValueError):
        arrays.load_abundance(spark, str(tmp_path / "a.npz"), "00")
    arrays.save_composition(contigs, latent.withColumnRenamed("v", "tnf"), str(tmp_path / "d.npz"), 350)
    with pytest.raises(ValueError):
        arrays.load_composition(spark, str(tmp_path / "d.npz"))


def test_folder_without_a_setting(tmp_path):
    """A session that sets no spark.checkpoint.dir gets one local folder for all its tables."""
    code = """
from pyspark.sql import SparkSession
from sparkmill.operators.graph import components, stored
from sparkmill.sources.scratch import shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert stored(spark.range(3)).count() == 3
assert components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).where("component = 1").count() == 3
assert shared_folder(spark) == shared_folder(spark)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, timeout=240)
