import json

import numpy as np
import pytest

from sparkmill import cli
from sparkmill.functions.names import refhash, refhash_difference
from sparkmill.plans import workflows as w
from sparkmill.sources import alignments, tables

GENERA = ["d;p;c;o;f;g1", "d;p;c;o;f;g2", "d;p;c;o2;f3;g3"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Contigs of three genomes with compositions and depths of their own in two samples."""
    d, rng = tmp_path_factory.mktemp("run"), np.random.default_rng(1)
    fasta, depth, taxa = [], ["contigname\ts1\ts2\ts3"], ["contigs\tpredictions"]
    base = rng.dirichlet(np.ones(4) * 2, size=(3, 4))
    levels = rng.uniform(1, 30, size=(3, 3))
    for k in range(60):
        g, state, seq = k % 3, 0, []
        for _ in range(int(rng.integers(400, 900))):
            state = int(rng.choice(4, p=base[g, state]))
            seq.append("ACGT"[state])
        name = f"S{k % 2 + 1}C{k}"
        fasta.append(f">{name}\n{''.join(seq)}\n")
        depth.append("\t".join([name, *(f"{x:.4f}" for x in levels[g] * rng.uniform(0.9, 1.1, 3))]))
        taxa.append(f"{name}\t{GENERA[g]}")
    (d / "c.fna").write_text("".join(fasta))
    (d / "d.tsv").write_text("\n".join(depth) + "\n")
    (d / "t.tsv").write_text("\n".join(taxa) + "\n")
    return d


SMALL = ["-m", "250", "--seed", "3", "-n", "32", "-l", "6", "-e", "60", "-t", "16", "-q", "30"]


def purity(members):
    by = {}
    for r in members:
        by.setdefault(r["cluster"], []).append(int(r["name"].split("C")[1]) % 3)
    return sum(max(v.count(g) for g in range(3)) for v in by.values()) / sum(map(len, by.values()))


def test_default(spark, files, tmp_path):
    out = tmp_path / "o"
    cli.run(spark, ["default", "--outdir", str(out), "--fasta", str(files / "c.fna"), "--abundance_tsv", str(files / "d.tsv"), "--minfasta", "500", *SMALL])
    members = tables.read_clusters(spark, str(out / "vae_clusters_unsplit.tsv")).collect()
    assert len(members) == 60 and purity(members) > 0.6
    split = tables.read_clusters(spark, str(out / "vae_clusters_split.tsv")).collect()
    assert all(r["cluster"].split("C")[0] == r["name"].split("C")[0] for r in split)
    assert (out / "bins").exists() and (out / "vae_clusters_metadata.tsv").exists()
    with pytest.raises(FileExistsError):
        cli.run(spark, ["default", "--outdir", str(out), "--fasta", "x", "--abundance_tsv", "y"])


def test_adversarial(spark, files, tmp_path):
    out = tmp_path / "o"
    cli.run(spark, ["adversarial", "--outdir", str(out), "--fasta", str(files / "c.fna"), "--abundance_tsv", str(files / "d.tsv"), *SMALL, "--n_aae", "32", "--z_aae", "8", "--y_aae", "6", "--e_aae", "20", "--t_aae", "16", "--q_aae", "10"])
    assert tables.read_clusters(spark, str(out / "aae_z_clusters_unsplit.tsv")).count() == 60
    assert tables.read_clusters(spark, str(out / "aae_y_clusters_split.tsv")).count() == 60


def test_taxonomy_workflows(spark, files, tmp_path):
    args = ["--fasta", str(files / "c.fna"), "--abundance_tsv", str(files / "d.tsv"), "--taxonomy", str(files / "t.tsv"), "-pe", "60", "-pt", "32"]
    cli.run(spark, ["labelled", "--outdir", str(tmp_path / "a"), *args, *SMALL])
    assert tables.read_clusters(spark, str(tmp_path / "a" / "bimodal_clusters_unsplit.tsv")).count() == 60
    predicted = tables.read_predictions(spark, str(tmp_path / "a" / "results_taxonomy.tsv")).collect()
    right = sum(r["ranks"] == GENERA[int(r["name"].split("C")[1]) % 3].split(";") for r in predicted)
    assert right > 50
    cli.run(spark, ["taxonomy_benchmark", "--outdir", str(tmp_path / "b"), *args, "-m", "250", "--seed", "3"])
    report = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "b" / "accuracy_report.tsv")).collect()
    assert len(report) == 6 and float(report[0]["accuracy"]) == 1.0


def test_recluster(spark, files, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 4))[np.arange(60) % 3] + rng.normal(size=(60, 4)) * 0.05
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "contig_idx long, v array<double>").write.parquet(str(tmp_path / "l"))
    (tmp_path / "m.json").write_text(json.dumps({"markers": [[i // 3] if i < 9 else None for i in range(60)], "marker_names": [["a"], ["b"], ["c"]], "refhash": ""}))
    (tmp_path / "c.tsv").write_text("clustername\tcontigname\n" + "".join(f"all\tS{k % 2 + 1}C{k}\n" for k in range(60)))
    args = ["--fasta", str(files / "c.fna"), "--latent_path", str(tmp_path / "l"), "--markers", str(tmp_path / "m.json"), "-m", "250"]
    cli.run(spark, ["recluster", "--outdir", str(tmp_path / "k"), *args, "--clusters_path", str(tmp_path / "c.tsv")])
    got = tables.read_clusters(spark, str(tmp_path / "k" / "clusters_reclustered_unsplit.tsv")).collect()
    assert len({r["cluster"] for r in got}) == 3 and purity(got) == 1
    cli.run(spark, ["recluster", "--outdir", str(tmp_path / "d"), *args, "--algorithm", "dbscan", "--taxonomy", str(files / "t.tsv")])
    assert purity(tables.read_clusters(spark, str(tmp_path / "d" / "clusters_reclustered_unsplit.tsv")).collect()) == 1


def test_small_commands(spark, files, tmp_path):
    cli.run(spark, ["concatenate", "--outdir", str(tmp_path / "c"), "-m", "250", str(files / "c.fna"), str(files / "c.fna")])
    cli.run(spark, ["default", "--outdir", str(tmp_path / "x"), "--fasta", str(files / "c.fna"), "--abundance_tsv", str(files / "d.tsv"), *SMALL[:-4], "-e", "2", "-c", "3"])
    with pytest.raises(ValueError, match="twice"):
        cli.run(spark, ["concatenate", "--outdir", str(tmp_path / "e"), "-m", "250", "--keepnames", str(files / "c.fna"), str(files / "c.fna")])
    (tmp_path / "a.tsv").write_text("x\t1\ny\t2\n")
    (tmp_path / "b.tsv").write_text("y\t3\nx\t4\n")
    cli.run(spark, ["merge_depths", "--outdir", str(tmp_path / "m"), str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")])
    long, samples = tables.read_abundance(spark, str(tmp_path / "m" / "abundance.tsv"))
    assert samples == ["a", "b"] and long.count() == 4


def test_dereplicate(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "bin string, contig_idx long")
    lengths = spark.createDataFrame([(1, 900), (2, 100), (3, 500)], "contig_idx long, length int")
    quality = spark.createDataFrame([("a", 95.0, 1.0), ("b", 91.0, 0.0), ("c", 20.0, 0.0)], "bin string, completeness double, contamination double")
    assert {r.bin for r in w.dereplicate(members, lengths, quality).collect()} == {"b"}
    with pytest.raises(ValueError, match="no quality"):
        w.dereplicate(members, lengths, quality.where("bin <> 'c'"))
    clean, ripped = w.rip(members, lengths)
    assert {(r.bin, r.contig_idx) for r in ripped.collect()} == {("a--b", 2)}


@pytest.mark.parametrize("bad", [{"min_length": 100}, {"threshold": 2}, {"epochs": 0}, {"min_successes": 0}, {"compress": True}, {"sep": ""}])
def test_options(bad):
    with pytest.raises(ValueError):
        w.Options("x", **bad)


def test_depths_from_alignments(spark, files, tmp_path):
    """Depths of two samples, one of them in two files, written by the command; the same files as input of a workflow."""
    contigs = w.load_contigs(spark, str(files / "c.fna"), 250).select("name", "length", "contig_idx")
    refs = contigs.select(w.F.col("contig_idx").cast("int").alias("ref_id"), "name", "length")
    reads = refs.select("ref_id", w.F.explode(w.F.sequence(w.F.lit(0), w.F.col("ref_id") % 4)).alias("i"), "length")
    reads = reads.select("ref_id", w.F.lit(0).alias("pos"), w.F.lit(0).alias("flag"), w.F.lit(9).alias("mapq"), w.F.concat_ws(".", "ref_id", "i").alias("read"), w.F.concat(w.F.col("length").cast("string"), w.F.lit("M")).alias("cigar"), (w.F.col("i") * 100).alias("edits"))
    for name, n in (("one", 1), ("two", 2)):
        alignments.write_alignments(reads, refs, str(tmp_path / name), files=n)
    paths = [str(tmp_path / name) for name in ("one", "two")]
    cli.run(spark, ["alignment_depths", "--outdir", str(tmp_path / "o"), "--bamfiles", *paths])
    long, samples = tables.read_abundance(spark, str(tmp_path / "o" / "abundance.tsv"), contigs)
    ids = {r.name: r.contig_idx for r in contigs.collect()}
    assert samples == paths and {(ids[r.name] % 4 + 1, r.depth) for r in long.collect()} == {(k, float(k)) for k in (1, 2, 3, 4)}
    strict = {r.name: r.depth for r in w.alignment_abundance(spark, paths[:1], 0.9, contigs)[0].collect()}
    assert all(strict[n] < ids[n] % 4 + 1 for n in ids if ids[n] % 4 == 3)
    data = w.load(spark, str(files / "c.fna"), None, w.Options(str(tmp_path / "x"), min_length=500), paths)
    assert data.features.count() == data.contigs.count() < 60
    with pytest.raises(ValueError, match="either"):
        w.load(spark, str(files / "c.fna"), str(files / "d.tsv"), w.Options("x"), paths)
    with pytest.raises(ValueError, match="are not the contigs"):
        w.alignment_abundance(spark, paths, 0.0, contigs.withColumn("length", w.F.col("length") + 1))


def test_names_and_hashes_that_do_not_fit_are_errors(spark, files, tmp_path):
    (tmp_path / "d.tsv").write_text((files / "d.tsv").read_text() + "unknown\t1\t1\t1\n")
    with pytest.raises(ValueError, match="unknown"):
        w.load(spark, str(files / "c.fna"), str(tmp_path / "d.tsv"), w.Options("x", min_length=250))
    (tmp_path / "c.tsv").write_text("clustername\tcontigname\na\tS1C0\na\tmissing\n")
    for command in (["bin_fasta", "--clusters"], ["dereplicate", "--quality", "q", "--clusters"]):
        with pytest.raises(ValueError, match="missing"):
            cli.run(spark, [command[0], "--outdir", str(tmp_path / "o"), "--fasta", str(files / "c.fna"), *command[1:], str(tmp_path / "c.tsv")])
    spark.range(1).select(w.F.col("id").alias("contig_idx"), w.F.array(w.F.lit(1.0)).alias("v")).write.parquet(str(tmp_path / "l"))
    args = ["recluster", "--outdir", str(tmp_path / "r"), "--fasta", str(files / "c.fna"), "-m", "250", "--latent_path", str(tmp_path / "l"), "--clusters_path", str(tmp_path / "c.tsv"), "--markers", str(tmp_path / "m.json")]
    right = refhash(w.load_contigs(spark, str(files / "c.fna"), 250)).first()["refhash"]
    for given, fault in (("00", "other contigs"), (right, "missing")):
        (tmp_path / "m.json").write_text(json.dumps({"markers": [[0]] + [None] * 59, "marker_names": [["a"]], "refhash": given}))
        with pytest.raises(ValueError, match=fault):
            cli.run(spark, args)


def test_names_are_compared_where_blocks_differ(spark):
    left = spark.range(20_000).select(w.F.col("id").alias("contig_idx"), w.F.concat(w.F.lit("n"), w.F.col("id").cast("string")).alias("name"))
    right = left.where("contig_idx <> 7").withColumn("name", w.F.when(w.F.col("contig_idx") == 9000, "other").when(w.F.col("contig_idx") == 50, "n50  ").otherwise(w.F.col("name")))
    right = right.unionByName(spark.createDataFrame([(30_000, "more")], "contig_idx long, name string"))
    got = sorted(tuple(r) for r in refhash_difference(left, right).collect())
    assert got == [(7, "n7", None), (9000, "n9000", "other"), (30_000, None, "more")]
    assert refhash_difference(left, left).count() == 0
