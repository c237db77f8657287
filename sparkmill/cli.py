"""Command line: default | labelled | adversarial, predict_taxonomy, taxonomy_benchmark, recluster, dereplicate, concatenate, merge_depths, alignment_depths, bin_fasta."""

from __future__ import annotations

import argparse
import json
import os
import secrets
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkmill.functions.names import check_refhash
from sparkmill.operators import bins, composition
from sparkmill.operators.taxonomy import annotate
from sparkmill.plans import workflows as w
from sparkmill.sources import fasta, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkmill", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, *groups) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.add_argument("--outdir", required=True, help="must not exist")
        for g in groups:
            g(p)
        return p

    def general(p):
        p.add_argument("-m", type=int, default=2000, dest="min_length", help="least length of a contig")
        p.add_argument("--seed", type=int, default=None)

    def contigs(p):
        p.add_argument("--fasta", required=True)

    def depths(p):
        p.add_argument("--abundance_tsv")
        alignments(p)

    def alignments(p):
        p.add_argument("--bamfiles", nargs="+", help="a BAM file, or a folder of them, for each sample")
        p.add_argument("-z", type=float, default=0.0, dest="min_identity", help="least identity of an alignment")

    def taxa(p):
        p.add_argument("--taxonomy", required=True)
        p.add_argument("--no_predictor", action="store_true")

    def output(p):
        p.add_argument("--minfasta", type=int, default=None, dest="min_fasta")
        p.add_argument("--compress", action="store_true")
        p.add_argument("-o", dest="sep", default=None, help="separator of sample and contig")

    def vae(p):
        p.add_argument("-n", type=int, nargs="+", default=None, dest="n_hidden")
        p.add_argument("-l", type=int, default=32, dest="n_latent")
        p.add_argument("-a", type=float, default=None, dest="alpha")
        p.add_argument("-b", type=float, default=200.0, dest="beta")
        p.add_argument("-d", type=float, default=None, dest="dropout")
        p.add_argument("-e", type=int, default=300, dest="epochs")
        p.add_argument("-t", type=int, default=256, dest="batch")
        p.add_argument("-q", type=int, nargs="*", default=[25, 75, 150, 225], dest="double_at")

    def predictor(p):
        p.add_argument("-pe", type=int, default=100, dest="predictor_epochs")
        p.add_argument("-pt", type=int, default=1024, dest="predictor_batch")
        p.add_argument("-pthr", type=float, default=0.5, dest="threshold")
        p.add_argument("-ploss", choices=("flat_softmax", "cond_softmax", "soft_margin"), default="flat_softmax", dest="loss")

    def clustering(p):
        p.add_argument("-w", type=int, default=300, dest="window")
        p.add_argument("-u", type=int, default=15, dest="min_successes")
        p.add_argument("-c", type=int, default=None, dest="max_clusters")

    def aae(p):
        for flag, kind, default, name in (("--n_aae", int, 547, "n_hidden"), ("--z_aae", int, 283, "n_z"), ("--y_aae", int, 700, "n_y"), ("--sl_aae", float, 0.00964, "sl"), ("--slr_aae", float, 0.5, "slr"), ("--aae_temp", float, 0.1596, "temperature"), ("--e_aae", int, 70, "epochs"), ("--t_aae", int, 256, "batch")):
            p.add_argument(flag, type=kind, default=default, dest=f"aae_{name}")
        p.add_argument("--q_aae", type=int, nargs="*", default=[25, 50], dest="aae_double_at")

    base = (general, contigs, depths)
    add("default", *base, output, vae, clustering)
    add("adversarial", *base, output, vae, clustering, aae)
    add("labelled", *base, taxa, output, vae, clustering, predictor)
    add("predict_taxonomy", *base, taxa, predictor)
    add("taxonomy_benchmark", *base, taxa, predictor)
    p = add("recluster", general, contigs, output)
    p.add_argument("--latent_path", required=True, help="Parquet with contig_idx and v")
    p.add_argument("--markers", required=True, help="JSON of markers")
    p.add_argument("--clusters_path")
    p.add_argument("--taxonomy")
    p.add_argument("--algorithm", choices=("kmeans", "dbscan"), default="kmeans")
    p = add("dereplicate", contigs)
    p.add_argument("--clusters", nargs="+", required=True)
    p.add_argument("--quality", required=True)
    for flag, default in (("--overlap", 0.75), ("--completeness", 0.9), ("--contamination", 0.05)):
        p.add_argument(flag, type=float, default=default)
    p = add("concatenate", general)
    p.add_argument("inputs", nargs="+")
    p.add_argument("--keepnames", action="store_true")
    p = add("merge_depths")
    p.add_argument("inputs", nargs="+")
    add("alignment_depths", alignments)
    p = add("bin_fasta", contigs)
    p.add_argument("--clusters", required=True)
    p.add_argument("--minsize", type=int, default=200_000)
    return top


def options(a: argparse.Namespace) -> w.Options:
    given = {k: v for k, v in vars(a).items() if k in w.Options.__dataclass_fields__ and v is not None and k != "out"}
    if "double_at" in given:
        given["double_at"] = tuple(given["double_at"])
    extra = {k.removeprefix("aae_"): v for k, v in vars(a).items() if k.startswith("aae_")}
    if "double_at" in extra:
        extra["double_at"] = tuple(extra["double_at"])
    given["seed"] = a.seed if getattr(a, "seed", None) is not None else secrets.randbelow(2**31)
    return w.Options(out=a.outdir, aae=extra, **given)


def run(spark: SparkSession, args: list[str]) -> None:
    a = parser().parse_args(args)
    if "://" not in a.outdir and os.path.exists(a.outdir):
        raise FileExistsError(a.outdir)
    o = options(a)
    if a.command in ("default", "adversarial", "labelled", "predict_taxonomy", "taxonomy_benchmark"):
        data = w.load(spark, a.fasta, a.abundance_tsv, o, a.bamfiles, a.min_identity)
        if a.command == "default":
            w.bin_default(data, o)
        elif a.command == "adversarial":
            w.bin_adversarial(data, o)
        else:
            refined = tables.is_refined(spark, a.taxonomy)
            table = tables.to_taxonomy(tables.read_predictions(spark, a.taxonomy)) if refined else tables.read_taxonomy(spark, a.taxonomy)
            named = annotate(data.contigs.select("contig_idx", "name"), table).select("contig_idx", "ranks")
            if a.command == "labelled":
                w.bin_taxonomy(data, named, o, refine=not (refined or a.no_predictor))
            elif a.command == "predict_taxonomy":
                w.write_taxonomy(data, named, o)
            else:
                w.taxonomy_benchmark(data, named, o).orderBy("level").write.option("sep", "\t").option("header", True).csv(f"{o.out}/accuracy_report.tsv")
    elif a.command == "recluster":
        contigs = w.load_contigs(spark, a.fasta, o.min_length)
        with open(a.markers) as f:
            text = f.read()
        found, names = tables.read_markers(spark, text)
        check_refhash(contigs, json.loads(text)["refhash"], "the markers")
        latent = spark.read.parquet(a.latent_path)
        members = annotated = None
        if a.algorithm == "kmeans":
            members = bins.known(tables.read_clusters(spark, a.clusters_path), contigs).select("cluster", "contig_idx")
        else:
            annotated = annotate(contigs.select("contig_idx", "name"), tables.read_taxonomy(spark, a.taxonomy, canonical=True))
        w.recluster(contigs, latent, found, len(names), o, members, annotated)
    elif a.command == "dereplicate":
        contigs = w.load_contigs(spark, a.fasta, 250)
        rows = None
        for k, path in enumerate(a.clusters):
            c = tables.read_clusters(spark, path)
            rows = c if rows is None else rows.unionByName(c)
        members = bins.known(rows, contigs).select(F.col("cluster").alias("bin"), "contig_idx").distinct()
        out = w.dereplicate(members, contigs.select("contig_idx", "length"), tables.read_quality(spark, a.quality), a.overlap, a.completeness, a.contamination)
        tables.write_clusters(out.join(contigs.select("contig_idx", "name"), "contig_idx").select(F.col("bin").alias("cluster"), "name"), f"{a.outdir}/clusters.tsv")
    elif a.command == "concatenate":
        files = None
        for k, path in enumerate(a.inputs, 1):
            one = fasta.indexed(fasta.read_fasta(spark, path)).select(F.lit(k).alias("file_ord"), "name", "seq")
            files = one if files is None else files.unionByName(one)
        twice = composition.duplicate_names(files, *([] if a.keepnames else ["file_ord"])).limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['name']} occurs twice")
        fasta.write_fasta(composition.concatenated(files, a.min_length, not a.keepnames), f"{a.outdir}/contigs.fna", compress=True)
    elif a.command == "alignment_depths":
        if not a.bamfiles:
            raise ValueError("give a BAM file for each sample")
        long, samples = w.alignment_abundance(spark, a.bamfiles, a.min_identity)
        wide = long.groupBy(F.col("name").alias("contigname")).pivot("sample", [*range(len(samples))]).agg(F.first("depth"))
        tables.write_abundance(wide.select("contigname", *[F.col(str(k)).alias(s) for k, s in enumerate(samples)]), f"{a.outdir}/abundance.tsv")
    elif a.command == "merge_depths":
        tables.write_abundance(tables.merge_depth_files(tables.read_depth_files(spark, a.inputs))[0], f"{a.outdir}/abundance.tsv")
    else:
        contigs = w.load_contigs(spark, a.fasta, 250)
        members = bins.known(tables.read_clusters(spark, a.clusters), contigs)
        large = bins.at_least_bases(members, contigs.select("contig_idx", "length"), a.minsize)
        fasta.write_bins(large.select(F.col("cluster").alias("bin"), "name"), contigs, f"{a.outdir}/bins", max_bins=None)


def main() -> None:
    run(SparkSession.builder.appName("sparkmill").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
