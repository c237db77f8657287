"""Whole workflows: default and taxonomy-aided binning, adversarial binning, taxonomy prediction, reclustering, dereplication."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.functions.names import splits
from sparkmill.models.aae import AAE
from sparkmill.models.hierarchy import Tree
from sparkmill.models.taxonomy import BimodalVAE, LabelPredictor
from sparkmill.models.training import train_frame, width
from sparkmill.models.vae import VAE, Inputs, apply_frame, encode_frame, lists
from sparkmill.operators import bins, composition, taxonomy
from sparkmill.operators.abundance import filled
from sparkmill.operators.clustering import medoid_clusters, metadata
from sparkmill.operators.features import features
from sparkmill.operators.graph import components, stored
from sparkmill.operators.recluster import recluster_density, recluster_kmeans
from sparkmill.sources import alignments, fasta, tables
from sparkmill.sources.scratch import numbered


@dataclass
class Options:
    """Settings of a run, checked when made."""

    out: str
    min_length: int = 2000
    seed: int = 0
    sep: str | None = None
    min_fasta: int | None = None
    compress: bool = False
    n_hidden: list[int] | None = None
    n_latent: int = 32
    alpha: float | None = None
    beta: float = 200.0
    dropout: float | None = None
    epochs: int = 300
    batch: int = 256
    double_at: tuple[int, ...] = (25, 75, 150, 225)
    predictor_epochs: int = 100
    predictor_batch: int = 1024
    threshold: float = 0.5
    loss: str = "flat_softmax"
    window: int = 300
    min_successes: int = 15
    max_clusters: int | None = None
    aae: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.min_length < 250:
            raise ValueError("contigs must have at least 250 bases")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must be between 0 and 1")
        if self.epochs < 1 or self.batch < 1 or self.predictor_epochs < 1 or self.predictor_batch < 1:
            raise ValueError("epochs and batches must be at least 1")
        if list(self.double_at) != sorted(set(self.double_at)) or any(e < 0 or e >= self.epochs for e in self.double_at):
            self.double_at = tuple(sorted({e for e in self.double_at if 0 <= e < self.epochs}))
        if not 1 <= self.min_successes <= self.window:
            raise ValueError("min_successes must be between 1 and the window")
        if self.compress and self.min_fasta is None:
            raise ValueError("compress needs min_fasta")
        if self.sep == "":
            raise ValueError("the separator must not be empty")


@dataclass
class Dataset:
    """Contigs, their features and the samples."""

    contigs: DataFrame
    features: DataFrame
    samples: list[str]


def load_contigs(spark: SparkSession, path: str, least: int, sniff: bool = False) -> DataFrame:
    """Stored (contig_idx, name, seq, length) of a FASTA; two contigs of one name, or fewer than two contigs, are an error."""
    contigs = stored(fasta.indexed(fasta.read_fasta(spark, path, sniff), least))
    if composition.duplicate_names(contigs).limit(1).count():
        raise ValueError(f"{path} has a name twice")
    if contigs.limit(2).count() < 2:
        raise ValueError("at least two contigs are needed")
    return contigs


def alignment_abundance(spark: SparkSession, paths: list[str], min_identity: float = 0.0, contigs: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """((name, sample, depth) in long form, the paths as names of samples): trimmed mean depths from BAM files, a path (file or folder) for each sample.

    With contigs (name, length), every path must have each of them, of the same length, in its references; others are left out.
    """
    parts = []
    for k, path in enumerate(paths):  # a path for each sample
        records, references = alignments.read_alignments(spark, path)
        if contigs is not None:
            own = references.select("name", F.col("length").alias("found"))
            odd = contigs.join(own, "name", "left").where("found is null or found <> length").limit(1).collect()
            if odd:
                raise ValueError(f"the references of {path} are not the contigs: {odd[0]['name']}")
            references = references.join(contigs.select("name"), "name", "left_semi")
            records = records.join(references.select("file", "ref_id"), ["file", "ref_id"], "left_semi")
        one = references.groupBy("name").agg(F.min("length").alias("length"), F.max("length").alias("most"))
        if one.where("length <> most").limit(1).count():
            raise ValueError(f"the files of {path} give a reference different lengths")
        one = stored(numbered(one.select("name", "length"), [F.col("name")]).select(F.lit(path).alias("file"), F.col("i").alias("ref_id"), "name", "length"))
        records = records.join(references.select("file", "ref_id", "name"), ["file", "ref_id"]).drop("file", "ref_id").join(one.drop("length"), "name")
        parts.append(alignments.alignment_depths(records, one, min_identity).select("name", F.lit(k).alias("sample"), "depth"))
    return reduce(DataFrame.unionByName, parts), [*paths]


def load(spark: SparkSession, fasta_path: str, abundance_path: str | None, options: Options, bam_paths: list[str] | None = None, min_identity: float = 0.0) -> Dataset:
    """Composition and abundance (from a table or from BAM files) of the contigs long enough, as stored features.

    The names of the table must be those of the contigs: one that is missing or unknown is a ValueError.
    """
    if bool(abundance_path) == bool(bam_paths):
        raise ValueError("give either an abundance table or BAM files")
    contigs = load_contigs(spark, fasta_path, options.min_length)
    long, samples = tables.read_abundance(spark, abundance_path, contigs) if abundance_path else alignment_abundance(spark, bam_paths, min_identity, contigs)
    ids = [*range(len(samples))]
    kept = long.join(contigs.select("name", "contig_idx"), "name").select("contig_idx", "sample", "depth")
    tnf = composition.composition(composition.kmer_vectors(contigs))
    rows = stored(features(contigs, filled(kept, contigs.select("contig_idx"), ids), tnf, len(samples)))
    return Dataset(contigs, rows, samples)


def binsplit_separator(contigs: DataFrame, given: str | None, default: str = "C") -> str | None:
    """The separator that splits every name: the given one, else the default one if it does. A given one that does not is an error."""
    sep = given or default
    bad = contigs.where(~splits(F.col("name"), sep)).limit(1).collect()
    if bad and given:
        raise ValueError(f"{bad[0]['name']} has no separator {given}")
    return None if bad else sep


def cluster_and_write(data: Dataset, latent: DataFrame, options: Options, base: str = "vae", prefix: str = "") -> DataFrame:
    """Cluster a latent (contig_idx, v), write the unsplit, split and metadata tables and, if asked, FASTA bins; returns (cluster, contig_idx, name)."""
    points = latent.join(data.contigs.select("contig_idx", "length"), "contig_idx")
    found = medoid_clusters(points, window=options.window, min_successes=options.min_successes, seed=options.seed)
    if options.max_clusters is not None:
        found = found.where(F.col("cluster") <= options.max_clusters)
    found = stored(found.withColumn("cluster", F.concat(F.lit(prefix), F.col("cluster").cast("string"))))
    members = found.join(data.contigs.select("contig_idx", "name"), "contig_idx").select("cluster", "contig_idx", "name")
    tables.write_clusters(members, f"{options.out}/{base}_clusters_unsplit.tsv")
    metadata(found, data.contigs).write.option("sep", "\t").option("header", True).option("nullValue", "None").csv(f"{options.out}/{base}_clusters_metadata.tsv")
    write_split(members, data.contigs, options, base)
    return members


def write_split(members: DataFrame, contigs: DataFrame, options: Options, base: str) -> None:
    sep = binsplit_separator(contigs, options.sep)
    named = bins.split_by_sample(members, sep) if sep else members.select(F.col("cluster").cast("string").alias("bin"), "name")
    if sep:
        tables.write_clusters(named.withColumnRenamed("bin", "cluster"), f"{options.out}/{base}_clusters_split.tsv")
    if options.min_fasta is not None:
        large = bins.at_least_bases(named.withColumnRenamed("bin", "cluster").join(contigs.select("name", "contig_idx"), "name"), contigs.select("contig_idx", "length"), options.min_fasta)
        fasta.write_bins(large.select(F.col("cluster").alias("bin"), "name"), contigs, f"{options.out}/bins", options.compress, None)


def bin_default(data: Dataset, options: Options) -> DataFrame:
    """Features, VAE, latent, clusters."""
    vae = VAE(len(data.samples), width(data.features, "tnf"), options.n_hidden, options.n_latent, options.alpha, options.beta, options.dropout, options.seed)
    train_frame(vae, data.features, options.epochs, options.batch, options.double_at, seed=options.seed)
    latent = stored(encode_frame(vae, data.features))
    latent.write.parquet(f"{options.out}/latent")
    return cluster_and_write(data, latent, options)


def bin_adversarial(data: Dataset, options: Options) -> tuple[DataFrame, DataFrame]:
    """(clusters of the continuous latent, clusters of the categorical one): both are written."""
    aae = AAE(len(data.samples), width(data.features, "tnf"), seed=options.seed, **{k: v for k, v in options.aae.items() if k in ("n_hidden", "n_z", "n_y", "sl", "slr", "temperature")})
    train_frame(aae, data.features, options.aae.get("epochs", 70), options.aae.get("batch", 256), options.aae.get("double_at", (25, 50)), 1e-3, options.seed)
    z = cluster_and_write(data, encode_frame(aae, data.features), options, "aae_z", "z_")
    spark = data.features.sparkSession
    model = spark.sparkContext.broadcast(aae)
    y = stored(apply_frame(data.features, "category long", lambda x: [pa.array(model.value.categories(x).astype(np.int64))]))
    members = y.join(data.contigs.select("contig_idx", "name"), "contig_idx").select(F.concat(F.lit("y_"), F.col("category").cast("string")).alias("cluster"), "contig_idx", "name")
    tables.write_clusters(members, f"{options.out}/aae_y_clusters_unsplit.tsv")
    write_split(members, data.contigs, options, "aae_y")
    return z, members


def tree_of(annotated: DataFrame) -> tuple[list[str], Tree]:
    """Names of the nodes and the tree of annotations (ranks); a name at two places is an error. A tree is small: a node a taxon."""
    odd = taxonomy.ambiguous_ranks(annotated).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['name']} stands at two places of the taxonomy")
    rows = taxonomy.tree(taxonomy.edges(annotated)).orderBy("node").collect()
    at = {r["name"]: r["node"] for r in rows}
    return [r["name"] for r in rows], Tree([-1 if r["parent"] is None else at[r["parent"]] for r in rows])


def _labelled(features: DataFrame, annotated: DataFrame, names: list[str]) -> DataFrame:
    """features with a column label: the node of a contig's last rank, the root's without annotation. A node a taxon is broadcast."""
    nodes = F.broadcast(features.sparkSession.createDataFrame([*enumerate(names)], "label int, target string"))
    own = taxonomy.targets(annotated).join(nodes, "target").select("contig_idx", "label").dropDuplicates(["contig_idx"])
    return features.join(own, "contig_idx", "left").fillna(0, subset=["label"])


def predict_taxonomy(data: Dataset, annotated: DataFrame, options: Options, held_out: Column | None = None) -> DataFrame:
    """(contig_idx, ranks, probs): predictions for all contigs of a classifier trained on the annotated ones (contig_idx, ranks).

    held_out: a condition on contig_idx; then the classifier is trained on the other contigs and applied to these alone.
    The model is applied by Arrow batches.
    """
    names, tree = tree_of(annotated)
    rows = _labelled(data.features.join(annotated.select("contig_idx"), "contig_idx", "left_semi"), annotated, names)
    rows = rows if held_out is None else rows.where(~held_out)
    model = LabelPredictor(len(data.samples), tree, width(data.features, "tnf"), options.n_hidden, options.dropout, options.loss, options.seed)
    train_frame(model, rows, options.predictor_epochs, options.predictor_batch, (), 1e-3, options.seed)
    order = [k for k in np.argsort(tree.depth, kind="stable").tolist() if k]
    shared, least = data.features.sparkSession.sparkContext.broadcast((model, names)), options.threshold

    def run(x: Inputs) -> list[pa.Array]:
        model, names = shared.value
        ranks, probs = [], []
        for p in model.predict(x):
            kept = [k for k in order if p[k] > least]
            ranks.append([names[k] for k in kept])
            probs.append([min(1.0, max(0.0, float(p[k]))) for k in kept])
        return [pa.array(ranks, pa.list_(pa.string())), pa.array(probs, pa.list_(pa.float64()))]

    return apply_frame(data.features if held_out is None else data.features.where(held_out), "ranks array<string>, probs array<double>", run)


def write_taxonomy(data: Dataset, annotated: DataFrame, options: Options) -> DataFrame:
    out = stored(predict_taxonomy(data, annotated, options))
    tables.write_predictions(out.join(data.contigs.select("contig_idx", "name"), "contig_idx"), f"{options.out}/results_taxonomy.tsv")
    return out


def taxonomy_benchmark(data: Dataset, annotated: DataFrame, options: Options, folds: int = 5) -> DataFrame:
    """Accuracy by rank of predictions for each fold from the others; contigs are dealt by a seeded hash and compared by number."""
    fold = F.pmod(F.xxhash64(F.col("contig_idx").cast("long"), F.lit(options.seed)), F.lit(folds))
    parts = [predict_taxonomy(data, annotated, options, fold == k) for k in range(folds)]
    predicted = parts[0]
    for p in parts[1:]:
        predicted = predicted.unionByName(p)
    return taxonomy.accuracy(annotated, stored(predicted))


def bin_taxonomy(data: Dataset, annotated: DataFrame, options: Options, refine: bool = True) -> DataFrame:
    """Binning with labels: predictions (unless refine is off) are the labels of a bimodal autoencoder, whose joint latent is clustered."""
    if refine:
        annotated = write_taxonomy(data, annotated, options).select("contig_idx", "ranks")
    names, tree = tree_of(annotated)
    rows = stored(_labelled(data.features, annotated, names))
    model = BimodalVAE(len(data.samples), tree, width(rows, "tnf"), options.n_hidden, options.n_latent, options.alpha, options.beta, options.dropout, options.loss, options.seed)
    train_frame(model, rows, options.epochs, options.batch, options.double_at, 1e-3, options.seed)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    latent = apply_frame(rows, "v array<float>", lambda x, label: [lists(shared.value.encode(x, label))], "label")
    return cluster_and_write(data, stored(latent), options, "bimodal")


def recluster(contigs: DataFrame, latent: DataFrame, contig_markers: DataFrame, n_markers: int, options: Options, members: DataFrame | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """(cluster, contig_idx, name): k-means within given clusters (cluster, contig_idx), or density clusters by genus; written like other clusters."""
    points = latent.join(contigs.select("contig_idx", "length"), "contig_idx")
    if members is not None:
        parts = stored(recluster_kmeans(members, points, contig_markers, n_markers))
        out = parts.select(F.concat_ws("_", F.col("cluster").cast("string"), F.col("part").cast("string")).alias("cluster"), "contig_idx")
    elif annotated is not None:
        genus = annotated.select("contig_idx", taxonomy.genus(F.col("ranks")).alias("genus"))
        out = recluster_density(points.join(genus, "contig_idx"), contig_markers, n_markers)[0].select(F.col("cluster").cast("string"), "contig_idx")
    else:
        raise ValueError("clusters are needed for k-means, or a taxonomy for density clusters")
    named = stored(out.join(contigs.select("contig_idx", "name"), "contig_idx"))
    tables.write_clusters(named, f"{options.out}/clusters_reclustered_unsplit.tsv")
    write_split(named, contigs, options, "clusters_reclustered")
    return named


def dereplicate(members: DataFrame, lengths: DataFrame, quality: DataFrame, least_overlap: float = 0.75, least_completeness: float = 0.9, most_contamination: float = 0.05) -> DataFrame:
    """(bin, contig_idx) of the near-complete bins (quality in percent) of several binnings, without the worse one of bins that overlap."""
    unscored = members.join(quality, "bin", "left_anti").limit(1).collect()
    if unscored:
        raise ValueError(f"{unscored[0]['bin']} has no quality")
    good = quality.where((F.col("completeness") / 100 >= least_completeness) & (F.col("contamination") / 100 <= most_contamination))
    kept = stored(members.join(good.select("bin"), "bin", "left_semi"))
    pairs = stored(bins.worse_better(bins.overlaps(kept, lengths), good).where(F.col("weight") >= least_overlap))
    gone = bins.dereplicated(pairs, least_overlap)
    return kept.join(gone, "bin", "left_anti")


def rip(members: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members whose only overlaps are those of pairs of bins, ripped bins a--b and b--a of these pairs).

    First lone pairs lose negligible overlaps, then components of more than two bins their weakest edges, each with its
    shared contigs, until only pairs are left.
    """
    bp = bins.sizes(members.withColumnRenamed("bin", "cluster"), lengths).select(F.col("cluster").alias("bin"), "bp")
    clean = stored(bins.weak_edges_cut(members, stored(bins.overlaps(members, lengths)), bp))
    pairs = stored(bins.overlaps(clean, lengths))
    edges = stored(bins.cut_order(pairs.join(components(pairs).withColumnRenamed("node", "a"), "a")))
    clean = stored(bins.cut_shared(clean, lengths, edges.where("cut")))
    return clean, bins.ripped(clean, edges.where("not cut").select("a", "b"))
