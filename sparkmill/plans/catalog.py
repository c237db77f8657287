"""Every query by name over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions import names, sequences, vectors
from sparkmill.operators import abundance, bins, composition, features, graph, markers, neighbours, recluster
from sparkmill.operators import taxonomy as tax
from sparkmill.plans import standins as s
from sparkmill.plans.standins import LEAST, N_SAMPLES, SEP, sql
from sparkmill.sources import alignments
from sparkmill.sources.scratch import dealt, numbered, shared_folder, stored

#: Dimensions of the embeddings, which stand in for compositions.
DIMS = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(column: str, name: str | None = None):
    return F.round(F.col(column).cast("double"), 6).alias(name or column)


def long(column: str, name: str | None = None):
    return F.col(column).cast("long").alias(name or column)


# --- contigs and composition


@query(sql("contigs", f"SELECT count(*) FILTER (length >= {LEAST}) AS n_seqs, sum(CASE WHEN length >= {LEAST} THEN length ELSE 0 END)::BIGINT AS n_bases, count(*) FILTER (length < {LEAST}) AS n_removed FROM contigs"))
def contig_stats(spark, d):
    return composition.dataset_totals(s.lengths(spark, d), LEAST)


@query(sql("contigs", f"SELECT contig_idx, name, length FROM contigs WHERE length >= {LEAST}"))
def min_length_filter(spark, d):
    return composition.min_length(s.lengths(spark, d), LEAST).select("contig_idx", "name", "length")


_KMERS = f"k AS (SELECT contig_idx, kmer, count(*) AS n FROM (SELECT contig_idx, l[i] || l[i + 1] || l[i + 2] || l[i + 3] AS kmer FROM (SELECT contig_idx, l, unnest(range(1, len(l) - 2)) AS i FROM (SELECT contig_idx, string_split(upper(seq), '') AS l FROM contigs WHERE length >= {LEAST}))) WHERE regexp_full_match(kmer, '[ACGT]{{4}}') GROUP BY ALL)"


@query(sql("contigs", f", {_KMERS} SELECT * FROM k".replace("\n,", ",")).replace("\n, k AS", ",\nk AS"))
def kmer_counts(spark, d):
    return composition.kmer_counts(composition.kmer_vectors(composition.min_length(s.contigs(spark, d), LEAST)))


@query(sql("contigs", f", {_KMERS}, b AS (SELECT contig_idx, kmer, n / 2 AS h FROM k UNION ALL SELECT contig_idx, translate(reverse(kmer), 'ACGT', 'TGCA'), n / 2 FROM k) SELECT contig_idx, kmer, round(sum(h) / any_value(t.n), 6) AS freq FROM b JOIN (SELECT contig_idx, sum(n) AS n FROM k GROUP BY 1) t USING (contig_idx) GROUP BY ALL").replace("\n, k AS", ",\nk AS"))
def kmer_freq_rc(spark, d):
    vectors = composition.kmer_vectors(composition.min_length(s.contigs(spark, d), LEAST))
    return composition.kmer_frequencies(vectors).select("contig_idx", "kmer", r6("freq"))


@query()
def composition_tnf(spark, d):
    rows = composition.kmer_vectors(composition.min_length(s.contigs(spark, d), LEAST))
    return composition.composition(rows.where(F.exists("counts", lambda x: x > 0)))


@query(sql("contigs", "SELECT 'S' || (contig_idx % 3 + 1) || 'C' || name AS name, length FROM contigs WHERE length >= 2000"))
def concat_rename(spark, d):
    files = s.contigs(spark, d).select((F.col("contig_idx") % 3 + 1).alias("file_ord"), "name", "seq")
    return composition.concatenated(files, 2000).select("name", F.length("seq").alias("length"))


@query("SELECT source AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return composition.duplicate_names(s.table(spark, d, "documents").select(F.col("source").alias("name")))


@query(sql("contigs", f"SELECT contig_idx, md5('>' || name || chr(10) || rtrim(regexp_replace(seq2, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS record FROM (SELECT *, regexp_replace(seq, '[^a-z]', 'n', 'g') AS seq2 FROM contigs) WHERE length >= {LEAST}"))
def fasta_wrap(spark, d):
    c = composition.min_length(s.contigs(spark, d), LEAST)
    seq = F.regexp_replace("seq", "[^a-z]", "n")
    return c.select("contig_idx", F.md5(sequences.fasta_record(F.col("name"), seq).cast("binary")).alias("record"))


@query("SELECT page_id, CASE WHEN regexp_matches(h, '^[0-9A-Za-z!#$%&+./:;?@^_|~-][0-9A-Za-z!#$%&*+./:;=?@^_|~-]*$') AND NOT regexp_matches(h, '^[#*=]') THEN h END AS identifier FROM (SELECT page_id, regexp_extract(url, '^([^ \\t\\r\\n]*)', 1) AS h FROM pages)")
def fasta_identifiers(spark, d):
    return s.table(spark, d, "pages").select("page_id", sequences.identifier(F.col("url")).alias("identifier"))


@query(sql("contigs", "SELECT contig_idx, translate(array_to_string(list_reverse(string_split(seq, '')), ''), 'ACGTacgt', 'TGCAtgca') AS rc FROM contigs"))
def reverse_complements(spark, d):
    """Every contig whole, whatever its length and characters."""
    return s.contigs(spark, d).select("contig_idx", sequences.reverse_complement(F.col("seq")).alias("rc"))


# --- names, bins by sample, hashes


@query(sql("contigs", "SELECT split_part(name, 'C', 1) || 'C' || (contig_idx % 10) AS bin, count(*) AS n_contigs, sum(length)::BIGINT AS bp FROM contigs GROUP BY 1"))
def binsplit(spark, d):
    c = s.lengths(spark, d)
    split = bins.split_by_sample(c.select((F.col("contig_idx") % 10).alias("cluster"), "name"), SEP)
    return split.join(c, "name").groupBy("bin").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.col("length").cast("long")).alias("bp"))


@query("SELECT count(*) FILTER (NOT (position('h' IN url) > 1 AND length(substr(url, position('h' IN url) + 1)) > 0)) AS n_bad, count(*) AS n FROM pages")
def binsplit_check(spark, d):
    return bins.unsplittable(s.table(spark, d, "pages").select(F.col("url").alias("name")), "h").select("n_bad", "n")


@query(sql("contigs", "SELECT contig_idx % 10 AS cluster, contig_idx FROM contigs WHERE contig_idx % 10 IN (SELECT contig_idx % 10 FROM contigs GROUP BY 1 HAVING sum(length) >= (SELECT sum(length) / 10 FROM contigs))"))
def bin_size_filter(spark, d):
    c = s.lengths(spark, d)
    least = c.agg((F.sum("length") / 10).alias("x")).first()[0]
    return bins.at_least_bases(c.select((F.col("contig_idx") % 10).alias("cluster"), "contig_idx"), c.select("contig_idx", "length"), least)


@query("SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS contig_idx FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4)")
def cluster_min_size(spark, d):
    return bins.at_least_members(s.table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("contig_idx")), 4).select("cluster", "contig_idx")


@query(sql("contigs", "SELECT contig_idx % 10 AS part, md5(string_agg(regexp_replace(name, '\\s+$', ''), '' ORDER BY contig_idx)) AS refhash FROM contigs GROUP BY 1"))
def refhash(spark, d):
    return names.refhash(s.lengths(spark, d).withColumn("part", F.col("contig_idx") % 10), groups=("part",))


@query(sql("contigs", "SELECT contig_idx, l.name AS left_name, r.name AS right_name FROM (SELECT * FROM contigs WHERE contig_idx % 50 <> 3) l FULL JOIN (SELECT contig_idx, CASE WHEN contig_idx % 40 = 0 THEN name || 'x' ELSE name END AS name FROM contigs WHERE contig_idx % 60 <> 7) r USING (contig_idx) WHERE l.name IS DISTINCT FROM r.name"))
def refhash_check(spark, d):
    c = s.lengths(spark, d)
    other = c.withColumn("name", F.when(F.col("contig_idx") % 40 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))).where("contig_idx % 60 <> 7")
    return names.refhash_difference(c.where("contig_idx % 50 <> 3"), other)


@query("SELECT 'S' || l_suppkey % 3 || 'C' || l_orderkey AS name FROM lineitem EXCEPT SELECT 'S' || o_custkey % 3 || 'C' || o_orderkey FROM orders")
def unknown_contigs(spark, d):
    members = s.table(spark, d, "lineitem").select(names.renamed(F.col("l_suppkey") % 3, F.col("l_orderkey").cast("string")).alias("name"))
    contigs = s.table(spark, d, "orders").select(names.renamed(F.col("o_custkey") % 3, F.col("o_orderkey").cast("string")).alias("name"))
    return bins.unknown_contigs(members, contigs)


# --- abundance and features


_FILLED = "f AS (SELECT p.p_partkey AS contig_idx, s.sample, coalesce(depth, 0) AS depth FROM part p, (SELECT unnest(range(6))::INT AS sample) s LEFT JOIN depths ON depths.contig_idx = p.p_partkey AND depths.sample = s.sample)"
_SCALED = _FILLED + ", m AS (SELECT contig_idx, sample, depth * 1e6 / sum(depth) OVER (PARTITION BY sample) AS depth FROM f), t AS (SELECT *, sum(depth) OVER (PARTITION BY contig_idx) AS total FROM m)"


def _after(views: str, more: str) -> str:
    return sql(views, ", " + more).replace("\n, ", ",\n", 1)


def _filled(spark, d):
    ids = s.depth_contigs(spark, d).select("contig_idx")
    return abundance.filled(s.depths(spark, d), ids, [*range(N_SAMPLES)])


@query(_after("depths", _FILLED + " SELECT * FROM (PIVOT f ON sample IN (0, 1, 2, 3, 4, 5) USING sum(depth) GROUP BY contig_idx)").replace("SELECT * FROM (PIVOT", "SELECT contig_idx, " + ", ".join(f'"{i}" AS sample_{i}' for i in range(N_SAMPLES)) + " FROM (PIVOT"))
def abundance_merge(spark, d):
    return abundance.merged_wide(_filled(spark, d), [*range(N_SAMPLES)])


@query(_after("depths", f"n AS (SELECT 1) SELECT contig_idx, count(DISTINCT sample) AS n_samples, count(*) AS n_rows FROM depths GROUP BY 1 HAVING count(DISTINCT sample) <> {N_SAMPLES} OR count(*) <> {N_SAMPLES}"))
def abundance_merge_faults(spark, d):
    return abundance.merge_faults(s.depths(spark, d), N_SAMPLES)


@query(_after("depths", _SCALED + " SELECT contig_idx, sample, round(depth, 6) AS depth, round(CASE WHEN total = 0 THEN 1 / 6 ELSE depth / total END, 6) AS share FROM t"))
def depth_normalise(spark, d):
    return abundance.scaled(_filled(spark, d), N_SAMPLES).select("contig_idx", "sample", r6("depth"), r6("share"))


@query(_after("depths", _SCALED + ", g AS (SELECT DISTINCT contig_idx, ln(greatest(total, 0.001)) AS l FROM (SELECT contig_idx, any_value(total) AS total FROM t GROUP BY 1)) SELECT contig_idx, round((l - avg(l) OVER ()) / stddev_pop(l) OVER (), 6) AS total_ab FROM g"))
def total_abundance_z(spark, d):
    return features.total_abundance(abundance.scaled(_filled(spark, d), N_SAMPLES)).select("contig_idx", r6("total_ab"))


@query(sql("contigs", f"SELECT contig_idx, round(w * count(*) OVER () / sum(w) OVER (), 6) AS weight FROM (SELECT contig_idx, greatest(ln(length) - 5, 2) AS w FROM contigs WHERE length >= {LEAST})"))
def length_weights(spark, d):
    return features.length_weights(composition.min_length(s.lengths(spark, d), LEAST)).select("contig_idx", r6("weight"))


@query("SELECT vec_id, dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_pop(x) OVER (PARTITION BY dim), 5) AS z FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def column_zscore(spark, d):
    e = s.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return vectors.zscored(e, "x", ["dim"]).select("vec_id", "dim", F.round("z", 5).alias("z"))


@query("SELECT contig_idx, round(avg(depth), 6) AS depth FROM (SELECT l_orderkey AS contig_idx, l_quantity AS depth, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1")
def trimmed_mean(spark, d):
    li = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("contig_idx"), F.col("l_quantity").alias("depth"))
    return abundance.trimmed_mean(li, trim=0.2).select("contig_idx", r6("depth"))


_READS = "refs AS (SELECT p_partkey AS contig_idx, p_size * 100 + 250 AS length FROM part), reads AS (SELECT (l_suppkey % 6)::INT AS sample, l_partkey AS contig_idx, length, (l_quantity * 5)::BIGINT AS n, l_orderkey * 37 % (length - (l_quantity * 5)::BIGINT + 1) AS start, l_linenumber AS edits, l_returnflag AS flag FROM lineitem JOIN refs ON contig_idx = l_partkey)"


def _trimmed(groups: str, n: str, digits: int = 6) -> str:
    """Mean of the middle of all per-base depths, bases without any included, of what per_base (groups, depth, length) has."""
    return f"SELECT {groups}, coalesce(round(list_avg(d[1 + floor(({n}) * 0.1)::INT : ({n}) - floor(({n}) * 0.1)::INT]), {digits}), 0) AS depth FROM (SELECT {groups}, length, list_sort(list_concat(list(depth), list_transform(range(({n}) - count(*)), lambda x: 0))) AS d FROM per_base GROUP BY {groups}, length)"


@query(f"WITH {_READS}, per_base AS (SELECT contig_idx, length, count(*) AS depth FROM (SELECT contig_idx, length, unnest(range(start, start + n)) AS p FROM reads) GROUP BY contig_idx, length, p), means AS ({_trimmed('contig_idx', 'length')}) SELECT contig_idx, coalesce(depth, 0) AS depth FROM refs LEFT JOIN means USING (contig_idx)")
def interval_depths(spark, d):
    """Trimmed mean depth of every contig from the intervals of its reads."""
    reads = s.reads(spark, d).select("contig_idx", "start", (F.col("start") + F.col("n")).alias("end"))
    return abundance.trimmed_mean_of_intervals(reads, s.depth_contigs(spark, d), ["contig_idx"]).select("contig_idx", r6("depth"))


@query(f"WITH {_READS}, per_base AS (SELECT sample, contig_idx, length, count(*) AS depth FROM (SELECT sample, contig_idx, length, unnest(range(start, start + n)) AS p FROM reads WHERE flag <> 'R' AND 1 - edits / n >= 0.97) WHERE p >= 75 AND p < length - 75 GROUP BY sample, contig_idx, length, p), means AS ({_trimmed('sample, contig_idx', 'length - 150', 9)}) SELECT sample, contig_idx, coalesce(depth, 0) AS depth FROM refs CROSS JOIN (SELECT unnest(range(6))::INT AS sample) LEFT JOIN means USING (sample, contig_idx)")
def alignment_depths(spark, d):
    """Reads of each sample written as BAM files and read back: trimmed mean depths by records of an identity of 0.97 or more that aren't secondary."""
    refs = numbered(s.depth_contigs(spark, d).select(F.col("contig_idx").cast("string").alias("name"), "length"), [F.col("name")]).select(F.col("i").cast("int").alias("ref_id"), "name", "length")
    refs = stored(refs)
    reads = s.reads(spark, d).withColumn("name", F.col("contig_idx").cast("string")).join(refs.select("name", "ref_id"), "name")
    reads = stored(reads.select("sample", "ref_id", F.col("start").alias("pos"), F.when(F.col("flag") == "R", 256).otherwise(0).alias("flag"), F.lit(60).alias("mapq"), F.col("read"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"), "edits"))
    folder = f"{shared_folder(spark)}/alignments-{uuid.uuid4().hex}"
    files = alignments.write_samples(reads, refs, folder, N_SAMPLES)
    records, found = (alignments.of_samples(x, files) for x in alignments.read_alignments(spark, folder))
    out = alignments.alignment_depths(records, found.where("not again"), 0.97)
    return out.select(F.col("file").alias("sample"), F.col("name").cast("long").alias("contig_idx"), F.round("depth", 9).alias("depth"))


@query()
def model_features(spark, d):
    c = s.depth_contigs(spark, d)
    tnf = s.latent(spark, d).select("contig_idx", F.transform("v", lambda x: x.cast("float")).alias("tnf"))
    return features.features(c, _filled(spark, d), tnf, N_SAMPLES, DIMS)


# --- vectors and neighbourhoods


@query(sql("unit", "SELECT contig_idx, dim, round(x, 6) AS x FROM (SELECT contig_idx, unnest(range(len(v))) AS dim, unnest(v) AS x FROM unit)"))
def vec_normalise(spark, d):
    return neighbours.normalised(s.latent(spark, d)).select("contig_idx", F.posexplode("v").alias("dim", "x")).select("contig_idx", long("dim"), r6("x"))


@query(sql("unit", "SELECT u.contig_idx, CASE WHEN u.contig_idx = 7 THEN 0 ELSE round(0.5 - list_dot_product(u.v, m.v), 6) END AS distance FROM unit u, (SELECT v FROM unit WHERE contig_idx = 7) m"))
def medoid_distances(spark, d):
    return neighbours.distances_from(neighbours.normalised(s.latent(spark, d)), 7).select("contig_idx", (F.round("distance", 6) + 0.0).alias("distance"))


@query(sql("unit", "SELECT a.contig_idx AS a, b.contig_idx AS b, round(0.5 - list_dot_product(a.v, b.v), 6) AS distance FROM unit a JOIN unit b ON a.contig_idx < b.contig_idx WHERE 0.5 - list_dot_product(a.v, b.v) <= 0.05"))
def neighbours_within(spark, d):
    return neighbours.neighbours(neighbours.normalised(s.latent(spark, d)), 0.05).select("a", "b", (F.round("distance", 6) + 0.0).alias("distance"))


@query(sql("unit", "SELECT a.contig_idx, round(sum(b.length * (0.05 - CASE WHEN a.contig_idx = b.contig_idx THEN 0 ELSE 0.5 - list_dot_product(a.v, b.v) END)), 4) AS density FROM unit a JOIN unit b ON a.contig_idx = b.contig_idx OR 0.5 - list_dot_product(a.v, b.v) <= 0.05 GROUP BY 1"))
def local_density(spark, d):
    return neighbours.local_density(neighbours.normalised(s.latent(spark, d))).select("contig_idx", F.round("density", 4).alias("density"))


_HIST = "h AS (SELECT least(floor(d / 0.005), 59)::INT AS bin, sum(length)::DOUBLE AS mass FROM (SELECT u.length, CASE WHEN u.contig_idx = 7 THEN 0 ELSE 0.5 - list_dot_product(u.v, m.v) END AS d FROM unit u, (SELECT v FROM unit WHERE contig_idx = 7) m) WHERE d <= 0.3 GROUP BY 1)"


@query(_after("unit", _HIST + " SELECT * FROM h"))
def distance_histogram(spark, d):
    return neighbours.histogram(neighbours.distances_from(neighbours.normalised(s.latent(spark, d)), 7))


@query(_after("unit", _HIST + " SELECT t.bin, round(coalesce(sum(mass * exp(-pow((h.bin - t.bin) * 0.005 / 0.01, 2) / 2) * 0.005 / (0.01 * sqrt(2 * pi()))), 0), 4) AS density FROM (SELECT unnest(range(60))::INT AS bin) t LEFT JOIN h ON abs(h.bin - t.bin) <= 15 GROUP BY 1"))
def smoothed_density(spark, d):
    h = neighbours.histogram(neighbours.distances_from(neighbours.normalised(s.latent(spark, d)), 7))
    return neighbours.smoothed(h).select("bin", F.round("density", 4).alias("density"))


@query(sql("contigs", "SELECT contig_idx, row_number() OVER (ORDER BY length DESC, contig_idx DESC) AS seed_rank FROM contigs"))
def seed_order(spark, d):
    return neighbours.seed_order(s.lengths(spark, d)).select("contig_idx", long("seed_rank"))


@query(sql("unit", ", e AS (SELECT a.contig_idx AS x, b.contig_idx AS y FROM unit a JOIN unit b ON a.contig_idx <> b.contig_idx AND 0.5 - list_dot_product(a.v, b.v) <= 0.002)").replace("\n, e AS", ",\ne AS").replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT contig_idx AS node, contig_idx AS to_ FROM unit UNION SELECT r.node, e.y FROM r JOIN e ON r.to_ = e.x) SELECT node, min(to_) AS component FROM r GROUP BY 1")
def eps_components(spark, d):
    points = neighbours.normalised(s.latent(spark, d))
    return graph.components(neighbours.linked(points, 0.002), points.select(F.col("contig_idx").alias("node")))


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS y, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x))), 5) AS mass FROM embeddings")
def categorical_clusters(spark, d):
    e = s.table(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", vectors.first_max(F.col("embedding")).alias("y"), F.round(F.exp(vectors.log_sum_exp(F.col("v"))), 5).alias("mass"))


# --- taxonomy


@query(sql("taxonomy", "SELECT contig_idx, len(ranks)::INT AS n_ranks, CASE WHEN t = '' THEN NULL ELSE string_split(t, ';')[1] END AS first_rank, CASE WHEN t = '' THEN NULL ELSE string_split(t, ';')[3] END AS third_rank FROM (SELECT *, array_to_string(ranks, ';') AS t FROM taxonomy)"))
def tax_parse(spark, d):
    text = s.taxonomy(spark, d).select("contig_idx", F.array_join("ranks", ";").alias("t"))
    ranks = text.select("contig_idx", tax.parse_ranks(F.col("t")).alias("ranks"))
    return ranks.select("contig_idx", F.size("ranks").alias("n_ranks"), F.get("ranks", F.lit(0)).alias("first_rank"), F.get("ranks", F.lit(2)).alias("third_rank"))


@query("SELECT name, count(DISTINCT depth) AS n_depths, count(DISTINCT parent) AS n_parents FROM (SELECT DISTINCT n_name AS parent, c_mktsegment AS name, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'root', n_name, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1 HAVING count(DISTINCT depth) > 1 OR count(DISTINCT parent) > 1")
def tax_validate(spark, d):
    c, n = s.table(spark, d, "customer"), s.table(spark, d, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array("n_name", "c_mktsegment").alias("ranks"))
    return tax.ambiguous_ranks(rows)


@query(sql("edges", "SELECT * FROM edges"))
def tax_edges(spark, d):
    return tax.edges(s.taxonomy(spark, d))


@query(sql("tree", "SELECT (row_number() OVER (ORDER BY depth, path) - 1)::INT AS node, name, parent, depth FROM tree"))
def tax_tree(spark, d):
    return tax.tree(tax.edges(s.taxonomy(spark, d))).select("node", "name", "parent", "depth")


@query(sql("taxonomy", "SELECT contig_idx, CASE WHEN len(ranks) > 0 THEN ranks[-1] ELSE 'root' END AS target FROM taxonomy"))
def tax_targets(spark, d):
    return tax.targets(s.taxonomy(spark, d))


@query(sql("tree", "SELECT name, path[i] AS ancestor, (len(path) - i)::INT AS distance FROM (SELECT name, path, unnest(range(1, len(path) + 1)) AS i FROM tree)"))
def tax_ancestors(spark, d):
    return tax.ancestors(tax.tree(tax.edges(s.taxonomy(spark, d))))


@query(_after("tree", "c AS (SELECT parent AS name, count(*) AS k FROM tree WHERE parent IS NOT NULL GROUP BY 1), l AS (SELECT depth, path FROM tree WHERE name NOT IN (SELECT name FROM c)), b AS (SELECT unnest(path) AS name, depth FROM l) SELECT name, any_value(tree.depth) AS depth, coalesce(any_value(k), 0)::BIGINT AS n_children, count(*) AS n_leaves, (max(b.depth) - any_value(tree.depth))::INT AS max_height, (min(b.depth) - any_value(tree.depth))::INT AS min_height FROM tree JOIN b USING (name) LEFT JOIN c USING (name) GROUP BY name"))
def tax_statistics(spark, d):
    return tax.tree_statistics(tax.tree(tax.edges(s.taxonomy(spark, d)))).select("name", "depth", long("n_children"), "n_leaves", "max_height", "min_height")


_PAIRS = "pairs AS (SELECT a.contig_idx, list_concat(['root'], a.ranks) AS path_a, list_concat(['root'], b.ranks) AS path_b FROM taxonomy a JOIN taxonomy b ON b.contig_idx = a.contig_idx + 1), n AS (SELECT *, CASE WHEN path_a[2] IS DISTINCT FROM path_b[2] OR path_a[2] IS NULL THEN 1 WHEN path_a[3] IS DISTINCT FROM path_b[3] OR path_a[3] IS NULL THEN 2 WHEN path_a[4] IS DISTINCT FROM path_b[4] OR path_a[4] IS NULL THEN 3 ELSE 4 END - 1 AS g FROM pairs)"


def _tax_pairs(spark, d):
    t = s.taxonomy(spark, d).select("contig_idx", F.concat(F.array(F.lit(tax.ROOT)), "ranks").alias("path"))
    return t.select("contig_idx", F.col("path").alias("path_a")).join(t.select((F.col("contig_idx") - 1).alias("contig_idx"), F.col("path").alias("path_b")), "contig_idx")


@query(_after("taxonomy", _PAIRS + " SELECT contig_idx, g AS lca_depth, path_a[g + 1] AS lca FROM n"))
def tax_lca(spark, d):
    return tax.lca(_tax_pairs(spark, d)).select("contig_idx", "lca_depth", "lca")


@query(_after("taxonomy", _PAIRS + ", m AS (SELECT contig_idx, g, (len(path_a) - 1)::INT AS t, (len(path_b) - 1)::INT AS p FROM n) SELECT contig_idx, (t - g)::INT AS deficient, (p - g)::INT AS excess, (t + p - 2 * g)::INT AS distance, round(CASE WHEN t = 0 THEN 1 ELSE g / t END, 6) AS recall, round(CASE WHEN p = 0 THEN 1 ELSE g / p END, 6) AS precision, round(CASE WHEN t + p = 0 THEN 1 ELSE 2 * g / (t + p) END, 6) AS f1 FROM m"))
def lca_metrics(spark, d):
    return tax.lca_metrics(_tax_pairs(spark, d)).select("contig_idx", "deficient", "excess", "distance", r6("recall"), r6("precision"), r6("f1"))


_LEAVES = "leaves AS (SELECT l_partkey AS contig_idx, name, sum(l_quantity) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT n_nationkey, n_name AS name FROM nation) ON n_nationkey = s_nationkey GROUP BY ALL), p AS (SELECT contig_idx, name, w / sum(w) OVER (PARTITION BY contig_idx) AS prob FROM leaves), up AS (SELECT contig_idx, name, 2 AS depth, prob FROM p UNION ALL SELECT contig_idx, r_name, 1, sum(prob) FROM p JOIN nation ON n_name = p.name JOIN region ON r_regionkey = n_regionkey GROUP BY ALL UNION ALL SELECT contig_idx, 'root', 0, sum(prob) FROM p GROUP BY 1)"


def _nations(spark, d):
    n, r = s.table(spark, d, "nation"), s.table(spark, d, "region")
    ranks = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", "n_name").alias("ranks"))
    return graph.stored(tax.tree(tax.edges(ranks)))


def _rolled(spark, d, tree=None):
    """Lines are dealt by contig once; a task takes its share of them through all steps, here and in what goes by contig after it."""
    li, su, n = (s.table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    lines = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = dealt(lines.select(F.col("l_partkey").alias("contig_idx"), F.col("n_name").alias("name"), "l_quantity"), li.count(), "contig_idx")
    leaves = lines.groupBy("contig_idx", "name").agg(F.sum("l_quantity").alias("w"))
    probs = leaves.select("contig_idx", "name", (F.col("w") / F.sum("w").over(Window.partitionBy("contig_idx"))).alias("prob"))
    return tax.rolled_up(probs, tree or _nations(spark, d))


@query("WITH " + _LEAVES + " SELECT contig_idx, name, depth, round(prob + 1e-9, 6) AS prob FROM up")
def tax_rollup(spark, d):
    return _rolled(spark, d).select("contig_idx", "name", "depth", F.round(F.col("prob") + 1e-9, 6).alias("prob"))


@query("WITH " + _LEAVES + " SELECT contig_idx, coalesce(string_agg(name, ';' ORDER BY depth, name) FILTER (round(prob, 9) > 0.2 AND depth > 0), '') AS ranks FROM up GROUP BY 1")
def tax_predictions(spark, d):
    return tax.predictions(_rolled(spark, d).withColumn("prob", F.round("prob", 9)), 0.2).select("contig_idx", F.array_join("ranks", ";").alias("ranks"))


@query("WITH " + _LEAVES + " SELECT contig_idx, name, depth, round(prob, 6) AS prob FROM (SELECT *, max(depth) OVER (PARTITION BY contig_idx ORDER BY prob DESC, depth DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT contig_idx, name, depth, round(prob, 9) AS prob FROM up)) WHERE best IS NULL OR depth > best")
def pareto(spark, d):
    return tax.pareto(_rolled(spark, d).withColumn("prob", F.round("prob", 9))).select("contig_idx", "name", "depth", (F.round("prob", 6) + 0.0).alias("prob"))


@query("WITH " + _LEAVES + " SELECT contig_idx, name, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY contig_idx ORDER BY depth DESC, prob DESC, name) AS k FROM (SELECT contig_idx, name, depth, round(prob, 9) AS prob FROM up) WHERE prob > 0.2) WHERE k = 1")
def argmax_conf(spark, d):
    return tax.most_specific(_rolled(spark, d).withColumn("prob", F.round("prob", 9)), threshold=0.2).select("contig_idx", "name", (F.round("prob", 6) + 0.0).alias("prob"))


@query(_after("taxonomy", "p AS (SELECT contig_idx - 1 AS contig_idx, ranks FROM taxonomy) SELECT level, count(*) FILTER (t = o) AS correct, count(*) AS have_truth, (SELECT count(*) FROM taxonomy) AS n_contigs, round(count(*) FILTER (t = o) / (SELECT count(*) FROM taxonomy), 6) AS accuracy FROM (SELECT a.contig_idx, i::INT - 1 AS level, a.ranks[i] AS t, p.ranks[i] AS o FROM (SELECT contig_idx, ranks, unnest(range(1, len(ranks) + 1)) AS i FROM taxonomy) a LEFT JOIN p USING (contig_idx)) GROUP BY 1"))
def tax_accuracy(spark, d):
    t = s.taxonomy(spark, d)
    return tax.accuracy(t, t.withColumn("contig_idx", F.col("contig_idx") - 1)).select("level", "correct", "have_truth", "n_contigs", r6("accuracy"))


@query(sql("taxonomy", "SELECT ranks[2] AS genus, count(*) AS n FROM taxonomy GROUP BY 1"))
def genus_groups(spark, d):
    """The stand-in's second rank is put in the place of the genus."""
    ranks = F.concat(F.array(*[F.lit(r) for r in ("domain", "phylum", "class", "order")]), "ranks")
    return tax.genus_sizes(s.taxonomy(spark, d).select("contig_idx", ranks.alias("ranks"))).select("genus", "n")


def _tree(spark, d):
    return graph.stored(tax.tree(tax.edges(s.taxonomy(spark, d))))


@query(sql("tree", "SELECT depth, count(*) AS n, array_to_string(list_sort(list(name)), ';') AS names FROM tree GROUP BY 1"))
def tax_levels(spark, d):
    return tax.levels(_tree(spark, d)).select("depth", "n", F.array_join("names", ";").alias("names"))


@query(sql("tree", "SELECT a.name, b.name AS sibling FROM tree a JOIN tree b ON a.parent = b.parent AND a.name <> b.name"))
def tax_siblings(spark, d):
    return tax.siblings(_tree(spark, d))


@query(_after("tree", "v AS (SELECT CASE WHEN len(ranks) > 0 THEN ranks[-1] ELSE 'root' END AS name, count(*) AS value FROM taxonomy GROUP BY 1), a AS (SELECT name, unnest(path) AS up FROM tree) SELECT up AS name, sum(value)::BIGINT AS total FROM a JOIN v USING (name) GROUP BY 1"))
def tax_accumulate(spark, d):
    t = s.taxonomy(spark, d)
    values = tax.targets(t).groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return tax.accumulated(values, tax.tree(tax.edges(t)))


@query(_after("tree", "c AS (SELECT parent AS name, count(*) AS k FROM tree WHERE parent IS NOT NULL GROUP BY 1), l AS (SELECT unnest(path) AS name FROM tree WHERE name NOT IN (SELECT name FROM c)), n AS (SELECT name, count(*) AS leaves FROM l GROUP BY 1), w AS (SELECT t.name, sum(-ln(c.k)) AS x FROM (SELECT name, unnest(path) AS at_ FROM tree) t JOIN c ON c.name = t.at_ WHERE t.name <> t.at_ GROUP BY 1) SELECT n.name, round(leaves / (SELECT leaves FROM n WHERE name = 'root'), 6) AS uniform_leaf, round(exp(coalesce(x, 0)), 6) AS uniform_cond FROM n LEFT JOIN w ON w.name = n.name"))
def tax_uniform(spark, d):
    tree = _tree(spark, d)
    return tax.leaf_probability(tax.tree_statistics(tree), tree).select("name", r6("uniform_leaf"), r6("uniform_cond"))


@query(_after("tree", "k AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'ASIA') SELECT t.name, arg_max(k.name, i) AS onto FROM (SELECT name, unnest(path) AS up, unnest(range(len(path))) AS i FROM tree) t LEFT JOIN k ON k.name = t.up GROUP BY 1").replace("arg_max(k.name, i)", "arg_max(k.name, i) FILTER (k.name IS NOT NULL)"))
def tax_projection(spark, d):
    names = s.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    return tax.projection(_tree(spark, d), names.unionByName(names.sparkSession.createDataFrame([("ASIA",)], "name string")))


@query(_after("tree", "k AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0) SELECT DISTINCT up AS name FROM (SELECT name, unnest(path) AS up FROM tree) JOIN k USING (name)"))
def tax_subtree(spark, d):
    names = s.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    return tax.rooted_subtree(_tree(spark, d), names).select("name")


@query("SELECT n_name AS child, r_name AS parent, 1 AS depth FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, n_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def tax_from_pairs(spark, d):
    c, n, r = (s.table(spark, d, t) for t in ("customer", "nation", "region"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    down = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.concat("n_name", F.lit("/"), "c_mktsegment").alias("child")).distinct()
    return tax.tree_from_pairs(up.unionByName(down))


@query("WITH " + _LEAVES + ", s2 AS (SELECT contig_idx, depth, name, prob, row_number() OVER (PARTITION BY contig_idx, depth, g ORDER BY prob DESC, name) AS r FROM (SELECT up.contig_idx, depth, up.name, round(prob, 9) AS prob, CASE WHEN depth = 2 THEN n_regionkey END AS g FROM up LEFT JOIN nation ON n_name = up.name AND depth = 2 WHERE depth > 0)) SELECT contig_idx, round(coalesce(max(prob) FILTER (r = 2), 0), 6) AS threshold FROM s2 GROUP BY 1")
def plurality_threshold(spark, d):
    tree = _nations(spark, d)
    probs = _rolled(spark, d, tree).withColumn("prob", F.round("prob", 9))
    return tax.plurality_threshold(probs, tree).select("contig_idx", (F.round("threshold", 6) + 0.0).alias("threshold"))


# --- markers


@query(sql("counts", "SELECT cluster, marker, n FROM counts"))
def marker_counts(spark, d):
    return markers.marker_counts(s.marker_members(spark, d), s.contig_markers(spark, d))


def _quality(spark, d):
    m = s.marker_members(spark, d)
    return markers.bin_quality(m, markers.marker_counts(m, s.contig_markers(spark, d)), s.n_markers(spark, d))


@query(sql("quality", "SELECT cluster, n_unique, n_total, round(completeness, 6) AS completeness, round(contamination, 6) AS contamination FROM quality"))
def bin_quality(spark, d):
    return _quality(spark, d).select("cluster", "n_unique", "n_total", r6("completeness"), r6("contamination"))


@query(sql("quality", "SELECT count(*) FILTER (completeness >= 0.4 AND contamination <= 0.1) AS n_good FROM quality"))
def good_genomes(spark, d):
    return markers.good_genomes(_quality(spark, d), 0.4, 0.1)


@query(sql("quality", "SELECT cluster FROM quality WHERE n_total - n_unique <= (SELECT count(*) / 20 FROM supplier)"))
def unsaturated_bins(spark, d):
    return markers.unsaturated(_quality(spark, d), s.n_markers(spark, d) / 20).select("cluster")


@query(sql("quality", "SELECT cluster, round(completeness * 100, 6) AS completeness, round(contamination * 100, 6) AS contamination FROM quality WHERE completeness >= 0.4 AND contamination <= 0.1"))
def near_complete(spark, d):
    q = _quality(spark, d).select("cluster", F.round(F.col("completeness") * 100, 6).alias("completeness"), F.round(F.col("contamination") * 100, 6).alias("contamination"))
    return markers.near_complete(q, 0.4, 0.1)


_MEDIAN = "med AS (SELECT cluster, list_sort(list(coalesce(n, 0)))[count(*) // 2 + 1]::BIGINT AS median FROM (SELECT * FROM (SELECT DISTINCT cluster FROM members), (SELECT s_suppkey % 5 AS marker FROM supplier GROUP BY 1)) LEFT JOIN few USING (cluster, marker) GROUP BY 1)"
_FEW = "few AS (SELECT cluster, marker, count(*) AS n FROM members JOIN (SELECT DISTINCT contig_idx, marker % 5 AS marker FROM contig_markers) USING (contig_idx) GROUP BY ALL)"


def _few(spark, d):
    m, k = s.marker_members(spark, d), s.contig_markers(spark, d).select("contig_idx", (F.col("marker") % 5).alias("marker")).distinct()
    counts = markers.marker_counts(m, k)
    return m, k, counts, markers.upper_median(m, counts, 5)


@query(_after("members contig_markers", f"{_FEW}, {_MEDIAN} SELECT cluster, median FROM med"))
def median_scg(spark, d):
    return _few(spark, d)[3]


@query(_after("members contig_markers", f"{_FEW}, {_MEDIAN}, k AS (SELECT DISTINCT contig_idx, marker % 5 AS marker FROM contig_markers), c AS (SELECT few.cluster, few.marker, members.contig_idx, o_custkey * 7 % 500 + o_orderkey % 500 AS length FROM few JOIN med USING (cluster) JOIN members USING (cluster) JOIN k ON k.contig_idx = members.contig_idx AND k.marker = few.marker JOIN orders ON o_orderkey = members.contig_idx WHERE median >= 2 AND n = median), g AS (SELECT cluster, marker, min(length) AS least FROM c GROUP BY cluster, marker), b AS (SELECT cluster, marker, row_number() OVER (PARTITION BY cluster ORDER BY least DESC, marker) AS r FROM g) SELECT cluster, marker, contig_idx FROM c JOIN b USING (cluster, marker) WHERE r = 1"))
def kmeans_seeds(spark, d):
    m, k, counts, medians = _few(spark, d)
    lengths = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("contig_idx"), (F.col("o_custkey") * 7 % 500 + F.col("o_orderkey") % 500).alias("length"))
    return markers.kmeans_seeds(m, k, lengths, counts, medians)


@query("SELECT DISTINCT l_orderkey AS contig_idx, CASE p_brand WHEN 'TIGR00388' THEN 'TIGR00389' ELSE p_brand END AS marker FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_brand, avg(p_size) AS cutoff FROM part GROUP BY 1) USING (p_brand) WHERE l_quantity >= cutoff")
def accepted_hits(spark, d):
    li, p = s.table(spark, d, "lineitem"), s.table(spark, d, "part")
    hits = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("contig_idx"), F.col("p_brand").alias("model"), F.col("l_quantity").alias("score"))
    return markers.accepted_hits(hits, p.groupBy(F.col("p_brand").alias("model")).agg(F.avg("p_size").alias("cutoff")))


# --- overlap, dereplication, ripping


def _overlap(spark, d):
    return bins.overlaps(s.binnings(spark, d), s.lengths(spark, d).select("contig_idx", "length"))


@query(sql("overlap", "SELECT a, b, shared_bp, round(weight, 6) AS weight FROM overlap"))
def overlap_pairs(spark, d):
    return _overlap(spark, d).select("a", "b", "shared_bp", r6("weight"))


def _bin_scores(spark, d):
    """A made-up quality of each bin from its number of contigs."""
    n = s.binnings(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return n.select("bin", (F.col("n") % 101 / 100).alias("completeness"), (F.col("n") % 7 / 100).alias("contamination"))


_SCORES = "sc AS (SELECT bin, count(*) % 101 / 100 AS completeness, count(*) % 7 / 100 AS contamination FROM binnings GROUP BY 1)"
_WORSE = _SCORES + ", wb AS (SELECT CASE WHEN round(x.completeness - 5 * x.contamination, 9) > round(y.completeness - 5 * y.contamination, 9) THEN b ELSE a END AS worse, CASE WHEN round(x.completeness - 5 * x.contamination, 9) > round(y.completeness - 5 * y.contamination, 9) THEN a ELSE b END AS better, shared_bp, weight FROM overlap JOIN sc x ON x.bin = a JOIN sc y ON y.bin = b)"


@query(_after("overlap", _WORSE + " SELECT worse, better, shared_bp, round(weight, 6) AS weight FROM wb"))
def worse_better(spark, d):
    return bins.worse_better(_overlap(spark, d), _bin_scores(spark, d)).select("worse", "better", "shared_bp", r6("weight"))


@query(_after("overlap", _WORSE + ", p AS (SELECT worse, better, row_number() OVER (ORDER BY round(completeness - 5 * contamination, 9), worse, better) AS i FROM wb JOIN sc ON sc.bin = worse WHERE weight >= 0.5), r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone UNION ALL SELECT p.i, CASE WHEN list_contains(gone, worse) OR list_contains(gone, better) THEN gone ELSE list_append(gone, worse) END FROM r JOIN p ON p.i = r.i + 1) SELECT unnest(gone) AS bin FROM r WHERE i = (SELECT max(i) FROM r)").replace("WITH ", "WITH RECURSIVE ", 1))
def dereplicate(spark, d):
    scores = _bin_scores(spark, d).select("bin", F.round(bins.score(), 9).alias("completeness"), F.lit(0.0).alias("contamination"))
    return bins.dereplicated(bins.worse_better(_overlap(spark, d), scores), 0.5)


@query(_after("overlap", "p AS (SELECT a, b FROM overlap WHERE weight <= 0.1), both_ AS (SELECT a, b FROM p UNION SELECT b, a FROM p) SELECT DISTINCT x.a || '--' || x.b AS bin, m.contig_idx FROM both_ x JOIN binnings m ON m.bin = x.a WHERE NOT EXISTS (SELECT 1 FROM binnings o WHERE o.bin = x.b AND o.contig_idx = m.contig_idx)"))
def rip_pairs(spark, d):
    return bins.ripped(s.binnings(spark, d), graph.stored(_overlap(spark, d).where("weight <= 0.1")))


@query(_after("overlap", _SCORES + ", o AS (SELECT bin, round(completeness - 5 * contamination, 9) AS s FROM sc) SELECT a, b, CASE WHEN round(y.s * 0.5, 6) > round(x.s * 0.25, 6) THEN b ELSE a END AS keeper FROM overlap JOIN o x ON x.bin = a JOIN o y ON y.bin = b"))
def keeper_choice(spark, d):
    pairs, old = _overlap(spark, d), _bin_scores(spark, d)
    q = old.select("bin", F.round(F.col("completeness") - 5 * F.col("contamination"), 9).alias("completeness"), F.lit(0.0).alias("contamination"))
    after = pairs.select("a", F.concat_ws("--", "a", "b").alias("n"), F.lit(0.75).alias("k")).unionByName(pairs.select(F.col("b").alias("a"), F.concat_ws("--", "b", "a").alias("n"), F.lit(0.5).alias("k")))
    after = after.join(q.withColumnRenamed("bin", "a"), "a").select(F.col("n").alias("bin"), (F.col("completeness") * F.col("k")).alias("completeness"), "contamination")
    out = bins.keepers(q, after, pairs)
    return out.select("a", "b", F.when(F.round("drop_b", 6) > F.round("drop_a", 6), F.col("b")).otherwise(F.col("a")).alias("keeper"))


@query(_after("binnings", _SCORES + " SELECT bin, CASE WHEN starts_with(bin, 'A') THEN 0.5 ELSE completeness END AS completeness, CASE WHEN starts_with(bin, 'A') THEN 0.0 ELSE contamination END AS contamination FROM sc"))
def refreshed_scores(spark, d):
    old = _bin_scores(spark, d)
    new = old.where(F.startswith("bin", F.lit("A"))).select("bin", F.lit(0.5).alias("completeness"), F.lit(0.0).alias("contamination"))
    return bins.refreshed_scores(old, new)


@query(sql("contigs", "SELECT contig_idx % 10 AS cluster, split_part(min(name), 'C', 1) AS sample FROM contigs GROUP BY 1"))
def cluster_samples(spark, d):
    return bins.cluster_samples(s.lengths(spark, d).select((F.col("contig_idx") % 10).alias("cluster"), "name"), SEP)


@query("SELECT o_orderpriority AS version, round(sum(least_s) / 3600, 6) AS hours, round(sum(nc), 6) AS nc FROM (SELECT o_orderpriority, o_orderstatus, min(o_totalprice) AS least_s, avg(o_custkey) AS nc FROM orders GROUP BY ALL) GROUP BY 1")
def benchmark_summary(spark, d):
    o = s.table(spark, d, "orders")
    runs = o.select(F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("dataset"), F.col("o_totalprice").alias("seconds"), F.col("o_custkey").alias("nc"))
    return bins.benchmark_summary(runs).select("version", r6("hours"), r6("nc"))


@query(_after("overlap", "after AS (SELECT * FROM binnings WHERE CASE WHEN starts_with(bin, 'A') THEN contig_idx % 2 = 0 ELSE contig_idx % 2 = 1 OR starts_with(bin, 'B_de') END), lost AS (SELECT DISTINCT bin FROM (SELECT * FROM binnings EXCEPT SELECT * FROM after)), o AS (SELECT x.bin FROM after x JOIN after y ON x.contig_idx = y.contig_idx AND x.bin <> y.bin) SELECT DISTINCT bin FROM after WHERE bin IN (SELECT bin FROM lost) AND bin NOT IN (SELECT bin FROM o)"))
def changed_alone(spark, d):
    m, odd = s.binnings(spark, d), F.col("contig_idx") % 2 == 1
    after = m.where(F.when(F.startswith("bin", F.lit("A")), ~odd).otherwise(odd | F.startswith("bin", F.lit("B_de"))))
    return bins.changed_alone(m, after, s.lengths(spark, d).select("contig_idx", "length"))


@query(sql("unit", ", e AS (SELECT a.contig_idx AS x, b.contig_idx AS y FROM unit a JOIN unit b ON a.contig_idx <> b.contig_idx AND a.contig_idx % 4 = b.contig_idx % 4 AND 0.5 - list_dot_product(a.v, b.v) <= 0.005)").replace("\n, e AS", ",\ne AS").replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT contig_idx AS node, contig_idx AS to_ FROM unit UNION SELECT r.node, e.y FROM r JOIN e ON r.to_ = e.x) SELECT node AS contig_idx, min(to_) AS cluster FROM r GROUP BY 1")
def genus_density_clusters(spark, d):
    points = neighbours.normalised(s.latent(spark, d)).withColumn("genus", F.concat(F.lit("g"), (F.col("contig_idx") % 4).cast("string")))
    return recluster.density_clusters(points, 0.01)


@query()
def recluster_density(spark, d):
    """The radius with most good genomes, of all radii; markers: the suppliers of orders."""
    points = s.latent(spark, d).withColumn("genus", F.concat(F.lit("g"), (F.col("contig_idx") % 4).cast("string")))
    found, _ = recluster.recluster_density(points, s.contig_markers(spark, d), s.n_markers(spark, d))
    return found


# the smallest number of weakest edges without which no bin of the component has two edges
_CUT = "reach AS (SELECT bin AS node, bin AS other FROM bin_bp UNION SELECT r.node, CASE WHEN r.other = o.a THEN o.b ELSE o.a END FROM reach r JOIN overlap o ON r.other IN (o.a, o.b)), part AS (SELECT node, min(other) AS part FROM reach GROUP BY 1), e AS (SELECT a, b, shared_bp, weight, part, row_number() OVER (PARTITION BY part ORDER BY round(weight, 12), a, b) AS i FROM overlap JOIN part ON node = a), f AS (SELECT part, max(i) AS least FROM (SELECT part, bin, i, row_number() OVER (PARTITION BY bin ORDER BY i DESC) AS k FROM (SELECT part, a AS bin, i FROM e UNION ALL SELECT part, b, i FROM e)) WHERE k = 2 GROUP BY 1), c AS (SELECT e.*, i <= coalesce(least, 0) AS cut FROM e LEFT JOIN f USING (part))"


def _cut_order(spark, d):
    pairs = graph.stored(_overlap(spark, d).withColumn("weight", F.round("weight", 12)))
    return bins.cut_order(pairs.join(graph.components(pairs).withColumnRenamed("node", "a"), "a"))


@query(_after("overlap", _CUT + " SELECT a, b, round(weight, 6) AS weight FROM c WHERE NOT cut").replace("WITH ", "WITH RECURSIVE ", 1))
def pairs_only(spark, d):
    """Edges that remain once no component has more than two bins."""
    return bins.pairs_only(_cut_order(spark, d)).select("a", "b", r6("weight"))


# contigs are in one bin of each binning here, so a cut takes all that an edge shares; bins' lengths go along as a list
_WALK = "n AS (SELECT bin, bp, row_number() OVER (ORDER BY bin) AS k FROM bin_bp), w AS (SELECT c.a, c.b, c.shared_bp, x.k AS ka, y.k AS kb, row_number() OVER (ORDER BY round(weight, 12), a, b) AS i FROM c JOIN n x ON x.bin = a JOIN n y ON y.bin = b WHERE cut), r AS (SELECT 0::BIGINT AS i, (SELECT list(bp ORDER BY k) FROM n) AS bps, 0::BIGINT AS loser UNION ALL SELECT w.i, list_transform(bps, lambda x, j: CASE WHEN j = (CASE WHEN bps[ka] > bps[kb] THEN ka ELSE kb END) THEN x - shared_bp ELSE x END), CASE WHEN bps[ka] > bps[kb] THEN ka ELSE kb END FROM r JOIN w ON w.i = r.i + 1), gone AS (SELECT n.bin, CASE WHEN n.bin = w.a THEN w.b ELSE w.a END AS other FROM r JOIN w USING (i) JOIN n ON n.k = r.loser)"


@query(_after("overlap", _CUT + ", " + _WALK + " SELECT bin, contig_idx FROM binnings m WHERE NOT EXISTS (SELECT 1 FROM gone g JOIN binnings o ON o.bin = g.other WHERE g.bin = m.bin AND o.contig_idx = m.contig_idx)").replace("WITH ", "WITH RECURSIVE ", 1))
def cut_components(spark, d):
    """Members once components are cut to pairs, shared contigs going out of the longer bin."""
    lengths = s.lengths(spark, d).select("contig_idx", "length")
    return bins.cut_shared(s.binnings(spark, d), lengths, _cut_order(spark, d).where("cut"))


@query()
def medoid_clusters(spark, d):
    from sparkmill.operators.clustering import medoid_clusters as run

    return run(s.latent(spark, d)).select("cluster", "contig_idx", "medoid", "kind", "radius")


@query()
def recluster_kmeans(spark, d):
    from sparkmill.operators.recluster import recluster_kmeans as run

    m, k, _, _ = _few(spark, d)
    o = s.table(spark, d, "orders")
    latent = o.select(F.col("o_orderkey").alias("contig_idx"), F.array(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 7).cast("double")).alias("v"), (F.col("o_orderkey") % 500 + 250).cast("int").alias("length"))
    return run(m, latent, k, 5)


@query()
def vae_encode(spark, d):
    """A small autoencoder, trained for a few epochs, then applied by Arrow batches."""
    from sparkmill.models.training import train_frame
    from sparkmill.models.vae import VAE, encode_frame

    rows = graph.stored(model_features(spark, d))
    vae = VAE(N_SAMPLES, DIMS, [64], 8, seed=1)
    train_frame(vae, rows, epochs=6, batch=64, double_at=(2, 4), lr=1e-3)
    return encode_frame(vae, rows)


@query()
def tax_predict(spark, d):
    """A small classifier of the latent's label, applied to all contigs."""
    from sparkmill.models.hierarchy import Tree
    from sparkmill.models.taxonomy import LabelPredictor
    from sparkmill.models.training import train_frame
    from sparkmill.models.vae import Inputs, apply_frame

    rows = graph.stored(model_features(spark, d).withColumn("label", (3 + F.col("contig_idx") % 4).cast("int")))
    tree = Tree([-1, 0, 0, 1, 1, 2, 2])
    model = LabelPredictor(N_SAMPLES, tree, DIMS, [64], seed=1)
    train_frame(model, rows, epochs=5, batch=64, lr=1e-3)
    shared = spark.sparkContext.broadcast(model)

    def run(x: Inputs, ids: np.ndarray) -> list[pa.Array]:
        probs, best, _ = shared.value.predict_with_truth(x, 3 + ids % 4)
        return [pa.array(best.astype(np.int32)), pa.array(probs[np.arange(len(best)), best].astype(float))]

    return apply_frame(rows, "node int, prob double", run, "contig_idx")
