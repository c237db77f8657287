"""Stand-in inputs made from the star-schema tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.sources.parquet import read_table

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"
N_SAMPLES, SEP, LEAST = 6, "C", 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_table(spark, path) if name == "documents" else spark.read.parquet(path)  # the table of long texts


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as contigs: (contig_idx, name, seq, length)."""
    seq = F.translate(F.lower("text"), LETTERS, BASES)
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("S"), (F.col("doc_id") % N_SAMPLES + 1).cast("string"), F.lit(SEP), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("contig_idx"), name.alias("name"), seq.alias("seq"), F.length(seq).alias("length"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_idx, name, length) alone: the lower-cased text need not be mapped."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("S"), (F.col("doc_id") % N_SAMPLES + 1).cast("string"), F.lit(SEP), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("contig_idx"), name.alias("name"), F.length(F.lower("text")).alias("length"))


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as depths of contigs in samples."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("contig_idx"), (F.col("l_suppkey") % N_SAMPLES).cast("int").alias("sample")).agg(F.sum("l_quantity").alias("depth"))


def depth_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the contigs of those depths, with a made-up length."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("contig_idx"), (F.col("p_size") * 100 + 250).cast("int").alias("length"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as reads on the contigs that part stands for: (sample, contig_idx, start, n, edits, flag, read)."""
    li = table(spark, sf_dir, "lineitem").join(depth_contigs(spark, sf_dir), F.col("l_partkey") == F.col("contig_idx"))
    n = (F.col("l_quantity") * 5).cast("long")
    rows = li.select((F.col("l_suppkey") % N_SAMPLES).cast("int").alias("sample"), "contig_idx", (F.col("l_orderkey") * 37 % (F.col("length") - n + 1)).alias("start"), n.alias("n"), F.col("l_linenumber").alias("edits"), F.col("l_returnflag").alias("flag"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("read"))
    return rows


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings, whole, with a made-up length."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("contig_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (500 + F.col("vec_id") * 37 % 1000).cast("int").alias("length"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, nation and region as annotations of up to three ranks."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    ranks = F.array("r_name", "n_name", F.concat("n_name", F.lit("/"), "c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("contig_idx"), F.slice(ranks, F.lit(1), (F.col("c_custkey") % 4).cast("int")).alias("ranks"))


def contig_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("contig_idx"), F.col("l_suppkey").alias("marker")).distinct()


def marker_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("contig_idx"))


def n_markers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def binnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binnings of the documents as one list of bins: by source, and by language and length class."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.concat(F.lit("A_"), "source").alias("bin"), F.col("doc_id").alias("contig_idx"))
    b = d.select(F.concat(F.lit("B_"), "lang", F.lit("_"), F.floor(F.length("text") / 4000).cast("string")).alias("bin"), F.col("doc_id").alias("contig_idx"))
    return a.unionByName(b)


SQL = {
    "contigs": f"contigs AS (SELECT doc_id AS contig_idx, 'S' || (doc_id % {N_SAMPLES} + 1) || '{SEP}' || doc_id AS name, translate(lower(text), '{LETTERS}', '{BASES}') AS seq, length(lower(text)) AS length FROM documents)",
    "depths": f"depths AS (SELECT l_partkey AS contig_idx, (l_suppkey % {N_SAMPLES})::INT AS sample, sum(l_quantity) AS depth FROM lineitem GROUP BY ALL)",
    "depth_contigs": "depth_contigs AS (SELECT p_partkey AS contig_idx, (p_size * 100 + 250)::INT AS length FROM part)",
    "latent": "latent AS (SELECT vec_id AS contig_idx, embedding::DOUBLE[] AS v, (500 + vec_id * 37 % 1000)::INT AS length FROM embeddings)",
    "unit": "unit AS (SELECT contig_idx, length, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) * sqrt(2.0))) AS v FROM latent)",
    "taxonomy": "taxonomy AS (SELECT c_custkey AS contig_idx, [r_name, n_name, n_name || '/' || c_mktsegment][1:c_custkey % 4] AS ranks FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "edges": "edges AS (SELECT DISTINCT ranks[i] AS child, CASE WHEN i = 1 THEN 'root' ELSE ranks[i - 1] END AS parent, i::INT AS depth FROM (SELECT ranks, unnest(range(1, len(ranks) + 1)) AS i FROM taxonomy))",
    "tree": "tree AS (SELECT 'root' AS name, NULL AS parent, 0 AS depth, ['root'] AS path UNION ALL SELECT child, parent, depth, list_concat(['root'], p) FROM (SELECT DISTINCT child, parent, depth, ranks[1:depth] AS p FROM edges JOIN taxonomy ON taxonomy.ranks[depth] = child))",
    "contig_markers": "contig_markers AS (SELECT DISTINCT l_orderkey AS contig_idx, l_suppkey AS marker FROM lineitem)",
    "members": "members AS (SELECT o_custkey AS cluster, o_orderkey AS contig_idx FROM orders)",
    "counts": "counts AS (SELECT cluster, marker, count(*) AS n FROM members JOIN contig_markers USING (contig_idx) GROUP BY ALL)",
    "quality": "quality AS (SELECT cluster, coalesce(n_unique, 0)::BIGINT AS n_unique, coalesce(n_total, 0)::BIGINT AS n_total, coalesce(n_unique, 0) / m AS completeness, (coalesce(n_total, 0) - coalesce(n_unique, 0)) / m AS contamination FROM (SELECT DISTINCT cluster FROM members) LEFT JOIN (SELECT cluster, count(*) AS n_unique, sum(n) AS n_total FROM counts GROUP BY 1) USING (cluster), (SELECT count(*) AS m FROM supplier))",
    "binnings": "binnings AS (SELECT 'A_' || source AS bin, doc_id AS contig_idx FROM documents UNION ALL SELECT 'B_' || lang || '_' || (length(text) // 4000), doc_id FROM documents)",
    "bin_bp": "bin_bp AS (SELECT bin, sum(length)::BIGINT AS bp FROM binnings JOIN contigs USING (contig_idx) GROUP BY 1)",
    "overlap": "overlap AS (SELECT x.bin AS a, y.bin AS b, sum(length)::BIGINT AS shared_bp, sum(length) / least(any_value(p.bp), any_value(q.bp)) AS weight FROM binnings x JOIN binnings y ON x.contig_idx = y.contig_idx AND x.bin < y.bin JOIN contigs ON contigs.contig_idx = x.contig_idx JOIN bin_bp p ON p.bin = x.bin JOIN bin_bp q ON q.bin = y.bin GROUP BY ALL)",
}
_NEEDS = {"unit": ["latent"], "edges": ["taxonomy"], "tree": ["taxonomy", "edges"], "counts": ["members", "contig_markers"], "quality": ["members", "contig_markers", "counts"], "bin_bp": ["binnings", "contigs"], "overlap": ["contigs", "binnings", "bin_bp"]}


def sql(views: str, query: str) -> str:
    """The query with the named views before it, in order, and those that they need."""
    names: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in names:
            names.append(name)

    for v in views.split():
        add(v)
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + query
