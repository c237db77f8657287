"""Tab-separated tables: clusters, taxonomies, abundances, depths of single samples, quality reports, SAM headers, markers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.functions.names import marker_name
from sparkmill.operators.taxonomy import parse_ranks, parse_scores

CLUSTERS = "clustername\tcontigname"
TAXONOMY, REFINED = "contigs\tpredictions", "contigs\tpredictions\tscores"


def _lines(spark: SparkSession, path: str, header: str | None) -> DataFrame:
    """Lines of text with their place; the first one must be the header, if there is one to be."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    if header is None:
        return rows
    first = rows.limit(1).collect()
    found = first[0]["value"].rstrip("\r\n") if first else ""
    if found != header:
        raise ValueError(f"{path} starts with {found!r}, not with {header!r}")
    return rows.where(F.rtrim(F.translate("value", "\r", "")) != header)


def _fields(rows: DataFrame, n: int | tuple[int, int]) -> DataFrame:
    """rows with `x`, their fields; another number of them than n (or between two) is an error. Blank lines are left out."""
    low, high = (n, n) if isinstance(n, int) else n
    x = F.split(F.translate("value", "\r", ""), "\t")
    rows = rows.where(F.trim(F.translate("value", "\t\r", "")) != "").withColumn("x", x)
    return rows.withColumn("x", F.when(F.size("x").between(low, high), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a row of this table: "), "value")).cast("array<string>")))


def read_clusters(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    """Distinct (cluster, name) of the clusters of at least min_size contigs; lines that are blank or start with # are skipped."""
    rows = _fields(_lines(spark, path, CLUSTERS).where(~F.startswith("value", F.lit("#"))), 2)
    once = rows.select(F.get("x", F.lit(0)).alias("cluster"), F.get("x", F.lit(1)).alias("name")).distinct()
    return once if min_size <= 1 else once.join(once.groupBy("cluster").count().where(F.col("count") >= min_size).select("cluster"), "cluster", "left_semi")


def write_clusters(members: DataFrame, path: str) -> tuple[int, int]:
    """members (cluster, name) as a clusters table; returns the numbers of clusters and of rows."""
    out = members.select(F.col("cluster").cast("string").alias("clustername"), F.col("name").alias("contigname"))
    out.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return tuple(out.agg(F.count_distinct("clustername"), F.count(F.lit(1))).first())


def read_taxonomy(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """(name, ranks) of an unrefined taxonomy; canonical: at most seven ranks."""
    rows = _fields(_lines(spark, path, TAXONOMY), 2).select(F.get("x", F.lit(0)).alias("name"), parse_ranks(F.get("x", F.lit(1))).alias("ranks"))
    return rows.withColumn("ranks", F.when(F.size("ranks") > 7, F.raise_error(F.concat(F.lit("more than seven ranks: "), "name")).cast("array<string>")).otherwise(F.col("ranks"))) if canonical else rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(name, ranks, probs) of a refined taxonomy; a row of a name alone has no ranks, others as many ranks as probabilities."""
    rows = _fields(_lines(spark, path, REFINED), (1, 3))
    at = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(""))
    rows = rows.select(at(0).alias("name"), parse_ranks(at(1)).alias("ranks"), parse_scores(at(2)).alias("probs"))
    return rows.withColumn("probs", F.when(F.size("ranks") == F.size("probs"), F.col("probs")).otherwise(F.raise_error(F.concat(F.lit("not as many ranks as scores: "), "name")).cast("array<double>")))


def is_refined(spark: SparkSession, path: str) -> bool:
    """Which of the two taxonomy tables a file is; ValueError if neither."""
    head = spark.read.text(path).limit(1).collect()
    found = head[0][0].rstrip("\r\n") if head else ""
    if found not in (TAXONOMY, REFINED):
        raise ValueError(f"{path} is no taxonomy: it starts with {found!r}")
    return found == REFINED


def write_predictions(predicted: DataFrame, path: str) -> None:
    """predicted (name, ranks, probs) as a refined taxonomy, probabilities to five decimals."""
    rows = predicted.select(F.col("name").alias("contigs"), F.array_join("ranks", ";").alias("predictions"), F.array_join(F.transform("probs", lambda p: F.round(p, 5).cast("string")), ";").alias("scores"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def to_taxonomy(predicted: DataFrame) -> DataFrame:
    """Predictions without their probabilities."""
    return predicted.drop("probs")


def read_abundance(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """((name, sample, depth) in long form with samples numbered from 0, their names) of an abundance table.

    The first column must be `contigname`, at least one sample must follow, and rows have the header's width. With contigs
    (name), names must be the same: a missing or unknown one is an error. Depths must be finite and not negative.
    """
    head = spark.read.text(path).limit(1).collect()
    columns = head[0][0].rstrip("\r\n").split("\t") if head else []
    if len(columns) < 2 or columns[0] != "contigname":
        raise ValueError(f"{path} needs the column contigname and a column for each sample")
    rows = _fields(_lines(spark, path, "\t".join(columns)), len(columns)).select(F.get("x", F.lit(0)).alias("name"), F.slice("x", 2, len(columns) - 1).alias("d"))
    if contigs is not None:
        odd = rows.join(contigs.select("name", F.lit(1).alias("known")), "name", "full_outer").where("known is null or d is null").limit(1).collect()
        if odd:
            raise ValueError(f"the names of {path} are not those of the contigs: {odd[0]['name']}")
    long = rows.select("name", F.posexplode("d").alias("sample", "t")).select("name", "sample", F.expr("try_cast(t AS double)").alias("depth"), "t")
    ok = F.col("depth").isNotNull() & ~F.isnan("depth") & (F.col("depth") >= 0) & (F.col("depth") < float("inf"))
    return long.select("name", "sample", F.when(ok, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("not a depth: "), "t")).cast("double")).alias("depth")), columns[1:]


def write_abundance(wide: DataFrame, path: str) -> None:
    wide.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_depth_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, depth) of headerless tables of one sample each; more columns are ignored, depths finite and not negative."""
    rows = _fields(_lines(spark, path, None), (2, 1_000))
    d = F.expr("try_cast(get(x, 1) AS double)")
    ok = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))
    return rows.select("file", F.get("x", F.lit(0)).alias("name"), F.when(ok, d).otherwise(F.raise_error(F.concat(F.lit("not a depth: "), "value")).cast("double")).alias("depth"))


def merge_depth_files(depths: DataFrame) -> tuple[DataFrame, list[str]]:
    """((contigname, one column a file), files in sorted order). Every file must have every contig once, else ValueError."""
    from sparkmill.operators.abundance import merge_faults

    files = [r[0] for r in depths.select("file").distinct().orderBy("file").collect()]  # one name a sample
    odd = merge_faults(depths.select(F.col("name").alias("contig_idx"), F.col("file").alias("sample")), len(files)).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['contig_idx']} is not once in every file")
    short = [f.rpartition("/")[2].removesuffix(".tsv").removesuffix(".aemb") for f in files]
    wide = depths.groupBy("name").pivot("file", files).agg(F.first("depth"))
    return wide.select(F.col("name").alias("contigname"), *[F.col(f"`{f}`").alias(s) for f, s in zip(files, short)]), short


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(bin, completeness, contamination) in percent of scorers' reports; the header line and further columns are skipped."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    name, complete, dirty = rows.columns[:3]
    return rows.select(F.col(f"`{name}`").alias("bin"), F.col(f"`{complete}`").cast("double").alias("completeness"), F.col(f"`{dirty}`").cast("double").alias("contamination"))


def read_sam_header(spark: SparkSession, path: str, least: int) -> DataFrame:
    """(row, name, length, kept) of lines SN:name, LN:length."""
    rows = _fields(_lines(spark, path, None), 2)
    length = F.substring_index(F.get("x", F.lit(1)), ":", -1).cast("int")
    return rows.select("row", F.regexp_replace(F.get("x", F.lit(0)), "^SN:", "").alias("name"), length.alias("length"), (length >= least).alias("kept"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of a comma-separated edge list without a header; tree_from_pairs makes a tree of them."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.translate("value", "\r", ""), ",").alias("x"))
    ok = F.when(F.size("x") == 2, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.array_join("x", ","))).cast("array<string>"))
    return rows.select(F.trim(ok[0]).alias("parent"), F.trim(ok[1]).alias("child"))


def markers_json(contig_markers: DataFrame, n_contigs: int, names: list[list[str]], refhash: str) -> str:
    """Markers of few contigs as the JSON of the marker files; null for a contig without any."""
    found = {r["contig_idx"]: r["m"] for r in contig_markers.groupBy("contig_idx").agg(F.array_sort(F.collect_list("marker")).alias("m")).collect()}
    return json.dumps({"markers": [found.get(i) for i in range(n_contigs)], "marker_names": names, "refhash": refhash})


def read_markers(spark: SparkSession, text: str, refhash: str | None = None) -> tuple[DataFrame, list[list[str]]]:
    """((contig_idx, marker), names) of that JSON; another refhash than expected is an error."""
    raw = json.loads(text)
    if refhash is not None and raw["refhash"] != refhash:
        raise ValueError("the markers belong to other contigs")
    rows = [(i, int(m)) for i, ms in enumerate(raw["markers"]) for m in ms or ()]
    return spark.createDataFrame(rows, "contig_idx long, marker int"), raw["marker_names"]


def marker_ids(models: DataFrame) -> DataFrame:
    """(model, marker_id): numbers from 0 in the order of names, synonyms having one; more than 256 are an error."""
    from pyspark.sql import Window

    named = models.select("model", marker_name(F.col("model")).alias("n"))
    ids = named.select("n").distinct().select("n", (F.row_number().over(Window.orderBy("n")) - 1).alias("marker_id"))  # at most 256 rows, else refused
    ids = ids.withColumn("marker_id", F.when(F.col("marker_id") < 256, F.col("marker_id")).otherwise(F.raise_error(F.lit("more than 256 markers")).cast("int")))
    return named.join(ids, "n").select("model", "marker_id")
