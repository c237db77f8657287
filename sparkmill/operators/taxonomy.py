"""Taxonomic annotations, the tree that they span, and predictions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.operators.graph import stored

ROOT = "root"
CANONICAL_RANKS = 7


def parse_ranks(text: Column) -> Column:
    """`;`-separated ranks; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def parse_scores(text: Column) -> Column:
    """`;`-separated probabilities, held between 0 and 1."""
    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ";")), lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def genus(ranks: Column) -> Column:
    """The sixth rank, or null."""
    return F.try_element_at(ranks, F.lit(6))


def genus_sizes(taxonomy: DataFrame) -> DataFrame:
    """(genus, n): contigs of each genus; those that are not annotated so far down have none."""
    return taxonomy.groupBy(genus(F.col("ranks")).alias("genus")).agg(F.count(F.lit(1)).alias("n"))


def annotate(contigs: DataFrame, taxonomy: DataFrame, lenient: bool = False) -> DataFrame:
    """contigs with their ranks by name. Annotations of other names are ignored; unless lenient, a contig without one, or with two, is an error."""
    once = taxonomy.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("ranks").alias("ranks"))
    out = contigs.join(once, "name", "left")
    fault = F.when(F.col("n") > 1, F.concat(F.lit("annotated twice: "), "name"))
    if not lenient:
        fault = fault.when(F.col("n").isNull(), F.concat(F.lit("not annotated: "), "name"))
    return out.withColumn("ranks", F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(F.col("ranks"))).drop("n")


def edges(taxonomy: DataFrame) -> DataFrame:
    """Distinct (child, parent, depth), the first rank's parent being the root at depth 0."""
    steps = taxonomy.select(F.posexplode("ranks").alias("i", "child"), "ranks")
    parent = F.when(F.col("i") == 0, F.lit(ROOT)).otherwise(F.get("ranks", F.col("i") - 1))
    return steps.select("child", parent.alias("parent"), (F.col("i") + 1).alias("depth")).distinct()


def ambiguous_ranks(taxonomy: DataFrame) -> DataFrame:
    """Names at more than one depth or below more than one parent: (name, n_depths, n_parents)."""
    e = edges(taxonomy).groupBy(F.col("child").alias("name")).agg(F.count_distinct("depth").alias("n_depths"), F.count_distinct("parent").alias("n_parents"))
    return e.where("n_depths > 1 or n_parents > 1")


def tree(edge_table: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, name, parent, depth, path): nodes numbered by depth, then by their path of names; the root is 0.

    Levels are joined from the root down, one equi-join for each level that exists.
    """
    edge_table = stored(edge_table)
    level = edge_table.sparkSession.createDataFrame([(ROOT, 0, [ROOT])], "name string, depth int, path array<string>")
    found = level
    for depth in range(1, max_depth + 1):
        rows = edge_table.where(F.col("depth") == depth)
        if rows.limit(1).count() == 0:
            break
        level = rows.join(level.select(F.col("name").alias("parent"), "path"), "parent").select(F.col("child").alias("name"), F.col("depth").cast("int"), F.concat("path", F.array("child")).alias("path"))
        found = found.unionByName(level)
    numbered = found.select((F.row_number().over(Window.orderBy("depth", "path")) - 1).cast("int").alias("node"), "name", F.get("path", F.size("path") - 2).alias("parent"), "depth", "path")
    return numbered


def targets(taxonomy: DataFrame) -> DataFrame:
    """(contig_idx, target): the last rank, or the root if there is none."""
    return taxonomy.select("contig_idx", F.when(F.size("ranks") > 0, F.element_at("ranks", -1)).otherwise(F.lit(ROOT)).alias("target"))


def ancestors(tree_table: DataFrame, strict: bool = False) -> DataFrame:
    """(name, ancestor, distance); a node is its own at distance 0 unless strict."""
    up = tree_table.select("name", F.posexplode(F.reverse("path")).alias("distance", "ancestor"))
    return up.where("distance > 0") if strict else up.select("name", "ancestor", "distance")


def tree_statistics(tree_table: DataFrame) -> DataFrame:
    """(name, depth, n_children, n_leaves, max_height, min_height) of every node; heights are measured to leaves below."""
    children = tree_table.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    base = tree_table.select("name", "depth").join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaves = tree_table.join(base.where("n_children = 0").select("name"), "name", "left_semi").select(F.col("depth").alias("leaf_depth"), F.explode("path").alias("name"))
    below = leaves.groupBy("name").agg(F.count(F.lit(1)).alias("n_leaves"), F.max("leaf_depth").alias("deep"), F.min("leaf_depth").alias("shallow"))
    return base.join(below, "name").select("name", "depth", "n_children", "n_leaves", (F.col("deep") - F.col("depth")).alias("max_height"), (F.col("shallow") - F.col("depth")).alias("min_height"))


def leaf_probability(statistics: DataFrame, tree_table: DataFrame) -> DataFrame:
    """(name, uniform_leaf, uniform_cond): probability of a node if leaves, or the children of every node, are equally likely."""
    total = F.lit(statistics.where(F.col("name") == ROOT).first()["n_leaves"])
    ways = tree_table.select("name", F.explode(F.slice("path", 1, 64)).alias("at")).where("name <> at")
    choices = ways.join(statistics.select(F.col("name").alias("at"), "n_children"), "at").groupBy("name").agg(F.sum(-F.log(F.col("n_children").cast("double"))).alias("l"))
    return statistics.join(choices, "name", "left").select("name", (F.col("n_leaves") / total).alias("uniform_leaf"), F.exp(F.coalesce("l", F.lit(0.0))).alias("uniform_cond"))


def shared_depth(a: Column, b: Column) -> Column:
    """Length of the common prefix of two paths."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def lca(pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """pairs with the name and depth of the lowest common ancestor of two paths."""
    n = shared_depth(F.col(a), F.col(b))
    return pairs.withColumn("lca_depth", n - 1).withColumn("lca", F.get(a, F.col("lca_depth")))


def lca_metrics(pairs: DataFrame, truth: str = "path_a", predicted: str = "path_b") -> DataFrame:
    """Depth-based metrics of predictions: deficient and excess depth, tree distance, recall, precision and F1, the root not counted."""
    n = lca(pairs, truth, predicted)
    t, p, s = F.size(truth) - 1, F.size(predicted) - 1, F.col("lca_depth")
    part = lambda x: F.when(x == 0, 1.0).otherwise(s / x)
    return n.select(*pairs.columns, "lca", "lca_depth", (t - s).alias("deficient"), (p - s).alias("excess"), (t + p - 2 * s).alias("distance"), part(t).alias("recall"), part(p).alias("precision"), F.when(t + p == 0, 1.0).otherwise(2 * s / (t + p)).alias("f1"))


def rolled_up(leaf_probs: DataFrame, tree_table: DataFrame) -> DataFrame:
    """(contig_idx, name, depth, prob): every node's probability is the sum of those of the leaves below (contig_idx, name, prob).

    Where leaf_probs are dealt by contig_idx, so are these; what goes by contig after it, as predictions do, needs no shuffle.
    """
    up = tree_table.select("name", F.explode("path").alias("at"))
    return leaf_probs.join(up, "name").groupBy("contig_idx", "at").agg(F.sum("prob").alias("prob")).join(tree_table.select(F.col("name").alias("at"), "depth"), "at").select("contig_idx", F.col("at").alias("name"), "depth", "prob")


def predictions(node_probs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(contig_idx, ranks, probs): nodes above the threshold from the top down, without the root."""
    kept = F.when((F.col("prob") > threshold) & (F.col("name") != ROOT), F.struct("depth", "name", "prob"))
    rows = node_probs.groupBy("contig_idx").agg(F.array_sort(F.collect_list(kept)).alias("x"))
    return rows.select("contig_idx", F.col("x.name").alias("ranks"), F.col("x.prob").alias("probs"))


def most_specific(node_probs: DataFrame, info: str = "depth", threshold: float = 0.5) -> DataFrame:
    """(contig_idx, name, prob): of the nodes above the threshold, the one of most information, then of highest probability, then first by name."""
    ranked = node_probs.where(F.col("prob") > threshold)
    return ranked.groupBy("contig_idx").agg(F.min(F.struct((-F.col(info)).alias("i"), (-F.col("prob")).alias("p"), F.col("name").alias("name"))).alias("x")).select("contig_idx", "x.name", (-F.col("x.p")).alias("prob"))


def pareto(node_probs: DataFrame, info: str = "depth") -> DataFrame:
    """Nodes that no other of their contig beats in both probability and information."""
    w = Window.partitionBy("contig_idx").orderBy(F.desc("prob"), F.desc(info), "name").rowsBetween(Window.unboundedPreceding, -1)
    return node_probs.withColumn("best", F.max(info).over(w)).where(F.col("best").isNull() | (F.col(info) > F.col("best"))).drop("best")


def plurality_threshold(node_probs: DataFrame, tree_table: DataFrame) -> DataFrame:
    """(contig_idx, threshold): the highest probability that is only second among its siblings; 0 if none has a sibling."""
    with_parent = node_probs.join(tree_table.where("parent is not null").select("name", "parent"), "name", "left")
    second = with_parent.withColumn("r", F.row_number().over(Window.partitionBy("contig_idx", "parent").orderBy(F.desc("prob"), "name")))
    return second.groupBy("contig_idx").agg(F.coalesce(F.max(F.when((F.col("r") == 2) & F.col("parent").isNotNull(), F.col("prob"))), F.lit(0.0)).alias("threshold"))


def accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(level, correct, have_truth, n_contigs, accuracy) by rank; the accuracy is of all contigs."""
    n = truth.count()
    a = truth.select("contig_idx", F.posexplode("ranks").alias("level", "t"))
    b = predicted.select("contig_idx", F.posexplode("ranks").alias("level", "p"))
    rows = a.join(b, ["contig_idx", "level"], "left")
    out = rows.groupBy("level").agg(F.count_if(F.col("t") == F.col("p")).alias("correct"), F.count(F.lit(1)).alias("have_truth"))
    return out.select("level", "correct", "have_truth", F.lit(n).cast("long").alias("n_contigs"), (F.col("correct") / F.lit(n)).alias("accuracy"))


def levels(tree_table: DataFrame) -> DataFrame:
    """(depth, n, names): the nodes of each level in order of their names. A row a level."""
    return tree_table.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def siblings(tree_table: DataFrame) -> DataFrame:
    """(name, sibling): other children of a node's parent."""
    a = tree_table.where("parent is not null").select("name", "parent")
    return a.join(a.select(F.col("name").alias("sibling"), "parent"), "parent").where("name <> sibling").select("name", "sibling")


def accumulated(values: DataFrame, tree_table: DataFrame, downwards: bool = False) -> DataFrame:
    """(name, total): values (name, value) summed over a node and all below it, or over a node and all above it."""
    pairs = ancestors(tree_table)
    if downwards:
        rows = pairs.join(values.withColumnRenamed("name", "ancestor"), "ancestor").groupBy("name")
    else:
        rows = pairs.join(values, "name").groupBy(F.col("ancestor").alias("name"))
    return rows.agg(F.sum("value").alias("total"))


def rooted_subtree(tree_table: DataFrame, names: DataFrame) -> DataFrame:
    """The nodes of the smallest subtree with the root that holds all the names."""
    needed = ancestors(tree_table).join(names.select("name").distinct(), "name", "left_semi").select(F.col("ancestor").alias("name")).distinct()
    return tree_table.join(needed, "name", "left_semi")


def projection(tree_table: DataFrame, names: DataFrame) -> DataFrame:
    """(name, onto): every node's lowest ancestor, or itself, among the names; null if there is none."""
    near = ancestors(tree_table).join(names.select(F.col("name").alias("ancestor")).distinct(), "ancestor").groupBy("name").agg(F.min(F.struct("distance", "ancestor")).alias("x"))
    return tree_table.select("name").join(near, "name", "left").select("name", F.col("x.ancestor").alias("onto"))


def tree_from_pairs(pairs: DataFrame) -> DataFrame:
    """Edges (child, parent, depth) of pairs (parent, child); a child of two parents, or one that no root leads to, is an error."""
    twice = pairs.groupBy("child").agg(F.count_distinct("parent").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['child']} has multiple parents")
    level = pairs.join(pairs.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti").select("child", "parent", F.lit(1).alias("depth"))
    found, depth = level, 1
    while level.limit(1).count():
        depth += 1
        level = pairs.join(level.select(F.col("child").alias("parent")), "parent").select("child", "parent", F.lit(depth).alias("depth"))
        found = found.unionByName(level)
        if depth > 64:
            raise ValueError("the pairs go round, or are deeper than 64 levels")
    return found


def format_tree(tree_table: DataFrame) -> str:
    """Indented names; for small trees, as it goes through the driver."""
    return "\n".join("  " * r["depth"] + r["name"] for r in tree_table.orderBy("path").collect())
