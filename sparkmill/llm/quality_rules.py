"""Quality rules with host verdicts, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import SPACES, materialize, words

#: Rules whose failures are aggregated by host.
RULES = ("short", "repetitive", "symbols", "duplicate_lines")
#: Up to this many hosts are broadcast; beyond it hosts are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def repeat_words(ws: Column, grams: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Equal windows become neighbours by sorting (window, position); the covered positions are then counted once each.
    """
    tagged = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce((F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]), (F.get(s, j - 1)["g"] == x["g"]), (F.get(s, j + 1)["g"] == x["g"]), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # a one-element transform binds the sorted array, so that it is sorted once
    once = F.element_at(F.transform(F.array(tagged), covered), 1)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), once).otherwise(0).cast("long")


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a flag for each of RULES.

    A null or blank text has no words and counts of zero. Repeated rows stay; other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("id", "host", "t", words(F.col("t")).alias("ws"))
    base = base.select("*", F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"))
    grams = F.when(F.size("ws") >= 3, F.transform(F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 2, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(F.col("ws"), i + 1), F.lit(" "), F.get(F.col("ws"), i + 2)))).otherwise(F.array().cast("array<string>"))
    base = base.select("*", grams.alias("grams"))
    counts = base.select(
        "id",
        "host",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeat_words(F.col("ws"), F.col("grams")).alias("n_repeat_words"),
    )
    return counts.select(
        "*",
        (F.col("n_words") < 50).alias("short"),
        (100 * F.col("n_repeat_words") > 50 * F.col("n_words")).alias("repetitive"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"),
        (2 * F.col("n_dup_lines") > F.col("n_lines")).alias("duplicate_lines"),
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """Per host and rule: n, failures and the rate shrunk by a beta prior that is fitted to all hosts by moments.

    Prior: mean m and variance v of the hosts' rates (weighted by rows), strength m(1-m)/v - 1 held between 1 and 10,000.
    A null host is a host of its own.
    """
    sums = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    long = sums.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failures")) for r in RULES])).alias("x")).select("host", "n", "x.rule", "x.failures")
    rate = F.col("failures") / F.col("n")
    prior = long.groupBy("rule").agg((F.sum("failures") / F.sum("n")).alias("m"), (F.sum(F.col("n") * rate * rate) / F.sum("n")).alias("m2"))
    spread = F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(1e-12))
    prior = prior.select("rule", "m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1.0)), F.lit(1e4)).alias("strength"))
    # one row for each of RULES: bounded
    return long.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failures", ((F.col("failures") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Documents with their rule counts, base verdict and host verdict.

    A host fails if the shrunk failure rate of any rule is above max_rate. kept = passes the base rules and its host does.
    The counts are written once to the shared folder, as both the host aggregate and the verdict read them.
    """
    counts = materialize(rule_counts(docs, id_col, text_col, host_col), "rules")
    hosts = materialize(host_rates(counts).groupBy("host").agg(F.max("rate").alias("host_rate")), "hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    side = hosts.withColumnRenamed("host", "h")
    out = counts.join(F.broadcast(side) if few else side, F.col("host").eqNullSafe(F.col("h")), "left")
    failed = F.col("short") | F.col("repetitive")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("host_rate") <= max_rate)).alias("kept"), F.round("host_rate", 6).alias("host_rate")
    )
