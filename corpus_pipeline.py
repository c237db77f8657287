"""A training corpus from raw documents: quality, near copies, repeated strings, mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bpe, shared
from sparkmill.llm.mixing import mixed_documents
from sparkmill.llm.ranking import train_ranker
from sparkmill.llm.similar import drop_similar
from sparkmill.llm.suffix import remove_repeats
from sparkmill.sources.parquet import read_table

#: A passage that is cut has over fifty words and occurs again; it is looked for by its strings of so many bytes, chosen by grams of so many.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 150, 40
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Tables in the shared folder that the latest stage has written on its way.
_of_latest: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage; when it is called, its predecessor's result is stored, so what the predecessor wrote on its way is deleted."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _of_latest:
            shared.delete_table(spark, _of_latest.pop())
        before = set(shared.written())
        out = f(spark, docs, sf_dir)
        _of_latest.extend(path for path in shared.written() if path not in before)
        return out

    return call


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject all documents whose score is below one half; where none reaches it, those below the highest score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return train_ranker(docs, labels).keep_above_quantile(docs, quantile=1.0, ceiling=0.5)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash multi-index hashing finds candidates, a similarity of 0.8 of whole sets of five-word shingles links."""
    return drop_similar(docs, shingle=5, similarity=0.8)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of PASSAGE_WORDS and more that strings of PASSAGE_BYTES cover which occur again are cut out of every text; a document of which no word is left by that goes."""
    out = remove_repeats(docs, min_len=PASSAGE_BYTES, gram=PASSAGE_GRAM, min_words=PASSAGE_WORDS, whole_rows=True, as_text=True)
    cut, row = F.size("spans") > 0, F.col("row")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    own = [(F.when(cut, new[c]).otherwise(row[c]) if c in new else row[c]).alias(c) for c in docs.columns]
    return out.where(~cut | F.col("kept").rlike(r"[^\x20\x09-\x0D]")).select(*own)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn, up to three epochs of each; a document is a row for each repetition."""
    return mixed_documents(docs, weights=(1, 2, 3), max_epochs=3)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_strings", repeated_strings), ("mixture", mixture), ("token_ids", token_ids)]

#: A trained classifier, fingerprints and byte pairs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a table that was read for the last time is deleted."""
    docs, last = read_table(spark, f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared.write_table(out, name)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            shared.delete_table(spark, last)
        last = path
    while _of_latest:
        shared.delete_table(spark, _of_latest.pop())
    return docs
