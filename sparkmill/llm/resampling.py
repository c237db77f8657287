"""Resampling a corpus towards a target distribution by hashed n-gram importance weights, each distinct text worked out once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import materialize, ranked, small_batches

#: Buckets of hashed features.
BUCKETS = 10_000
#: Words that a worker remembers the bucket of.
CACHE = 500_000

_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
#: Byte by byte: A-Z lower-cased, word bytes kept, all else a space. Bytes of 0x80 and more occur only within non-ASCII characters, which are word characters.
_BYTES = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Buckets(dict):
    """Feature -> bucket: crc32 of its bytes, modulo."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        bucket = crc32(feature) % self.n
        if len(feature) <= 64:
            self[feature] = bucket
        return bucket


def text_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: A-Z lower-cased, split at ASCII characters other than letters and digits; null has none."""
    return (text or "").encode().translate(_BYTES).split()


def _ngrams(words: list[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def text_features(texts: DataFrame, text_col: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(digest, copies, n_words, n_features, buckets, counts): each distinct text of a column once, with how many rows hold it.

    Rows are grouped by their whole text (null is the empty text), copies being counted before the shuffle, so no group
    gathers them. digest is the text's SHA-256; features are all runs of one to `longest` consecutive words, counted by
    bucket.
    """
    small_batches(texts.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = texts.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.select(F.sha2("text", 256).alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(buckets)
        for b in batches:
            words, features, found, counts = [], [], [], []
            for text in b["text"]:
                own = text_words(text.as_py())
                at = np.fromiter(map(bucket_of.__getitem__, _ngrams(own, longest) if longest > 1 else own), np.int32)
                each, n = np.unique(at, return_counts=True)
                words.append(len(own))
                features.append(len(at))
                found.append(each)
                counts.append(n)
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            flat = lambda rows, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *rows]).astype(kind)))
            yield pa.record_batch([b["digest"], b["copies"], pa.array(words, pa.int64()), pa.array(features, pa.int64()), flat(found, np.int32), flat(counts, np.int64)], names=["digest", "copies", "n_words", "n_features", "buckets", "counts"])

    return distinct.mapInArrow(run, "digest string, copies long, n_words long, n_features long, buckets array<int>, counts array<bigint>")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in all rows, copies counted; summed in each task, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for b in batches:
            lists = b["counts"]
            of = np.repeat(b["copies"].to_numpy(), np.diff(lists.offsets.to_numpy()))
            np.add.at(held, b["buckets"].flatten().to_numpy(), lists.flatten().to_numpy() * of)
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["bucket", "n"])

    parts = features.select("copies", "buckets", "counts").mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(q / p)) for each bucket, q and p being its smoothed shares of the target's and the corpus's features."""
    n, of_corpus, of_target = len(corpus), int(corpus.sum()) + len(corpus), int(target.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log(float((t + 1) * of_corpus) / float((s + 1) * of_target))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64).reshape(n)


def _weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of distinct texts."""
    sent = features.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["buckets"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = np.concatenate([[0], np.cumsum(sent.value[lists.flatten().to_numpy()] * b["counts"].flatten().to_numpy())]).astype(np.int64)
            yield pa.record_batch([b["digest"], b["n_words"], b["n_features"], pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["digest", "n_words", "n_features", "weight"])

    return features.drop("copies").mapInArrow(run, "digest string, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per document: id, n_features, weight, score and rank: 1, 2, 3, ... for the `percent` of those with at least `least_words` words that score highest, else null.

    weight sums the gains of a text's features (0 without any); score adds Gumbel noise from a seeded hash of the id, so
    that the highest scores are a draw without replacement by weight. Ties go to the smaller id. Each distinct text is
    taken apart and weighed once and counts as often as rows hold it; weights are joined back to the rows by the text's
    digest before the noise, the rows' side being split where a text has many. Ranks come from a sort by range.

    A null text is empty. A null id hashes as the empty id and comes last among equal scores. Repeated rows are documents
    of their own; those of equal id and text score alike and take successive ranks. An empty target gives the smoothing's
    weights, no rows give none. Other columns are not read, whatever their names.
    """
    texts = materialize(text_features(docs, text_col, longest, buckets), "text-features")
    gain = gains(bucket_counts(texts, buckets), bucket_counts(text_features(target, target_col, longest, buckets), buckets))
    weights = materialize(_weights(texts, gain), "weights")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = rows.join(weights, "digest").select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    scored = materialize(scored, "scores")
    n = scored.where("able").count()
    order = [F.desc("able"), F.desc("score"), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("row")]
    placed = ranked(scored.withColumn("row", F.monotonically_increasing_id()), order)
    rank = F.when(F.col("able") & (F.col("i") < n * percent // 100), F.col("i") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
