"""Quality scores by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import materialize, small_batches

#: The bounded sample that is trained on: at most so many labelled rows, those of least seeded hash, and so many pairs.
MAX_ROWS, MAX_PAIRS = 20_000, 60_000
SEED = 5
NAMES = ("log_words", "upper", "digits", "marks", "symbols", "bars", "spaces", "distinct_words", "same_as_before", "distinct_pairs", "word_length", "longest_word", "sentence_length", "distinct_lines", "top_word", "high_bytes")

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(65, 91), range(48, 58), b"!?", b"#*$%&<>@^~=+_{}[]\\/", b"|", b" \t\r\n\x0b\x0c", b".", range(128, 256)), 1):
    _CLASS[list(_chars)] = _k


def features(text: str | None) -> np.ndarray:
    """Shares and lengths of a whole text, all zero for an empty one."""
    out = np.zeros(len(NAMES))
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    upper, digit, mark, symbol, bar, space, stop, high = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)[1:9] / len(raw)
    n, lower = len(words), raw.lower().split()
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:]))) / max(1, n - 1) if n > 1 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = list(map(len, words))
    out[:] = (np.log1p(n), upper, digit, mark, symbol, bar, space, len(counts) / n, again / n, pairs, np.log(sum(sizes) / n), np.log(max(sizes)), np.log1p(n / (1 + stop * len(raw))), len(set(lines)) / len(lines), max(counts.values()) / n, high)
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features with their squares and products, held within bounds so that odd texts can't dominate."""
    x = np.clip(x, -6, 6)
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, np.clip(x[:, i] * x[:, j], -12, 12) / 4])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of least logistic loss with a ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Ranker:
    """A trained scorer: score = sigmoid(slope * (weights . features) + offset)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.offset, -30, 30)))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score in 0 to 1) for every row; empty and null texts get the score of no features."""
        return self.add_score(docs.select(id_col, text_col), text_col, "score").select(id_col, "score")

    def add_score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """docs with one more column, the score."""
        small_batches(docs.sparkSession)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.array([features(t.as_py()) for t in b.column(at)])
                    yield pa.record_batch([*b.columns, pa.array(self.prob(x))], names=[*b.schema.names, name])

        return docs.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{name}` double"]))

    def score_and_quantile(self, docs: DataFrame, quantile: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
        """What score returns, and the given quantile of all scores, to a ten-thousandth; 0 without rows."""
        scored = materialize(self.score(docs, id_col, text_col), "scores")
        bar = scored.agg(F.percentile_approx("score", F.lit(quantile), F.lit(10_000))).first()[0]
        return scored, 0.0 if bar is None else bar

    def keep_above_quantile(self, docs: DataFrame, quantile: float, ceiling: float = 1.0, text_col: str = "text") -> DataFrame:
        """Rows of docs whose score reaches the given quantile of all scores (to a ten-thousandth), or `ceiling` if that is lower."""
        name = "score"
        while name in docs.columns:
            name += "_"
        scored = materialize(self.add_score(docs, text_col, name), "scored")  # features are worked out once
        found = scored.agg(F.percentile_approx(name, F.lit(quantile), F.lit(10_000))).first()[0]
        bar = min(ceiling, 0.0 if found is None else found)
        return scored.where(F.col(name) >= F.lit(bar)).drop(name)


def preference_pairs(good: int, bad: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Indices of preferred and other rows: each row of the larger side at least once, up to MAX_PAIRS."""
    if not good or not bad:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = min(MAX_PAIRS, max(4 * max(good, bad), 1000))
    return rng.permutation(np.resize(np.arange(good), n)), rng.permutation(np.resize(np.arange(bad), n))


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Bradley-Terry: logistic loss on the feature differences of preferred and other rows, then a calibrated sigmoid.

    With labels of one kind only there is no pair: the weights are zero and the score is that label's share.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    z = expand((x - mean) / scale)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    p, q = preference_pairs(len(good), len(bad), np.random.default_rng(SEED))
    if not len(p):
        share = (len(good) + 0.5) / (len(y) + 1)
        return Ranker(mean, scale, np.zeros(z.shape[1]), 1.0, float(np.log(share / (1 - share))))
    weights = logistic(z[good[p]] - z[bad[q]], np.ones(len(p)), ridge=len(p) / 2_000)
    raw = z @ weights
    spread = raw.std() + 1e-9
    slope, offset = logistic(np.column_stack([raw / spread, np.ones(len(raw))]), y.astype(float), ridge=1e-3)
    return Ranker(mean, scale, weights, float(max(slope, 0.0) / spread), float(offset))


def train_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Ranker:
    """Train on at most max_rows labelled documents (those whose ids have the least seeded hash), the features of whole texts.

    Null labels are left out; a document that is labelled more than once has the majority's label, and of the rows that
    repeat a doc_id with different texts the one with the least hash is used. The sampled ids, at most max_rows of them,
    are broadcast; what reaches the driver is a feature row for each.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64(F.lit(SEED), "key"), "key").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(picked), F.col("id") == F.col("key")).select("key", "t", "y", F.xxhash64("t").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                x = [features(t.as_py()).tolist() for t in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(x, pa.list_(pa.float64()))], names=["key", "y", "hash", "x"])

    kind = dict(rows.dtypes)["key"]
    found = rows.mapInArrow(run, f"key {kind}, y int, hash long, x array<double>").groupBy("key").agg(F.min(F.struct("hash", "y", "x")).alias("one")).select("key", "one.y", "one.x").toArrow().sort_by("key")
    x = np.array(found["x"].to_pylist()).reshape(-1, len(NAMES))
    return fit(x, found["y"].to_numpy())
