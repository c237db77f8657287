"""Language-model scores by the marginal likelihood of a subword lattice."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.shared import materialize, regrouped, small_batches

#: Words of which a text corpus can have at most so many: those that make up at least that part of all tokens.
HEAD = 500_000
#: Words that a worker counts before it hands them on.
COUNTED = 200_000
#: Bytes of a piece that are looked up at least; a vocabulary with longer pieces has all of them looked up.
LONGEST = 16
#: Words longer than this many bytes go through the recursion one at a time.
BATCHED = 48
EM_ROUNDS = 1
#: Pseudo-counts for each piece, on average, that re-estimation adds: they are shared out by the weights of the existing scores.
PRIOR = 0.1
#: Bytes of a word that may go to every worker.
HEAD_BYTES = 64
#: Words that a worker sorts by length together.
LATTICE_WORDS = 40_000
LN10 = float(np.log(10))
#: Odd multipliers of the polynomial hash that pieces are looked up by (fixed values).
MULTIPLIER, MIX = 0x100000001B3, 0x9E3779B97F4A7C15


class Pieces:
    """Vocabulary pieces as byte strings (a leading space marks the start of a word), with a table to look up many at a time."""

    def __init__(self, model_file: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        scores: dict[bytes, float] = {bytes([b]): -1e9 for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                raw = sp.id_to_piece(i).replace("▁", " ").encode()
                if raw:
                    scores[raw] = max(scores.get(raw, -1e9), sp.get_score(i))
        self.pieces = sorted(scores)
        self.longest = max(LONGEST, *map(len, self.pieces))
        # the scores of the existing vocabulary are ranks: weights fall with the rank by Zipf's law
        rank = np.argsort(np.argsort([-scores[p] for p in self.pieces], kind="stable"), kind="stable")
        weight = 1.0 / (rank + 10.0)
        self.log_p = np.log(weight / weight.sum() / 2)

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(hashes, piece numbers) of an open table, and the bytes of the longest piece; equal hashes of different pieces are an error, as lookups trust them."""
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        bits = int(np.ceil(np.log2(len(hashes)))) + 2
        keys, at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for i, h in enumerate(hashes.tolist()):
            k = (h * MIX & (1 << 64) - 1) >> (64 - bits)
            while at[k] >= 0:
                k = (k + 1) & (len(at) - 1)
            keys[k], at[k] = h, i
        return keys, at, self.longest

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * MULTIPLIER + b + 1) & (1 << 64) - 1
        return h


class Lattice:
    """All segmentations of words into pieces, many words of one length at a time."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, longest: int, log_p: np.ndarray) -> None:
        self.keys, self.at, self.longest, self.log_p = keys, at, longest, log_p
        self.shift = np.uint64(64 - int(np.log2(len(at))))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        k = ((h * np.uint64(MIX)) >> self.shift).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            slot = k[left]
            here = self.at[slot]
            hit = (self.keys[slot] == h[left]) & (here >= 0)
            out[left[hit]] = here[hit]
            left = left[~hit & (here >= 0)]
            k[left] = (k[left] + 1) & (len(self.at) - 1)
        return out

    def arcs(self, rows: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For every end: (start, words, pieces) of the pieces that end there."""
        n, size = rows.shape
        out: list[list] = [[] for _ in range(size + 1)]
        x = rows.astype(np.uint64) + np.uint64(1)
        for s in range(size):
            h = np.zeros(n, np.uint64)
            for e in range(s, min(size, s + self.longest)):
                h = h * np.uint64(MULTIPLIER) + x[:, e]
                p = self.find(h)
                words = np.flatnonzero(p >= 0)
                if len(words):
                    out[e + 1].append((s, words, p[words]))
        return out

    def forward(self, arcs: list, n: int) -> np.ndarray:
        """Log-space forward recursion: alpha[end, word] = log of the summed weight of all segmentations up to there."""
        alpha = np.full((len(arcs), n), -np.inf)
        alpha[0] = 0
        for e in range(1, len(arcs)):
            for s, words, p in arcs[e]:
                alpha[e, words] = np.logaddexp(alpha[e, words], alpha[s, words] + self.log_p[p])
        return alpha

    def expected(self, arcs: list, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of words that occur `weight` times."""
        n, out = len(weight), np.zeros(len(self.log_p))
        alpha = self.forward(arcs, n)
        beta = np.full((len(arcs), n), -np.inf)
        beta[-1] = 0
        for e in range(len(arcs) - 1, 0, -1):
            for s, words, p in arcs[e]:
                lp = self.log_p[p] + beta[e, words]
                out += np.bincount(p, weight[words] * np.exp(alpha[s, words] + lp - alpha[-1, words]), len(out))
                beta[s, words] = np.logaddexp(beta[s, words], lp)
        return out

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, rows of bytes) of words of equal length, a space before each."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        for size in np.unique(lens).tolist():
            own = order[np.searchsorted(lens[order], size) : np.searchsorted(lens[order], size, "right")]
            step = 4096 if size <= BATCHED else max(1, 200_000 // size)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                yield part, np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), size + 1)

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word: a window of as many columns as the longest piece has bytes of alpha is held for long ones."""
        out = np.zeros(len(words))
        for part, rows in self.batches(words):
            if rows.shape[1] <= BATCHED + 1:
                out[part] = self.forward(self.arcs(rows), len(part))[-1]
            else:
                out[part] = self._long(rows)
        return out

    def _long(self, rows: np.ndarray) -> np.ndarray:
        """The same recursion without keeping arcs: for each end the substrings before it are looked up together."""
        n, size = rows.shape
        x = rows.astype(np.uint64) + np.uint64(1)
        alpha = np.full((n, self.longest + 1), -np.inf)
        alpha[:, 0] = 0  # column k: the end k places before the newest
        powers = np.array([pow(MULTIPLIER, k, 1 << 64) for k in range(self.longest)], np.uint64)
        for e in range(1, size + 1):
            reach = min(self.longest, e)
            h = np.cumsum(x[:, e - reach : e][:, ::-1] * powers[:reach], axis=1, dtype=np.uint64)
            p = self.find(h.ravel()).reshape(n, reach)
            terms = np.where(p >= 0, self.log_p[p], -np.inf) + alpha[:, :reach]
            top = terms.max(axis=1)
            new = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
            alpha[:, 1:] = alpha[:, :-1].copy()
            alpha[:, 0] = new
        return alpha[:, 0]


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased words `[^\\x20\\x09-\\x0D]+`."""
    return raw.lower().split()


def count_words(docs: DataFrame, text: Column, train: Column) -> DataFrame:
    """(word binary, c, a): occurrences in training rows and in all rows, the empty word standing for the ends of texts.

    Workers add up before the shuffle and hold at most COUNTED different words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train_words, other_words = Counter(), Counter()

        def out() -> pa.RecordBatch:
            n, m = len(train_words), len(other_words)
            c = np.concatenate([np.fromiter(train_words.values(), np.int64, n), np.zeros(m, np.int64)])
            a = np.concatenate([c[:n], np.fromiter(other_words.values(), np.int64, m)])
            rows = pa.record_batch([pa.array([*train_words, *other_words], pa.binary()), pa.array(c), pa.array(a)], names=["word", "c", "a"])
            train_words.clear()
            other_words.clear()
            return rows

        for b in batches:
            for t, k in zip(b.column(0), b.column(1).to_pylist()):
                own = train_words if k else other_words
                own.update(words_of(t.as_py()))
                own[b""] += 1
                if len(train_words) + len(other_words) >= COUNTED:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(text.cast("binary"), F.lit("").cast("binary")).alias("t"), train.cast("int").alias("k"))
    return rows.mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def score_texts(docs: DataFrame, model_file: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = EM_ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities of the whole text.

    score: words are generated as sequences of vocabulary pieces and a text ends by an end token; the probability of a
    word is the sum over all its segmentations. The existing vocabulary's scores weight the pieces at first; expected counts
    over all training words then re-estimate the weights, with the first weights as their prior. A word's probability is
    worked out once, in the table of all different words. Words of up to HEAD_BYTES that make up at least 1 / HEAD of all
    tokens, so at most HEAD of them, go to every worker; the others are joined by a shuffle. A null text has the end token only; repeated rows stay.
    """
    pieces = Pieces(model_file)
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(pieces.table())  # the vocabulary: bounded
    counts = materialize(count_words(docs, F.col(text_col), ~held_out), "words")
    n, v, every, ends = counts.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count_if(F.col("c") > 0), F.sum("a"), F.sum(F.when(F.octet_length("word") == 0, F.col("c"))))]).first()

    log_p, end_p = pieces.log_p, float(np.log(0.5))
    for _ in range(rounds if n > ends else 0):

        def estimate(batches: Iterator[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*shared.value, log_p), np.zeros(len(log_p))
            for b in regrouped(batches, LATTICE_WORDS):
                words, weight = b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64)
                for part, rows in lattice.batches(words):
                    for k in range(0, len(part), max(1, 200_000 // rows.shape[1])):
                        own = rows[k : k + max(1, 200_000 // rows.shape[1])]
                        total += lattice.expected(lattice.arcs(own), weight[part[k : k + len(own)]])
            hit = np.flatnonzero(total)
            yield pa.record_batch({"piece": pa.array(hit.astype(np.int32)), "n": pa.array(total[hit])})

        learned = counts.where("c > 0 and octet_length(word) > 0").select("word", "c").mapInArrow(estimate, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        weight = PRIOR * len(log_p) * 2 * np.exp(pieces.log_p)  # what no training word uses keeps some of its own weight
        weight[learned["piece"].to_numpy()] += learned["n"].to_numpy()
        total = weight.sum() + ends + 0.1
        log_p, end_p = np.log(weight / total), float(np.log((ends + 0.1) / total))

    base_den = float(np.log10(n + 0.1 * (v + 1)))

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value, log_p)
        for b in regrouped(batches, LATTICE_WORDS):
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            lp = lattice.log_prob(words) / LN10
            lp[[i for i, w in enumerate(words) if not w]] = end_p / LN10
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.log10(c + 0.1) - base_den), pa.array(lp)], names=["word", "c", "a", "base", "lp"])

    words = materialize(counts.mapInArrow(model, "word binary, c long, a long, base double, lp double"), "model")
    head_rows = words.where(((F.col("a") * HEAD >= every) & (F.octet_length("word") <= HEAD_BYTES)) | (F.octet_length("word") == 0)).toArrow()
    head = spark.sparkContext.broadcast({w: (int(c > 0), x, y) for w, c, x, y in zip(*[head_rows[k].to_pylist() for k in ("word", "c", "base", "lp")])})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("t"))
    kind = dict(rows.dtypes)["id"]
    names = ["row", "id", "held_out", "word", "n", "n_tokens", "known", "base", "lp"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its frequent words add (its word can't be one: it has a space), and a row for each other word of it."""
        known_words = head.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                row, word, count, owner = [], [], [], []
                sums = [[], [], [], []]
                for d, (r, t) in enumerate(zip(part.column(0).to_pylist(), part.column(3))):
                    own, other = Counter(words_of(t.as_py())), {}
                    known, base, lp = known_words[b""]
                    for w, times in own.items():
                        x = known_words.get(w)
                        if x is None:
                            other[w] = times
                        else:
                            known += times * x[0]
                            base += times * x[1]
                            lp += times * x[2]
                    for s, x in zip(sums, (own.total() + 1, known, base, lp)):
                        s.append(x)
                    row += [r] * (len(other) + 1)
                    owner += [d] + [None] * len(other)
                    word += [b" %d" % r, *other]
                    count += [0, *other.values()]
                own = pa.array(owner, pa.int32())
                take = lambda x, kind: pa.array(x, kind).take(own)
                yield pa.record_batch([pa.array(row, pa.int64()), part.column(1).take(own), part.column(2).take(own), pa.array(word, pa.binary()), pa.array(count, pa.int32()), take(sums[0], pa.int64()), take(sums[1], pa.int64()), take(sums[2], pa.float64()), take(sums[3], pa.float64())], names=names)

    parts = rows.mapInArrow(score, f"row long, id {kind}, held_out boolean, word binary, n int, n_tokens long, known long, base double, lp double")
    side = words.select(F.col("word").alias("w"), (F.col("c") > 0).cast("int").alias("w_known"), F.col("base").alias("w_base"), F.col("lp").alias("w_lp")).where("octet_length(w) > 0")
    joined = parts.join(side, F.col("word") == F.col("w"), "left")
    total = lambda own, other: F.sum(F.coalesce(F.col(own), F.lit(0)) + F.col("n") * F.coalesce(F.col(other), F.lit(0)))
    out = joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), total("known", "w_known").cast("long").alias("n_known"), total("base", "w_base").alias("base_score"), total("lp", "w_lp").alias("score"))
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
