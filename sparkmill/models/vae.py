"""Variational autoencoder of depths, composition and total abundance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.functions.vectors import masked
from sparkmill.models.nn import Adam, Chain, Layer, Linear, Trained, hidden, minibatches, softmax, softmax_back

N_TNF = 103


@dataclass
class Inputs:
    """Rows aligned by position: depths (n x samples), tnf, total abundance (n x 1) and weights (n x 1)."""

    depths: np.ndarray
    tnf: np.ndarray
    total: np.ndarray
    weights: np.ndarray
    ids: np.ndarray | None = None
    labels: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.depths)

    def at(self, i: np.ndarray) -> Inputs:
        return Inputs(self.depths[i], self.tnf[i], self.total[i], self.weights[i])

    def joined(self) -> np.ndarray:
        return np.hstack([self.depths, self.tnf, self.total])

    @staticmethod
    def of(t: pa.Table) -> Inputs:
        """From rows (contig_idx, depths, tnf, total_ab, weight and maybe label) in memory."""
        wide = lambda c: t[c].combine_chunks().flatten().to_numpy().astype(np.float32).reshape(len(t), -1)
        one = lambda c: t[c].to_numpy().astype(np.float32)[:, None]
        labels = t["label"].to_numpy() if "label" in t.schema.names else None
        return Inputs(wide("depths"), wide("tnf"), one("total_ab"), one("weight"), t["contig_idx"].to_numpy(), labels)


def check(n_samples: int, n_latent: int, n_hidden: list[int], alpha: float, beta: float, dropout: float) -> None:
    if n_samples < 1 or n_latent < 1 or any(n < 1 for n in n_hidden):
        raise ValueError("samples, latent dimensions and neurons must be at least 1")
    if not 0 < alpha < 1 or beta <= 0 or not 0 <= dropout < 1:
        raise ValueError("alpha must be between 0 and 1, beta positive and dropout at least 0 and below 1")


def defaults(n_samples: int, n_hidden: list[int] | None, alpha: float | None, dropout: float | None) -> tuple[list[int], float, float]:
    many = n_samples > 1
    return n_hidden or ([512, 512] if many else [256, 256]), (0.15 if many else 0.5) if alpha is None else alpha, (0.2 if many else 0.0) if dropout is None else dropout


@dataclass
class Weights:
    """Weights of the loss terms: total abundance, depths, composition, prior."""

    total: float
    depths: float
    tnf: float
    prior: float

    @staticmethod
    def of(n_samples: int, n_tnf: int, n_latent: int, alpha: float, beta: float) -> Weights:
        depths = 0.0 if n_samples == 1 else (1 - alpha) * (n_samples - 1) / (n_samples * np.log(n_samples))
        return Weights((1 - alpha) / n_samples, depths, alpha / n_tnf, 1 / (n_latent * beta))


def reconstruction(x: Inputs, depths: np.ndarray, tnf: np.ndarray, total: np.ndarray, k: Weights) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Weighted loss of each row, and its unweighted terms."""
    terms = {"total": ((total - x.total) ** 2).sum(axis=1), "depths": -(np.log(depths + 1e-9) * x.depths).sum(axis=1), "tnf": ((tnf - x.tnf) ** 2).sum(axis=1)}
    return terms["total"] * k.total + terms["depths"] * k.depths + terms["tnf"] * k.tnf, terms


class Decoder(Layer):
    """From latent to softmax depths, composition and total abundance."""

    def __init__(self, n_latent: int, n_hidden: list[int], n_samples: int, n_tnf: int, dropout: float, rng: np.random.Generator) -> None:
        self.n_samples, self.n_tnf = n_samples, n_tnf
        sizes = [n_latent, *n_hidden[::-1]]
        self.net = Chain(hidden(sizes, dropout, rng), Linear(sizes[-1], n_samples + n_tnf + 1, rng))

    def __call__(self, z, train=False, rng=None):
        y, back = self.net(z, train, rng)
        s, t = self.n_samples, self.n_samples + self.n_tnf
        depths = softmax(y[:, :s])
        return (depths, y[:, s:t], y[:, t:]), lambda g: back(np.hstack([softmax_back(depths, g[0]), g[1], g[2]]))


def reconstruction_grads(x: Inputs, depths, tnf, total, k: Weights, row: np.ndarray):
    """Gradients of the weighted loss times `row` (n x 1) for the three outputs."""
    return -x.depths / (depths + 1e-9) * k.depths * row, 2 * (tnf - x.tnf) * k.tnf * row, 2 * (total - x.total) * k.total * row


class VAE(Trained):
    """Encoder to the mean of a normal latent with unit deviation, decoder, weighted loss."""

    def __init__(self, n_samples: int, n_tnf: int = N_TNF, n_hidden: list[int] | None = None, n_latent: int = 32, alpha: float | None = None, beta: float = 200.0, dropout: float | None = None, seed: int = 0) -> None:
        n_hidden, alpha, dropout = defaults(n_samples, n_hidden, alpha, dropout)
        check(n_samples, n_latent, n_hidden, alpha, beta, dropout)
        self.rng = np.random.default_rng(seed)
        self.n_latent, self.k = n_latent, Weights.of(n_samples, n_tnf, n_latent, alpha, beta)
        sizes = [n_samples + n_tnf + 1, *n_hidden]
        self.encoder = Chain(hidden(sizes, dropout, self.rng), Linear(sizes[-1], n_latent, self.rng))
        self.decoder = Decoder(n_latent, n_hidden, n_samples, n_tnf, dropout, self.rng)

    def loss(self, x: Inputs, train: bool = True) -> float:
        """Mean loss of the rows; with train the gradients are collected."""
        mu, back_mu = self.encoder(x.joined(), train, self.rng)
        z = mu + self.rng.standard_normal(mu.shape, dtype=np.float32) if train else mu
        out, back = self.decoder(z, train, self.rng)
        rows, _ = reconstruction(x, *out, self.k)
        prior = 0.5 * (mu * mu).sum(axis=1)
        if train:
            row = x.weights / len(x)
            g = back(reconstruction_grads(x, *out, self.k, row))
            back_mu(g + mu * self.k.prior * row)
        return float(((rows + prior * self.k.prior) * x.weights[:, 0]).mean())

    def train(self, x: Inputs, epochs: int = 300, batch: int = 256, double_at: tuple[int, ...] = (25, 75, 150, 225), lr: float | None = None) -> list[float]:
        """Loss of every epoch. The batch doubles at the given epochs. lr: Adam with that rate; else its step adapts itself."""
        return self.train_epochs(x, None, epochs, batch, double_at, lr)

    def epoch(self, x: Inputs, labels: None, batch: int, steps: list[Adam]) -> list[float]:
        losses = []
        for i in minibatches(len(x), batch, self.rng):
            losses.append(self.loss(x.at(i)))
            steps[0].step()
        return losses

    def encode(self, x: Inputs) -> np.ndarray:
        """Means of the latent, their 12 lowest mantissa bits zero."""
        return masked(self.encoder(x.joined())[0], 12)


def lists(v: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))


def apply_frame(features: DataFrame, kinds: str, f: Callable[..., list[pa.Array]], *more: str) -> DataFrame:
    """(contig_idx, columns of `kinds`): f of the inputs, and of the columns named in more, for every Arrow batch of features; nothing goes through the driver."""
    names = ["contig_idx", *[k.split()[0] for k in kinds.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                wide = [b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (1, 2)]
                x = Inputs(*wide, b.column(3).to_numpy()[:, None], np.ones((b.num_rows, 1), np.float32))
                yield pa.record_batch([b.column(0), *f(x, *[b.column(4 + i).to_numpy() for i in range(len(more))])], names=names)

    return features.select(F.col("contig_idx").cast("long").alias("contig_idx"), "depths", "tnf", "total_ab", *[F.col(m).alias(f"more{i}") for i, m in enumerate(more)]).mapInArrow(run, f"contig_idx long, {kinds}")


def encode_frame(model, features: DataFrame) -> DataFrame:
    """(contig_idx, v array<float>): the model's latent of every row, by Arrow batches; the weights are broadcast."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    return apply_frame(features, "v array<float>", lambda x: [lists(shared.value.encode(x))])
