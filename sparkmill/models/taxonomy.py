"""Models with labels of a tree: a classifier, and a variational autoencoder of two modalities."""

from __future__ import annotations

import numpy as np

from sparkmill.functions.vectors import masked
from sparkmill.models.hierarchy import HierarchicalLoss, Tree, one_hot
from sparkmill.models.nn import Adam, Chain, Layer, Linear, Trained, hidden, minibatches
from sparkmill.models.vae import N_TNF, VAE, Decoder, Inputs, Weights, check, defaults, reconstruction, reconstruction_grads


class LabelPredictor(Trained):
    """Labels of a tree from depths, composition and abundance: hidden layers (four of 512 for many samples) and a hierarchical loss."""

    def __init__(self, n_samples: int, tree: Tree, n_tnf: int = N_TNF, n_hidden: list[int] | None = None, dropout: float | None = None, loss: str = "flat_softmax", seed: int = 0) -> None:
        n_hidden, _, dropout = defaults(n_samples, n_hidden or [512] * 4, None, dropout)
        check(n_samples, 1, n_hidden, 0.5, 1.0, dropout)
        self.rng, self.hier = np.random.default_rng(seed), HierarchicalLoss(loss, tree)
        sizes = [n_samples + n_tnf + 1, *n_hidden]
        self.net = Chain(hidden(sizes, dropout, self.rng), Linear(sizes[-1], self.hier.n_scores, self.rng))

    def train(self, x: Inputs, labels: np.ndarray, epochs: int = 100, batch: int = 1024, double_at: tuple[int, ...] = (), lr: float | None = 1e-3) -> list[float]:
        return self.train_epochs(x, labels, epochs, batch, double_at, lr)

    def epoch(self, x: Inputs, labels: np.ndarray, batch: int, steps: list[Adam]) -> list[float]:
        losses = []
        for i in minibatches(len(x), batch, self.rng):
            scores, back = self.net(x.at(i).joined(), True, self.rng)
            value, grad = self.hier.loss(scores, labels[i])
            back((grad / len(i)).astype(np.float32))
            steps[0].step()
            losses.append(float(value.mean()))
        return losses

    def predict(self, x: Inputs) -> np.ndarray:
        """Probabilities of all nodes."""
        return self.hier.probabilities(self.net(x.joined())[0])

    def predict_with_truth(self, x: Inputs, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(probabilities, most specific confident node, mean loss)."""
        scores = self.net(x.joined())[0]
        probs = self.hier.probabilities(scores)
        return probs, self.hier.best(probs), float(self.hier.loss(scores, labels)[0].mean())


def kld_to(p: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean divergence of unit normals with means p and q over all components, and its gradients."""
    d = p - q
    return float((d * d / 2).mean()), d / d.size, -d / d.size


class LabelVAE(Layer):
    """Variational autoencoder of one-hot labels with a hierarchical loss."""

    def __init__(self, tree: Tree, hier: HierarchicalLoss, n_hidden: list[int], n_latent: int, dropout: float, prior: float, rng: np.random.Generator) -> None:
        self.rng, self.hier, self.prior, self.width = rng, hier, prior, max(tree.n, 105)
        sizes = [self.width, *n_hidden]
        self.encoder = Chain(hidden(sizes, dropout, rng), Linear(sizes[-1], n_latent, rng))
        self.decoder = Chain(hidden([n_latent, *n_hidden[::-1]], dropout, rng), Linear(n_hidden[0], hier.n_scores, rng))

    def loss(self, labels: np.ndarray, n_nodes: int) -> float:
        mu, back_mu = self.encoder(one_hot(labels, n_nodes), True, self.rng)
        z = mu + self.rng.standard_normal(mu.shape, dtype=np.float32)
        scores, back = self.decoder(z, True, self.rng)
        value, grad = self.hier.loss(scores, labels)
        back_mu(back((grad / len(labels)).astype(np.float32)) + mu * self.prior / len(labels))
        return float(value.mean() + 0.5 * (mu * mu).sum(axis=1).mean() * self.prior)


class BimodalVAE(Trained):
    """Three encoders (contigs, labels, both) and two decoders (contigs, labels) that share a latent.

    The joint encoder's latent goes through both single decoders and is drawn to the latents of the single encoders; the
    single autoencoders are trained along on their own rows. The three losses are added. Contigs without a label take the
    root as theirs.
    """

    def __init__(self, n_samples: int, tree: Tree, n_tnf: int = N_TNF, n_hidden: list[int] | None = None, n_latent: int = 32, alpha: float | None = None, beta: float = 200.0, dropout: float | None = None, loss: str = "flat_softmax", seed: int = 0) -> None:
        n_hidden, alpha, dropout = defaults(n_samples, n_hidden, alpha, dropout)
        self.tree, self.hier, self.rng = tree, HierarchicalLoss(loss, tree), np.random.default_rng(seed)
        self.k = Weights.of(n_samples, n_tnf, n_latent, alpha, beta)
        self.contigs = VAE(n_samples, n_tnf, n_hidden, n_latent, alpha, beta, dropout, seed)
        self.labels = LabelVAE(tree, self.hier, n_hidden, n_latent, dropout, self.k.prior, self.rng)
        sizes = [n_samples + n_tnf + 1 + max(tree.n, 105), *n_hidden]
        self.joint = Chain(hidden(sizes, dropout, self.rng), Linear(sizes[-1], n_latent, self.rng))

    def _both(self, x: Inputs, labels: np.ndarray) -> np.ndarray:
        return np.hstack([x.joined(), one_hot(labels, self.tree.n)])

    def loss(self, x: Inputs, labels: np.ndarray, alone: Inputs, alone_labels: np.ndarray) -> float:
        """Loss of paired rows and of rows for the single modalities; the gradients are collected."""
        n = len(x)
        mu, back_mu = self.joint(self._both(x, labels), True, self.rng)
        noise = lambda: self.rng.standard_normal(mu.shape, dtype=np.float32)
        out, back_c = self.contigs.decoder(mu + noise(), True, self.rng)
        scores, back_l = self.labels.decoder(mu + noise(), True, self.rng)
        rows, _ = reconstruction(x, *out, self.k)
        value, grad = self.hier.loss(scores, labels)
        row = x.weights / n
        g = back_c(reconstruction_grads(x, *out, self.k, row)) + back_l((grad * row).astype(np.float32))
        mean_weight, total = float(x.weights.mean()), 0.0
        for encoder, given in ((self.contigs.encoder, x.joined()), (self.labels.encoder, one_hot(labels, self.tree.n))):
            q, back_q = encoder(given, True, self.rng)
            kld, gp, gq = kld_to(mu, q)
            scale = np.float32(self.k.prior * mean_weight)
            g = g + gp * scale
            back_q(gq * scale)
            total += kld * float(scale)
        back_mu(g)
        joint = float(((rows + value) * x.weights[:, 0]).mean()) + total
        return joint + self.contigs.loss(alone) + self.labels.loss(alone_labels, self.tree.n)

    def train(self, x: Inputs, labels: np.ndarray, epochs: int = 300, batch: int = 256, double_at: tuple[int, ...] = (25, 75, 150, 225), lr: float | None = 1e-3) -> list[float]:
        return self.train_epochs(x, labels, epochs, batch, double_at, lr)

    def epoch(self, x: Inputs, labels: np.ndarray, batch: int, steps: list[Adam]) -> list[float]:
        losses = []
        for i, j in zip(minibatches(len(x), batch, self.rng), minibatches(len(x), batch, self.rng)):
            losses.append(self.loss(x.at(i), labels[i], x.at(j), labels[j]))
            steps[0].step()
        return losses

    def encode(self, x: Inputs, labels: np.ndarray) -> np.ndarray:
        """The joint encoder's latent."""
        return masked(self.joint(self._both(x, labels))[0], 12)


def permuted(n: int, total: int, seed: int) -> np.ndarray:
    """Row numbers 0..n-1 permuted again and again, cut at `total`."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.permutation(n) for _ in range(-(-total // n))])[:total] if total else np.zeros(0, np.int64)


class ConcatVAE(Trained):
    """Variational autoencoder of contigs and labels as one input and one output."""

    def __init__(self, n_samples: int, tree: Tree, n_tnf: int = N_TNF, n_hidden: list[int] | None = None, n_latent: int = 32, alpha: float | None = None, beta: float = 200.0, dropout: float | None = None, loss: str = "flat_softmax", seed: int = 0) -> None:
        n_hidden, alpha, dropout = defaults(n_samples, n_hidden, alpha, dropout)
        check(n_samples, n_latent, n_hidden, alpha, beta, dropout)
        self.tree, self.hier, self.rng = tree, HierarchicalLoss(loss, tree), np.random.default_rng(seed)
        self.k = Weights.of(n_samples, n_tnf, n_latent, alpha, beta)
        sizes = [n_samples + n_tnf + 1 + max(tree.n, 105), *n_hidden]
        self.encoder = Chain(hidden(sizes, dropout, self.rng), Linear(sizes[-1], n_latent, self.rng))
        self.contigs = Decoder(n_latent, n_hidden, n_samples, n_tnf, dropout, self.rng)
        self.labels = Chain(hidden([n_latent, *n_hidden[::-1]], dropout, self.rng), Linear(n_hidden[0], self.hier.n_scores, self.rng))

    def loss(self, x: Inputs, labels: np.ndarray) -> float:
        mu, back_mu = self.encoder(np.hstack([x.joined(), one_hot(labels, self.tree.n)]), True, self.rng)
        z = mu + self.rng.standard_normal(mu.shape, dtype=np.float32)
        out, back_c = self.contigs(z, True, self.rng)
        scores, back_l = self.labels(z, True, self.rng)
        rows, _ = reconstruction(x, *out, self.k)
        value, grad = self.hier.loss(scores, labels)
        row = x.weights / len(x)
        back_mu(back_c(reconstruction_grads(x, *out, self.k, row)) + back_l((grad * row).astype(np.float32)) + mu * self.k.prior * row)
        return float(((rows + value + 0.5 * (mu * mu).sum(axis=1) * self.k.prior) * x.weights[:, 0]).mean())

    def train(self, x: Inputs, labels: np.ndarray, epochs: int = 100, batch: int = 256, lr: float = 1e-3) -> list[float]:
        return self.train_epochs(x, labels, epochs, batch, (), lr)

    def epoch(self, x: Inputs, labels: np.ndarray, batch: int, steps: list[Adam]) -> list[float]:
        losses = []
        for i in minibatches(len(x), batch, self.rng):
            losses.append(self.loss(x.at(i), labels[i]))
            steps[0].step()
        return losses

    def encode(self, x: Inputs, labels: np.ndarray) -> np.ndarray:
        return masked(self.encoder(np.hstack([x.joined(), one_hot(labels, self.tree.n)]))[0], 12)
