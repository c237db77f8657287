"""Adversarial autoencoder with a continuous and a categorical latent."""

from __future__ import annotations

import numpy as np

from sparkmill.functions.vectors import masked
from sparkmill.models.nn import Adam, BatchNorm, Chain, Layer, LeakyReLU, Linear, Sigmoid, Trained, minibatches, softmax, softmax_back
from sparkmill.models.vae import N_TNF, Inputs


def _block(sizes: list[int], rng: np.random.Generator) -> Chain:
    return Chain(*[x for a, b in zip(sizes, sizes[1:]) for x in (Linear(a, b, rng), BatchNorm(b), LeakyReLU())])


def _discriminator(n: int, h: int, rng: np.random.Generator) -> Chain:
    half = max(1, h // 2)
    return Chain(Linear(n, h, rng), LeakyReLU(), Linear(h, half, rng), LeakyReLU(), Linear(half, 1, rng), Sigmoid())


def _cross_entropy(p: np.ndarray, label: float) -> tuple[float, np.ndarray]:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    loss = -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()
    return float(loss), ((p - label) / (p * (1 - p)) / len(p)).astype(np.float32)


class AAE(Trained):
    """Reconstruction of depths and composition; two discriminators hold the latents to their priors.

    z: a normal; y: a relaxed one-hot of uniform categories at `temperature`, the clusters. sl: share of the adversarial
    loss, slr: share of z in it.
    """

    def __init__(self, n_samples: int, n_tnf: int = N_TNF, n_hidden: int = 547, n_z: int = 283, n_y: int = 700, sl: float = 0.00964, slr: float = 0.5, temperature: float = 0.1596, alpha: float | None = None, seed: int = 0) -> None:
        if min(n_samples, n_hidden, n_z, n_y) < 1 or not 0 <= sl <= 1 or not 0 <= slr <= 1 or temperature <= 0:
            raise ValueError("sizes must be at least 1, sl and slr between 0 and 1, the temperature positive")
        self.alpha = (0.15 if n_samples > 1 else 0.5) if alpha is None else alpha
        self.rng = np.random.default_rng(seed)
        self.n_samples, self.n_z, self.n_y, self.sl, self.slr, self.temperature = n_samples, n_z, n_y, sl, slr, temperature
        n, h = n_samples + n_tnf, n_hidden
        self.encoder, self.mu, self.log_var, self.y = _block([n, h, h], self.rng), Linear(h, n_z, self.rng), Linear(h, n_z, self.rng), Linear(h, n_y, self.rng)
        self.decoder = Chain(_block([n_z + n_y, h, h], self.rng), Linear(h, n, self.rng))
        self.judge_z, self.judge_y = _discriminator(n_z, h, self.rng), _discriminator(n_y, h, self.rng)

    def _latents(self, x: Inputs, train: bool):
        e, back_e = self.encoder(np.hstack([x.depths, x.tnf]), train, self.rng)
        mu, back_mu = self.mu(e)
        lv, back_lv = self.log_var(e)
        logits, back_y = self.y(e)
        y, noise = softmax(logits), self.rng.standard_normal(mu.shape).astype(np.float32) if train else np.float32(0)
        spread = np.exp(np.clip(lv, -20, 20) / 2)
        z = mu + noise * spread
        return mu, z, y, lambda gz, gy: back_e(back_mu(gz) + back_lv(gz * noise * spread / 2) + back_y(softmax_back(y, gy)))

    def _reconstruct(self, x: Inputs, z: np.ndarray, y: np.ndarray, train: bool):
        out, back = self.decoder(np.hstack([z, y]), train, self.rng)
        s, n = self.n_samples, len(x)
        depths, tnf = softmax(out[:, :s]), out[:, s:]
        k_tnf = self.alpha / (2 * tnf.shape[1])
        if s > 1:
            k = (1 - self.alpha) / np.log(s)
            loss, g = -(np.log(depths + 1e-9) * x.depths).sum(axis=1).mean() * k, -x.depths / (depths + 1e-9) * k / n
        else:
            k = 1 - self.alpha
            loss, g = ((depths - x.depths) ** 2).sum(axis=1).mean() * k, 2 * (depths - x.depths) * k / n
        loss += ((tnf - x.tnf) ** 2).sum(axis=1).mean() * k_tnf
        return float(loss), lambda scale: back(np.hstack([softmax_back(depths, g), 2 * (tnf - x.tnf) * k_tnf / n]).astype(np.float32) * np.float32(scale))

    def _prior_y(self, n: int) -> np.ndarray:
        gumbel = -np.log(-np.log(self.rng.uniform(1e-9, 1 - 1e-9, (n, self.n_y))))
        return softmax((gumbel / self.temperature).astype(np.float32))

    def train(self, x: Inputs, epochs: int = 70, batch: int = 256, double_at: tuple[int, ...] = (25, 50), lr: float = 1e-3) -> list[float]:
        """Reconstruction loss of every epoch."""
        return self.train_epochs(x, None, epochs, batch, double_at, lr)

    def steps(self, lr: float | None) -> list[Adam]:
        """Of the coders and of the two discriminators."""
        judges = {id(p) for j in (self.judge_z, self.judge_y) for p in j.params()}
        own = [[p for p in self.params() if id(p) not in judges], self.judge_z.params(), self.judge_y.params()]
        return [Adam(params, lr or 1.0, adapt=lr is None) for params in own]

    def epoch(self, x: Inputs, labels: None, batch: int, steps: list[Adam]) -> list[float]:
        """The reconstruction loss of every minibatch."""
        coder, judges, losses = steps[0], [*zip((self.judge_z, self.judge_y), steps[1:])], []
        for i in minibatches(len(x), batch, self.rng):
            rows = x.at(i)
            _, z, y, back = self._latents(rows, True)
            loss, back_r = self._reconstruct(rows, z, y, True)
            g = back_r(1 - self.sl)
            gs = []
            for (judge, _), latent, share in zip(judges, (z, y), (self.slr, 1 - self.slr)):
                p, back_j = judge(latent)
                gs.append(back_j(_cross_entropy(p, 1.0)[1] * np.float32(self.sl * share)))
            back(g[:, : self.n_z] + gs[0], g[:, self.n_z :] + gs[1])
            coder.step()
            for (judge, step), latent, prior in zip(judges, (z, y), (self.rng.standard_normal(z.shape).astype(np.float32), self._prior_y(len(rows)))):
                for p in judge.params():
                    p.grad[...] = 0
                for rows_, label in ((prior, 1.0), (latent, 0.0)):
                    p, back_j = judge(rows_)
                    back_j(_cross_entropy(p, label)[1] / 2)
                step.step()
            losses.append(loss)
        return losses

    def encode(self, x: Inputs) -> np.ndarray:
        """The continuous latent."""
        return masked(self._latents(x, False)[0], 12)

    def categories(self, x: Inputs) -> np.ndarray:
        """1-based category of every row: the clusters of the categorical latent."""
        return self._latents(x, False)[2].argmax(axis=1) + 1
