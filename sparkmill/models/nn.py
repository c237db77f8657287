"""Small neural networks: every call returns its output and a function that carries gradients back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

Back = Callable[[np.ndarray], np.ndarray]
SLOPE, EPS, MOMENTUM = 0.01, 1e-5, 0.1


class Param:
    """Weights and the gradient collected since the last step."""

    def __init__(self, value: np.ndarray) -> None:
        self.value = value.astype(np.float32)
        self.grad = np.zeros_like(self.value)


class Layer:
    def params(self) -> list[Param]:
        return [p for x in vars(self).values() for p in _params(x)]

    def state(self) -> list[np.ndarray]:
        """Weights and running statistics in a fixed order."""
        return [p.value for p in self.params()] + [b for m in self.modules() if isinstance(m, BatchNorm) for b in (m.mean, m.var)]

    def load(self, arrays: list[np.ndarray]) -> None:
        own = self.state()
        if [a.shape for a in own] != [np.shape(a) for a in arrays]:
            raise ValueError("these weights belong to another model")
        for mine, given in zip(own, arrays):
            mine[...] = given

    def modules(self) -> Iterator[Layer]:
        yield self
        for x in vars(self).values():
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Layer):
                    yield from y.modules()

    def save(self, path: str) -> None:
        np.savez(path, *self.state())

    def restore(self, path: str) -> None:
        with np.load(path) as f:
            self.load([f[k] for k in f.files])


def _params(x: object) -> list[Param]:
    if isinstance(x, Param):
        return [x]
    if isinstance(x, Layer):
        return x.params()
    return [p for y in x for p in _params(y)] if isinstance(x, list) else []


class Linear(Layer):
    def __init__(self, n_in: int, n_out: int, rng: np.random.Generator) -> None:
        bound = 1 / np.sqrt(max(1, n_in))
        self.w, self.b = Param(rng.uniform(-bound, bound, (n_in, n_out))), Param(rng.uniform(-bound, bound, n_out))

    def __call__(self, x: np.ndarray, train: bool = False, rng: np.random.Generator | None = None) -> tuple[np.ndarray, Back]:
        def back(g: np.ndarray) -> np.ndarray:
            self.w.grad += x.T @ g
            self.b.grad += g.sum(axis=0)
            return g @ self.w.value.T

        return x @ self.w.value + self.b.value, back


class LeakyReLU(Layer):
    def __call__(self, x, train=False, rng=None):
        k = np.where(x > 0, np.float32(1), np.float32(SLOPE))
        return x * k, lambda g: g * k


class Dropout(Layer):
    def __init__(self, share: float) -> None:
        self.share = share

    def __call__(self, x, train=False, rng=None):
        if not train or not self.share:
            return x, lambda g: g
        k = (rng.random(x.shape) >= self.share).astype(np.float32) / np.float32(1 - self.share)
        return x * k, lambda g: g * k


class Sigmoid(Layer):
    def __call__(self, x, train=False, rng=None):
        y = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        return y, lambda g: g * y * (1 - y)


class BatchNorm(Layer):
    def __init__(self, n: int) -> None:
        self.scale, self.shift = Param(np.ones(n)), Param(np.zeros(n))
        self.mean, self.var = np.zeros(n, np.float32), np.ones(n, np.float32)

    def __call__(self, x, train=False, rng=None):
        if train:
            m, v, n = x.mean(axis=0), x.var(axis=0), len(x)
            self.mean += MOMENTUM * (m - self.mean)
            self.var += MOMENTUM * (v * (n / max(1, n - 1)) - self.var)
        else:
            m, v = self.mean, self.var
        s = 1 / np.sqrt(v + EPS)
        z = (x - m) * s

        def back(g: np.ndarray) -> np.ndarray:
            self.scale.grad += (g * z).sum(axis=0)
            self.shift.grad += g.sum(axis=0)
            g = g * self.scale.value
            return s * (g - g.mean(axis=0) - z * (g * z).mean(axis=0)) if train else g * s

        return z * self.scale.value + self.shift.value, back


class Chain(Layer):
    def __init__(self, *layers: Layer) -> None:
        self.layers = [*layers]

    def __call__(self, x, train=False, rng=None):
        backs = []
        for layer in self.layers:
            x, b = layer(x, train, rng)
            backs.append(b)

        def back(g: np.ndarray) -> np.ndarray:
            for b in reversed(backs):
                g = b(g)
            return g

        return x, back


def hidden(sizes: list[int], dropout: float, rng: np.random.Generator) -> Chain:
    """Linear, leaky ReLU, dropout and batch norm for each step of sizes."""
    return Chain(*[x for a, b in zip(sizes, sizes[1:]) for x in (Linear(a, b, rng), LeakyReLU(), Dropout(dropout), BatchNorm(b))])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def softmax_back(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    return p * (g - (g * p).sum(axis=1, keepdims=True))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Adam:
    """Adam; with adapt its step is scaled by a growing lower bound of the distance to the solution, so that lr can stay 1."""

    def __init__(self, params: list[Param], lr: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), adapt: bool = False) -> None:
        self.params, self.lr, self.betas, self.adapt, self.t = params, lr, betas, adapt, 0
        self.m, self.v = ([np.zeros_like(p.value) for p in params] for _ in range(2))
        self.d, self.top, self.s = 1e-6, 0.0, [np.zeros_like(p.value) for p in params]

    def state(self) -> list[np.ndarray]:
        return [*self.m, *self.v, *self.s, np.array([self.t, self.d, self.top], np.float64)]

    def load(self, arrays: list[np.ndarray]) -> None:
        for mine, given in zip([*self.m, *self.v, *self.s], arrays):
            mine[...] = given
        self.t, self.d, self.top = int(round(arrays[-1][0])), float(arrays[-1][1]), float(arrays[-1][2])

    def step(self) -> None:
        b1, b2 = self.betas
        self.t += 1
        fix = np.sqrt(1 - b2**self.t) / (1 - b1**self.t)
        k = self.lr * fix * (self.d if self.adapt else 1.0)
        below = 0.0
        for p, m, v, s in zip(self.params, self.m, self.v, self.s):
            scale = np.sqrt(v) + 1e-8
            if self.adapt:  # the correlation of gradients with the way gone so far bounds the distance from below
                self.top += k * float((p.grad * s / scale).sum()) * (1 - np.sqrt(b2))
                s *= np.sqrt(b2)
                s += (1 - np.sqrt(b2)) * k * p.grad
                below += float(np.abs(s).sum()) * (1 - np.sqrt(b2))
            m += (1 - b1) * (p.grad - m)
            v += (1 - b2) * (p.grad * p.grad - v)
            p.value -= k * m / (np.sqrt(v) + 1e-8)
            p.grad[...] = 0
        if self.adapt and below > 0:
            self.d = float(np.clip(self.top / below, self.d, 1.02 * self.d if self.d > 1e-4 else 2 * self.d))


def minibatches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Shuffled row numbers; a rest is dropped if n is more than a batch."""
    order = rng.permutation(n)
    if n <= size:
        yield order
        return
    for k in range(0, n - size + 1, size):
        yield order[k : k + size]


class Trained(Layer):
    """A model that is trained by epochs over rows; its layers share one generator."""

    def steps(self, lr: float | None) -> list[Adam]:
        """The optimisers. lr: Adam with that rate; else its step adapts itself."""
        return [Adam(self.params(), lr or 1.0, adapt=lr is None)]

    def epoch(self, x, labels: np.ndarray | None, batch: int, steps: list[Adam]) -> list[float]:
        """The loss of every minibatch."""
        raise NotImplementedError

    def reseed(self, seed: list[int]) -> None:
        rng = np.random.default_rng(seed)
        for m in self.modules():
            if hasattr(m, "rng"):
                m.rng = rng

    def train_epochs(self, x, labels: np.ndarray | None, epochs: int, batch: int, double_at: tuple[int, ...], lr: float | None) -> list[float]:
        """Loss of every epoch over rows in memory. The batch doubles at the given epochs."""
        steps, out = self.steps(lr), []
        for epoch in range(epochs):
            batch *= 1 + (epoch in double_at)
            out.append(float(np.mean(self.epoch(x, labels, batch, steps))))
        return out
