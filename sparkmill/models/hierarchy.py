"""Losses and predictions over a tree of labels."""

from __future__ import annotations

import numpy as np

from sparkmill.models.nn import log_softmax, softmax

LOSSES = ("flat_softmax", "cond_softmax", "soft_margin")
#: Margin weight of soft_margin (a fixed value).
TAU = 0.01


class Tree:
    """Parents in topological order, the root first with parent -1."""

    def __init__(self, parents: np.ndarray | list[int]) -> None:
        self.parents = np.asarray(parents)
        n = self.n = len(self.parents)
        if n == 0 or self.parents[0] != -1 or (self.parents[1:] >= np.arange(1, n)).any() or (self.parents[1:] < 0).any():
            raise ValueError("the first node must be the root, and a parent must stand before its children")
        self.n_children = np.bincount(self.parents[1:], minlength=n)
        self.leaves = np.flatnonzero(self.n_children == 0)
        self.depth, size = np.zeros(n, np.int64), np.ones(n, np.int64)
        for v in range(1, n):
            self.depth[v] = self.depth[self.parents[v]] + 1
        for v in range(n - 1, 0, -1):
            size[self.parents[v]] += size[v]
        #: In a walk that enters a node before all below it, v is entered at enter[v] and what is below it before leave[v].
        self.enter, free = np.zeros(n, np.int64), np.ones(n, np.int64)
        for v in range(1, n):
            self.enter[v] = free[self.parents[v]]
            free[self.parents[v]] += size[v]
            free[v] = self.enter[v] + 1
        self.leave = self.enter + size
        self.walk = np.argsort(self.enter)
        self.n_leaves = self.sums(np.isin(np.arange(n), self.leaves)[None].astype(np.int64))[0]
        self.levels = np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])

    def above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a is b or an ancestor of b."""
        return (self.enter[a] <= self.enter[b]) & (self.enter[b] < self.leave[a])

    def sums(self, x: np.ndarray) -> np.ndarray:
        """rows x nodes: what x has at each node and all below it, as differences of sums along the walk."""
        upto = np.zeros((len(x), self.n + 1), np.float64 if x.dtype.kind == "f" else np.int64)
        np.cumsum(x[:, self.walk], axis=1, out=upto[:, 1:])
        return (upto[:, self.leave] - upto[:, self.enter]).astype(x.dtype)

    def siblings(self) -> list[np.ndarray]:
        """The children of every inner node."""
        order = np.argsort(self.parents[1:], kind="stable") + 1
        return np.split(order, np.cumsum(self.n_children[self.n_children > 0])[:-1]) if self.n > 1 else []

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = np.array(a)
        while True:
            up = ~self.above(a, b)
            if not up.any():
                return a
            a[up] = self.parents[a[up]]


class HierarchicalLoss:
    """Loss of scores for labels that may be inner nodes, with its gradient, and probabilities of all nodes."""

    def __init__(self, name: str, tree: Tree) -> None:
        if name not in LOSSES:
            raise ValueError(f"{name} is none of {', '.join(LOSSES)}")
        self.name, self.tree = name, tree
        self.n_scores = {"flat_softmax": len(tree.leaves), "cond_softmax": tree.n - 1, "soft_margin": tree.n}[name]
        if name == "cond_softmax":
            kids = tree.siblings()
            self.order = np.concatenate(kids) if kids else np.zeros(0, np.int64)  # scores stand family by family
            self.cuts = np.cumsum([0, *map(len, kids)])

    def _families(self, scores: np.ndarray) -> np.ndarray:
        """Log probabilities given the parent, 0 for the root."""
        out = np.zeros((len(scores), self.tree.n), scores.dtype)
        if len(self.order):
            sizes, first = np.diff(self.cuts), self.cuts[:-1]
            x = scores - np.repeat(np.maximum.reduceat(scores, first, axis=1), sizes, axis=1)
            out[:, self.order] = x - np.repeat(np.log(np.add.reduceat(np.exp(x), first, axis=1)), sizes, axis=1)
        return out

    def loss(self, scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss of each row, gradient of each row's loss)."""
        t, rows = self.tree, np.arange(len(scores))
        if self.name == "flat_softmax":
            lp = log_softmax(scores)
            mine = t.above(labels[:, None], t.leaves)
            inside = np.where(mine, lp, -np.inf)
            top = inside.max(axis=1, keepdims=True)
            label_lp = top[:, 0] + np.log(np.exp(inside - top).sum(axis=1))
            return -label_lp, np.exp(lp) - np.exp(inside - label_lp[:, None])
        if self.name == "cond_softmax":
            lc, on = self._families(scores), t.above(np.arange(t.n), labels[:, None])
            own = on[:, self.order]  # a family counts if the label is below its parent, of which one is then on
            inside = t.above(t.parents[self.order], labels[:, None]) & (t.parents[self.order] != labels[:, None])
            return -(lc * on).sum(axis=1), np.exp(lc[:, self.order]) * inside - own
        raised = scores + np.float32(TAU) * ~t.above(np.arange(t.n), labels[:, None])
        grad = softmax(raised)
        top = raised.max(axis=1)
        value = top + np.log(np.exp(raised - top[:, None]).sum(axis=1)) - scores[rows, labels]
        grad[rows, labels] -= 1
        return value, grad

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """n x nodes."""
        t = self.tree
        if self.name == "flat_softmax":
            every = np.zeros((len(scores), t.n), scores.dtype)
            every[:, t.leaves] = softmax(scores)
            return t.sums(every)
        if self.name == "cond_softmax":
            lc = self._families(scores)
            for level in t.levels[1:]:
                lc[:, level] += lc[:, t.parents[level]]
            return np.exp(lc)
        return t.sums(softmax(scores))

    def best(self, probs: np.ndarray, threshold: float = 0.5) -> np.ndarray:
        """The most specific node above the threshold (fewest leaves below, then highest probability), single children left out; the root if none."""
        t = self.tree
        ok = (probs > threshold) & (t.n_children != 1)
        value = np.where(ok, -t.n_leaves * 10.0 + np.clip(probs, 0, 1), -np.inf)
        return np.where(ok.any(axis=1), value.argmax(axis=1), 0)


def one_hot(labels: np.ndarray, n: int) -> np.ndarray:
    """Width n, 105 at least."""
    return np.eye(max(n, 105), dtype=np.float32)[labels]
