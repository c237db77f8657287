import numpy as np
import pytest

from sparkmill.models import nn
from sparkmill.models.aae import AAE
from sparkmill.models.hierarchy import LOSSES, HierarchicalLoss, Tree
from sparkmill.models.taxonomy import BimodalVAE, ConcatVAE, LabelPredictor, permuted
from sparkmill.models.vae import VAE, Inputs

PARENTS = [-1, 0, 0, 1, 1, 2, 2, 2, 5]


def inputs(n=200, samples=4, tnf=12, seed=1):
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, 4, n)
    depths = nn.softmax(rng.normal(size=(4, samples))[kind] * 2 + rng.normal(size=(n, samples)) * 0.2)
    x = rng.normal(size=(4, tnf))[kind] + rng.normal(size=(n, tnf)) * 0.3
    return Inputs(*(a.astype(np.float32) for a in (depths, x, rng.normal(size=(n, 1)), rng.uniform(0.5, 1.5, (n, 1))))), kind


def numeric(f, x, eps=1e-3):
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        keep = x[i]
        x[i] = keep + eps
        up = f()
        x[i] = keep - eps
        g[i] = (up - f()) / (2 * eps)
        x[i] = keep
    return g


@pytest.mark.parametrize("make", [lambda r: nn.Linear(3, 2, r), lambda r: nn.LeakyReLU(), lambda r: nn.Sigmoid(), lambda r: nn.BatchNorm(3), lambda r: nn.hidden([3, 4, 2], 0.0, r)])
def test_gradients_of_layers(make):
    rng = np.random.default_rng(0)
    layer, x = make(rng), rng.normal(size=(5, 3))
    for p in layer.params():
        p.value, p.grad = p.value.astype(float), p.grad.astype(float)
    weight = rng.normal(size=layer(x, True)[0].shape)
    loss = lambda: float((layer(x, True)[0] * weight).sum())
    got = layer(x, True)[1](weight)
    assert np.allclose(got, numeric(loss, x), atol=1e-4)
    for p in layer.params():
        assert np.allclose(p.grad, numeric(loss, p.value), atol=1e-4)


@pytest.mark.parametrize("name", LOSSES)
def test_hierarchical_losses(name):
    tree = Tree(PARENTS)
    hier, rng = HierarchicalLoss(name, tree), np.random.default_rng(2)
    labels = np.array([0, 1, 2, 3, 5, 7, 8])
    scores = rng.normal(size=(len(labels), hier.n_scores))
    value, grad = hier.loss(scores, labels)
    assert np.allclose(grad, numeric(lambda: hier.loss(scores, labels)[0].sum(), scores), atol=1e-5)
    probs = hier.probabilities(scores)
    assert probs.shape == (len(labels), tree.n) and np.allclose(probs[:, 0], 1)
    for v in range(tree.n):
        kids = np.flatnonzero(np.array(PARENTS) == v)
        if len(kids) and name != "soft_margin":
            assert np.allclose(probs[:, kids].sum(axis=1), probs[:, v])
    if name != "soft_margin":
        assert np.allclose(value, -np.log(probs[np.arange(len(labels)), labels]))


def test_tree():
    tree = Tree(PARENTS)
    assert tree.leaves.tolist() == [3, 4, 6, 7, 8] and tree.n_leaves.tolist() == [5, 2, 3, 1, 1, 1, 1, 1, 1]
    assert tree.lca(np.array([3, 8, 6, 0]), np.array([4, 7, 3, 5])).tolist() == [1, 2, 0, 0]
    for bad in ([], [0], [-1, 2, 0]):
        with pytest.raises(ValueError):
            Tree(bad)


def test_best_takes_the_most_specific_confident_node():
    hier = HierarchicalLoss("flat_softmax", Tree(PARENTS))
    probs = np.array([[1, 0.9, 0.1, 0.6, 0.3, 0, 0.1, 0, 0], [1, 0.4, 0.4, 0.2, 0.2, 0.2, 0.1, 0.1, 0.2], [1, 0.2, 0.8, 0, 0.2, 0.7, 0.1, 0, 0.7]])
    assert hier.best(probs).tolist() == [3, 0, 8]


def test_vae_gradient():
    x, _ = inputs(6, 3, 4)
    vae = VAE(3, 4, [5], 2, dropout=0.0, seed=3)
    for m in vae.modules():
        for k, v in list(vars(m).items()):
            if isinstance(v, nn.Param):
                v.value, v.grad = v.value.astype(float), v.grad.astype(float)

    class Fixed:
        def standard_normal(self, shape, dtype=None):
            return np.random.default_rng(7).standard_normal(shape)

    vae.rng = Fixed()
    vae.loss(x)
    got = [p.grad.copy() for p in vae.params()]
    for p, g in zip(vae.params(), got):
        def f():
            for q in vae.params():
                q.grad[...] = 0
            return vae.loss(x)

        assert np.allclose(g, numeric(f, p.value, 1e-4), atol=2e-4)


def test_vae_learns_and_is_deterministic(tmp_path):
    x, kind = inputs()
    runs = []
    for _ in range(2):
        vae = VAE(4, 12, [32, 32], 4, seed=5)
        losses = vae.train(x, epochs=40, batch=32, double_at=(20,), lr=1e-3)
        runs.append(vae.encode(x))
    assert losses[-1] < 0.75 * losses[0]
    assert (runs[0] == runs[1]).all() and runs[0].dtype == np.float32
    assert (runs[0].view(np.uint32) & 0xFFF == 0).all()
    vae.save(str(tmp_path / "m.npz"))
    other = VAE(4, 12, [32, 32], 4, seed=9)
    other.restore(str(tmp_path / "m.npz"))
    assert (other.encode(x) == runs[1]).all()
    with pytest.raises(ValueError):
        VAE(4, 12, [8], 4).restore(str(tmp_path / "m.npz"))


def test_adaptive_step_learns():
    x, _ = inputs()
    losses = VAE(4, 12, [32], 4, seed=5).train(x, epochs=60, batch=32, double_at=())
    assert losses[-1] < 0.8 * losses[0]


@pytest.mark.parametrize("bad", [{"n_samples": 0}, {"n_latent": 0}, {"n_hidden": [0]}, {"alpha": 1.0}, {"beta": 0}, {"dropout": 1.0}])
def test_vae_refuses(bad):
    with pytest.raises(ValueError):
        VAE(**{"n_samples": 3} | bad)


def test_aae_learns():
    x, kind = inputs()
    aae = AAE(4, 12, 32, 8, 6, seed=1)
    losses = aae.train(x, epochs=30, batch=32, double_at=(15,))
    assert losses[-1] < 0.8 * losses[0]
    assert aae.encode(x).shape == (200, 8)
    assert set(aae.categories(x).tolist()) <= set(range(1, 7))


@pytest.mark.parametrize("loss", LOSSES)
def test_label_models_learn(loss):
    x, kind = inputs()
    tree, labels = Tree(PARENTS), np.array([3, 4, 6, 8])[kind]
    predictor = LabelPredictor(4, tree, 12, [32, 32], loss=loss, seed=2)
    losses = predictor.train(x, labels, epochs=40, batch=64)
    assert losses[-1] < 0.5 * losses[0]
    probs, best, _ = predictor.predict_with_truth(x, labels)
    assert (best == labels).mean() > 0.9
    both = BimodalVAE(4, tree, 12, [32], 4, loss=loss, seed=2)
    losses = both.train(x, labels, epochs=20, batch=64)
    assert losses[-1] < losses[0] and both.encode(x, labels).shape == (200, 4)
    one = ConcatVAE(4, tree, 12, [32], 4, loss=loss, seed=2)
    losses = one.train(x, labels, epochs=20, batch=64)
    assert losses[-1] < losses[0]


def test_permuted():
    p = permuted(5, 13, 1)
    assert len(p) == 13 and sorted(p[:5].tolist()) == sorted(p[5:10].tolist()) == [0, 1, 2, 3, 4]
    assert (p == permuted(5, 13, 1)).all()


def frame(spark, x, labels, parts):
    rows = [(i, x.depths[i].tolist(), x.tnf[i].tolist(), float(x.total[i, 0]), float(x.weights[i, 0]), int(labels[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "contig_idx long, depths array<float>, tnf array<float>, total_ab float, weight float, label int").repartition(parts)


@pytest.mark.parametrize("shard_rows", [1000, 45])
def test_training_over_shards(spark, shard_rows):
    """Every row is used, the curve falls, and doesn't depend on how the table is split."""
    from sparkmill.models.training import train_frame

    x, kind = inputs()
    labels = np.array([3, 4, 6, 8])[kind]
    curves, weights = [], []
    for parts in (1, 4):
        vae = VAE(4, 12, [16], 4, seed=5)
        curves.append(train_frame(vae, frame(spark, x, labels, parts), 6, 16, (3,), 3e-3, shard_rows=shard_rows))
        weights.append(vae.encode(x))
    assert np.allclose(curves[0], curves[1], rtol=1e-6) and np.allclose(weights[0], weights[1], atol=1e-4)
    assert curves[0][-1] < curves[0][0]
    tree = Tree(PARENTS)
    model = LabelPredictor(4, tree, 12, [32], seed=2)
    losses = train_frame(model, frame(spark, x, labels, 3), 12, 32, (), 1e-2, shard_rows=shard_rows)
    assert losses[-1] < 0.7 * losses[0]
    with pytest.raises(ValueError, match="two contigs"):
        train_frame(model, frame(spark, x, labels, 1).limit(1), 1, 8)


def test_one_shard_is_training_in_memory(spark):
    """Epoch by epoch with the same generators the weights are those of training without a table."""
    from sparkmill.models.training import train_frame

    x, kind = inputs()
    own, other = AAE(4, 12, 16, 4, 5, seed=1), AAE(4, 12, 16, 4, 5, seed=1)
    got = train_frame(own, frame(spark, x, kind, 2).drop("label"), 3, 32, (1,), 1e-3, seed=9)
    steps, batch, want = other.steps(1e-3), 32, []
    for epoch in range(3):
        batch *= 1 + (epoch == 1)
        other.reseed([9, epoch, 0])
        want.append(float(np.mean(other.epoch(x, None, batch, steps))))
    assert np.allclose(got, want, rtol=1e-6)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(own.state(), other.state()))


def test_many_shards_are_added_up_in_groups(spark, monkeypatch):
    from sparkmill.models import training

    x, kind = inputs()
    curves = []
    for together in (2, 16):
        monkeypatch.setattr(training, "TOGETHER", together)
        curves.append(training.train_frame(VAE(4, 12, [8], 2, seed=5), frame(spark, x, kind, 3), 2, 16, (), 1e-3, shard_rows=30))
    assert np.allclose(curves[0], curves[1], rtol=1e-6)


def random_parents(rng, n):
    return np.array([-1, *(int(rng.integers(max(0, v - 6), v)) for v in range(1, n))])


def test_intervals_are_what_a_dense_table_of_ancestors_says():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 40):
        tree = Tree(random_parents(rng, n))
        dense = np.eye(n, dtype=bool)
        for v in range(1, n):
            dense[:, v] |= dense[:, tree.parents[v]]
        every = np.arange(n)
        assert (tree.above(every[:, None], every) == dense).all()
        assert tree.n_leaves.tolist() == dense[:, tree.leaves].sum(axis=1).tolist()
        x = rng.random((5, n))
        assert np.allclose(tree.sums(x), x @ dense.T)
        assert [s.tolist() for s in tree.siblings()] == [np.flatnonzero(tree.parents == v).tolist() for v in np.flatnonzero(tree.n_children)]
        if n == 1:
            continue
        labels = rng.integers(0, n, 6)
        cond, flat, margin = (HierarchicalLoss(k, tree) for k in ("cond_softmax", "flat_softmax", "soft_margin"))
        s = rng.normal(size=(6, cond.n_scores))
        lc = np.zeros((6, n))
        for a, b in zip(cond.cuts, cond.cuts[1:]):
            lc[:, cond.order[a:b]] = s[:, a:b] - np.log(np.exp(s[:, a:b]).sum(axis=1, keepdims=True))
        assert np.allclose(cond.loss(s, labels)[0], -(lc * dense[:, labels].T).sum(axis=1))
        assert np.allclose(cond.probabilities(s), np.exp(lc @ dense))
        s = rng.normal(size=(6, flat.n_scores))
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        assert np.allclose(flat.probabilities(s), p @ dense[:, tree.leaves].T)
        assert np.allclose(flat.loss(s, labels)[0], -np.log((p @ dense[:, tree.leaves].T)[np.arange(6), labels]))
        s = rng.normal(size=(6, n))
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        assert np.allclose(margin.probabilities(s), p @ dense.T)


def test_a_tree_of_many_nodes():
    rng = np.random.default_rng(9)
    parents = np.concatenate([[-1], (rng.random(199_999) * np.minimum(np.arange(1, 200_000), 30_000)).astype(np.int64)])
    loss = HierarchicalLoss("cond_softmax", Tree(parents))
    scores = rng.normal(size=(2, loss.n_scores)).astype(np.float32)
    value, grad = loss.loss(scores, np.array([5, 199_999]))
    probs = loss.probabilities(scores)
    assert np.isfinite(value).all() and grad.shape == scores.shape and np.allclose(np.exp(-value), probs[[0, 1], [5, 199_999]], rtol=1e-3)
    assert np.allclose(probs[:, loss.tree.parents == 0].sum(axis=1), 1, rtol=1e-4)
