import numpy as np
import pytest

from sparkmill.llm import embeddings
from test_simhash import plain_components


def plain(rows, least):
    good = {i: np.array(v, np.float64) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= least]
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    return count, plain_components(range(len(rows)), links)


def vectors(seed, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(12):
        c = rng.normal(size=dim)
        out += [(c + rng.normal(size=dim) * s).astype(np.float32).tolist() for s in rng.choice([0.0, 0.02, 0.15, 0.3], 30)]
    tight = rng.normal(size=dim)
    out += [(tight + rng.normal(size=dim) * 1e-3).astype(np.float32).tolist() for _ in range(60)]
    out += [out[3]] * 25 + [[2 * x for x in out[3]], [0.0] * dim, None, [None] * dim, [float("nan")] * dim, [1e-30] * dim, [float("inf")] * dim, [], [1.0, 2.0], [2.0, 4.0], [1e30] * dim]
    return out


@pytest.mark.parametrize(("seed", "block", "leaf"), [(1, 4096, 256), (2, 50, 8), (3, 7, 2)])
def test_links_and_components(spark, seed, block, leaf):
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, links int, root string")
    out = embeddings.near_embeddings(df, block=block).collect()
    count, component = plain(rows, 0.95)
    assert {r.vec_id: (r.links, r.component) for r in out} == {i: (count[i], component[i]) for i in range(len(rows))}


def test_recursion_with_small_leaves(monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(4)
    x = embeddings.unit(np.repeat(rng.normal(size=(9, 6)), 20, axis=0) + rng.normal(size=(180, 6)) * 0.05)
    axes = np.linalg.eigh(np.cov(x.T))[1]
    n = rng.integers(1, 5, 180)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    one = embeddings.Interval(x, n, axes)
    assert (sum(embeddings.join_intervals(one, one, 0.95)[:2]) == near @ n).all()
    a, b = embeddings.Interval(x[:70], n[:70], axes), embeddings.Interval(x[70:], n[70:], axes)
    left, right, _ = embeddings.join_intervals(a, b, 0.95)
    assert (left == near[:70, 70:] @ n[70:]).all() and (right == n[:70] @ near[:70, 70:]).all()


def test_repeated_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    out = embeddings.near_embeddings(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.links, str(r.component)) for r in out) == [("1", 1, "1"), ("1", 1, "1"), ("None", 0, "None")]
    assert embeddings.near_embeddings(spark.createDataFrame([], schema)).collect() == []
