import hashlib
import math

import numpy as np
import pytest

from sparkmill.llm import centroids


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    """The definition, with Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in kept[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [[] for _ in middle]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, middle)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = [sum(d for _, d, j in found if j == c) for c in range(len(middle))]
    return sorted((str(i), j, d, per[j], sum(per), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, d, j in found)


def got(out):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string, id int").repartition(5)


@pytest.mark.parametrize("groups", [1, 3, 8])
def test_equals_the_definition(spark, groups):
    rng = np.random.default_rng(groups)
    x = rng.normal(size=(6, 64))[rng.integers(0, 6, 260)] + rng.normal(size=(260, 64)) * 0.6
    rows = [(i, v) for i, v in enumerate(np.float32(x).astype(float).tolist())]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [None, *[0.0] * 63]), (304, [float("nan"), *[1.0] * 63]), (305, [float("inf"), *[1.0] * 63]), (306, [0.0] * 64), (None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1])]
    assert got(centroids.centroid_clusters(frame(spark, rows), groups=groups)) == plain(rows)


def test_ties_and_empty_centroids(spark):
    """Few distinct whole numbers: equal distances throughout, and equal first centroids of which the later stay empty."""
    rng = np.random.default_rng(5)
    rows = [(i, [*(rng.integers(-1, 2, 2) / 1024).tolist(), *[0.0] * 62]) for i in range(200)]
    out = got(centroids.centroid_clusters(frame(spark, rows)))
    assert out == plain(rows)
    assert len({r[1] for r in out}) < 8


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert got(centroids.centroid_clusters(frame(spark, rows))) == plain(rows)
    assert centroids.centroid_clusters(frame(spark, [(1, None), (2, [1.0])])).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.centroid_clusters(frame(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_hold_and_spare_distances(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 0.15)).astype(np.int64)
    middle, scanned = x[:8].copy(), []
    exact = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda rows, c: (scanned.append(len(rows)), exact(rows, c))[1])
    group = centroids.grouped(middle, 3)
    best, upper, lower = centroids.scan_all(x, middle, group)
    for step in range(8):
        new = np.array([x[best == c].sum(axis=0) // max(1, (best == c).sum()) if (best == c).any() else middle[c] for c in range(8)])
        drift = np.sqrt(((new - middle) ** 2).sum(axis=1).astype(float)) * (1 + centroids.SLACK)
        middle = new
        scanned.clear()
        best, upper, lower = centroids.moved_on(x, best, upper, lower, middle, group, drift)
        d = ((x[:, None] - middle[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all()
        root = np.sqrt(d.astype(float))
        assert (root[np.arange(4000), best] <= upper).all()
        root[np.arange(4000), best] = np.inf
        for g in range(group.max() + 1):
            assert (root[:, group == g].min(axis=1, initial=np.inf) >= lower[:, g]).all()
    assert sum(scanned) < 0.5 * 8 * 4000
