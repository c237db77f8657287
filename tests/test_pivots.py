"""Near points found by pivots, beside all pairs."""

import numpy as np
import pytest

from sparkmill.operators import graph, neighbours, pivots, recluster

SMALL = {"pivots": 9, "block_rows": 40, "together": 10}


def points(seed=1, n=400, dims=16):
    """Tight groups of unlike sizes, a third of all rows one vector, and lone points."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, dims))
    x = centre[rng.integers(0, 9, n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.1, 0.4], size=(n, 1))
    x[::3] = x[0]
    x[5::17] = rng.normal(size=x[5::17].shape)
    return x


def frame(spark, x, genus=None):
    rows = [(i, v.tolist(), 500 + i % 7, None if genus is None else genus[i]) for i, v in enumerate(x)]
    return neighbours.normalised(spark.createDataFrame(rows, "contig_idx long, v array<double>, length int, genus string"))


def plain(x, radius, genus=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(2)
    d = 0.5 - u @ u.T
    ok = np.triu(d <= radius, 1)
    if genus is not None:
        ok &= np.array([[a == b for b in genus] for a in genus])
    return d, ok


@pytest.mark.parametrize("radius", [0.002, 0.05, 0.2])
@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_pairs_equal_all_pairs(spark, radius, sizes):
    x = points()
    genus = [None if i % 4 == 0 else "g%d" % (i % 2) for i in range(len(x))] if sizes else None
    d, ok = plain(x, radius, genus)
    got = {(r.a, r.b): r.distance for r in neighbours.neighbours(frame(spark, x, genus), radius, ("genus",) if sizes else (), **sizes).collect()}
    assert got.keys() == {*zip(*map(lambda k: k.tolist(), np.nonzero(ok)))}
    assert all(abs(d[p] - v) < 1e-12 for p, v in got.items())


def components_of(n, pairs):
    top = list(range(n))
    for a, b in sorted(pairs):
        low, high = sorted((top[a], top[b]))
        top = [low if t == high else t for t in top]
    return top


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_forest_and_sums(spark, sizes):
    x = points(2)
    df = frame(spark, x).cache()
    edges = [(r.a, r.b, r.distance) for r in neighbours.linked(df, 0.1, **sizes).collect()]
    d, ok = plain(x, 0.1)
    assert len(edges) < ok.sum() / 3
    for radius in (0.003, 0.02, 0.1):
        assert components_of(len(x), [(a, b) for a, b, t in edges if t <= radius]) == components_of(len(x), zip(*np.nonzero(plain(x, radius)[1])))
    near = np.where(ok | ok.T, 0.1 - d, 0.0)
    length = np.array([500 + i % 7 for i in range(len(x))])
    want = length * 0.1 + near @ length
    got = {r.contig_idx: r.density for r in neighbours.local_density(df, 0.1, **sizes).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9)
    df.unpersist()


def test_vectors_that_are_near_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [None, 1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "contig_idx long, v array<double>")
    df = neighbours.normalised(df)
    assert sorted({(r.a, r.b) for r in neighbours.neighbours(df, 0.05).collect()}) == [(1, 4)]
    assert neighbours.neighbours(df.limit(0), 0.05).collect() == []
    with pytest.raises(ValueError, match="lengths"):
        neighbours.neighbours(neighbours.normalised(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "contig_idx long, v array<double>")), 0.05)


def formed(spark, x, radius, **sizes):
    """Shares of all pairs whose blocks meet in a task, and whose distance is worked out."""
    rows, basis = pivots.block_pairs(frame(spark, x), radius, **sizes)
    met, tried = 0, []
    table = rows.select("lo", "hi", "block", "id", "v").toPandas()
    for (lo, hi), g in table.groupby(["lo", "hi"]):
        one, two = (np.array(g.v[g.block == k].tolist()).reshape(-1, x.shape[1]) for k in (lo, hi))
        met += len(one) * (len(one) - 1) // 2 if lo == hi else len(one) * len(two)
        if len(one) and len(two):
            list(pivots.near_pairs(one, None if lo == hi else two, radius, basis, tried))
    every = len(x) * (len(x) - 1) / 2
    return met / every, sum(tried) / every


def test_few_pairs_are_formed(spark):
    """Of grouped points few pairs meet; of points without any structure in 64 dimensions few distances are worked out."""
    rng = np.random.default_rng(7)
    grouped = rng.normal(size=(40, 64))[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 64)) * 0.15
    met, tried = formed(spark, grouped, 0.05, pivots=64)
    assert met < 0.2 and tried < 0.1
    loose = rng.normal(size=(1200, 64))
    assert formed(spark, loose, 0.002)[0] < 0.4
    assert formed(spark, loose, 0.05)[1] < 0.1


def test_large_radii_and_many_points_cost_no_more_than_they_must():
    """Where the bound excludes nothing no distance of a far pair is worked out by itself, and a row goes to few blocks however many there are."""
    x = np.random.default_rng(9).normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(2)
    tried = []
    found = sum(len(i) for i, _, _ in pivots.near_pairs(x, None, 0.3, pivots.directions(x[:16]), tried))
    assert found == np.triu(0.5 - x @ x.T <= 0.3, 1).sum() and sum(tried) <= found + 1
    for n in (100_000, 600_000, 1_000_000):
        cells, rows = pivots.division(n)
        assert cells + n / rows <= 64 and rows <= pivots.MOST_BLOCK_ROWS


def plain_choice(scores):
    """The rule by itself: place of the chosen score and how many were looked at."""
    best, at, worse = 0, None, 0
    for k, score in enumerate(scores):
        if best == 0 or score > best:
            best, at = score, k
        if score >= best:
            worse = 0
        else:
            worse += 1
            if worse > 2:
                return at, k + 1
    return at, len(scores)


@pytest.mark.parametrize(("scores", "chosen", "seen"), [([0, 0, 3, 2, 2, 3, 2, 2, 2], 2, 9), ([0] * 17, 16, 17), ([5, 4, 4, 4, 9], 0, 4), ([1, 2, 2, 1, 1, 3], 5, 6)])
def test_the_choice_of_a_radius(scores, chosen, seen):
    asked = []
    levels = ((r, k, True) for k, r in enumerate(recluster.RADII[: len(scores)]))
    found, radius = recluster.best_level(levels, lambda k: (asked.append(k), scores[k])[1])
    assert (found, radius, len(asked)) == (chosen, recluster.RADII[chosen], seen)
    assert plain_choice(scores) == (chosen, seen)


def test_all_radii_from_one_comparison(spark):
    """Every level has the density clusters of its radius, and the chosen one is that of a walk over all radii."""
    x = points(3, 160, 8)
    genus = ["g%d" % (i % 2) if i % 5 else None for i in range(len(x))]
    df = graph.stored(frame(spark, x, genus))
    rng = np.random.default_rng(1)
    markers = {(i, int(m)) for i in range(len(x)) for m in rng.integers(0, 6, 3)}
    every, scores = [], []
    for radius in recluster.RADII:
        own = components_of(len(x), zip(*np.nonzero(plain(x, radius / 2, genus)[1])))
        every.append(own)
        good = 0
        for c in set(own):
            counts = [sum((i, m) in markers for i in range(len(x)) if own[i] == c) for m in range(6)]
            unique = sum(n > 0 for n in counts)
            good += unique / 6 >= 0.75 and (sum(counts) - unique) / 6 <= 0.3
        scores.append(good)
    levels = [(r, {p.contig_idx: p.cluster for p in f.collect()}) for r, f, _ in recluster.density_levels(df, recluster.RADII)]
    assert [r for r, _ in levels] == [*recluster.RADII]
    for own, (_, found) in zip(every, levels):
        assert [found[i] for i in range(len(x))] == own
    table = spark.createDataFrame(sorted(markers), "contig_idx long, marker int")
    found, radius = recluster.recluster_density(df, table, 6)
    k = plain_choice(scores)[0]
    assert radius == recluster.RADII[k]
    assert [c for _, c in sorted((r.contig_idx, r.cluster) for r in found.collect())] == every[k]
