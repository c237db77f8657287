import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmill.functions import vectors
from sparkmill.operators import abundance, bins, clustering, composition, features, graph, markers, neighbours, recluster, taxonomy


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def naive_four_mers(seq):
    out = np.zeros(256, int)
    for i in range(len(seq) - 3):
        w = seq[i : i + 4].upper()
        if set(w) <= set("ACGT"):
            out[sum("ACGT".index(c) * 4 ** (3 - k) for k, c in enumerate(w))] += 1
    return out


def test_four_mers(spark):
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("acgtACGTnNyw"), size=n, p=[0.11] * 8 + [0.03] * 4)) for n in (0, 3, 4, 5, 500, 2000)]
    got = composition.kmer_vectors(spark.createDataFrame(list(enumerate(seqs)), "contig_idx long, seq string")).collect()
    for r in got:
        assert r.counts == naive_four_mers(seqs[r.contig_idx]).tolist()


def test_kernel():
    k = composition.kernel()
    assert k.shape == (256, 103) and np.allclose(k.T @ k, np.eye(103))
    assert np.allclose(k.sum(axis=0), 0)
    names = composition.FOUR_MERS
    turn = [names.index(n.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for n in names]
    assert np.allclose(k, k[turn])
    for three in {n[:3] for n in names}:
        assert np.allclose(sum(k[names.index(three + c)] - k[names.index(c + three)] for c in "ACGT"), 0)
    assert composition.project(np.zeros((1, 256))).shape == (1, 103)


def test_composition(spark):
    df = spark.createDataFrame([(0, "ACGTACGTTTGA" * 20), (1, "NNNN")], "contig_idx long, seq string")
    v = composition.kmer_vectors(df)
    (r,) = composition.composition(v.where("contig_idx = 0")).collect()
    assert np.allclose(r.tnf, composition.project(np.array([naive_four_mers("ACGTACGTTTGA" * 20)]))[0], atol=1e-3)
    assert (np.array(r.tnf, np.float32).view(np.uint32) & 0xFFF == 0).all()
    with pytest.raises(Exception, match="no 4-mer"):
        composition.composition(v).collect()


@pytest.mark.parametrize("bits", [0, 5, 23])
def test_mask(spark, bits):
    x = np.random.default_rng(1).normal(size=50).astype(np.float32)
    y = vectors.masked(x, bits)
    assert (y.view(np.uint32) & ((1 << bits) - 1) == 0).all() and np.allclose(x, y, rtol=2.0 ** (bits - 23))
    (r,) = spark.createDataFrame([(x.tolist(),)], "v array<float>").select(vectors.mask_lower_bits(F.col("v"), bits)).collect()
    assert r[0] == y.tolist()
    with pytest.raises(ValueError):
        vectors.masked(x, 24)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.half_unit(F.col("a")), vectors.half_unit(F.col("b")), vectors.softmax(F.col("a")), vectors.cosine_distance(F.col("a"), F.col("a")), vectors.first_max(F.col("a")), vectors.one_hot(F.lit(1), 3), vectors.leaky_relu(F.lit(-2.0)), vectors.sigmoid(F.lit(0.0))).first()
    assert np.allclose(r[0], np.array([1, 2, 2]) / 3 / np.sqrt(2)) and np.allclose(r[1], np.full(3, 1 / np.sqrt(6)))
    assert np.allclose(r[2], np.exp([1, 2, 2]) / np.exp([1, 2, 2]).sum()) and abs(r[3]) < 1e-12
    assert tuple(r)[4:] == (2, [0, 1, 0], -0.02, 0.5)


def test_zscore_of_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert rows(vectors.zscored(df, "x", ["g"]), "g", "z") == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]


def test_abundance(spark):
    depths = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 4.0), (1, 1, 3.0)], "contig_idx long, sample int, depth double")
    ids = spark.createDataFrame([(0,), (1,), (2,)], "contig_idx long")
    full = abundance.filled(depths, ids, [0, 1])
    got = {(r.contig_idx, r["sample"]): r for r in abundance.scaled(full, 2).collect()}
    assert got[0, 1].depth == 250_000 and got[1, 1].total == 1_250_000 and got[2, 0].share == 0.5
    assert got[0, 0].share == pytest.approx(500 / 750)
    with pytest.raises(Exception, match="zero depth"):
        abundance.scaled(abundance.filled(depths, ids, [0, 1, 2]), 3).collect()
    per_base = spark.createDataFrame([(1, float(x)) for x in [100, 0, *range(1, 9)]], "contig_idx long, depth double")
    assert rows(abundance.trimmed_mean(per_base), "contig_idx", "depth") == [(1, 4.5)]


def test_features(spark):
    rng = np.random.default_rng(2)
    n, s = 30, 3
    depth, tnf, length = rng.uniform(0, 9, (n, s)), rng.normal(size=(n, 5)).astype(np.float32), rng.integers(250, 9000, n)
    long = [(i, j, float(depth[i, j])) for i in range(n) for j in range(s)]
    out = features.features(spark.createDataFrame([(i, int(x)) for i, x in enumerate(length)], "contig_idx long, length int"), spark.createDataFrame(long, "contig_idx long, sample int, depth double"), spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tnf)], "contig_idx long, tnf array<float>"), s, 5)
    got = sorted(out.collect(), key=lambda r: r.contig_idx)
    d = depth * 1e6 / depth.sum(axis=0)
    t = np.log(np.maximum(d.sum(axis=1), 0.001))
    w = np.maximum(np.log(length) - 5, 2)
    assert np.allclose([r.depths for r in got], d / d.sum(axis=1, keepdims=True), atol=1e-6)
    assert np.allclose([r.tnf for r in got], (tnf - tnf.mean(axis=0)) / tnf.std(axis=0), atol=1e-5)
    assert np.allclose([r.total_ab for r in got], (t - t.mean()) / t.std(), atol=1e-5)
    assert np.allclose([r.weight for r in got], w * n / w.sum(), atol=1e-5)


def test_neighbours_within_groups(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    g = [None if i % 3 == 0 else "g%d" % (i % 3) for i in range(150)]
    df = spark.createDataFrame([(i, v.tolist(), g[i]) for i, v in enumerate(x)], "contig_idx long, v array<double>, genus string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(2)
    d = 0.5 - u @ u.T
    want = sorted((i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.2 and g[i] == g[j])
    got = neighbours.neighbours(neighbours.normalised(df), 0.2, ("genus",))
    assert rows(got, "a", "b") == want


def partition(rows):
    """Members by cluster, whatever the clusters' names."""
    out = {}
    for k, m in rows:
        out.setdefault(k, set()).add(m)
    return sorted(map(sorted, out.values()))


def loose_points(seed, n=260, dims=64):
    """Groups of unlike width, some of which run into each other, copies and lone points."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dims))
    centre[6:] = centre[:6] + rng.normal(size=(6, dims)) * 0.35
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.1, 0.2, 0.3], size=(n, 1))
    x[::9], x[4::13] = x[0], rng.normal(size=x[4::13].shape)
    return x, rng.integers(5, 12, n) * 100


@pytest.mark.parametrize(("seed", "dims", "seeds", "options"), [(1, 32, 32, {}), (2, 3, 9, {"window": 4, "min_successes": 3, "max_steps": 3, "seed": 4})])
def test_medoid_clusters_in_rounds(spark, seed, dims, seeds, options):
    """Over a distributed table the clusters, their medoids, radii and order are those of the sequential clusterer."""
    x, lengths = loose_points(seed, 40 if dims > 3 else 18, dims)
    ids = np.arange(len(x)) * 3 + 5
    df = spark.createDataFrame([(int(i), v.tolist(), int(n)) for i, v, n in zip(ids, x, lengths)], "contig_idx long, v array<double>, length int").repartition(5)
    found = list(clustering.MedoidClusterer(x, lengths, ids=ids, **options))
    assert len({c.kind for c in found}) >= 2 and (not options or found[-1].allowed_pvr > clustering.FIRST_PVR)
    got = {}
    for r in clustering.clusters_in_rounds(neighbours.normalised(df), seeds=seeds, **options).collect():
        got.setdefault((r.batch, r.turn), []).append(r)
    own = [(sorted(r.contig_idx for r in g), g[0].medoid, g[0].kind, g[0].radius) for _, g in sorted(got.items())]
    assert own == [(sorted(ids[c.members].tolist()), int(ids[c.medoid]), c.kind, c.radius) for c in found]


def test_medoid_clusters_of_many_groups_take_few_rounds(spark):
    """Clusters whose histograms overlap but whose walks don't are found in the same round, as the sequential clusterer finds them."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(16, 24)), 4, axis=0) + rng.normal(size=(64, 24)) * 0.1, rng.normal(size=(16, 24))])
    lengths = rng.integers(5, 12, len(x)) * 100
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, lengths))], "contig_idx long, v array<double>, length int")
    found = list(clustering.MedoidClusterer(x, lengths))
    rows = clustering.clusters_in_rounds(neighbours.normalised(df)).collect()
    got = {}
    for r in rows:
        got.setdefault((r.batch, r.turn), []).append(r)
    assert [(sorted(r.contig_idx for r in g), g[0].medoid, g[0].kind) for _, g in sorted(got.items())] == [(sorted(c.members.tolist()), c.medoid, c.kind) for c in found]
    assert sum(c.kind == "normal" for c in found) >= 10 and max(r.batch for r in rows) <= 3


def test_medoid_clusters_of_far_groups_take_one_round(spark):
    """Groups in each other's histograms, of several seeds each, whose clusters take nothing of one another are all found in the first round."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(14, 12)), 3, axis=0) + rng.normal(size=(42, 12)) * 0.05, rng.normal(size=(20, 12))])
    lengths = rng.integers(5, 12, len(x)) * 100
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, lengths))], "contig_idx long, v array<double>, length int")
    found = list(clustering.MedoidClusterer(x, lengths))
    got = {}
    for r in clustering.clusters_in_rounds(neighbours.normalised(df)).collect():
        got.setdefault((r.batch, r.turn), []).append(r)
    assert [(sorted(r.contig_idx for r in g), g[0].medoid, g[0].kind, g[0].radius) for _, g in sorted(got.items())] == [(sorted(c.members.tolist()), c.medoid, c.kind, c.radius) for c in found]
    assert {batch for (batch, _), g in got.items() if g[0].kind == "normal"} == {0} and sum(c.kind == "normal" for c in found) >= 10


@pytest.mark.parametrize(("rows", "most", "noise"), [(40, 0.25, 0.9), (40, 0.9, 0.9), (500, 0.25, 0.05), (16, 0.6, 1.2)])
def test_components_within(spark, monkeypatch, rows, most, noise):
    """Around a sample, whole products and pivots give the components of brute force; copies, and rows without a finite vector, too."""
    from sparkmill.operators import linkage

    rng = np.random.default_rng(rows)
    x = np.repeat(rng.normal(size=(3, 10)), [200, 30, 20], axis=0) + rng.normal(size=(250, 10)) * noise
    x[::25] = x[1]
    u = x / np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(2)
    monkeypatch.setattr(linkage, "SAMPLE_ROWS", rows)
    monkeypatch.setattr(linkage, "SPARSE", most)
    df = spark.createDataFrame([(i * 7 + 3, v.tolist()) for i, v in enumerate(u)] + [(1, None), (2, [float("nan")] * 10)], "contig_idx long, v array<double>")
    for radius in (0.1, 0.2):
        near = 0.5 - u @ u.T <= radius
        label = np.arange(250)
        while (label != (low := np.where(near, label, 250).min(axis=1))).any():
            label = low
        want = {i * 7 + 3: int(c) * 7 + 3 for i, c in enumerate(label)} | {1: 1, 2: 2}
        got = linkage.components_within(df, radius, few=0).collect()
        assert len(got) == 252 and {r.node: r.component for r in got} == want
    assert linkage.components_within(df.limit(0), 0.1, few=0).collect() == []


def test_medoid_clusters_of_large_and_small_parts(spark):
    x, lengths = loose_points(3, 24, 32)
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, lengths))], "contig_idx long, v array<double>, length int")
    one, two = (partition((r.cluster, r.contig_idx) for r in clustering.medoid_clusters(df, part_rows=n).collect()) for n in (4, 10_000))
    assert one == two and sum(map(len, one)) == 24
    assert clustering.medoid_clusters(df.limit(0)).collect() == []


def test_valley_as_a_walk():
    """The same threshold as going over the densities one by one."""
    rng = np.random.default_rng(4)

    def walk(density, ratio):
        top, top_at, low, low_at, stage = 0.0, 0, None, None, "rise"
        for i, d in enumerate(density):
            if stage == "rise":
                if d > top:
                    top, top_at = d, i
                elif d < 0.6 * top:
                    stage, low, low_at = "fall", d, None
                continue
            if d > 1.5 * low:
                break
            if d < low:
                low, low_at = d, i
        if stage == "rise" or top_at > 20 or low_at is None or low >= ratio * top or low_at * 0.005 > 0.2 + ratio:
            return None
        return low_at * 0.005, low / top

    seen = 0
    for _ in range(400):
        density = np.abs(np.convolve(rng.normal(size=60) * rng.choice([0, 1, 3], 60) + rng.choice([0, 4]) * (np.arange(60) < 9), np.ones(5), "same")) + rng.choice([0.0, 0.01])
        for ratio in (0.1, 0.3, 0.6):
            want, got = walk(density.tolist(), ratio), clustering.valley(density, ratio)
            assert (want is None) == (got is None) and (want is None or got == pytest.approx(want))
            seen += want is not None
    assert seen > 50


def test_medoid_clustering(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    x = np.vstack([c + rng.normal(size=(60, 12)) * 0.08 for c in centres] + [rng.normal(size=(20, 12))])
    lengths = rng.integers(500, 1000, len(x))
    found = list(clustering.MedoidClusterer(x, lengths))
    members = np.concatenate([c.members for c in found])
    assert sorted(members.tolist()) == list(range(len(x)))
    u = x / np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(2)
    for c in found:
        assert c.medoid in c.members and c.kind in ("normal", "loner", "fallback")
        assert (c.radius is None) == (c.kind == "loner")
        if c.radius:
            assert (0.5 - u[c.members] @ u[c.medoid] <= c.radius + 1e-9).all()
    big = [c for c in found if len(c.members) > 40]
    assert len(big) == 6 and all(len({int(m) // 60 for m in c.members}) == 1 for c in big)
    df = spark.createDataFrame([(i + 7, v.tolist(), int(n), "ab"[i % 2]) for i, (v, n) in enumerate(zip(x, lengths))], "contig_idx long, v array<double>, length int, sample string")
    named = list(clustering.MedoidClusterer(x, lengths, ids=np.arange(len(x)) + 7))
    one = clustering.medoid_clusters(df).collect()
    assert {r.cluster for r in one} == set(range(1, len(named) + 1))
    assert partition((r.cluster, r.contig_idx - 7) for r in one) == partition((k, int(m)) for k, c in enumerate(named) for m in c.members)
    parts = clustering.medoid_clusters(df, by="sample")
    assert parts.count() == len(x) and set(parts.columns) >= {"sample", "cluster"}


@pytest.mark.parametrize("bad", [{"max_steps": 0}, {"window": 0}, {"min_successes": 0}, {"min_successes": 400}])
def test_clusterer_refuses(bad):
    with pytest.raises(ValueError):
        clustering.MedoidClusterer(np.ones((3, 2)), np.ones(3), **bad)


def test_clusterer_of_odd_points():
    assert list(clustering.MedoidClusterer(np.zeros((0, 3)), np.zeros(0))) == []
    found = list(clustering.MedoidClusterer(np.array([[0.0, 0], [1, 1], [2, 2], [-1, 0]]), np.array([5, 6, 7, 8])))
    assert sorted(m for c in found for m in c.members.tolist()) == [0, 1, 2, 3]


def test_valley():
    d = np.zeros(60)
    d[:10], d[10:20], d[20:30] = 10, np.linspace(5, 0.1, 10), 8
    cut, ratio = clustering.valley(d, 0.1)
    assert cut == pytest.approx(19 * 0.005) and ratio == pytest.approx(0.01)
    assert clustering.valley(d, 0.005) is None
    assert clustering.valley(np.linspace(0, 1, 60), 0.1) is None
    assert clustering.valley(np.full(60, 3.0), 0.1) is None


def test_kmeans_splits(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(20, 3)) * 0.1, rng.normal(size=(20, 3)) * 0.1 + 5])
    latent = spark.createDataFrame([(i, v.tolist(), 1000 + i) for i, v in enumerate(x)], "contig_idx long, v array<double>, length int")
    members = spark.createDataFrame([("one", i) for i in range(40)], "cluster string, contig_idx long")
    found = spark.createDataFrame([(0, 1), (25, 1), (1, 2), (30, 2), (2, 3)], "contig_idx long, marker int")
    out = recluster.recluster_kmeans(members, latent, found, 3).collect()
    assert len({r.part for r in out}) == 2
    assert len({(r.contig_idx < 20, r.part) for r in out}) == 2


def test_density_clusters(spark):
    x = [([1.0, 0.0], "g"), ([1.0, 0.01], "g"), ([0.0, 1.0], "g"), ([1.0, 0.0], "h"), ([0.01, 1.0], None), ([0.0, 1.0], None)]
    points = neighbours.normalised(spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(x)], "contig_idx long, v array<double>, genus string"))
    assert rows(recluster.density_clusters(points, 0.05), "contig_idx", "cluster") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 4)]
    found = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 2)], "contig_idx long, marker int")
    got, radius = recluster.recluster_density(points.drop("v").join(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(x)], "contig_idx long, v array<double>"), "contig_idx"), found, 2)
    assert radius in recluster.RADII and got.count() == 6 and len(recluster.RADII) == 17


def test_markers(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "cluster string, contig_idx long")
    found = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 10)], "contig_idx long, marker int")
    counts = markers.marker_counts(members, found)
    q = markers.bin_quality(members, counts, 4)
    assert rows(q, "cluster", "n_unique", "n_total", "completeness", "contamination") == [("a", 2, 4, 0.5, 0.5), ("b", 1, 1, 0.25, 0.0), ("c", 0, 0, 0.0, 0.0)]
    assert rows(markers.upper_median(members, counts, 4), "cluster", "median") == [("a", 2), ("b", 0), ("c", 0)]
    assert rows(markers.upper_median(members, counts, 3), "cluster", "median") == [("a", 2), ("b", 0), ("c", 0)]
    assert markers.good_genomes(q, 0.25, 0.1).first()[0] == 1


def test_overlap_and_dereplication(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 2), ("d", 9), ("e", 9), ("e", 8)], "bin string, contig_idx long")
    lengths = spark.createDataFrame([(1, 100), (2, 300), (8, 5000), (9, 1)], "contig_idx long, length int")
    pairs = bins.overlaps(members, lengths)
    assert rows(pairs, "a", "b", "shared_bp", "weight") == [("a", "b", 400, 1.0), ("a", "c", 300, 1.0), ("b", "c", 300, 1.0), ("d", "e", 1, 1.0)]
    quality = spark.createDataFrame([("a", 90.0, 1.0), ("b", 90.0, 2.0), ("c", 50.0, 0.0), ("d", 10.0, 0.0), ("e", 10.0, 0.0)], "bin string, completeness double, contamination double")
    wb = bins.worse_better(pairs, quality)
    assert rows(wb, "worse", "better") == [("b", "a"), ("c", "a"), ("c", "b"), ("d", "e")]
    assert rows(bins.dereplicated(wb), "bin") == [("b",), ("c",), ("d",)]
    assert rows(bins.ripped(members, pairs.where("a = 'a' and b = 'c'")), "bin", "contig_idx") == [("a--c", 1)]
    bp = bins.sizes(members.withColumnRenamed("bin", "cluster"), lengths).select(F.col("cluster").alias("bin"), "bp")
    weak = pairs.withColumn("weight", F.when(F.col("a") == "d", 0.0005).otherwise(F.col("weight")))
    assert rows(bins.weak_edges_cut(members, weak, bp).where("bin in ('d', 'e')"), "bin", "contig_idx") == [("d", 9), ("e", 8)]
    left = bins.pairs_only(pairs.join(graph.components(pairs).withColumnRenamed("node", "a"), "a"))
    assert len(rows(left, "a", "b")) == 2


@pytest.mark.parametrize("bound", [0, 1000])
def test_components(spark, bound):
    rng = np.random.default_rng(8)
    order = rng.permutation(200) + 1000
    path = spark.createDataFrame([(int(x), int(y)) for x, y in zip(order, order[1:])], "a long, b long")
    assert {r.component for r in graph.components(path, one_task_edges=bound).collect()} == {1000}
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)], "a long, b long")
    nodes = spark.createDataFrame([(99,), (3,)], "node long")
    got = dict(rows(graph.components(edges, nodes, one_task_edges=bound), "node", "component"))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 60, 99: 99}


def test_taxonomy(spark):
    t = spark.createDataFrame([(0, ["b", "f1", "g1"]), (1, ["b", "f1"]), (2, []), (3, ["b", "f2", "g2"])], "contig_idx long, ranks array<string>")
    tree = taxonomy.tree(taxonomy.edges(t))
    assert rows(tree, "node", "name", "parent") == [(0, "root", None), (1, "b", "root"), (2, "f1", "b"), (3, "f2", "b"), (4, "g1", "f1"), (5, "g2", "f2")]
    assert rows(taxonomy.targets(t), "contig_idx", "target") == [(0, "g1"), (1, "f1"), (2, "root"), (3, "g2")]
    p = taxonomy.leaf_probability(taxonomy.tree_statistics(tree), tree)
    assert rows(p, "name", "uniform_leaf", "uniform_cond")[1] == ("f1", 0.5, 0.5)
    odd = spark.createDataFrame([(0, ["b", "x"]), (1, ["c", "x"])], "contig_idx long, ranks array<string>")
    assert rows(taxonomy.ambiguous_ranks(odd), "name") == [("x",)]
    contigs = spark.createDataFrame([(0, "n0"), (1, "n1")], "contig_idx long, name string")
    table = spark.createDataFrame([("n0", ["b"]), ("other", ["c"])], "name string, ranks array<string>")
    with pytest.raises(Exception, match="not annotated: n1"):
        taxonomy.annotate(contigs, table).collect()
    assert rows(taxonomy.annotate(contigs, table, lenient=True), "contig_idx", "ranks") == [(0, ["b"]), (1, None)]
    with pytest.raises(Exception, match="annotated twice: n0"):
        taxonomy.annotate(contigs, table.union(table)).collect()
    probs = spark.createDataFrame([(1, "g1", 0.6), (1, "g2", 0.4)], "contig_idx long, name string, prob double")
    up = taxonomy.rolled_up(probs, tree)
    (r,) = taxonomy.predictions(up, 0.5).collect()
    assert r.ranks == ["b", "f1", "g1"] and r.probs == [1.0, 0.6, 0.6]
    assert rows(taxonomy.plurality_threshold(up, tree), "threshold") == [(0.4,)]


def test_split_needs_a_sample(spark):
    df = spark.createDataFrame([("1", "s1-c1"), ("1", "s8-c1"), ("2", "s12-c0")], "cluster string, name string")
    assert rows(bins.split_by_sample(df, "-"), "bin") == [("s1-1",), ("s12-2",), ("s8-1",)]
    with pytest.raises(Exception, match="no sample"):
        bins.split_by_sample(df, "x").collect()


def test_final_bins(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "bin string, contig_idx long")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    q = "bin string, completeness double, contamination double"
    original = spark.createDataFrame([("a", 99.0, 0.0), ("b", 99.0, 0.0), ("c", 50.0, 0.0)], q)
    after = spark.createDataFrame([("a--b", 95.0, 0.0), ("b--a", 92.0, 0.0)], q)
    assert rows(bins.final_bins(members, pairs, original, after), "bin", "contig_idx") == [("a", 1), ("b", 2), ("b", 3)]
    assert rows(bins.pair_scores(after), "a", "b", "score_ab", "score_ba") == [("a", "b", 95.0, 92.0)]
    named = members.withColumn("name", F.concat(F.lit("S1C"), F.col("contig_idx").cast("string")))
    assert rows(bins.quality_report(named, original, "C"), "bin", "sample", "n_contigs") == [("a", "S1", 2), ("b", "S1", 2), ("c", "S1", 1)]


def test_tree_from_pairs(spark):
    good = spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "c")], "parent string, child string")
    assert rows(taxonomy.tree_from_pairs(good), "child", "depth") == [("a", 1), ("b", 2), ("c", 1)]
    with pytest.raises(ValueError, match="multiple parents"):
        taxonomy.tree_from_pairs(good.union(spark.createDataFrame([("c", "b")], "parent string, child string")))
    t = taxonomy.tree(taxonomy.edges(spark.createDataFrame([(["b", "x"],)], "ranks array<string>")))
    assert taxonomy.format_tree(t) == "root\n  b\n    x"


def test_kmeans_takes_many_clusters_in_a_task():
    """Clusters that come together, their rows in any order, are split like each by itself."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for c in range(12):
        n = int(rng.integers(3, 30))
        x, length, seed = rng.normal(size=(n, 2)), rng.integers(1, 9, n), np.arange(n) < 2
        part = recluster.lloyd(x, length.astype(float), x[seed].copy())
        for i in range(n):
            rows.append({"cluster": c, "contig_idx": c * 100 + i, "v": x[i].tolist(), "length": int(length[i]), "is_seed": bool(seed[i])})
            want[c * 100 + i] = (c, int(part[i]))
    table = pa.Table.from_pylist(rows)
    got = recluster._split(table.take(rng.permutation(table.num_rows))).to_pylist()
    assert {r["contig_idx"]: (r["cluster"], r["part"]) for r in got} == want
