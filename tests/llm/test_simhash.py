import random
import re

import numpy as np
import pytest
import xxhash

from sparkmill.llm import simhash
from sparkmill.llm.graph import components


def plain_fingerprint(text, k=4):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))] if ws else []
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(nodes, links):
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def plain_classes(fps, distance=4):
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= distance]
    return plain_components(ids, links)


@pytest.mark.parametrize("text", ["", " \t", "One", "A b C", "a b c d", "É é x Ü " * 9, "the cat sat on the mat " * 40, "x\x0by\x0cz w v u"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize(("m", "hot"), [(2, 20_000), (3, 20_000), (4, 20_000), (3, 3)])
def test_near_links_find_every_pair(spark, m, hot):
    rng = random.Random(m)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    fps = {}
    for s in seeds:
        x = s
        for _ in range(12):
            fps[len(fps)] = x
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
    rows = [(x, [x]) for x in {int(np.uint64(x).view(np.int64)) for x in fps.values()}]
    edges = simhash.near_links(spark.createDataFrame(rows, "node long, fps array<long>"), 4, m, hot=hot)
    to_id = {int(np.uint64(x).view(np.int64)): i for i, x in sorted(fps.items(), reverse=True)}
    links = [(to_id[r.u], to_id[r.v]) for r in edges.collect()] + [(i, to_id[int(np.uint64(x).view(np.int64))]) for i, x in fps.items()]
    assert plain_components(fps, links) == plain_classes(fps)


def test_hot_segments_are_cut_in_blocks(spark):
    """Fingerprints that share all but a few bits of two segments: one value is held by all."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, dtype=np.int64)
    flips = np.array([1 << int(b) for b in range(24, 60)], np.int64)
    fps = np.unique(np.concatenate([[centre ^ a ^ b for a in flips for b in flips], rng.integers(0, 2**20, 500) | (1 << 40)]))
    every = np.arange(len(fps))
    brute = dict(zip(*[x.tolist() for x in simhash.Nodes(fps, fps, 4).close(every, every)]))
    nodes = spark.createDataFrame([(x, [x]) for x in fps.tolist()], "node long, fps array<long>")
    for hot in (100, 20_000):
        if hot == 100:
            assert simhash.hot_keys(nodes, 1, 3, hot).count() > 0
        found = {r.node: r.root for r in components(simhash.near_links(nodes, 4, 3, hot=hot)).collect()}
        assert {k: v for k, v in found.items() if k != v} == brute


def test_wide_fingerprints_are_of_the_set(spark):
    t = b"a b c d a b c d e f"
    assert simhash.wide_fingerprint(t, 2, 4) == simhash.wide_fingerprint(b"A b  c d a\tb c d a b c d e f", 2, 4)
    assert len(set(simhash.wide_fingerprint(t, 2, 4))) == 4 and simhash.wide_fingerprint(b"", 2, 2) == [0, 0]


def test_classes(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(500)]
    texts = {i: " ".join(rng.choices(vocabulary, k=300)) for i in range(20)}
    for i in range(20, 60):
        ws = texts[i % 10].split()
        ws[rng.randrange(300)] = "changed"
        texts[i] = " ".join(ws)
    texts |= {60: None, 61: "", 62: " \n", 63: "Hi", 64: "hi", 65: texts[3]}
    rows = [(i, t, 1, 2) for i, t in texts.items()] + [(5, texts[5], 1, 2), (None, "only here", 1, 2)]
    out = simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string, fp int, component int")).collect()
    assert len(out) == len(rows)
    expected = plain_classes({i: plain_fingerprint(t) for i, t in texts.items()})
    for r in out:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == plain_fingerprint(texts[r.doc_id])
            assert r.component == expected[r.doc_id]
    assert [r.component for r in out if r.doc_id is None] == [None]
    assert simhash.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_go(spark):
    rng = random.Random(6)
    texts = [" ".join("w%d" % rng.randrange(4000) for _ in range(400)) for _ in range(30)]
    copies = []
    for t in texts[:20]:
        ws = t.split()
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(400)] = "new"
        copies.append(" ".join(ws))
    rows = [*enumerate(texts), *[(100 + i, t) for i, t in enumerate(copies)], (25, texts[25]), (200, "short"), (201, "Short"), (202, None), (None, "alone"), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component int")
    out = simhash.drop_near_copies(docs, shingle=1, distance=7)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect() if r.doc_id is not None))
    assert ids == [*range(30), 200, 202]
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bound", [0, 1000])
def test_components(spark, bound):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7), (0, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), bound).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert found == plain_components(nodes, [e for e in edges if e[0] != e[1]])
