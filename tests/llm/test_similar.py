import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparkmill.llm import similar  # noqa: E402


def shingles(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def near(a, b):
    a, b = shingles(a), shingles(b)
    return 10 * len(a & b) >= 8 * len(a | b)


def changed(rng, text, places):
    ws = text.split()
    for i in rng.sample(range(len(ws)), places):
        ws[i] = "new%d" % rng.randrange(10**9)
    return " ".join(ws)


def plain_kept(texts):
    ids = sorted(texts)
    top = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and near(texts[i], texts[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return {i for i in ids if top[i] == i}


@pytest.mark.parametrize("together", [similar.TOGETHER, 3])
def test_near_copies_are_those_of_similarity_four_fifths(spark, together):
    rng = random.Random(20)
    words = ["w%d" % i for i in range(4000)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([60, 300, 500]))) for i in range(40)}
    for i in range(40, 200):  # from hardly changed to a similarity of about 0.6
        base = texts[i % 40]
        texts[i] = changed(rng, base, max(1, round(len(base.split()) * rng.uniform(0, 0.055))))
    texts |= {200: "a b", 201: "A  b", 202: "", 203: " \n", 204: "a b c"}
    shared = [near(texts[i], texts[i % 40]) for i in range(40, 200)]
    assert 40 < sum(shared) < 120
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    out = corpus_pipeline.near_copies(spark, docs, "") if together == similar.TOGETHER else similar.drop_similar(docs, together=together)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == plain_kept(texts)


def test_recall_of_pairs_at_the_threshold(spark):
    """Copies with scattered changes and with one block cut out, all of a similarity from 0.8 to 0.85: most pairs are found, by the one setting that there is."""
    rng = random.Random(22)
    words = ["w%d" % int(3000 * rng.random() ** 2) for _ in range(20_000)]
    rows, kinds = [], {}
    while len(kinds) < 400:
        base = rng.choices(words, k=rng.choice([150, 400, 900]))
        if len(kinds) % 2:
            other = changed(rng, " ".join(base), round(len(base) * rng.uniform(0.017, 0.022)))
        else:
            n = round(len(base) * rng.uniform(0.15, 0.2))
            at = rng.randrange(len(base) - n)
            other = " ".join(base[:at] + base[at + n :])
        if near(" ".join(base), other):
            kinds[len(rows)] = len(kinds) % 2
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, other)]
    found = {r.doc_id: r.component for r in similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {k: sum(found[i + 1] == i for i in kinds if kinds[i] == k) / sum(x == k for x in kinds.values()) for k in (0, 1)}
    assert share[1] >= 0.98 and share[0] >= 0.9, share


def test_ids_that_repeat_or_are_null(spark):
    rng = random.Random(21)
    a, b, c = (" ".join("w%d" % rng.randrange(4000) for _ in range(200)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, changed(rng, b, 1)), (None, c), (None, changed(rng, c, 1)), (None, changed(rng, a, 1)), (5, None), (6, None)]
    found = [tuple(r) for r in similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, 1)] * 3 + [(2, 1), (None, None), (None, None), (None, 1), (5, 5), (6, 5)], key=str)
    assert similar.similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = []
    for _ in range(150):  # about the centre, near it but seldom near each other, and what stands alone
        own = centre.copy()
        own[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(own))
    sets += [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(20)]
    links = similar.similar_links(sets, 0.8)

    def jaccard(a, b):
        n = len(np.intersect1d(a, b))
        return n / (len(a) + len(b) - n)

    assert all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in links)

    def classes(pairs):
        top = [*range(len(sets))]
        for i, j in pairs:
            a, b = sorted((top[i], top[j]))
            top = [a if x == b else x for x in top]
        return top

    assert classes(links) == classes([(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])


def test_unlike_texts_are_no_candidates(spark):
    """Of texts that have nothing in common nearly none become candidates, however many there are; one word of 64 bits alone would connect hundreds of these."""
    n = 30_000
    fps = np.random.default_rng(5).integers(0, 1 << 64, (n, similar.WORDS), dtype=np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps.tolist())], "node long, fps array<long>")
    links = similar.near_links(nodes, similar.CANDIDATE_DISTANCE, similar.SEGMENTS, similar.WORDS, similar.RADIUS, judged=similar.JUDGED)
    assert links.count() <= 10
