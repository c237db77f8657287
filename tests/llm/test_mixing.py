import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmill.llm import mixing


def plain_targets(sizes, weights, total, most):
    """Exact: raise the common level until the capped sum reaches the total."""
    caps = [Fraction(most) * s for s in sizes]
    left = [i for i in range(len(sizes)) if weights[i]]
    done = {}
    while left:
        level = (Fraction(total) - sum(done.values())) / sum(Fraction(weights[i]) for i in left)
        low = min(left, key=lambda i: caps[i] / Fraction(weights[i]))
        if level * Fraction(weights[low]) <= caps[low]:
            return [float(done.get(i, level * Fraction(weights[i]) if i in left else 0)) for i in range(len(sizes))]
        done[low] = caps[low]
        left.remove(low)
    return [float(done.get(i, 0)) for i in range(len(sizes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 5)), max_size=8), st.integers(1, 4))
def test_water_fill(rows, most):
    sizes, weights = [r[0] for r in rows], [r[1] for r in rows]
    got = mixing.water_fill(sizes, weights, sum(sizes), most)
    assert got == pytest.approx(plain_targets(sizes, weights, sum(sizes), most), rel=1e-9, abs=1e-9)
    assert all(t <= most * s + 1e-9 for t, s in zip(got, sizes))


def documents(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 20 + ["B", "a", "é", "\U0001f600", "z", None, "tiny"]) if i % 400 else "tiny"
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) if rng.random() > 0.02 else None, source, i, "x"))
    return rows + [rows[5], (None, "one two", "B", 1, "y")]


SCHEMA = "doc_id long, text string, source string, size long, bucket string"


def test_mix(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, plain_targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], sum(sizes.values()), 3)))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 3
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
        mine = {r.repeats for r in out if r.source == s}
        assert max(mine) - min(mine) <= 1
    key = lambda r: (str(r.doc_id), r.size, round(r.target, 6), r.repeats)
    for again in (mixing.mix(docs.repartition(7)), mixing.mix(docs, driver_sources=0)):
        assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_rows_are_repeated_whatever_the_splits(spark, tmp_path):
    """The scan is split one way when the plan is made and another way when it runs."""
    rows = documents(2)
    spark.createDataFrame(rows, SCHEMA).withColumnRenamed("bucket", "of").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.repeats
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for values in (("2000", "1", "50"), ("128m", "4m", "1")):
        for n, v in zip(names, values):
            spark.conf.set(n, v)
        got = Counter(r.doc_id for r in mixed.collect())
        assert got == +want
    for n in names:
        spark.conf.unset(n)


def test_very_long_and_blank_texts(spark):
    rows = [(i, "w " * n, "a", 0, "") for i, n in enumerate([0, 1, 300_000, 1, 2])] + [(9, "x", None, 0, "")]
    out = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i].size for i in (0, 1, 2, 9)] == [0, 1, 300_000, 1] and out[2].source_size == 300_004
    assert all(r.taken <= 3 * r.size for r in out.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8), st.integers(1, 4))
def test_fill_level(spark, rows, most):
    sizes, weights = [r[0] for r in rows], [r[1] for r in rows]
    level = mixing.fill_level(spark.createDataFrame([(s, float(w)) for s, w in rows], "size long, weight double"), sum(sizes), most)
    got = [min(level * w, most * s) if w else 0.0 for s, w in rows]
    assert got == pytest.approx(mixing.water_fill(sizes, weights, sum(sizes), most), rel=1e-9, abs=1e-9)


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, None, None, 0, ""), (2, " ", "a", 0, "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("pool", [mixing.POOL, 40])
def test_targets_are_met_beside_long_texts(spark, monkeypatch, pool):
    """Sources of a hundred short texts and one of 20,000 words: the words taken miss the target by half of the shortest text left at most."""
    monkeypatch.setattr(mixing, "POOL", pool)
    rng = random.Random(6)
    rows = [(s * 1000 + i, " ".join(["w"] * (20_000 if i == 100 else rng.randint(1, 40))), f"s{s}", 0, "") for s in range(5) for i in range(101)]
    rows += [(9000 + i, " ".join(["w"] * n), "many lengths", 0, "") for i, n in enumerate([rng.randint(1, 40) for _ in range(100)] + [200, 500, 900, 2000, 5000, 5001])]
    rows += [(6000 + i, "a b c d e f g", "copies", 0, "") for i in range(60)] + [(7000, "x y z", "copies", 0, "")] * 9
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).collect()
    for s in {r[2] for r in rows}:
        own = [r for r in out if r.source == s]
        whole = int(own[0].target // own[0].source_size)
        least = min((r.size for r in own if r.repeats == whole), default=max(r.size for r in own))  # all taken: the last one was the longest
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, least / 2 if s != "copies" else 14), s
        assert s != "many lengths" or abs(sum(r.taken for r in own) - own[0].target) <= 20
    assert sorted((r.doc_id, r.repeats) for r in mixing.mix(docs.repartition(3)).collect()) == sorted((r.doc_id, r.repeats) for r in out)
    again = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for r in out:
        want[r.doc_id] += r.repeats
    assert again == +want
