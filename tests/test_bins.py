"""Cutting components to pairs and greedy dereplication, beside plain walks in the stated order."""

import random

import pytest

from sparkmill.operators import bins, graph
from sparkmill.plans import workflows


def plain_overlaps(members, length):
    bp = {b: sum(length[c] for c in cs) for b, cs in members.items()}
    return {(a, b): sum(length[c] for c in members[a] & members[b]) / min(bp[a], bp[b]) for a in members for b in members if a < b and members[a] & members[b]}


def parts_of(names, edges):
    top = {n: n for n in names}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        top[root(a)] = root(b)
    return {n: root(n) for n in names}


def plain_cut(members, length):
    """(members, edges left): of each component the weakest edge is cut until no part has over two bins, the longer bin losing what both have."""
    members = {b: set(cs) for b, cs in members.items()}
    weight = plain_overlaps(members, length)
    component = parts_of(members, weight)
    left = dict(weight)
    for part in set(component.values()):
        names = [n for n in members if component[n] == part]
        order = sorted((w, a, b) for (a, b), w in weight.items() if component[a] == part)
        while max(list(p.values()).count(r) for p in [parts_of(names, [e for e in left if component[e[0]] == part])] for r in p.values()) > 2:
            _, a, b = order.pop(0)
            total = {n: sum(length[c] for c in members[n]) for n in (a, b)}
            loser, other = (a, b) if total[a] > total[b] else (b, a)
            members[loser] -= members[other]
            del left[a, b]
    return members, set(left)


def frames(spark, members, length):
    m = spark.createDataFrame([(b, c) for b, cs in members.items() for c in cs], "bin string, contig_idx long")
    return m, spark.createDataFrame([*length.items()], "contig_idx long, length int")


def cut(spark, members, length, one_task_pairs):
    m, lengths = frames(spark, members, length)
    pairs = graph.stored(bins.overlaps(m, lengths))
    edges = graph.stored(bins.cut_order(pairs.join(graph.components(pairs).withColumnRenamed("node", "a"), "a")))
    out = bins.cut_shared(m, lengths, edges.where("cut"), one_task_pairs)
    found = {b: set() for b in members}
    for r in out.collect():
        found[r.bin].add(r.contig_idx)
    assert {(r.a, r.b) for r in bins.pairs_only(edges.drop("cut")).collect()} == {(r.a, r.b) for r in edges.where("not cut").collect()}
    return found, {(r.a, r.b) for r in edges.where("not cut").collect()}


def random_bins(rng, n_bins, n_contigs):
    members = {f"b{k:02d}": {c for c in range(n_contigs) if rng.random() < 2.2 / n_bins} for k in range(n_bins)}
    return {b: cs for b, cs in members.items() if cs}, {c: rng.choice([100, 250, 250, 400, 1000]) for c in range(n_contigs)}


@pytest.mark.parametrize("one_task_pairs", [0, 4, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_cut_components_as_the_plain_walk(spark, seed, one_task_pairs):
    rng = random.Random(seed)
    members, length = random_bins(rng, 14, 40)
    members |= {"x1": {100, 101}, "x2": {101, 102}, "x3": {103}, "y1": {104, 105}, "y2": {105}, "y3": {105, 106}}
    length |= {c: 300 for c in range(100, 107)}
    found = cut(spark, members, length, one_task_pairs)
    assert found == plain_cut(members, length)
    now, left = found
    assert all((a, b) in left for a in now for b in now if a < b and now[a] & now[b])


def test_a_chain_of_three_loses_both_weak_ends(spark):
    members, length = {"a": {1, 2, 3}, "b": {3, 4, 5, 6}, "c": {6, 7, 8, 9}}, dict.fromkeys(range(1, 10), 100)
    assert cut(spark, members, length, 0) == cut(spark, members, length, 9) == plain_cut(members, length)
    m, lengths = frames(spark, members, length)
    clean, ripped = workflows.rip(m, lengths)
    kept = {(r.bin, r.contig_idx) for r in clean.collect()}
    assert sum(c == 6 for _, c in kept) == 1 and sum(c == 3 for _, c in kept) == 2
    assert {(r.bin, r.contig_idx) for r in ripped.collect()} == {("a--b", 1), ("a--b", 2), ("b--a", 4), ("b--a", 5), *({("b--a", 6)} if ("b", 6) in kept else set())}


def test_the_weakest_go_until_pairs_are_left(spark):
    """Path ab .5, bc .1, cd .9, de .6: bc, ab and de go."""
    rows = [("a", "b", 0.5), ("b", "c", 0.1), ("c", "d", 0.9), ("d", "e", 0.6)]
    pairs = spark.createDataFrame([(*r, "a") for r in rows], "a string, b string, weight double, component string")
    assert [(r.a, r.b) for r in bins.pairs_only(pairs).collect()] == [("c", "d")]
    none = pairs.limit(0)
    assert bins.pairs_only(none).collect() == []


def test_cutting_nothing(spark):
    m, lengths = frames(spark, {"a": {1}, "b": {2}}, {1: 5, 2: 5})
    none = spark.createDataFrame([], "a string, b string, weight double, component string")
    for bound in (0, 10):
        assert sorted(map(tuple, bins.cut_shared(m, lengths, none, bound).collect())) == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("one_task_pairs", [0, 5, 1000])
def test_dereplicated_as_the_plain_walk(spark, one_task_pairs):
    """One component of all bins, equal scores among them."""
    rng = random.Random(4)
    score = {f"b{k:02d}": rng.randint(0, 6) / 2 for k in range(30)}
    rows = {tuple(rng.sample(sorted(score), 2)) for _ in range(70)} | {(f"b{k:02d}", f"b{k + 1:02d}") for k in range(29)}
    pairs = [((a, b) if (score[a], a) <= (score[b], b) else (b, a)) for a, b in rows]
    pairs = [(w, b, 0.8 if rng.random() < 0.9 else 0.7, score[w]) for w, b in {*pairs}]
    gone = []
    for s, w, b in sorted((p[3], p[0], p[1]) for p in pairs if p[2] >= 0.75):
        if w not in gone and b not in gone:
            gone.append(w)
    df = spark.createDataFrame(pairs, "worse string, better string, weight double, worse_score double")
    assert sorted(r.bin for r in bins.dereplicated(df, one_task_pairs=one_task_pairs).collect()) == sorted(gone)
    assert bins.dereplicated(df.limit(0), one_task_pairs=one_task_pairs).collect() == []
