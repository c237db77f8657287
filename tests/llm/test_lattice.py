import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkmill.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, word string"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(MODEL)


def all_segmentations(word, table):
    """Sum over every segmentation, one by one."""
    word, total = b" " + word, 0.0
    for cuts in product([0, 1], repeat=len(word) - 1):
        marks = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        p = 1.0
        for a, b in zip(marks, marks[1:]):
            p *= table.get(word[a:b], 0.0)
        total += p
    return math.log(total)


def plain_log_prob(word, table):
    word = b" " + word
    alpha = [1.0] + [0.0] * len(word)
    scale = 0.0
    for e in range(1, len(word) + 1):
        alpha[e] = sum(alpha[s] * table.get(word[s:e], 0.0) for s in range(max(0, e - lattice.LONGEST), e))
        if alpha[e] < 1e-200:
            alpha = [a * 1e200 for a in alpha]
            scale -= 200 * math.log(10)
    return math.log(alpha[-1]) + scale


def test_marginals(pieces):
    table = dict(zip(pieces.pieces, np.exp(pieces.log_p).tolist()))
    words = [b"the", b"a", b"hello", "é".encode(), b"\xff\x00", b"thinking", "漢字".encode()]
    words += [bytes(random.Random(i).choices(b"abcdeiou", k=i + 1)) for i in range(12)]
    l = lattice.Lattice(*pieces.table(), pieces.log_p)  # noqa: E741
    got = l.log_prob(words)
    assert got == pytest.approx([all_segmentations(w, table) for w in words], rel=1e-9)
    long = [b"internationalisation" * 4, b"x" * 500, bytes(random.Random(1).choices(b"etaoin", k=300))]
    assert l.log_prob(long) == pytest.approx([plain_log_prob(w, table) for w in long], rel=1e-9)
    assert l._long(np.frombuffer(b" hello", np.uint8).reshape(1, -1))[0] == pytest.approx(got[2])


def test_expected_counts(pieces):
    l = lattice.Lattice(*pieces.table(), pieces.log_p)  # noqa: E741
    rows = np.frombuffer(b" cat the", np.uint8).reshape(2, -1)
    weight = np.array([3.0, 5.0])
    got = l.expected(l.arcs(rows), weight)
    # every byte is in one piece of each segmentation
    assert sum(len(p) * n for p, n in zip(pieces.pieces, got)) == pytest.approx(4 * weight.sum())
    eps, i = 1e-5, int(np.argmax(got))
    total = lambda: float((l.forward(l.arcs(rows), 2)[-1] * weight).sum())
    l.log_p[i] += eps
    up = total()
    l.log_p[i] -= 2 * eps
    down = total()
    l.log_p[i] += eps
    assert (up - down) / (2 * eps) == pytest.approx(got[i], rel=1e-4)


def corpus():
    rng = random.Random(2)
    words = ["The", "of", "and", "Éa", "stone", "water!", "x" * 70] + ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[50, 40, 30, 5, 5, 5, 1] + [1] * 300, k=rng.randint(0, 80))) for _ in range(120)]
    return [*enumerate(texts)] + [(500, None), (501, ""), (502, "\t\n"), (503, "only-here"), (3, texts[3]), (None, "The end")]


@pytest.mark.parametrize("head", [10, 500_000])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD", head)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    out = lattice.score_texts(docs, MODEL, held_out()).collect()
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    by_id = dict(rows)
    for r in out:
        ws = tokens(by_id[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0
    if head == 10:
        test_scores.few = {(str(r.doc_id), r.n_tokens): r.score for r in out}
    else:
        for r in out:
            assert r.score == pytest.approx(test_scores.few[str(r.doc_id), r.n_tokens])


def segmentations(word, table):
    """(pieces, weight) of every segmentation, one by one."""
    word = b" " + word
    for cuts in product([0, 1], repeat=len(word) - 1):
        marks = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(marks, marks[1:])]
        if all(p in table for p in parts):
            yield parts, math.prod(table[p] for p in parts)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_scores_equal_brute_force(spark, pieces, rounds):
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshr\u00e9", k=rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(40)] + [(90, None), (91, "unseen Words here")]
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    train = Counter(w for i, t in rows if not held(i) for w in lattice.words_of((t or "").encode()))
    ends = sum(not held(i) for i, _ in rows)
    table = dict(zip(pieces.pieces, np.exp(pieces.log_p).tolist()))
    prior, end = {p: lattice.PRIOR * len(table) * 2 * x for p, x in table.items()}, 0.5
    for _ in range(rounds):
        count = dict(prior)
        for w, c in train.items():
            found = [*segmentations(w, table)]
            for parts, x in found:
                for p in parts:
                    count[p] += c * x / sum(y for _, y in found)
        total = sum(count.values()) + ends + 0.1
        table, end = {p: x / total for p, x in count.items()}, (ends + 0.1) / total
    out = lattice.score_texts(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA), MODEL, held_out(), rounds=rounds).collect()
    assert len(out) == len(rows)
    for r in out:
        ws = lattice.words_of((dict(rows)[r.doc_id] or "").encode())
        want = sum(math.log10(sum(x for _, x in segmentations(w, table))) for w in ws) + math.log10(end)
        assert r.score == pytest.approx(want, rel=1e-6)


def test_a_very_long_text_and_very_long_words(spark):
    rows = [(1, "w" * 5000 + " and " * 50_000), (2, "v" * 70), (3, "and")]
    out = {r.doc_id: r for r in lattice.score_texts(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA), MODEL, F.lit(False)).collect()}
    assert [out[i].n_tokens for i in (1, 2, 3)] == [50_002, 2, 2] and all(r.n_known == r.n_tokens for r in out.values())
    assert -math.inf < out[1].score < out[2].score < out[3].score < 0


def test_learning_helps_and_is_bounded(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus()], SCHEMA)
    total = lambda k: sum(r.score for r in lattice.score_texts(docs, MODEL, held_out(), rounds=k).collect() if not r.held_out)
    assert total(0) < total(1) <= total(3)


def test_no_rows(spark):
    assert lattice.score_texts(spark.createDataFrame([], SCHEMA), MODEL, held_out()).collect() == []
    (row,) = lattice.score_texts(spark.createDataFrame([(1, "nothing learned", 1, "x")], SCHEMA), MODEL, F.lit(True)).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def test_every_piece_is_in_the_lattice(pieces):
    sp = lattice.sentencepiece.SentencePieceProcessor(model_file=MODEL)
    every = [sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    assert set(every) <= set(pieces.pieces)
    long = sorted({p[1:] for p in every if len(p) > 16 and p[:1] == b" " and p[1:]})
    assert long
    table = dict(zip(pieces.pieces, np.exp(pieces.log_p).tolist()))

    def whole(word):
        word = b" " + word
        alpha = [1.0]
        for e in range(1, len(word) + 1):
            alpha.append(sum(alpha[s] * table.get(word[s:e], 0.0) for s in range(e)))
        return math.log(alpha[-1])

    l = lattice.Lattice(*pieces.table(), pieces.log_p)  # noqa: E741
    assert l.log_prob(long) == pytest.approx([whole(w) for w in long], rel=1e-9)
    rows = [np.frombuffer(b" " + w, np.uint8).reshape(1, -1) for w in long]
    assert [l._long(r)[0] for r in rows] == pytest.approx([whole(w) for w in long], rel=1e-9)
