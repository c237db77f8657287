import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkmill.llm import queries, suffix


def plain(texts, n):
    """Removed runs and kept bytes of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            if not g and start is not None:
                runs.append((start, i))
                start = None
        out.append((runs, bytes(x for x, g in zip(d, gone) if not g)))
    return out


def corpus(seed, n=60, alphabet="abcdefé \n"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(20, 200)) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "ab" * 150, "\0" * 120, "\0" * 90]
    for _ in range(n):
        t = word(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(t))
            t = t[:at] + p[cut : cut + rng.randint(10, 200)] + t[at:]
        texts.append(t)
    return texts + [texts[10], texts[11][3:], texts[12] + texts[12]]


@pytest.mark.parametrize(("seed", "n", "gram", "hot"), [(1, 40, 10, 50_000), (2, 40, 10, 3), (3, 64, 24, 50_000), (4, 30, 29, 2)])
def test_removes_what_counting_windows_removes(spark, seed, n, gram, hot):
    texts = corpus(seed)
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(20, texts[20], 0, "x"), (None, texts[21][5:], 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, h string")
    out = suffix.remove_repeats(docs, min_len=n, gram=gram, bucket=40, hot=hot).collect()
    want = sorted((str(r[0]), runs, kept) for r, (runs, kept) in zip(rows, plain([r[1] for r in rows], n)))
    got = sorted((str(r.doc_id), [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in out)
    assert got == want
    assert all(r.n_bytes == sum(s.end - s.start for s in r.spans) + len(r.kept) for r in out)


@pytest.mark.parametrize("hot", [5, 30, 10_000])
def test_hot_grams_are_lengthened(spark, monkeypatch, hot):
    """One passage in very many texts, whole, in part, with unequal surroundings: all its contexts have one gram."""
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, texts = word(90), []
    for i in range(80):
        s, e = (0, 90) if i % 3 == 0 else (rng.randint(0, 40), rng.randint(50, 90))
        texts.append(word(rng.randint(0, 60)) + passage[s:e] + word(rng.randint(0, 60)))
    seen = []
    plainly = suffix.lengthened
    monkeypatch.setattr(suffix, "lengthened", lambda *x: seen.append(plainly(*x)) or seen[-1])
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix.remove_repeats(docs, min_len=40, gram=10, bucket=40, hot=hot).collect()}
    for i, (runs, kept) in enumerate(plain(texts, 40)):
        assert [(s.start, s.end) for s in out[i].spans] == runs and bytes(out[i].kept) == kept
    assert bool(seen) == (hot < 80)
    if hot == 30:  # groups below the bound go through the interval tree
        sizes = [r["count"] for r in seen[0][0].groupBy("s").count().collect()]
        assert sizes and max(sizes) <= hot


def test_a_text_longer_than_a_tile(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda k: "".join(rng.choices("abcdefghijkl \n", k=k))
    passage = word(700)
    long = word(600_000) + passage + word(700_000) + passage[100:] + word(1000)
    docs = spark.createDataFrame([(1, long), (2, word(500) + passage[:450]), (3, word(3000))], "doc_id long, text string")
    out = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix.remove_repeats(docs).collect()}
    assert out[1] == [(600_000, 600_700), (1_300_700, 1_301_300)] and out[2] == [(500, 950)] and out[3] == []


def test_groups_have_all_occurrences(spark):
    rng = random.Random(14)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = word(60)
    texts = [word(40) + passage + word(50) for _ in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    rows = suffix.repeat_groups(docs, min_len=50, gram=20).collect()
    places = {}
    for r in rows:
        places.setdefault((r.gram, r.group), set()).add(r.doc_id)
        assert r.end - r.start >= 50 and r.start <= 50 and r.end >= 90 and texts[r.doc_id].count(texts[r.doc_id][r.start : r.end]) == 1
    assert all(len(x) > 1 and 99 not in x for x in places.values())  # some share a letter more by chance
    assert {*range(12)} in places.values()
    assert min(r.start for r in rows) <= 40 and max(r.end for r in rows) >= 100


def test_tiles_choose_the_same_anchors():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 103, 30_000, dtype=np.uint8)
    buf[5_000:9_000] = 97
    offsets = np.array([0, 10, 10, 4_000, 16_000, 16_300, 30_000])
    want = suffix.Anchors(400, 50).find(buf, offsets)
    for tile in (512, 1_000, 4_096):
        assert (suffix.Anchors(400, 50, tile).find(buf, offsets) == want).all()
    for a, b in zip(offsets, offsets[1:]):
        alone = suffix.Anchors(400, 50).find(buf[a:b].copy(), np.array([0, b - a])) + a
        assert (alone == want[(want >= a) & (want < b)]).all()


def test_no_rows(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_occurrences_are_one_group(spark):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = word(60)
    docs = spark.createDataFrame([(i, word(40) + passage + word(50)) for i in range(12)], "doc_id long, text string")
    found, extents = suffix.repeat_extents(docs, min_len=50, gram=20)
    groups = found.join(extents, ["h", "c"]).groupBy("h", "g").count().collect()
    assert {r["count"] for r in groups} == {12}


def test_contexts_that_share_only_a_gram_are_not_sorted(spark, monkeypatch):
    """A phrase in many unlike texts: its contexts share the gram but no half of a string, and their bytes are not fetched."""
    rng = random.Random(21)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    phrase, passage = word(21), word(41)
    texts = [word(50) + phrase + word(50) for _ in range(40)] + [word(30) + passage + word(30) for _ in range(2)]
    texts += [word(9) + passage[:40], passage[1:] + word(9)]  # at a text's start and end one side alone fits
    seen, plainly = [], suffix.alike_contexts
    monkeypatch.setattr(suffix, "alike_contexts", lambda x: seen.append((x.count(), plainly(x))) or seen[-1][1])
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix.remove_repeats(docs, min_len=40, gram=10).collect()}
    for i, (runs, kept) in enumerate(plain(texts, 40)):
        assert [(s.start, s.end) for s in out[i].spans] == runs and bytes(out[i].kept) == kept
    ((before, after),) = seen
    assert before >= 20 and 4 <= after.count() <= before / 2


def test_the_query_removes_strings_of_400_bytes_and_counts_whole_texts(spark, tmp_path):
    """A repeated passage of over fifty words goes if it has 400 bytes; n_bytes is the text's size either way, n_removed tells."""
    rng = random.Random(31)
    words = lambda n, k: " ".join("".join(rng.choices("abcdefghé", k=k)) for _ in range(n))
    long, short = words(60, 7), words(52, 5)  # the latter has under 400 bytes
    assert len(long.encode()) >= 400 > len(short.encode()) + 2
    texts = [words(40, 6) + f" {long} " + words(30, 6), f"{long}. " + words(90, 6), words(50, 6) + f" {short} " + words(30, 6), f"{short}! " + words(200, 6)]
    texts += [words(n, 6) for n in (20, 100, 300)] + [words(80, 6).replace(" ", "\n") + long[:200], None, ""]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r[:5] for r in queries.op2_suffix_array(spark, str(tmp_path)).collect()}
    for i, (runs, kept) in enumerate(plain(texts, 400)):
        assert out[i] == (i, len((texts[i] or "").encode()), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest())
    assert {i for i in out if out[i][2]} == {0, 1}
