import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sparkmill.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight int, score string, digest int, row int, i int, able boolean"


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    """The definition, row by row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, longest)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in s}
    rows = []
    for i, words, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least, None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = k
    return sorted((str(r[0]), *r[1:4], r[5] or 0) for r in rows)


def found(out):
    return sorted((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"] or 0) for r in out.collect())


def documents(rng, n):
    words = ["Word", "WORD", "été", "ÉTÉ", "x1", "a-b", "ſ", "漢字", "y\u0085z", "n\x00m", "q_r", "İ"] + [f"w{k}" for k in range(60)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 97)])
def test_equals_the_definition(spark, longest, buckets):
    rng = random.Random(longest)
    texts = documents(rng, 120)
    rows = [(i, texts[0] if i % 3 == 0 else texts[i % 120]) for i in range(300)]  # a third of all rows are one text
    rows += [(400, None), (401, ""), (402, " ,;"), (None, texts[5]), (7, texts[7]), (7, texts[7])]
    target = [texts[3], texts[4], None, "unseen words only", texts[3]]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, True) for r in rows], SCHEMA)
    out = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=30)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert found(out) == plain(rows, target, longest, buckets, percent=30)


def test_identical_texts_are_taken_apart_once(spark):
    docs = spark.createDataFrame([("same text",)] * 500 + [("another",), (None,), ("",)], "text string").repartition(8)
    rows = {r.copies: r for r in resampling.text_features(docs, "text").collect()}
    assert sorted(rows) == [1, 2, 500] and rows[500].n_words == 2 and rows[2].n_features == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    """Rows of one id and text score alike and take successive ranks; the other rows are as without them."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(i // 4, text) for i in range(40)], "doc_id long, text string")
    out = resampling.resample(docs, docs.select("text"), percent=50).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [*range(1, 21)]
    top = sorted({r.score for r in out}, reverse=True)[:5]
    assert {r.score for r in out if r["rank"]} == {*top}


def test_empty_tables_and_a_very_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    rows = [(1, " ".join(f"w{k * k % 9973}" for k in range(300_000))), (2, "a b")]
    out = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), none, percent=100)
    assert found(out) == plain(rows, [], percent=100)
