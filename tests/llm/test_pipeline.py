import hashlib
import random
import re

import pytest

pytest.importorskip("corpus_pipeline")

import base64  # noqa: E402

import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

import corpus_pipeline  # noqa: E402
from sparkmill.llm import shared, suffix  # noqa: E402
from sparkmill.llm.mixing import mix  # noqa: E402
from sparkmill.llm.shared import materialize  # noqa: E402
from test_suffix import plain  # noqa: E402


def prose(rng, n, words):
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randint(6, 14))
        out += [*rng.choices(words, k=k - 1), rng.choice(words) + "."]
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    passage, short = prose(rng, 55, words), prose(rng, 40, words)
    docs, labels, junk, copies = [], [], set(), {}
    for i in range(400):
        t = prose(rng, rng.randint(60, 300), words)
        if i % 8 == 1:
            t = "!! ".join(t.upper().split()[:60]) + "!!"
            junk.add(i)
        elif i % 40 == 2:
            t = t + "\n" + passage + "\n" + prose(rng, 60, words)
        elif i % 40 == 6:
            t = t + "\n" + short + "\n" + prose(rng, 60, words)
        docs.append((i, t, "en", f"src{i % 4}", len(t)))
        labels.append((i, int(i not in junk), 0))
    for k in range(60):
        base = docs[10 * (k % 30) + 4][1].split()
        if k % 2:
            base[rng.randrange(len(base))] = "changed"
        t = " ".join(base)
        copies[500 + k] = 10 * (k % 30) + 4
        docs.append((500 + k, t, "en", "src0", len(t)))
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), docs, junk, copies, passage, short


def stages(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], d), name))
    return out


def test_stages(spark, corpus):
    d, docs, junk, copies, passage, short = corpus
    tables = stages(spark, d)
    assert all(t.columns == tables[0].columns for t in tables[1:5])
    rows = [{} for _ in tables[:5]]
    for k, t in enumerate(tables[:4]):
        rows[k] = {r.doc_id: r for r in t.collect()}
    good = set(rows[0]) - set(rows[1])
    assert good == junk
    junk_free = [i for i in rows[1]]
    assert set(rows[2]) == {i for i in junk_free if i not in copies}
    # repeated strings: against counting every window of the stage's own input
    ids = sorted(rows[2])
    few = 0
    for i, (runs, _) in zip(ids, plain([rows[2][i].text for i in ids], corpus_pipeline.PASSAGE_BYTES)):
        t = rows[2][i].text.encode()
        long = [r for r in runs if suffix.whole_words(t, *r) > 50]
        few += len(runs) - len(long)
        marks = [0, *(m for r in long for m in r), len(t)]
        want = b"".join(t[x:y] for x, y in zip(marks[::2], marks[1::2])).decode("utf-8", "ignore")
        if re.search("[^\x20\x09-\x0d]", want):
            assert rows[3][i].text == want and rows[3][i].n_chars == len(want)
        else:
            assert i not in rows[3]
    assert any(len(rows[3][i].text) < len(rows[2][i].text) for i in rows[3])
    assert few and all(passage not in r.text for r in rows[3].values())
    assert sum(short in r.text for r in rows[3].values()) > 5  # forty words that repeat stay
    # mixture: rows as often as the operator repeats them
    times = {r.doc_id: r.repeats for r in mix(tables[3]).collect()}
    seen = {}
    for r in tables[4].collect():
        assert r.text == rows[3][r.doc_id].text
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in times.items() if n}
    # ids: the library's, and they decode to the text
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = tables[5].collect()
    assert len(last) == tables[4].count()
    for r in last:
        text = rows[3][r.doc_id].text
        assert r.ids == enc.encode_ordinary(text) and r.n_tokens == len(r.ids)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, corpus, tmp_path):
    """Nulls, blank and very long texts, repeated rows, and columns with the names that stages use inside."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    passage = prose(rng, 300, words)
    base = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus[1][:120]]
    odd = [(700, None, None, None, None), (701, "", "en", "a", 0), (702, " \n", "en", None, 2), (703, "漢" * 30_000 + " " + prose(rng, 30_000, words), "en", "a", 1), (704, prose(rng, 100, words), None, None, None), (704, prose(rng, 100, words), None, "b", 7), (705, passage, "en", "c", 9), (705, passage, "en", "c", 9), (706, prose(rng, 200, words) + "\n" + passage, "en", "c", 9), (None, prose(rng, 150, words), "en", "c", 9)]
    names = ["score", "row", "spans", "kept", "id", "t", "x", "bucket", "of", "u", "doc"]
    rows = [r + tuple(f"{n}{i}" for n in names) for i, r in enumerate(base + odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in corpus[2])) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    tables = stages(spark, str(tmp_path))
    assert all(t.columns == tables[0].columns for t in tables[1:5])
    near = tables[2].collect()
    ids = [r.doc_id for r in near if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and len({701, 702, 700} & set(ids)) <= 1
    texts = {(r.doc_id, r.text) for r in near}
    assert texts <= {(r[0], r[1]) for r in rows}
    cut = {r.doc_id: r for r in tables[3].collect()}
    assert all(r.text is None or r.n_chars is None or r.text == next(x.text for x in near if x.doc_id == i) or r.n_chars == len(r.text) for i, r in cut.items())
    for r in tables[5].collect():
        assert r.n_tokens == len(r.ids)


def test_finished_stages_leave_no_tables(spark, corpus):
    before = shared.written()
    out = corpus_pipeline.run(spark, corpus[0])
    assert len(shared.written()) == len(before) + 1 and out.count() > 0


def test_no_documents(spark, corpus, tmp_path):
    d = corpus[0]
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_bad_documents_go_whatever_their_share(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    docs, junk = [], set()
    for i in range(300):
        t = prose(rng, rng.randint(60, 300), words)
        if i % 5 < 2:
            t = "!! ".join(t.upper().split()[:60]) + "!!"
            junk.add(i)
        docs.append((i, t))
    spark.createDataFrame([(i, int(i not in junk)) for i, _ in docs], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {i for i, _ in docs} - junk
