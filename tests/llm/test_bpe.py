import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmill.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids int, k int, row string"


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "٣", "'s", "'", "'re", "'ll", "<|endoftext|>", "!", "漢", "字", "🙂", " ", "\u0085", "\x1c", "\x1f", "​", " ", "\x00", "ſ", "Ǆ", "²"]
    texts = [None, "", " ", "\n\n", "a" * 500, " " * 500, "it's we're they'll I'd", "x" + " " * 90 + "y", "word " * 200]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(80)]


@pytest.mark.parametrize(("chunk", "overlap", "run"), [(bpe.CHUNK, bpe.OVERLAP, bpe.RUN), (40, 16, 1), (64, 63, 2), (10, 6, 64), (20, 3, 4)])
def test_encode_equals_tiktoken(spark, truth, chunk, overlap, run):
    texts = hard_texts()
    rows = [(i, t, 0, 1, "x") for i, t in enumerate(texts)] + [(8, texts[8], 0, 1, "x"), (None, "null id", 0, 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap, run=run), RANKS, PATTERN).collect()
    both = bpe.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap, run=run, decoded=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, out))
    assert len(out) == len(rows)
    by_id = dict([*enumerate(texts), (None, "null id")])
    for r in out:
        text = by_id[r.doc_id] or ""
        assert r.ids == truth.encode_ordinary(text), repr(text)
        assert bytes(r.decoded) == text.encode()


def test_no_rows(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, PATTERN), RANKS, PATTERN).collect() == []


def test_one_long_piece(spark, truth):
    text = "ab" * 100_000
    (row,) = bpe.encode(spark.createDataFrame([(1, text, 0, 1, "x")], SCHEMA), RANKS, PATTERN).collect()
    assert row.ids == truth.encode_ordinary(text)


def test_texts_of_the_corpus_have_several_chunks(spark, truth):
    """At the sizes of production, on real texts: most are cut, none into runs; and one so long that it is dealt in runs."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sum(len(r.text or "") > bpe.CHUNK for r in rows) > len(rows) / 2
    long = " ".join(r.text for r in rows[:200] if r.text)
    assert len(long) > 3 * bpe.CHUNK * bpe.RUN
    texts = {r.doc_id: r.text for r in rows} | {-1: long, -2: long[:200_000] + "\n" * 100_000 + long}
    out = bpe.encode(spark.createDataFrame([*texts.items()], "doc_id long, text string"), RANKS, PATTERN, decoded=True).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == truth.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é's  \n\t1!漢re", max_size=120), st.integers(1, 30), st.integers(0, 20))
def test_chunks_are_stitched(text, chunk, overlap):
    with open(RANKS, "rb") as f:
        codec = bpe._codec(f.read(), PATTERN)
    starts, pieces = codec.tokenise(text, chunk, overlap)
    whole = [*codec.pattern.finditer(text)]
    assert starts == [m.start() for m in whole] and pieces == [m.group() for m in whole]


def test_stitch_takes_the_first_shared_boundary():
    assert bpe.stitch([100, 104, 110], [102, 104, 110]) == 104
    assert bpe.stitch([100], [101]) is None
