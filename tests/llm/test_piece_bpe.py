import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmill.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids int, id int, t string, decoded string"
with open(MODEL, "rb") as f:
    RAW = f.read()
TRUTH = sentencepiece.SentencePieceProcessor(model_proto=RAW)
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "▁", "▁▁", "th", "ing", "<s>", "</s>", "<unk>", "<0x41>", "漢", "🙂", "\u0085", "\x00", "​", "ſ", " ", " the", "%%%"]


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(RAW, check=True)


def hard_texts():
    rng = random.Random(1)
    texts = [None, "", " ", "   ", "▁", "\n\n", "a" * 500, " " * 500, "x" + " " * 90 + "y", "the " * 200, "a" * (piece_bpe.SHORT - 1), "b" * piece_bpe.SHORT]
    return texts + ["".join(rng.choices(PARTS, k=rng.randint(1, 200))) for _ in range(150)]


def test_equals_the_library(spark):
    texts = hard_texts()
    rows = [(i, t, 0, 1, "x", "y") for i, t in enumerate(texts)] + [(9, texts[9], 0, 1, "x", "y"), (None, "null id", 0, 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = piece_bpe.encode(docs, MODEL, decoded=True)
    assert out.columns == ["doc_id", "ids", "decoded"]
    by_id = dict([*enumerate(texts), (None, "null id")])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        ids = TRUTH.encode(by_id[r.doc_id] or "")
        assert r.ids == ids, repr(by_id[r.doc_id])
        assert r.decoded == TRUTH.decode(ids)
    again = piece_bpe.decode(out.drop("decoded"), MODEL).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=5), max_size=30).map("".join))
def test_any_text(codec, text):
    (ids,) = codec.encode([text])
    assert ids.tolist() == TRUTH.encode(text)
    assert codec.decode(ids.tolist()) == TRUTH.decode(ids.tolist())


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 270), max_size=12))
def test_any_ids_decode(codec, ids):
    assert codec.decode(ids) == TRUTH.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinrst▁h", min_size=1, max_size=piece_bpe.SHORT - 1))
def test_both_agendas_agree(codec, word):
    symbols, counts = codec.merged([word, "the", word])
    assert counts[0] == counts[2] and symbols[: counts[0]].tolist() == codec.merged_long(word).tolist()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE", 20)
    own, rng = piece_bpe.Codec(RAW), random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=40)) for _ in range(60)]
    for k in range(0, 60, 5):
        assert [x.tolist() for x in own.encode(texts[k : k + 5])] == TRUTH.encode(texts[k : k + 5])
    assert len(own.known) + len(own.old) < 1_000


def test_a_difference_from_the_library_is_an_error():
    own = piece_bpe.Codec(RAW, check=True)
    own.places = own.places[::-1].copy()  # merges in another order
    with pytest.raises(ValueError, match="in another way"):
        own.encode(["otherwise anything thereafter"])


def test_other_models_are_refused():
    spec = piece_bpe.sentencepiece_model_pb2.ModelProto()
    for change in (lambda s: setattr(s.trainer_spec, "byte_fallback", False), lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True), lambda s: setattr(s.pieces[300], "type", 4)):
        spec.ParseFromString(RAW)
        change(spec)
        with pytest.raises(ValueError):
            piece_bpe.Codec(spec.SerializeToString())


def test_no_rows_and_very_long_texts(spark):
    assert piece_bpe.encode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
    text = "ab" * 50_000 + " " + " ".join(f"word{k}" for k in range(100_000))
    (row,) = piece_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL, decoded=True).collect()
    assert row.ids == TRUTH.encode(text) and row.decoded == text
