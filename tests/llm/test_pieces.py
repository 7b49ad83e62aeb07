"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm import pieces
from tidemark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.vocabulary(PATH)
ENCODER, DECODER = pieces.Encoder(MODEL), pieces.Decoder(MODEL)


def encoded(encoder, texts, most=pieces.PIECE):
    raw = [t.replace(pieces.SPACE, " ").encode() for t in texts]
    ids, at = encoder.rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]), most)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def decoded(ids):
    buf, at = DECODER.rows(np.array([x for i in ids for x in i], np.int32), np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]))
    return [buf[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]


def expected(texts):
    return [LIBRARY.encode(t, add_bos=True, add_eos=True) for t in texts]


TEXT = st.text(st.sampled_from(" ▁\n\tabeinst.,") | st.characters(codec="utf-8"), max_size=60) | st.lists(
    st.sampled_from([p for p in MODEL["pieces"] if p]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_like_the_library(texts):
    want = expected(texts)
    assert encoded(ENCODER, texts) == want
    assert decoded(want) == [LIBRARY.decode(i) for i in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2]) | st.integers(3, 258) | st.integers(0, 31_999), max_size=12), min_size=1, max_size=5))
def test_any_ids_are_decoded_like_the_library(ids):
    assert decoded(ids) == [LIBRARY.decode(i) for i in ids]


def test_runs_of_spaces_whose_pieces_share_one_score():
    texts = [" " * n + w for n in range(70) for w in ("", "a", "the", "\n", "é")] + [w + " " * n for n in range(40) for w in ("a", "\n ")]
    assert encoded(ENCODER, texts) == expected(texts)


def test_backtracking_is_needed_and_bounded():
    """Words whose longest pieces are wrong, in one long run without a place to cut."""
    r = random.Random(5)
    text = "".join(r.choice(["un", "aff", "ord", "able", "ing", "ation", "s", "token", "th", "e", "er"]) for _ in range(20_000))
    greedy, place, longest = 0, 0, ENCODER.longest_in(text)
    while place < len(text):
        greedy, place = greedy + 1, place + ENCODER.size[longest[place]]
    got = encoded(ENCODER, [text])
    assert got == expected([text]) and len(got[0]) != greedy + 2


def test_long_texts_in_parts_and_windows():
    r = random.Random(6)
    words = ["paragraph", "überall", "日本語", "x" * 300, "\n\n", "🙂", "end."]
    text = " ".join(r.choice(words) for _ in range(3000))
    small = pieces.Encoder(MODEL, cache=50, window=40)
    assert encoded(small, [text], most=500) == expected([text])
    assert encoded(small, ["", text, "a", text, ""], most=500) == expected(["", text, "a", text, ""])


def test_remembered_entries_stay_bounded():
    known = pieces.Generations(10)
    for i in range(100):
        known.put(i, str(i))
        assert known.get(0) == "0"  # asked for again and again, so never forgotten
    assert len(known.new) <= 10 and len(known.old) <= 10 and known.get(50) is None


def test_tables(spark):
    long = "word " * 50_000 + "x" * 5000
    rows = [(1, "a b", 5, "x"), (2, None, 5, "x"), (3, "", 5, "x"), (None, "  <s> ▁ <0x0A>\n", 5, "x"), (1, "a b", 5, "x"), (4, long, 5, "x"), (5, "\x00é🙂", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string").repartition(3)
    got = pieces.decode(pieces.encode(df, PATH), PATH)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in got.collect():
        want = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), np.int32).tolist() == want and r.n_tokens == len(want) and r.decoded == LIBRARY.decode(want)
    assert got.count() == len(rows)
    none = pieces.decode(pieces.encode(df.limit(0), PATH, carry=False), PATH, carry=False)
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "decoded"]
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).collect()] == [""]


def test_query_equals_library_on_all_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_sentencepiece"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = LIBRARY.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want).encode()).hexdigest()


@pytest.mark.parametrize("change", [
    lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.trainer_spec, "byte_fallback", False),
    lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[500], "type", 4)])
def test_other_kinds_of_models_are_refused(tmp_path, change):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    change(model)
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.vocabulary(str(tmp_path / "other.model"))
