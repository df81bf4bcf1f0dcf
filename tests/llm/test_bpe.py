import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocellus.llm.bpe import Encoder, default_vocabulary, encode_column, piece_starts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(default_vocabulary(), "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def parts(values, lengths):
    return [x.tolist() for x in np.split(values, np.cumsum(lengths)[:-1])]


ALPHABET = [*" \n\t\r 　'''stmdlvreLL!?.,aZé9²٣中’-_", "'ll", "'re", "'s", "  ", "𝒳", "👁️", "́", "<|endoftext|>"]


def test_random_texts(encoder, library):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(30))) for _ in range(4000)]
    assert parts(*encoder.encode(texts)) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(encoder, library, text):
    assert parts(*encoder.encode([text])) == library([text])


def test_round_trip_and_offsets(encoder):
    texts = ["", None, "Dry eye’s  end\n\n", "角膜 haze" * 50, "x" * 3000]
    values, lengths, starts = encoder.encode(texts, offsets=True)
    for t, ids, at in zip(texts, parts(values, lengths), parts(starts, lengths)):
        assert encoder.decode(ids) == (t or "")
        data = (t or "").encode()
        assert all(data[a:].startswith(encoder.by_id()[i]) for i, a in zip(ids, at)) and at[:1] in ([], [0])


def test_very_long_piece(encoder, library):
    for text in ("ab" * 20_000, "角" * 5000, " " * 9000, "'" * 3000):
        assert parts(*encoder.encode([text])) == library([text])


def test_texts_do_not_join(encoder, library):
    texts = ["don", "'t", " ", "x", "'", "s", "\n", "\n"]
    assert parts(*encoder.encode(texts)) == library(texts)


def test_no_text():
    assert piece_starts(np.array([97], np.uint32), np.array([0])).tolist() == [True]


def test_column(spark, library):
    rows = [(1, "Dry eye", "x"), (2, None, "y"), (3, "", "z"), (None, "a b", None), (1, "Dry eye", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_column(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((i, library([t])[0] if t else []) for i, t, _ in rows), key=str)
    assert sorted(r.n_tokens for r in encode_column(df, "doc_id", "text", mode="count").collect()) == sorted(len(x) for _, x in got)
    assert encode_column(df.limit(0), "doc_id", "text").collect() == []


def test_long_texts_are_taken_in_pieces(encoder, library, monkeypatch):
    import ocellus.llm.bpe as bpe

    r = random.Random(7)
    texts = ["".join(r.choice(ALPHABET) for _ in range(3000)), None, "", "don't  stop " * 200, "x" * 900, "word " * 300]
    plain = encoder.encode(texts, offsets=True)
    monkeypatch.setattr(bpe, "PIECE", 100)
    cut = encoder.encode(texts, offsets=True)
    assert all((a == b).all() for a, b in zip(plain, cut))
    assert parts(*cut[:2]) == library([t or "" for t in texts])
