"""SentencePiece encoding and decoding against the library, on random, odd and long texts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import piece_codec

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as f:
    DATA = f.read()
ODD = ["", " ", "  ", "   a", "a  ", "<s>", "</s> <unk> <0x41>", "▁x ▁▁y", "日本語のテキスト", "😀👍🏽", "a\x00b", "\n\n\t", "ab" * 300, " " * 100, "x" * 5000, "naïve ÀÉ", "�", "http://ab.cd/ef?g=h&i=j" * 20, "０１２", "aB" * 40_000, "the quick " * 9000]


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.Pieces(DATA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


def agree(pieces, library, texts):
    want = library.encode(texts, add_bos=True, add_eos=True)
    got = [np.frombuffer(x, dtype="<u4") for x in pieces.encode(texts)]
    assert [g.tolist() for g in got] == want
    assert [pieces.decode(g).decode() for g in got] == [library.decode(w) for w in want]


def test_ids_and_texts_equal_the_library(pieces, library):
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab c▁ \né日<s>/0x1eEtThin") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    agree(pieces, library, ODD + mixed)


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text(batch):
    agree(_shared_pieces(), _shared_library(), batch)


_made = {}


def _shared_pieces():
    return _made.setdefault("p", piece_codec.Pieces(DATA)) if "p" not in _made else _made["p"]


def _shared_library():
    return _made.setdefault("l", sentencepiece.SentencePieceProcessor(model_proto=DATA)) if "l" not in _made else _made["l"]


def test_decoding_any_ids(pieces, library):
    rng = random.Random(9)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(0, 3), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids), ids


def test_rows_and_heap_agree(pieces):
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choice("thenaior▁") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    assert pieces.rows(words) == [pieces.heap(w) for w in words]


def test_memory_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(piece_codec, "MEMO", 50)
    small = piece_codec.Pieces(DATA)
    rng = random.Random(4)
    for _ in range(30):
        agree(small, library, [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(20)) + " " + "y" * 90])
        assert len(small.memo) <= 60 and len(small.before) <= 60 and all(len(s) <= piece_codec.LONGEST for s in small.memo)


def test_a_difference_from_the_library_is_an_error():
    wrong = piece_codec.Pieces(DATA)
    wrong.rank = wrong.rank[::-1].copy()
    with pytest.raises(ValueError, match="otherwise"):
        wrong.encode(["the quick brown fox jumps over the lazy dog"])


def test_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (90, None), (91, "twice"), (91, "twice")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)

    def digest(data):
        return hashlib.sha256(data).hexdigest()

    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(library.decode(ids).encode())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = piece_codec.round_trip(df, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    encoded = piece_codec.encode(df, PATH)
    back = piece_codec.decode(encoded, PATH)
    assert sorted(((r.doc_id or -1), r.text) for r in back.collect()) == sorted(((i or -1), library.decode(library.encode(t or ""))) for i, t in rows)
    for op in (piece_codec.round_trip, piece_codec.encode):
        assert op(df.limit(0), PATH).count() == 0
