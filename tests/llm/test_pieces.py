"""Piece encoding and decoding against the library on whole texts."""

import random

import pytest
import sentencepiece

from spanqa.llm import pieces
from spanqa.llm.queries import TOKENIZERS

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(2)
    signs = [*"ab the  \n\n\r\t▁▁éß中文字日本​\x00�𒀀<>0xs/ﬁ①. ,", "́", "the ", "  ", "and", " ", "　"]
    made = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(1500)]
    return made + [None, "", " ", "\n", "▁", "▁▁", " ▁ ", "\n▁", "<s></s><unk><0x0A>", "x" * 20_000, "word of a long text\n" * 40_000]


@pytest.mark.parametrize("frequent", [1, 40, pieces.FREQUENT])
def test_like_the_library(spark, library, frequent, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 300)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    ts = texts()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(ts)],
                               "doc_id long, text string, ids string, Decoded int, chunk string")
    out = pieces.encode(df, pieces.Model.read(PATH), frequent=frequent)
    assert out.columns == ["doc_id", "text", "chunk", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ts)
    for r in rows:
        ids = library.encode(ts[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.decoded, r.text) == (ids, library.decode(ids), ts[r.doc_id]), ts[r.doc_id]


def test_table(spark, library):
    df = spark.createDataFrame([("a b a b\nb a",), ("a  c",), (None,), ("",)], "text string")
    for frequent, chunks in ((2, {"▁a", "▁b"}), (1, {"▁a"}), (0, set()), (pieces.FREQUENT, {"▁a", "▁b"})):
        got = {r.chunk: bytes(r.ids) for r in pieces.chunk_table(df, pieces.Model.read(PATH), frequent=frequent).collect()}
        assert got.keys() == chunks
        for c, ids in got.items():
            assert list(memoryview(ids).cast("i")) == library.encode(c[1:])


def test_none(spark):
    assert pieces.encode(spark.createDataFrame([], "text string, ids int"), pieces.Model.read(PATH)).collect() == []


def test_other_models_are_refused(monkeypatch):
    class Crossing:
        def get_piece_size(self): return 1
        def id_to_piece(self, i): return "a▁b"
        def is_control(self, i): return False
        is_unknown = is_byte = is_control

    monkeypatch.setattr(pieces.Model, "load", lambda self: Crossing())
    with pytest.raises(ValueError):
        pieces.Model.read(PATH)
