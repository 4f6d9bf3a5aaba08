"""SentencePiece encoding and decoding against the sentencepiece library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "word", " word", "two words", "two  words", "end ", "\n", "a\nb\n\nc", "\ttab\ttab", "日本語テキスト", "\U0001f600 \U0001f468‍\U0001f469", "é é ß", "x" * 3000, "ab" * 2000, "▁ marks ▁▁", "<s></s><unk> <0x41>", "1234567890",
    "a b", "\x00\x01", "!!!???...", "    four", "a    b", "\r\n", "ﬁ ½", " \n ", "aaaaaaaaaaaaaaaaaaaaaaaa", "-" * 100,
]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.piece_model())


def split(ids, n):
    ends = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)]


def test_odd_texts(sp, codec):
    ids, n = codec.encode(pa.array(ODD, pa.string()))
    assert split(ids, n) == [sp.encode(t or "") for t in ODD]
    assert codec.decode(ids.astype(np.int64), n).to_pylist() == [sp.decode(x) for x in split(ids, n)]


def test_random_texts(sp, codec):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeé thein gors  \n.,▁日") for _ in range(rng.randrange(60))) for _ in range(2000)]
    ids, n = codec.encode(pa.array(texts, pa.string()))
    assert split(ids, n) == [sp.encode(t) for t in texts]


@pytest.mark.parametrize("alphabet", ["我们今天去公园散步的是一不了人在有国中大上地为子年日本語", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"])
def test_long_texts_without_spaces(sp, codec, alphabet):
    rng = random.Random(8)
    text = "".join(rng.choice(alphabet) for _ in range(60_000))
    ids, n = codec.encode(pa.array([text], pa.string()))
    assert ids.tolist() == sp.encode(text)


def test_query(spark, sp):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = pieces.op6_pieces(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = np.array(sp.encode(texts[r.doc_id]), "<u4")
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(want), zlib.crc32(want.tobytes()), True)


def test_rows_and_columns(spark, sp):
    model = pieces.piece_model()
    rows = [(1, None, "a"), (1, None, "a"), (None, "two words", None), (2, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(docs, model)
    assert out.columns == ["doc_id", "ids"]
    assert sorted((r.doc_id or 0, r.ids) for r in out.collect()) == [(0, sp.encode("two words")), (1, []), (1, []), (2, [])]
    assert sorted(r.text for r in pieces.decode(out, model).collect()) == ["", "", "", "two words"]
    assert pieces.encode(docs.where("false"), model).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(none, model).first().text is None
