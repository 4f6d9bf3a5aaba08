"""Token files against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import token_files as tf

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "word", "  two  words ", "don't can't I'll", "x.y,z. a,b", "1,000.50 e.g. U.S.A.", "Ünïcödé ÀÉ ß ÿ", "日本語 テキスト", "emoji \U0001f600\U0001f468‍\U0001f469", "a b c　d",
    "tab\tnew\nline\rreturn\x0bvt\x0cff", "\x1c\x1d\x85", "é combining", "ﬁ ligature ½ ²", "<|endoftext|> [UNK] </s> <s>", "x" * 5000, "İstanbul ıı ſ", "​ zero ﻿ width", "a" + "." * 50, "CamelCaseWord ALLCAPS", "ab.cd", "é.f,", "a,.b",
]


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def brute(tokenizer, rows):
    """(doc_id, start, n, crc) in order of doc_id, then text."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_words_apart_are_the_text_whole(spec, tokenizer):
    ids, n = tf.WordEncoder(spec).encode(pa.array(ODD, pa.string()))
    ends = np.cumsum(n)
    for t, a, b in zip(ODD, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_query(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in tf.op4_token_files(spark, SF).collect()), key=lambda r: r[1])
    assert got == brute(tokenizer, rows)


@pytest.mark.parametrize(("block", "shards"), [(1, 1), (7, 3), (64, 5), (1 << 16, 2)])
def test_documents_over_blocks(spark, spec, tokenizer, tmp_path, block, shards):
    rows = [(k * 3 - 20, t) for k, t in enumerate(ODD[:18] + ODD[19:])] + [(5, "again"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    path = str(tmp_path / "files")
    tf.write(docs, spec, path, block, shards)
    got = sorted((tuple(r) for r in tf.read(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(tokenizer, rows)
    chunks = spark.read.parquet(path).collect()
    assert all(c.n_ids <= block and sum(c.lengths) == c.n_ids for c in chunks)


def test_empty_table(spark, spec, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write(docs, spec, str(tmp_path / "none"))
    assert tf.read(spark, str(tmp_path / "none")).count() == 0


def test_planes_give_the_ids_back():
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1000, np.uint32)
    assert (tf.ids_of(tf.planes(ids), 1000) == ids).all()
    small = np.random.default_rng(0).integers(0, 49_000, 1 << 16).astype(np.uint32)
    assert sum(map(len, tf.planes(small))) < small.nbytes * 0.6
