"""Language identification: held-out accuracy, mixtures, and texts without a language."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs.where(~langid.held_out()).select("text", "lang")).cache()


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.op9_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    known = {r.lang for r in docs.values()} | {"und"}
    for r in rows:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in known
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
    asked = [(r.lang_pred, docs[r.doc_id].lang) for r in rows if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert len(asked) > 100 and np.mean([a == b for a, b in asked]) > 0.97


def test_a_mixture_has_both_languages(spark, learned):
    best = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND length(text) > 2000").orderBy("doc_id").collect():
        best.setdefault(r.lang, r.text[:2000])
    names = sorted(best)
    rows = [(k, best[a] + "\n" + best[b], f"{a},{b}") for k, (a, b) in enumerate((a, b) for a in names for b in names if a < b)]
    df = spark.createDataFrame(rows, "doc_id long, text string, both string")
    got = langid.predict(df, learned, keep=("doc_id", "both")).collect()
    assert rows and sum(set(r.both.split(",")) == set(r.languages.split(",")) for r in got) >= 0.8 * len(rows)
    alone = langid.predict(spark.createDataFrame(list(best.items()), "both string, text string"), learned, keep=("both",)).collect()
    assert [r.lang_pred for r in alone] == [r.both for r in alone]


def test_expectation_maximisation_finds_the_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(500, 0.1), 3).T + 1e-9
    n = rng.multinomial(20_000, p @ [0.7, 0.3, 0.0]).astype(float)
    seen = n > 0
    pi, chosen = langid.infer(p[seen], np.log(p[seen]), n[seen])
    assert chosen.tolist() == [True, True, False] and pi == pytest.approx([0.7, 0.3, 0.0], abs=0.03)


def test_texts_without_a_language(spark, learned):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "a"), (None, "é"), (5, "一"), (6, "_")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 6}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_empty_model_and_table(spark, learned):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    empty = langid.train(docs)
    assert [r.lang_pred for r in langid.predict(docs, empty).collect()] == ["und"]
    assert langid.predict(docs.where("false"), learned).count() == 0
    kept = langid.keep_known(docs.withColumn("score", docs.doc_id), learned)
    assert kept.columns == ["doc_id", "text", "lang", "score"]


def test_more_labels_than_allowed(spark):
    docs = spark.createDataFrame([(f"text {k}" * 50, f"l{k}") for k in range(12)], "text string, lang string")
    model = langid.train(docs)
    with pytest.raises(ValueError, match="labels"):
        langid._tables(model.withColumn("bucket", model.bucket), 0)


def test_long_texts_are_judged_whole(learned):
    labels, logs = langid._tables(learned, 64)
    names, scores, _ = langid.judge(pa.array(["1 " * 1_000_000 + "b", "9" * 2_000_000]), labels, logs)
    assert names[0] in labels and names[1] == "und" and scores[1] == 0
