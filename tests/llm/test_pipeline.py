"""The corpus pipeline stage by stage, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from cadenza.llm import pii
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{top}/{k}")
        new = spark.read.parquet(f"{top}/{k}")
        out.append((docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_names_and_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert len(corpus_pipeline.STAGES) == 5
    assert [c for _, _, c in stages[:-1]] == [columns] * 4


def test_language(stages):
    before, after, _ = stages[0]
    assert not Counter(after) - Counter(before)
    gone = Counter(before) - Counter(after)
    assert all(any(c.isalpha() for c in r.text or "") for r in after)
    assert sum(gone.values()) < 0.2 * len(before)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages[1]
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in before]) if i == c}
    assert Counter(after) == Counter(r for r in before if r.doc_id in want)


def test_personal_data_goes(stages):
    before, after, _ = stages[2]
    was = {r.doc_id: r for r in before}
    assert sorted(was) == sorted(r.doc_id for r in after)
    for r in after:
        assert r.text == pii.redact_text(was[r.doc_id].text)
        assert not [x for x in pii.find(r.text) if x[2] in ("email", "ip", "card", "phone")]


def test_mixing(stages):
    before, after, _ = stages[3]
    known = set(before)
    times = Counter(after)
    assert set(times) <= known and max(times.values()) <= 3


def test_encoding(stages):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after, _ = stages[4]
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in before)
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == want


def test_run_gives_what_the_stages_give(spark, stages):
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[-1][1])


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (None, "some words of a text", "en", None, 20), (None, "some words of a text", "en", None, 20), (5, "some words of a text", "en", "s", 20), (5, "some words of a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert stage(spark, docs, SF).count() <= 3 * len(rows)
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2, 3, 5]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    one, two = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [
        (7, one, "en", "b", 1), (7, two, "en", "b", 1), (7, one + " x", "en", "b", 1), (3, two + " y", "en", "b", 1), (7, one, "de", "a", 1), (None, one, "en", "b", 1), (None, "quite another text", "en", "b", 1),
        (9, None, "en", "b", 0), (9, None, "en", "b", 0), (10, "", "en", "b", 0), (11, "", "en", "b", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    firsts = [r for r in got if r[0] and r[1] and r[1].startswith("w0")]
    assert len(firsts) == 1 and firsts[0][0] == 7 and firsts[0][1] in (one, one + " x")
    if firsts[0][1] == one:
        assert firsts[0] == (7, one, "de", "a", 1)
    others = sorted((r for r in got if r not in firsts), key=str)
    assert others == sorted([rows[3], rows[5], rows[6], rows[7], rows[9], rows[10]], key=str)
    again = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs.repartition(5), SF).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)
    assert corpus_pipeline.one_of_each_group(spark, docs.where("false"), SF).count() == 0
