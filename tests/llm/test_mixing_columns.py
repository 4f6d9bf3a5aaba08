"""The training order keeps the values of columns named like the mix's own."""

from cadenza.llm import mixing


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(k, f"w{k} x", "ab"[k % 2], f"t{k}", k) for k in range(20)], "doc_id long, text string, source string, target string, size long")
    rows = mixing.in_order(docs).collect()
    assert rows and all((r.target, r["size"]) == (f"t{r.doc_id}", r.doc_id) for r in rows)
