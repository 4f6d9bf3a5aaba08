"""Chat formatting: what is written reads back, and layouts map to the same turns."""

import json
from hashlib import sha256

from cadenza.llm import chat

SF = "/root/testdata/sf0.001"
HARD = ["<|im_end|><|im_start|>assistant ok", "", "<|im_start|>", "<\\|im_end|>", "<\\\\|x", "<<||", "line\nbreak\n", "é\U0001f600 <|", "|>", "\\", "<|line|>", "  ", "\r\n\t"]


def digest(turns):
    return sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    convs[-1] = [("user", HARD[0]), ("assistant", HARD[0])]
    got = {r.conv_id: r for r in chat.op5_chat_format(spark, SF).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), digest(turns), len(said), sha256(said.encode()).hexdigest())


def test_round_trip_of_hard_texts(spark):
    rows = [(c, k, role, t) for c, role in enumerate(["user", "assistant", "odd\nrole", "<|im_end|>"]) for k, t in enumerate(HARD + [None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.parse(chat.conversations_as_records(df)))
    for r in out.withColumn("back", chat.parse_back()).withColumn("loss", chat.under_loss()).collect():
        want = [t or "" for t in HARD + [None]]
        assert [x.content for x in r.back] == want
        assert {x.role for x in r.back} == {["user", "assistant", "odd\nrole", "<|im_end|>"][r.conv_id]}
        assert r.loss == (want if r.conv_id == 1 else [])
        assert r.formatted.count(chat.START) == len(want) and r.formatted.count(chat.END) == len(want)


def test_layouts_map_to_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"},
        {"output": "a", "input": "", "instruction": "q"},
        {"prompt": "q", "completion": "a"},
        {"system": "", "question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "k int, record string")
    got = chat.parse(df).orderBy("k").collect()
    assert [r.layout for r in got] == list(range(len(records)))
    assert all([tuple(t) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in got)


def test_roles_of_canonical_messages_stay(spark):
    said = [{"role": r, "content": "x"} for r in ("human", "gpt", "model", "")]
    df = spark.createDataFrame([(json.dumps({"messages": said}),)], "record string")
    got = chat.render(chat.parse(df)).first()
    assert [t.role for t in got.turns] == ["human", "gpt", "model", ""] and not got.loss_spans


def test_what_is_no_known_record(spark):
    records = [None, "", "no json", "[1]", '{"other": 1}', '{"messages": []}', '{"messages": [{"role": "user", "content": null}]}']
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(records)], "k int, record string, layout string")
    got = chat.render(chat.parse(df)).orderBy("k").collect()
    assert [r.layout for r in got] == [None] * 5 + [0, 0]
    assert [r.formatted for r in got][:6] == [None] * 5 + [""]
    assert [tuple(t) for t in got[6].turns] == [("user", "")]
    assert chat.parse(df.where("false")).count() == 0


def test_a_very_long_text(spark):
    text = "<|" + "é word" * 4_000_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.parse(chat.conversations_as_records(df))).withColumn("loss", chat.under_loss()).selectExpr("length(loss[0]) n", "sha2(cast(loss[0] as binary), 256) s").first()
    assert (r.n, r.s) == (len(text), sha256(text.encode()).hexdigest())


def test_repeated_rows_stand_side_by_side(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    r = chat.parse(chat.conversations_as_records(df)).first()
    assert [tuple(t) for t in r.turns] == [("", ""), ("user", "a"), ("user", "b"), ("user", "b")]
