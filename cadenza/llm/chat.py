"""Chat formatting with schema fingerprints.

Records of any layout arrive as JSON. The nested field paths and types of a
record are hashed; the hash selects, from a table of declarative mappings,
how its fields become canonical turns. The turns are then written into one
text with marks, and the marks' look-alikes inside of texts are escaped so
that the turns and the texts under the loss mask can be read back. All of it
is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line break in a role, which ends at one.
LINE = "<|line|>"
TURNS = "array<struct<role: string, content: string>>"
#: The JSON reader's own limit on a text would lose longer ones.
LONG = {"maxStringLen": str((1 << 31) - 1)}

#: Names that layouts with roles of their own use for the canonical ones; elsewhere roles stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts, each as an example record and as the way to its turns: the field with an array of messages and the names of
#: role and content there, or a list of (role, names) for fields that are one turn each. An empty field is no turn.
LAYOUTS: list[dict] = [
    {"example": {"messages": [{"content": "", "role": ""}]}, "messages": ("messages", "role", "content")},
    {"example": {"conversations": [{"from": "", "value": ""}]}, "messages": ("conversations", "from", "value"), "roles": ROLES},
    {"example": {"instruction": "", "output": ""}, "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"example": {"input": "", "instruction": "", "output": ""}, "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"example": {"completion": "", "prompt": ""}, "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"example": {"question": "", "answer": "", "system": ""}, "fields": [("system", ["system"]), ("user", ["question"]), ("assistant", ["answer"])]},
]


def fingerprint(record: Column) -> Column:
    """A hash of a variant's nested field paths and types. Field order doesn't matter; null when the record is."""
    return F.xxhash64(F.schema_of_variant(record))


def skeleton(record: Column) -> Column:
    """The JSON record with its fields' texts empty, so that records with very long texts, which a variant can't hold, have a schema too."""
    return F.regexp_replace(F.regexp_replace(record, r"(?s)\\.", "?"), r':\s*"[^"]*"', ':""')


def parse(records: DataFrame, column: str = "record") -> DataFrame:
    """All columns but the record's, and turns array<struct<role, content>>, and layout: the number in LAYOUTS, null if none fits.

    A record that is null, not JSON or of no known layout has null turns. An
    empty list of messages is a list without turns. Null contents are empty texts. Columns named layout or turns give way.
    """
    import json

    spark = records.sparkSession
    # A list without messages, or whose messages lack all content, has another schema than the full one.
    examples = [(k, json.dumps(v)) for k, x in enumerate(LAYOUTS) for v in [x["example"], *_variants(x)]]
    table = F.array(*[F.struct(F.lit(k).alias("layout"), F.lit(v).alias("example")) for k, v in examples])
    known = spark.range(1).select(F.inline(table)).select("layout", fingerprint(F.parse_json("example")).alias("_print"))
    r = records.drop("layout", "turns").withColumn("_print", fingerprint(F.try_parse_json(skeleton(F.col(column)))))
    r = r.join(F.broadcast(known), "_print", "left")

    turns = F.lit(None).cast(TURNS)
    for k, x in enumerate(LAYOUTS):
        turns = F.when(F.col("layout") == k, _turns(x, column)).otherwise(turns)
    r = r.withColumn("turns", turns).drop("_print", column)
    return r.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def _variants(layout: dict) -> list[dict]:
    """Records of the layout with no messages, and with messages whose content is null throughout."""
    if "messages" not in layout:
        return []
    (name, messages), = layout["example"].items()
    _, _, content = layout["messages"]
    return [{name: []}, {name: [{**messages[0], content: None}]}]


def _turns(layout: dict, record: str) -> Column:
    if "messages" in layout:
        name, role, content = layout["messages"]
        alias = F.map_from_entries(F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in layout.get("roles", {"": ""}).items()]))
        return F.transform(
            F.from_json(record, f"`{name}` array<struct<`{role}`: string, `{content}`: string>>", LONG)[name],
            lambda m: F.struct(
                F.coalesce(F.try_element_at(alias, m[role]), m[role], F.lit("")).alias("role"),
                F.coalesce(m[content], F.lit("")).alias("content"),
            ),
        )
    names = [n for _, parts in layout["fields"] for n in parts]
    said = F.from_json(record, ", ".join(f"`{n}` string" for n in names), LONG)
    fields = []
    for role, parts in layout["fields"]:
        text = F.concat_ws("\n", *[F.nullif(said[n], F.lit("")) for n in parts])
        fields.append(F.struct(F.lit(role).alias("role"), text.alias("content")))
    return F.filter(F.array(*fields), lambda t: t["content"] != "")


def escape(text: Column) -> Column:
    r"""The text with a backslash added between each < and | that touch or have only backslashes between them."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(parsed: DataFrame, trained: str = "assistant") -> DataFrame:
    """All columns, and formatted, loss_spans: the text with marks, and where in it the contents of the trained role stand.

    Spans are (start, length) in code points from 0, escapes included. A
    record without turns is the empty text; null turns give null for both.
    """
    safe = F.transform("turns", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit(LINE)).alias("role"), escape(t["content"]).alias("content"), (t["role"] == trained).alias("loss")))
    p = parsed.withColumn("_safe", safe)
    pieces = F.transform("_safe", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["content"], F.lit(END + "\n")))
    p = p.withColumn("_sizes", F.transform(pieces, F.length)).withColumn("formatted", F.array_join(pieces, ""))
    head, tail = len(START) + 1, len(END) + 1
    # One pass over the turns, carrying where the next one starts.
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def walk(acc: Column, x: Column) -> Column:
        t, size = x["t"], x["size"]
        role = F.length(t["role"])
        span = F.struct((acc["at"] + head + role).alias("start"), (size - head - role - tail).alias("length"))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    both = F.zip_with("_safe", "_sizes", lambda t, size: F.struct(t.alias("t"), size.alias("size")))
    return p.withColumn("loss_spans", F.aggregate(both, step, walk)["spans"]).drop("_safe", "_sizes")


def parse_back(formatted: str = "formatted") -> Column:
    """Canonical turns array<struct<role, content>> of a formatted text."""
    parts = F.filter(F.split(F.col(formatted), r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        body = F.substr(p, cut + 1)
        role = F.replace(F.substr(p, F.lit(1), cut - 1), F.lit(LINE), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.left(body, F.length(body) - len(END) - 1)).alias("content"))

    return F.transform(parts, turn)


def under_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"])))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """conv_id and record: each conversation of (conv_id, turn, role, text) rows as a JSON record of messages, by turn, then role and text."""
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    sorted_rows = F.array_sort(F.collect_list(message))
    messages = F.transform(sorted_rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of marks, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    out = render(parse(conversations_as_records(rows.union(own))))
    out = out.withColumn("_back", parse_back()).withColumn("_loss", F.array_join(under_loss(), ""))
    said = F.array_join(F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
