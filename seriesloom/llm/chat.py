"""Chat formatting with DataFrame expressions only.

Template, one block per run of adjacent turns of one role:

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT ...<|im_end|>

(a newline ends each block). Texts and roles are escaped first: ``<|`` becomes ``<||``, so no control
string can occur in them, and unescaping turns ``<||`` back into ``<|``. The loss mask covers the
assistants' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
NEWLINE = "<|n"  # a newline inside a role
LEARNT = "assistant"  # the role whose texts the loss covers


def escape(text: Column) -> Column:
    """No control string occurs in the result: each starts with ``<|`` and a letter, and every ``<|`` gets a second bar."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: behind each ``<|`` of it stands the one bar that was added."""
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, text): conv_id, formatted, spans.

    ``formatted`` is the whole conversation in the template above, ``spans`` the [start, end) of every
    assistant text in it, in code points and escaped form. Turns are sorted by turn, ties by role and
    text; adjacent turns of one role share a block. Null texts and roles are empty; a null turn comes
    first; a null conv_id is a conversation of its own; repeated rows are repeated turns. Columns with
    other names are ignored. An empty table gives an empty result. One conversation is one cell of the
    result, so it has to fit into a task; nothing else is gathered.
    """
    text = escape(F.coalesce(F.col("text"), F.lit("")))
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def opener(t: Column, i: Column) -> Column:
        header = F.concat(F.lit(START), t["role"], F.lit("\n"))
        before = F.get(F.col("turns"), i - 1)["role"]
        return (
            F.when(before.isNull(), header)
            .when(before == t["role"], F.lit(SEPARATOR))
            .otherwise(F.concat(F.lit(END + "\n"), header))
        )

    chats = chats.withColumn(
        "parts",
        F.transform("turns", lambda t, i: F.struct(opener(t, i).alias("opener"), t["text"].alias("text"), t["role"].alias("role"))),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(done: Column, part: Column) -> Column:
        begin = done["n"] + F.length(part["opener"])
        end = begin + F.length(part["text"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        spans = F.when(part["role"] == LEARNT, F.array_append(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.cast("long").alias("n"), spans.alias("spans"))

    text_of = F.array_join(F.transform("parts", lambda p: F.concat(p["opener"], p["text"])), "")
    return chats.select(
        "conv_id",
        F.concat(text_of, F.lit(END + "\n")).alias("formatted"),
        F.aggregate("parts", start, add, lambda done: done["spans"]).alias("spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """The turns back from (conv_id, formatted, spans): conv_id, formatted, turns (role, text), loss_text.

    ``turns`` is parsed from the formatted text alone; ``loss_text`` is what the spans cover, unescaped.
    """
    blocks = F.split("formatted", END.replace("|", r"\|") + "\n")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2)
        plain = unescape(F.replace(F.substr(role, F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(body, SEPARATOR.replace("|", r"\|"))
        return F.transform(texts, lambda t: F.struct(plain.alias("role"), unescape(t).alias("text")))

    covered = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chats.select(
        "conv_id",
        "formatted",
        F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns_of)).alias("turns"),
        F.array_join(covered, "").alias("loss_text"),
    )
