r"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are sorted, adjacent turns of one role are
merged into a block, and a block is ``### role``, a line break, and each turn's text
followed by ``</turn>`` and a line break. ``</turn>`` and ``### `` inside a text or role
get a backslash after their first character, one more if they have some there already,
and lose it again when read back; so neither can occur in a text, and every text comes
back as it was. (In a role a backslash becomes ``\b`` and a line break ``\n``.)

The loss mask is a list of spans (start, length) in code points over the string, one
for each turn of ``loss_role``; it covers the texts and none of the marks.

Cases: a null text or role is empty; rows with an equal turn number are ordered by
role, then text, and a null turn number comes first; repeated rows are turns each; rows
with a null conversation id are one conversation; an empty table gives an empty result.
A conversation is one row, so its size is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<$1\\/turn>"), r"#(\\*)## ", r"#$1\\## ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"#(\\*)\\## ", r"#$1## "), r"<(\\*)\\/turn>", r"<$1/turn>")


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\")))


def format_conversations(df: DataFrame, loss_role: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_spans) of each conversation."""
    text = escape(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    turns = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("t"))
    block = "struct<role:string,texts:array<string>>"

    def merge(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(last["role"] == turn["role"], F.array_append(F.slice(blocks, 1, F.size(blocks) - 1), longer)) \
            .otherwise(F.array_append(blocks, fresh)).cast(f"array<{block}>")

    merged = turns.withColumn("b", F.aggregate("t", F.array().cast(f"array<{block}>"), merge))
    head = lambda b: F.concat(F.lit(HEAD), _role_in(b["role"]), F.lit("\n"))
    written = F.transform("b", lambda b: F.concat(head(b), F.array_join(b["texts"], END), F.lit(END)))
    # lengths of what precedes each text's start since the last text's end
    pieces = F.flatten(F.transform("b", lambda b: F.transform(b["texts"], lambda x, i: F.struct(
        (F.when(i == 0, F.length(head(b))).otherwise(0) + F.lit(0)).alias("gap"), F.length(x).alias("length"),
        (b["role"] == F.lit(loss_role)).alias("loss")))))
    state = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def step(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + p["gap"]).alias("start"), p["length"].alias("length"))
        return F.struct((s["at"] + p["gap"] + p["length"] + F.lit(len(END))).alias("at"),
                        F.when(p["loss"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(state)
    spans = F.aggregate(pieces, start, step, lambda s: s["spans"])
    return merged.select(F.col(id_col), F.array_join(written, "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, in order."""
    blocks = F.slice(F.split(formatted, HEAD), 2, F.greatest(F.size(F.split(formatted, HEAD)) - 1, F.lit(0)))

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        texts = F.split(F.substr(b, F.length(role) + 2), END)
        return F.transform(F.slice(texts, 1, F.size(texts) - 1),
                           lambda x: F.struct(_role_out(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    read = formatted.withColumn("_turns", read_turns(F.col("formatted"))) \
        .withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    listed = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col(id_col), F.size("_turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
