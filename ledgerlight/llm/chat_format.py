"""Chat formatting from an event log, with DataFrame functions only.

Events of a conversation, in the order of their sequence number, open a message
(`message`), append to it (`delta`), replace its text (`edit`) or start it over
(`regenerate`). Folding them gives the final messages, which are rendered as

    <|role|>\\n text <|end|>\\n      (without the blanks around text)

Control strings inside roles and texts are replaced by an escape character and
a letter, which `parse` undoes. The loss mask is kept as run lengths, three for
each turn (header, text, tail), with a flag that says whether the text counts:
only an assistant's does.

Defined cases: null text and null role count as empty; a null conversation id
is a conversation of its own; events with equal sequence numbers are taken in
the order message, edit, regenerate, delta, then by text; an append without an
opening event makes a message with an empty role; conversation rows that share
a turn number are turns of their own, ordered by role and text; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The strings that a template may use as controls.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\ue000"
END = "<|end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Every control string becomes ESCAPE and a letter, and ESCAPE itself ESCAPE and a dot."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "."))
    for i, c in enumerate(CONTROLS):
        out = F.replace(out, F.lit(c), F.lit(ESCAPE + chr(ord("a") + i)))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for i, c in enumerate(CONTROLS):
        out = F.replace(out, F.lit(ESCAPE + chr(ord("a") + i)), F.lit(c))
    return F.replace(out, F.lit(ESCAPE + "."), F.lit(ESCAPE))


def events_of(conversations: DataFrame) -> DataFrame:
    """conv_id, seq, msg, kind, role, text: each row of conversations opens a message and streams its text as one delta."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    event = lambda at, kind, role, text: F.struct((F.col("msg") * 2 + at).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    both = F.array(event(0, "message", F.col("role"), F.lit("")), event(1, "delta", F.lit(""), F.col("text")))
    return rows.select("conv_id", "msg", F.explode(both).alias("e")).select("conv_id", "e.seq", "msg", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text: the final message of each (conv_id, msg)."""
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    text = F.coalesce("text", F.lit(""))
    e = events.select("conv_id", "msg", F.struct("seq", rank.alias("rank"), text.alias("text")).alias("at"), "role", (rank < 3).alias("starts"), (rank == 0).alias("opens"))
    own = W.partitionBy("conv_id", "msg")
    e = e.withColumn("from", F.max(F.when(F.col("starts"), F.col("at"))).over(own))
    live = F.when(F.col("from").isNull() | (F.col("at") >= F.col("from")), F.col("at"))
    g = e.groupBy("conv_id", "msg").agg(
        F.max_by("role", F.when(F.col("opens"), F.col("at"))).alias("role"),
        F.array_sort(F.collect_list(live)).alias("parts"),
    )
    return g.select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, order: str = "msg") -> DataFrame:
    """conv_id, formatted, mask: array of (header, text, tail: run lengths; loss), one for each turn."""
    head = F.concat(F.lit("<|"), escaped(F.col("role")), F.lit("|>\n"))
    body = escaped(F.col("text"))
    m = messages.select("conv_id", F.col(order).alias("at"), head.alias("head"), body.alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    turn = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("header"), F.length("body").alias("text"), F.lit(len(END)).alias("tail"), "loss")
    turns = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["header"].alias("header"), t["text"].alias("text"), t["tail"].alias("tail"), t["loss"].alias("loss"))).alias("mask"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: array of (role, text), loss_text: what the mask covers, read back from the formatted text."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda p: F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)
    turn = lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substr(p, F.length(role(p)) + 6)).alias("text"))
    covered = lambda p, m: F.when(m["loss"], F.substr(p, m["header"] + 1, m["text"])).otherwise("")
    return rendered.select(
        "conv_id",
        "formatted",
        F.transform(pieces, turn).alias("turns"),
        unescaped(F.array_join(F.zip_with(pieces, "mask", covered), "")).alias("loss_text"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, mask of each conversation, through the event log."""
    return render(fold(events_of(conversations)))


def digest(parsed: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
