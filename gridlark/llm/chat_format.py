r"""Write conversations as training texts with a loss mask, and read them back; Spark functions only.

A conversation's rows are collected as structs, sorted by turn, and neighbours of one role are merged
into a run. A run is written as

    <turn ROLE>first text<next/>second text</turn>

and a line feed. Inside texts a control string gets a backslash behind its ``<`` (one more, if some
stand there already), so ``</turn>`` becomes ``<\/turn>`` and ``<\/turn>`` becomes ``<\\/turn>``; no
text can hold a control string after that, and taking one backslash away restores it. Roles have
``%``, ``<`` and ``>`` written as ``%25``, ``%3C`` and ``%3E``.

The text is made of pieces, each under the loss mask or not; the pieces under it are the texts of
``assistant`` turns, without control strings. All steps are linear in a conversation's length.

Defined results: a null role or text is empty; turns are ordered null first, turns with one number
by role, then text; repeated rows are turns each; rows without conv_id are one conversation without
id; an empty table gives no rows; other columns of the input do not matter. A conversation becomes
one value of one row, so the task that writes it holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"
OPEN, CLOSE, NEXT = "<turn ", "</turn>", "<next/>"
# A control string with any number of backslashes behind its first character.
CONTROL = r"<(\\*)(turn |/turn>|next/>)"
STUFFED = r"<\\(\\*)(turn |/turn>|next/>)"
ROLE_MARKS = {"%": "%25", "<": "%3C", ">": "%3E"}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, STUFFED, "<$1$2")


def _role(role: Column) -> Column:
    for plain, mark in ROLE_MARKS.items():
        role = F.replace(role, F.lit(plain), F.lit(mark))
    return role


def _unrole(role: Column) -> Column:
    for plain, mark in reversed(ROLE_MARKS.items()):
        role = F.replace(role, F.lit(mark), F.lit(plain))
    return role


def sorted_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: the conversation's turns in order, as structs of turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    return rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns")
    )


def merged_runs(conversations: DataFrame) -> DataFrame:
    """conv_id, runs: neighbouring turns of one role merged into structs of role and texts."""
    turns, ends = F.col("turns"), F.col("ends")
    role = lambda i: F.get(turns, i)["role"]
    changes = lambda i: F.coalesce(role(i) != role(i + 1), F.lit(True))
    before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(-1))
    run = lambda end, k: F.struct(
        role(end).alias("role"),
        F.transform(F.slice(turns, before(k) + 2, end - before(k)), lambda t: t["text"]).alias("texts"),
    )
    # The last index of each run, then the run as the slice since the one before.
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    return conversations.select("conv_id", "turns", F.filter(places, changes).alias("ends")).select(
        "conv_id", F.transform(ends, run).alias("runs")
    )


def format_chat(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, pieces: the text, and its parts in order as structs of text and loss."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)

    def pieces(run: Column) -> Column:
        learnt = run["role"] == LEARNT
        head = piece(F.concat(F.lit(OPEN), _role(run["role"]), F.lit(">")), off)
        texts = F.transform(
            run["texts"],
            lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), off), piece(escaped(t), learnt)),
        )
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(F.lit(CLOSE + "\n"), off)))

    made = merged_runs(sorted_turns(rows)).select("conv_id", F.flatten(F.transform("runs", pieces)).alias("pieces"))
    return made.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), "pieces")


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text: what ``formatted`` says, and the plain text under the loss mask."""

    def read(block: Column) -> Column:
        head = F.substring_index(block, ">", 1)
        texts = F.split(F.substr(block, F.length(head) + 2), NEXT, -1)
        role = _unrole(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split("formatted", CLOSE + "\n", -1)
    learnt = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["text"]))
    return formatted.withColumn("blocks", blocks).select(
        "conv_id",
        # Behind the last control string stands nothing.
        F.flatten(F.transform(F.slice("blocks", F.lit(1), F.size("blocks") - 1), read)).alias("turns"),
        F.array_join(learnt, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, as read back."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_chat(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
