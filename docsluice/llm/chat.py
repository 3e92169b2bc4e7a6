"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Texts never hold "<|": an escape parts the two characters.
OPEN, SEP, CLOSE, LINE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|line|>"


def escaped(text: Column) -> Column:
    r"""Reversible: \ becomes \\, and <| becomes <\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role stands on one line: a line end in it becomes a control string."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    r"""(conv_id, formatted, segments) from rows (conv_id, turn, role, text).

    A conversation's turns are sorted as structs (turn, role, text); nulls sort first, equal rows all stay. Adjacent
    turns of one role share a block: <|im_start|>role\ntext<|im_next|>text<|im_end|>\n. Control strings in a text are
    escaped reversibly. A null role or text counts as empty; a null conv_id is one conversation. segments has the
    pieces of the formatted string in order, each with a flag that says whether it is under the loss mask (the texts
    of assistant turns). An empty table gives no rows; other columns are not read.
    """
    row = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    role_at = lambda i: F.get(F.col("t"), i)["role"]

    def pieces(x, i):
        starts = (i == 0) | (role_at(i - 1) != x["role"])
        ends = (i == F.size("t") - 1) | (role_at(i + 1) != x["role"])
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.when(starts, F.concat(F.lit(OPEN), _role(x["role"]), F.lit("\n"))).otherwise(F.lit(SEP)), F.lit(False)),
            seg(escaped(x["text"]), x["role"] == "assistant"),
            seg(F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(False)),
        )

    out = sorted_.select("conv_id", F.flatten(F.transform("t", pieces)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    body = lambda b: F.substr(b, F.lit(len(OPEN) + 1))

    def turns(b):
        role = _unrole(F.substr(body(b), F.lit(1), F.locate("\n", body(b)) - 1))
        texts = F.split(F.substr(body(b), F.locate("\n", body(b)) + 1), r"<\|im_next\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(chats: DataFrame) -> DataFrame:
    """What the query returns, all of it read back from `formatted` and `segments`."""
    back = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("loss"))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(s["text"])), "")
    back = back.select("conv_id", "turns", F.length("formatted").cast("long").alias("formatted_chars"), loss.alias("loss"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
