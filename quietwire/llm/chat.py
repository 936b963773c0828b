"""Multi-party perspective rotation, in DataFrame operations.

A conversation of any number of speakers becomes one training example for each of them: that speaker's turns are the
assistant's, everyone else is a named user, and only the assistant's words are to be learnt. The mask is a list of run
lengths over the rendered text, so it is made in one pass beside the text and adds up to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """What a speaker wrote, unable to open a mark: "<|" becomes "<\\|". "<\\" becomes "<\\\\", so the text can be had back."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def _name(role: Column) -> Column:
    """A name inside a mark, unable to open or close one: a backslash is doubled, then one goes between "<" and "|", between "|" and ">", and after
    a "<" at the end. Single backslashes are those put in, so different names stay different."""
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    apart = F.replace(F.replace(doubled, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
    return F.concat(apart, F.when(role.endswith("<"), "\\").otherwise(""))


def _header(speaker: Column, role: Column) -> Column:
    return F.when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), _name(role), F.lit("|>\n")))


def _body(text: Column) -> Column:
    return F.concat(escaped(text), F.lit("<|end|>\n"))


def rotate_perspectives(df: DataFrame, conversation_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation and speaker: conv_id, speaker, n_turns, n_own_turns, rendered, mask.

    ``mask`` is an array of (length, learn): code points, in order, over the whole of ``rendered``; ``learn`` is 1 for what the
    assistant says, with its end mark.

    Turns are ordered by turn, then speaker, then text, so ties and repeated rows render in a defined order, each of them.
    Marks in texts and names are escaped (``escaped``), so no turn can pass for two or for another speaker's. A null turn comes first, a null speaker is "unknown", a null text is empty. Rows without a conversation id belong to no
    conversation and render nothing. Other columns are ignored; an empty table gives no rows. A conversation is one row of the result, as its
    rendering is, so it has to fit into one value.
    """
    turns = df.filter(F.col(conversation_col).isNotNull()).select(
        F.col(conversation_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("said"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    views = talks.select("conv_id", "said", F.explode(F.array_sort(F.array_distinct(F.transform("said", lambda t: t["role"])))).alias("speaker"))
    me = F.col("speaker")
    runs = F.flatten(
        F.transform(
            "said",
            lambda t: F.array(
                F.struct(F.char_length(_header(me, t["role"])).alias("length"), F.lit(0).alias("learn")),
                F.struct(F.char_length(_body(t["text"])).alias("length"), (t["role"] == me).cast("int").alias("learn")),
            ),
        )
    )
    return views.select(
        "conv_id",
        "speaker",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda t: t["role"] == me)).cast("long").alias("n_own_turns"),
        F.array_join(F.transform("said", lambda t: F.concat(_header(me, t["role"]), _body(t["text"]))), "").alias("rendered"),
        runs.alias("mask"),
    )
