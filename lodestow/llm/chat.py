"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its reply as the only trainable
text. Turns after the last assistant turn, which are nobody's context, form one more example without a target, so the
output holds the whole conversation.

Template: a turn is `<turn role="ROLE">`, a newline, its text, a newline, `</turn>` and a newline. In texts every run of
backslashes (also none) before `<turn` or `</turn` gets one more backslash; a control string of the template is never
preceded by one, so reading takes one off again and every text comes back as it was. Roles are percent-encoded.

Scale: conversations are grouped by id once; expanding, reading back and digests stay in those partitions without another
shuffle. The output grows with the square of a conversation's turns, as the method asks for, one example at a time: what a
task holds of a conversation is its turns, the example at hand and the replies read back so far.

Nulls: a null text or role is empty; a null turn comes first, equal turns are ordered by role and text; a null conv_id is
a conversation of its own. Repeated rows are repeated turns. Very long texts are formatted whole. Other columns are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*</?turn)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*</?turn)", "$1")


def _opening(role: Column) -> Column:
    return F.concat(F.lit('<turn role="'), F.url_encode(role), F.lit('">\n'))


def render(turn: Column) -> Column:
    """The formatted turn of a struct (role, text)."""
    return F.concat(_opening(turn["role"]), escape(turn["text"]), F.lit("\n</turn>\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text (context and target), loss_start, loss_length (code points of text under the loss mask), whole.

    An example without a target has loss_length null. Row order inside a conversation is example; the last one is whole, that
    is it holds every turn.
    """
    turns = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("formatted", F.transform("turns", render)).withColumn("last", F.size("turns") - 1)
    trainable = F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["role"] == TRAINABLE).alias("target")))
    kept = F.filter(trainable, lambda x: x["target"] | (x["at"] == F.col("last")))
    rows = whole.select("conv_id", "turns", "formatted", "last", F.posexplode(kept).alias("example", "x"))
    context = F.array_join(F.slice("formatted", F.lit(1), F.col("x.at")), "")
    turn = F.get("turns", F.col("x.at"))
    start = F.char_length("context") + F.char_length(_opening(turn["role"]))
    rows = rows.withColumn("context", context)
    return rows.select(
        "conv_id",
        "example",
        F.concat("context", F.get("formatted", F.col("x.at"))).alias("text"),
        F.when(F.col("x.target"), start).alias("loss_start"),
        F.when(F.col("x.target"), F.char_length(escape(turn["text"]))).alias("loss_length"),
        (F.col("x.at") == F.col("last")).alias("whole"),
    )


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    blocks = F.filter(F.split(text, r'(?:^|(?<=\n))<turn role="'), lambda b: b != "")
    role = lambda b: F.substring_index(b, '">\n', 1)
    body = lambda b: F.substr(b, F.char_length(role(b)) + 4, F.char_length(b) - F.char_length(role(b)) - 3 - F.lit(len("\n</turn>\n")))
    return F.transform(blocks, lambda b: F.struct(F.url_decode(role(b)).alias("role"), unescape(body(b)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the examples alone: turns (of the whole example), losses (the targets in order), formatted_chars."""
    loss = F.when(F.col("loss_start").isNotNull(), F.struct("example", unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_length"))).alias("loss")))
    # a row goes on with its target alone, so that contexts, which repeat, are not gathered
    rows = examples.select("conv_id", loss.alias("x"), F.when(F.col("whole"), F.col("text")).alias("text"), F.char_length("text").cast("long").alias("chars"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max("text").alias("text"), F.sum("chars").alias("formatted_chars"))
    return found.select("conv_id", parse(F.col("text")).alias("turns"), F.transform("x", lambda x: x["loss"]).alias("losses"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_targets."""
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("losses").cast("long").alias("n_targets"),
    )
