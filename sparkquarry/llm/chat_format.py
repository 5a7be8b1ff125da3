"""Chat formatting by prefix-target expansion.

Every turn of a conversation is written once, in a template whose marks texts can't forge.
Every assistant turn then gives one training example: its context is all that stands before
it, and only its own text is trainable. Since the contexts of a conversation are prefixes of
one formatted text, an example is kept as spans of that text; a conversation of n turns takes
space in proportion to n, not to its square. `expand` gives the spelled-out examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm.shared import cut, table

#: What the template marks turns with.
OPEN_USER, CLOSE_USER, CLOSE_REPLY = "[INST] ", " [/INST]", "</s>"
OPEN_ROLE, OPEN_TEXT, CLOSE_ROLE = "<s>[ROLE] ", " [TEXT] ", " [/ROLE]"

#: A control string, or one that escaping has lengthened by backslashes after its first character.
CONTROL = r"([<\[])(\\*)((?:/?s>)|(?:/?(?:INST|ROLE|TEXT)\]))"


def escape(text: Column) -> Column:
    """One more backslash in every control string, so that none is left; `unescape` takes it away."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(CONTROL, lambda m: m[1] + m[2][1:] + m[3], text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, at (from 0), trainable, piece, and the offsets, in code points
    of the conversation's formatted text, of the piece (start, stop) and of the turn's own text
    in it (text_start, text_stop).

    Turns stand in the order of `turn`; rows that tie, and rows without turn (which come first),
    are ordered by role and text, and repeated rows all count. Rows without conv_id form one
    conversation of their own. A null text is empty; a null role is written as an empty one.
    Roles other than user and assistant are written out. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    opening = (
        F.when(role == "user", F.lit(OPEN_USER))
        .when(role == "assistant", F.lit(""))
        .otherwise(F.concat(F.lit(OPEN_ROLE), escape(role), F.lit(OPEN_TEXT)))
    )
    closing = F.when(role == "user", F.lit(CLOSE_USER)).when(role == "assistant", F.lit(CLOSE_REPLY)).otherwise(F.lit(CLOSE_ROLE))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("raw"),
        opening.alias("opening"), text.alias("body"), closing.alias("closing"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.concat("opening", "body", "closing")
    placed = rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("at"), (F.col("role") == "assistant").alias("trainable"),
        piece.alias("piece"), F.sum(F.length(piece).cast("long")).over(so_far).alias("stop"),
        F.length("opening").alias("_open"), F.length("body").alias("_body"), F.length(piece).alias("_all"),
    )
    start = F.col("stop") - F.col("_all")
    return placed.select(
        "conv_id", "at", "trainable", "piece", start.alias("start"), "stop",
        (start + F.col("_open")).alias("text_start"), (start + F.col("_open") + F.col("_body")).alias("text_stop"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its context is [0, target_start) of the formatted text, and
    [target_start, target_stop) is all that is trainable in it."""
    return turns.where("trainable").select(
        "conv_id", "at", F.lit(0).cast("long").alias("context_start"),
        F.col("text_start").alias("target_start"), F.col("text_stop").alias("target_stop"),
    )


def expand(turns: DataFrame) -> DataFrame:
    """The examples spelled out: conv_id, at, context, target. Context lengths add up to the square
    of a conversation's length; for corpora with long conversations, read by spans instead."""
    other = turns.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), F.col("piece").alias("_piece"))
    before = turns.where("trainable").join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_at") < F.col("at")), "left")
    pieces = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_piece"))))
    own = F.substring(F.first("piece"), F.first(F.col("text_start") - F.col("start")) + 1, F.first(F.col("text_stop") - F.col("text_start")))
    return before.groupBy("conv_id", "at").agg(F.array_join(F.transform(pieces, lambda p: p["_piece"]), "").alias("context"), own.alias("target"))


_TURN = re.compile(
    "|".join(
        (
            re.escape(OPEN_USER) + r"(?P<user>.*?)" + re.escape(CLOSE_USER),
            re.escape(OPEN_ROLE) + r"(?P<role>.*?)" + re.escape(OPEN_TEXT) + r"(?P<text>.*?)" + re.escape(CLOSE_ROLE),
            r"(?P<reply>.*?)" + re.escape(CLOSE_REPLY),
        )
    ),
    re.DOTALL,
)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = _TURN.fullmatch(formatted)
    if found["user"] is not None:
        return "user", unescape(found["user"])
    if found["text"] is not None:
        return unescape(found["role"]), unescape(found["text"])
    return "assistant", unescape(found["reply"])


def read_back(turns: DataFrame, masks: DataFrame) -> DataFrame:
    """Per conversation, from what was written: counts, and digests of turns and trainable text.

    Rows stream through sorted by conversation and turn; hashes run along, so that memory
    doesn't grow with a conversation.
    """
    joined = turns.join(
        masks.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "target_start", "target_stop"),
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")), "left",
    )
    rows = joined.select("conv_id", "at", "piece", "start", "target_start", "target_stop").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [part.split()[0] for part in schema.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        ended = lambda: (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            out = []
            for conv, piece, start, mask, stop in zip(
                batch["conv_id"], batch["piece"], batch["start"], batch["target_start"], batch["target_stop"]
            ):
                conv = None if pd.isna(conv) else int(conv)
                if key != (conv,):
                    if key is not None:
                        out.append(ended())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(piece)
                if not pd.isna(mask):
                    loss = unescape(piece[int(mask) - start : int(stop) - start])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if key is not None:
            yield pd.DataFrame([ended()], columns=names).astype({"conv_id": "Int64"})

    return rows.mapInPandas(fold, schema)


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and the one that spells out control strings, written and read back."""
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = cut(format_turns(rows), "chat-turns")
    return read_back(turns, cut(examples(turns), "chat-examples"))
