"""Turns of conversations: keys, order and places, without moving any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.operators import ordered

#: Turn numbers of one segment: what one task lines up of a conversation, however long that is.
SPAN = 4096


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of a text as UTF-8."""
    return F.crc32(F.encode(text, "UTF-8"))


def turn_key(role: Column, text: Column) -> Column:
    """Hex SHA-256 of a role and a text, the role's length first so that no other pair gives the same bytes."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def place(rows: DataFrame, own: str = "conv_id", out: str = "at") -> DataFrame:
    """Adds the 1-based place of each row in its conversation, in order of turn (null first), then key.

    A conversation is cut along its order: by blocks of turn numbers, and rows without a turn by the head of their key.
    One summary row per block carries the count on, so a conversation with a third of all rows is many tasks.
    own must not be null; wrap a key that may be in a struct."""
    block = F.floor(F.col("turn") / F.lit(SPAN))
    segment = F.struct(block.alias("b"), F.when(F.col("turn").isNull(), F.substring("key", 1, 3)).alias("k"))
    return ordered.number_rows(rows, [own], segment, ["turn", "key"], out)
