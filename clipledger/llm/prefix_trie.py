"""Trie of conversation prefixes by fixed-length block hashing.

Every turn has a hash of its place, role and text, in four words of 32 bits; a prefix is known by the sums of its turns' words,
so the digest of a block of turns is a sum, and so is that of a prefix of blocks. Conversations are grouped by successive
block digests first. Where a block has no sibling below its parent, its turns are nodes as they stand, with the members of the
block. Only inside blocks that have siblings are the turn boundaries refined, once per distinct block, not per conversation.

No text moves: a turn is its key and its length from the first step on. Sums need no order of work, so a conversation with a third of
all turns is cut into segments. Copies fold into one row per task before they move. Subtree figures are sums over members,
never over paths: a conversation saves the turns before the first node of which it is the smallest member, and has a leaf if the node
where it ends has no child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm import turns
from clipledger.llm.support import written

#: Turns of a block.
BLOCK = 4
#: Ids joined to one text before they move on to their node's digest.
RUN = 500

_WORDS = ["w0", "w1", "w2", "w3"]
_NONE = hashlib.sha256(b"").hexdigest()


def _zero() -> Column:
    """Digest of the empty prefix."""
    return F.struct(*[F.lit(0).cast("bigint").alias(w) for w in _WORDS])


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key and chars (code points) of every row with a conv_id; null role or text counts as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        turns.turn_key(role, text).alias("key"), F.char_length(text).cast("bigint").alias("chars"),
    )


def _words(at: Column, key: Column) -> list[Column]:
    digest = F.sha2(F.concat(at.cast("string"), F.lit(":"), key), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(w) for i, w in enumerate(_WORDS)]


def _blocks(placed: DataFrame) -> DataFrame:
    """One row per conversation and block: s and e, the digests of the prefix before and after it, pre, the code points before it, and
    items, its turns (BLOCK at most) in order."""
    at = F.col("at")
    cut = placed.select(
        "conv_id", "at", "chars", *_words(at, F.col("key")), F.floor((at - 1) / F.lit(turns.SPAN)).alias("seg"),
        F.floor((at - 1) / F.lit(BLOCK)).alias("k"),
    ).repartition("conv_id", "seg")
    sums = [*_WORDS, "chars"]
    folded = cut.groupBy("conv_id", "seg", "k").agg(
        F.sort_array(F.collect_list(F.struct("at", "chars", *_WORDS))).alias("items"), *[F.sum(c).alias(c) for c in sums]
    )
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    nought = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    inside = before(Window.partitionBy("conv_id", "seg").orderBy("k"))
    local = folded.select("*", *[nought(F.sum(c).over(inside)).alias(f"_{c}") for c in sums])
    totals = folded.groupBy("conv_id", "seg").agg(*[F.sum(c).alias(c) for c in sums])
    along = before(Window.partitionBy("conv_id").orderBy("seg"))
    carry = totals.select("conv_id", "seg", *[nought(F.sum(c).over(along)).alias(f"_c_{c}") for c in sums])
    start = {c: F.col(f"_{c}") + F.col(f"_c_{c}") for c in sums}
    return local.join(carry, ["conv_id", "seg"]).select(
        "conv_id", "k", F.struct(*[start[w].alias(w) for w in _WORDS]).alias("s"),
        F.struct(*[(start[w] + F.col(w)).alias(w) for w in _WORDS]).alias("e"), start["chars"].alias("pre"), "chars", "items",
    )


#: What a node sums over its members: their number, the smallest, and of a second pass saved, leaf and the smallest one's saved.
_FIGURES = ["conv_id", "n_convs", "saved", "leaf", "own_saved"]


def _figures() -> list[Column]:
    return [
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _FIGURES[1:4]], F.min_by("own_saved", "conv_id").alias("own_saved")
    ]


def _nodes(blocks: DataFrame) -> DataFrame:
    """One row per node below the root: depth, id, parent (the id of its parent), pre, the code points before its last text, and the
    figures of its members."""
    distinct = blocks.groupBy("k", "s", "e").agg(*_figures(), F.first("items").alias("items"), F.first("pre").alias("pre"))
    alone = distinct.groupBy("k", "s").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("k", "s", F.lit(True).alias("alone"))
    marked = distinct.join(alone, ["k", "s"], "left")

    def summed(n: Column, start: Column, field: str) -> Column:
        return F.aggregate(F.slice("items", 1, n), start, lambda a, x: a + x[field])

    def prefix(n: Column) -> Column:
        return F.struct(*[summed(n, F.col(f"s.{w}"), w).alias(w) for w in _WORDS])

    steps = F.transform(
        F.sequence(F.lit(1), F.size("items")),
        lambda j: F.struct(
            (F.col("k") * BLOCK + j).cast("bigint").alias("depth"), prefix(j).alias("id"), prefix(j - 1).alias("parent"),
            summed(j - 1, F.col("pre"), "chars").alias("pre"),
        ),
    )
    opened = marked.select("alone", *_FIGURES, F.explode(steps).alias("n")).select("alone", *_FIGURES, "n.*")
    whole = opened.where("alone").drop("alone")
    refined = opened.where("alone is null").groupBy("depth", "id").agg(
        *_figures(), F.first("parent").alias("parent"), F.first("pre").alias("pre")
    )
    return whole.unionByName(refined)


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (node, conv_id) to texts of RUN ids at most."""
    node, ids = None, []
    for pdf in batches:
        out = []
        for key, conv in zip(pdf["node"], pdf["conv_id"]):
            if key != node or len(ids) >= RUN:
                if ids:
                    out.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = key, []
            ids.append(int(conv))
        yield pd.DataFrame(out, columns=["node", "first_id", "ids"])
    if ids:
        yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))], columns=["node", "first_id", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted texts of a node to the SHA-256 of them all, fed one by one."""
    node, sha = None, None
    for pdf in batches:
        out = []
        for key, ids in zip(pdf["node"], pdf["ids"]):
            if key != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if sha is not None:
        yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])


def _node_text(depth: Column, at: Column) -> Column:
    return F.concat_ws("-", depth.cast("string"), *[at[w].cast("string") for w in _WORDS])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) to (node, ends_sha256): SHA-256 of the node's conv_ids, ascending, comma-joined.

    The ids are sorted over range partitions, so a node with a third of all conversations is joined up by many tasks; the
    one that digests it reads a row for RUN ids and holds one at a time."""
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(
        _joined_ids, "node string, first_id bigint, ids string"
    )
    return runs.repartition("node").sortWithinPartitions("node", "first_id").mapInPandas(_digests, "node string, ends_sha256 string")


def trie(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the conversations ids (conv_id, distinct) with the turns placed (conv_id, at from 1 without gaps, key, chars).

    One row per node: conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Conversations without turns are members of the root alone; without conversations there is no node."""
    blocks = written(_blocks(placed))
    whole = blocks.groupBy("conv_id").agg(
        F.max_by(F.struct("e", (F.col("pre") + F.col("chars")).alias("total"), (F.col("k") * BLOCK + F.size("items")).alias("depth")), "k")
        .alias("w")
    )
    convs = written(
        ids.join(whole, "conv_id", "left").select(
            "conv_id", F.coalesce("w.e", _zero()).alias("e"), *[F.coalesce(f"w.{c}", F.lit(0)).cast("bigint").alias(c) for c in ("total", "depth")]
        )
    )
    smallest = convs.agg(F.min("conv_id")).first()[0]
    nothing = F.lit(0).cast("bigint")
    first = _nodes(blocks.withColumns({"n_convs": F.lit(1).cast("bigint"), "saved": nothing, "leaf": nothing, "own_saved": nothing}))
    first = written(first.select("conv_id", "depth", "id", "parent", "pre"))
    children = first.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    children = written(children)

    root = ids.sparkSession.range(1).select(
        F.lit(smallest).cast("bigint").alias("conv_id"), nothing.alias("depth"), _zero().alias("id"),
        F.lit(None).cast(first.schema["parent"].dataType).alias("parent"), nothing.alias("pre"),
    ).where("conv_id is not null")
    named = first.unionByName(root).join(children, ["depth", "id"], "left")
    owned = named.groupBy("conv_id").agg(
        F.min_by("pre", "depth").alias("_saved"), F.count_if(F.col("n_children").isNull()).alias("_leaf")
    )
    figures = convs.join(owned, "conv_id", "left").select(
        "conv_id", F.lit(1).cast("bigint").alias("n_convs"), F.coalesce("_saved", "total").alias("saved"),
        F.coalesce("_leaf", nothing).alias("leaf"),
    ).withColumn("own_saved", F.col("saved"))
    figures = written(figures)
    below = _nodes(blocks.join(figures, "conv_id"))
    top = figures.agg(*_figures()).where("conv_id is not null").select(
        "*", nothing.alias("depth"), _zero().alias("id"), F.lit(None).cast(first.schema["parent"].dataType).alias("parent"), nothing.alias("pre")
    )
    above = first.select((F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("_above"))
    every = below.join(above, ["depth", "parent"], "left").unionByName(top, allowMissingColumns=True)
    every = every.join(children, ["depth", "id"], "left")
    ends = end_digests(convs.select(_node_text(F.col("depth"), F.col("e")).alias("node"), "conv_id"))
    parent = F.when(F.col("depth") == 1, F.lit(smallest)).when(F.col("depth") > 1, F.col("_above"))
    saved = F.col("saved") - F.col("own_saved") - (F.col("n_convs") - 1) * F.col("pre")
    return every.withColumn("node", _node_text(F.col("depth"), F.col("id"))).join(ends, "node", "left").select(
        "conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", nothing).alias("n_children"), F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations (conv_id, turn, role, text) as they stand; see trie for the columns.

    Turns stand in order of turn, null first; rows of one turn in order of the SHA-256 of role and text, so repeated rows are repeated
    turns. Null role or text is empty. Rows without conv_id belong to no conversation and are left out. Other columns, whatever their
    names, are not read. An empty table gives no row."""
    placed = written(turns.place(turn_keys(conversations)))
    return trie(placed, conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct())


def shared_starts(conversations: DataFrame, step: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(placed turns, ids) of conversations rebuilt to share beginnings: conversation c takes the first h turns of conversation
    c - c % step, then its own after its first h; h is the CRC-32 of its decimal id modulo most."""
    placed = written(turns.place(turn_keys(conversations)))
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    donor = F.col("conv_id") - F.col("conv_id") % step
    cut = (turns.crc(F.col("conv_id").cast("string")) % most).cast("bigint")
    # most - 1 rows a donor at most, and the donor of step conversations on either side of nought.
    gifts = placed.where((F.col("conv_id") % step == 0) & (F.col("at") < most))
    lent = gifts.select(F.col("conv_id").alias("_from"), "at", "key", "chars")
    heads = ids.select("conv_id", donor.alias("_from"), cut.alias("_h")).join(lent, "_from").where("at <= _h")
    sizes = gifts.groupBy(F.col("conv_id").alias("_from")).agg(F.count(F.lit(1)).alias("_n"))
    tails = placed.withColumns({"_from": donor, "_h": cut}).where("at > _h").join(sizes, "_from", "left")
    moved = F.col("at") - F.col("_h") + F.least("_h", F.coalesce("_n", F.lit(0)))
    return heads.select("conv_id", "at", "key", "chars").unionByName(
        tails.select("conv_id", moved.cast("bigint").alias("at"), "key", "chars")
    ), ids
