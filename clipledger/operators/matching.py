"""Joins by path and by name. None of them is a nested loop: suffixes and substrings become keys."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions import paths
from clipledger.operators import ordered
from clipledger.session import cut_lineage


# --- path remap ---------------------------------------------------------------------------
def remap_paths(old_paths: DataFrame, inventory: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct old path -> best file of the inventory with the same basename.

    Best means the most shared trailing components, ties to the lowest ix; a single candidate wins
    whatever its folders; no candidate keeps the old path. The inventory is folded to one row per
    trailing suffix before the join, so a basename that fills a third of the inventory
    contributes one row per suffix and never a candidate list.
    """
    keys = keys or []
    asked = old_paths.select(*keys, "path").where("path <> ''").distinct()
    best = (
        inventory.select(*keys, "path", "ix", F.explode_outer(paths.trailing_suffixes(F.col("path"))).alias("s"))
        .groupBy(*keys, F.col("s.suffix").alias("suffix"))
        .agg(F.min_by(F.col("path"), F.col("ix")).alias("new_path"))
    )
    tails = asked.select(*keys, "path", F.explode_outer(paths.trailing_suffixes(F.col("path"))).alias("s")).select(
        *keys, "path", "s.depth", "s.suffix"
    )
    hit = (
        tails.join(best, [*keys, "suffix"])
        .groupBy(*keys, "path")
        .agg(F.max_by("new_path", "depth").alias("new_path"), F.max("depth").alias("overlap"))
    )
    return asked.join(hit, [*keys, "path"], "left").select(
        *keys, "path", F.coalesce("new_path", "path").alias("new_path"),
        F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap"),
    )


def remap_artifacts(artifacts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Artifacts with path replaced by the best file of the inventory (path, ix)."""
    moved = remap_paths(artifacts, inventory)
    return artifacts.join(moved.select("path", "new_path"), "path", "left").withColumn(
        "path", F.coalesce("new_path", "path")
    ).drop("new_path")


# --- adjacent sidecar ---------------------------------------------------------------------
def adjacent(clips: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Clips with the sidecar beside them, null where there is none."""
    there = sidecars.select("sidecar_path").distinct().withColumn("_there", F.lit(True))
    named = clips.withColumn("sidecar_path", paths.sidecar_for_clip(F.col("path")))
    joined = named.join(there, "sidecar_path", "left")
    return joined.withColumn("sidecar_path", F.when(F.col("_there"), F.col("sidecar_path"))).drop("_there")


# --- log-table merge ----------------------------------------------------------------------
def merge_log(clips: DataFrame, log: DataFrame, value: str) -> DataFrame:
    """Attach a log value: Tape + Start when the clip has a tape, Name only when tape is blank on both."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    by_tape = log.where(~blank("tape")).groupBy("tape", "start").agg(F.max_by(value, "ix").alias("_by_tape"))
    by_name = log.where(blank("tape")).groupBy("name").agg(F.max_by(value, "ix").alias("_by_name"))
    out = clips.join(by_tape, ["tape", "start"], "left").join(by_name, "name", "left")
    picked = F.when(blank("tape"), F.col("_by_name")).otherwise(F.col("_by_tape"))
    return out.withColumn(value, picked).drop("_by_tape", "_by_name")


# --- fuzzy name match ---------------------------------------------------------------------
def name_score(name: Column, base: Column, clip: Column) -> Column:
    """100 equal, 90 name in clip, 85 clip in name, 80 base in clip, 75 clip in base, else 0."""
    has_name, has_base, has_clip = (F.coalesce(c, F.lit("")) != "" for c in (name, base, clip))
    return (
        F.when(~has_clip, 0)
        .when(has_name & (name == clip), 100)
        .when(has_name & F.contains(clip, name), 90)
        .when(has_name & F.contains(name, clip), 85)
        .when(has_base & F.contains(clip, base), 80)
        .when(has_base & F.contains(base, clip), 75)
        .otherwise(0)
        .cast("bigint")
    )


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """All (needle, hay) with needle a substring of hay, over distinct non-empty strings.

    Every substring of a length some needle has becomes a join key, so the join is an equality on
    whole needles and returns true pairs only. A shared prefix adds keys, never candidate pairs.
    """
    small = needles.select("needle").where("needle <> ''").distinct()
    big = hays.select("hay").where("hay <> ''").distinct()
    lengths = small.select(F.length("needle").alias("len")).distinct()
    sized = big.select("hay", F.explode(F.sequence(F.lit(1), F.length("hay"))).alias("len")).join(
        lengths, "len", "left_semi"
    )
    cuts = sized.select(
        "hay",
        F.explode_outer(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("hay") - F.col("len") + 1),
                    lambda i: F.substr("hay", i, F.col("len")),
                )
            )
        ).alias("needle"),
    )
    return cuts.join(small, "needle")


def class_scores(classes: DataFrame, clip_names: DataFrame) -> DataFrame:
    """Distinct (name, base) against distinct clip names: the best tier of each pair that matches."""
    sides = classes.select(F.explode(F.array("name", "base")).alias("s")).where("s <> ''").distinct()
    clips = clip_names.select(F.col("clip_name").alias("s")).where("s <> ''").distinct()
    within = contained(sides.withColumnRenamed("s", "needle"), clips.withColumnRenamed("s", "hay")).select(
        F.col("needle").alias("side"), F.col("hay").alias("clip_name")
    )
    around = contained(clips.withColumnRenamed("s", "needle"), sides.withColumnRenamed("s", "hay")).select(
        F.col("hay").alias("side"), F.col("needle").alias("clip_name")
    )
    pairs = within.unionByName(around).distinct()
    by_name = classes.join(pairs, classes["name"] == pairs["side"]).select("name", "base", "clip_name")
    by_base = classes.join(pairs, classes["base"] == pairs["side"]).select("name", "base", "clip_name")
    both = by_name.unionByName(by_base).distinct()
    return both.withColumn("score", name_score(F.col("name"), F.col("base"), F.col("clip_name")))


CLASS = ["name", "base"]


def components(edges: DataFrame) -> DataFrame:
    """(name, base, clip_name) pairs to (clip_name, label): names that can reach each other share a label.

    Smallest-label exchange between the two sides with a jump to the label's own label each round,
    so the rounds grow with the logarithm of the longest chain. Works on distinct names only.
    """
    labels = cut_lineage(edges.select("clip_name").distinct().withColumn("label", F.col("clip_name")))
    while True:
        of_class = edges.join(labels, "clip_name").groupBy(*CLASS).agg(F.min("label").alias("label"))
        pushed = edges.join(of_class, CLASS).groupBy("clip_name").agg(F.min("label").alias("label"))
        above = pushed.select(F.col("clip_name").alias("label"), F.col("label").alias("_next"))
        old = labels.withColumnRenamed("label", "_old")
        moved = cut_lineage(
            pushed.join(above, "label").select("clip_name", F.least("label", "_next").alias("label")).join(old, "clip_name")
        )
        labels = moved.drop("_old")
        if moved.where("label <> _old").isEmpty():
            return labels


def _settled_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """The plain loop over one component's sidecars of a wave: each takes its best clip still free.

    Rows by kind: s a sidecar of a class, e that a class may have clips of a name at a score, c a clip of a name. The clips of a name
    go in order of clip_ix, so a name is a queue, and a class sees at each score the queues of its names as a heap by their first
    clip; an entry whose clip has gone is renewed when it comes up."""
    queues = {
        name: g["ix"].sort_values().tolist() for name, g in pdf[pdf["kind"] == "c"].groupby("clip_name", sort=False)
    }
    at = dict.fromkeys(queues, 0)
    tiers: dict[str, list[tuple[int, list]]] = {}
    edges = pdf[(pdf["kind"] == "e") & pdf["clip_name"].isin(queues)]
    for (key, score), g in edges.sort_values(["class_key", "score"], ascending=[True, False]).groupby(["class_key", "score"], sort=False):
        heap = [(queues[name][0], name) for name in g["clip_name"]]
        heapq.heapify(heap)
        tiers.setdefault(key, []).append((score, heap))
    out = []
    for side, key in pdf[pdf["kind"] == "s"][["ix", "class_key"]].sort_values("ix").itertuples(index=False):
        for score, heap in tiers.get(key, ()):
            while heap:
                clip, name = heap[0]
                queue, i = queues[name], at[name]
                if i == len(queue):
                    heapq.heappop(heap)
                elif queue[i] != clip:
                    heapq.heapreplace(heap, (queue[i], name))
                else:
                    break
            if heap:
                at[name] = i + 1
                out.append((side, clip, score, name))
                break
    return pd.DataFrame(out, columns=["sidecar_ix", "clip_ix", "score", "clip_name"])


def waves(members: DataFrame, block: int) -> DataFrame:
    """Adds wave: sidecars of a component in order of sidecar_ix, block of them a wave."""
    placed = ordered.number_rows(members, ["label"], ordered.block_segment(F.col("sidecar_ix")), ["sidecar_ix"], "_n")
    return placed.withColumn("wave", F.floor((F.col("_n") - 1) / F.lit(block))).drop("_n")


def assign(sidecars: DataFrame, clips: DataFrame, threshold: int = 65, block: int = 100_000) -> DataFrame:
    """One-to-one match: in sidecar order, each takes its best clip still free, ties to the lowest clip_ix.

    sidecars: sidecar_ix, name, base; clips: clip_ix, clip_name. Returns sidecar_ix, clip_ix, score.

    Names that cannot reach each other do not compete, so each connected component is settled on its own, in waves of at most
    block sidecars: wave n takes the n-th block of every component at once. The clips of a name are used up in order of
    clip_ix, so all that a wave leaves to the next is how many of each name are gone, and all it is given are its sidecars, the
    names their classes may have, and of each name the next clips, as many as these sidecars could take. There is no row per
    class and clip, no component is one task, and the number of waves is the largest component's sidecars over block.
    """
    members = sidecars.select(
        "sidecar_ix", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("base", F.lit("")).alias("base")
    )
    scores = cut_lineage(
        class_scores(members.select(*CLASS).distinct(), clips.select("clip_name").distinct()).where(F.col("score") >= threshold)
    )
    key = F.to_json(F.array("name", "base")).alias("class_key")
    edges = cut_lineage(scores.join(components(scores), "clip_name").select("label", *CLASS, key, "clip_name", "score"))
    labels = edges.select(*CLASS, "class_key", "label").distinct()
    members = cut_lineage(waves(members.join(labels, CLASS).select("sidecar_ix", "class_key", "label"), block))
    queued = clips.join(edges.select("clip_name").distinct(), "clip_name", "left_semi").select("clip_name", "clip_ix")
    queued = cut_lineage(ordered.number_rows(queued, ["clip_name"], ordered.block_segment(F.col("clip_ix")), ["clip_ix"], "_place"))
    last = members.agg(F.max("wave")).first()[0]
    done, gone = None, None
    for wave in range(0 if last is None else last + 1):
        new = _wave(members.where(F.col("wave") == wave), edges, queued, gone)
        new = cut_lineage(new)
        done = new if done is None else done.unionByName(new)
        gone = done.groupBy("clip_name").agg(F.count(F.lit(1)).alias("_gone"))
    if done is None:
        return members.select("sidecar_ix", F.col("sidecar_ix").alias("clip_ix"), F.lit(0).cast("bigint").alias("score")).limit(0)
    return done.drop("clip_name")


def _wave(members: DataFrame, edges: DataFrame, queued: DataFrame, gone: DataFrame | None) -> DataFrame:
    """sidecar_ix, clip_ix, score, clip_name of one wave; gone has the number of clips taken of each name before."""
    asking = members.groupBy("class_key").agg(F.count(F.lit(1)).alias("_asking"))
    wanted = edges.join(asking, "class_key")
    most = wanted.groupBy("clip_name").agg(F.sum("_asking").alias("_most"), F.min("label").alias("label"))
    if gone is not None:
        most = most.join(gone, "clip_name", "left")
    used = F.coalesce("_gone", F.lit(0)) if gone is not None else F.lit(0)
    given = queued.join(most, "clip_name").where((F.col("_place") > used) & (F.col("_place") <= used + F.col("_most")))
    rows = (
        members.select("label", F.lit("s").alias("kind"), "class_key", F.col("sidecar_ix").alias("ix"))
        .unionByName(wanted.select("label", F.lit("e").alias("kind"), "class_key", "clip_name", "score"), allowMissingColumns=True)
        .unionByName(given.select("label", F.lit("c").alias("kind"), "clip_name", F.col("clip_ix").alias("ix")), allowMissingColumns=True)
    )
    # Kinds leave some columns empty; a long that pandas reads with gaps would turn to floating point.
    whole = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("ix", "score")})
    return whole.groupBy("label").applyInPandas(_settled_groups, "sidecar_ix bigint, clip_ix bigint, score bigint, clip_name string")
