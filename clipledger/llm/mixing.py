"""Mixing sources to target weights by capped water-filling: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.support import WORD, stage

#: Weights by rank of the source, repeating; share of all sizes that is dealt out; most repetitions of a source.
WEIGHTS, SHARE_PERCENT, EPOCHS = (3, 1, 2), 150, 2
SEED = "mix-1"
SLICE_DIGITS = 3  # leading hex digits of the order: 4096 ranges in which a source's documents are lined up


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size); target = min(weight x level, EPOCHS x size).

    Pouring in rounds (clamp what is above its cap, deal the excess out by weight, repeat) ends at the level at which
    the capped shares add up to the total. Sources in order of cap / weight are clamped one after another, so the
    level is read off running sums. One row per source: the list of sources is the mix's configuration, so a window
    over all of it is small."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight.cast("bigint")).withColumn("cap", EPOCHS * F.col("source_size"))
    # Compared as whole numbers scaled by lcm(1, 2, 3), so ties are ties.
    caps = caps.withColumn("fill", F.col("cap") * 6 / F.col("weight"))
    every = Window.orderBy("fill", "rank")
    upto = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    lines = caps.withColumns({
        "total": F.sum("source_size").over(whole) * SHARE_PERCENT / 100.0,
        "spent": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "open": F.sum("weight").over(rest),
    }).withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
    # The first source in that order whose cap holds its share gives the level for all that follow.
    level = F.min_by(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level")),
                     F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct("fill", "rank"))).over(whole)
    return lines.withColumn("water", level).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("water"), F.col("cap").cast("double"))).alias("target"),
    )


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_m_size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint"))


_OWN = ["_m_none", "_m_src", "_m_slice"]


def _lined_up(docs: DataFrame, seed: str) -> DataFrame:
    """Adds what places a document in its source's line: source key, md5 of seed and doc_id, slice of that."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumns({
        "_m_none": F.col("source").isNull(), "_m_src": F.coalesce("source", F.lit("")), "_m_key": key,
    }).withColumn("_m_slice", F.substring("_m_key", 1, SLICE_DIGITS))


def _plan(lined: DataFrame) -> DataFrame:
    """Start of each slice in its source's line, with the source's size and target."""
    slices = lined.groupBy(*_OWN).agg(F.sum("_m_size").alias("n"))
    before = Window.partitionBy("_m_none", "_m_src").orderBy("_m_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = stage(slices.withColumn("_m_start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    sizes = slices.groupBy("_m_none", "_m_src").agg(F.sum("n").alias("source_size"))
    goals = targets(sizes.select(F.when(~F.col("_m_none"), F.col("_m_src")).alias("source"), "source_size")).select(
        F.col("source").isNull().alias("_m_none"), F.coalesce("source", F.lit("")).alias("_m_src"),
        F.col("source_size").alias("_m_total"), F.col("target").alias("_m_target"),
    )
    return stage(slices.join(goals, ["_m_none", "_m_src"]).select(*_OWN, "_m_start", "_m_total", "_m_target"))


def _with_taken(lined: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds _m_times (whole repetitions) and _m_part (words of the part taken once more)."""
    line = Window.partitionBy(*_OWN).orderBy("_m_key", "doc_id", "_m_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = lined.withColumn("_m_ahead", F.coalesce(F.sum("_m_size").over(line), F.lit(0))).join(plan, _OWN)
    goal, total = F.floor("_m_target"), F.col("_m_total")
    times = F.when(total > 0, F.floor(goal / F.greatest(total, F.lit(1)))).otherwise(0)
    left = F.greatest(goal - times * total - F.col("_m_start") - F.col("_m_ahead"), F.lit(0))
    return placed.withColumns({"_m_times": times, "_m_part": F.least(left, F.col("_m_size"))})


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents (doc_id, text, source).

    Every document is taken floor(target / source_size) times whole. What is left of the target is filled in seeded
    order of the documents (md5 of seed and doc_id): those before the mark once more, the one on it in part, so a
    source's taken words are its target rounded down. A source's documents are lined up within hash ranges, and the
    ranges' sums, 4096 a source at most, give the start of each, so no task gets a whole source.
    Null or empty text: size 0, taken 0. Null source: a source of its own, last. Repeated rows are taken each."""
    lined = stage(_lined_up(with_sizes(docs.select("doc_id", "text", "source")).drop("text"), seed))
    taken = F.col("_m_times") * F.col("_m_size") + F.col("_m_part")
    return _with_taken(lined, _plan(lined)).select(
        "doc_id", F.col("_m_size").alias("size"), F.col("_m_total").alias("source_size"), F.col("_m_target").alias("target"),
        taken.cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken whole, and the first words of the one on each source's
    mark. Columns stay; n_chars, where there is one, follows a shortened text. Rows without words are not taken."""
    sized = _lined_up(with_sizes(docs), seed)
    rows = _with_taken(sized, _plan(_lined_up(with_sizes(docs.select("doc_id", "text", "source")).drop("text"), seed)))
    whole = F.col("_m_times") + (F.col("_m_part") == F.col("_m_size")).cast("int")
    part = (F.col("_m_part") > 0) & (F.col("_m_part") < F.col("_m_size"))
    copies = rows.where("_m_size > 0").withColumn(
        "_m_copy", F.explode(F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array_repeat(F.lit(True), part.cast("int"))))
    )
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0), 1, F.col("_m_part").cast("int")), "")
    copies = copies.withColumn("text", F.when(F.col("_m_copy"), first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(F.col("_m_copy"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return copies.select(*docs.columns)
