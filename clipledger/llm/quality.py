"""Quality rules with risk-controlled cutoffs: DataFrame functions only.

Base rules are fixed. On top, each signal (symbols, repeated lines, repeated words, long words) gets a cutoff per
stratum (language). Documents labelled good are the holdout: a cutoff may be used only if the exact binomial
tail of its false rejections, P(X <= k) for X ~ Binomial(n, alpha), is at most delta / (strata x signals). Cutoffs of a
signal are tested from lenient to strict and testing stops at the first that fails (fixed sequence), so no further
correction is needed along the grid. Among certified cutoffs the one that rejects most labelled bad
documents is taken, the most lenient of equals; a signal that rejects no more bad than good ones is not used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.support import WORD, broadcast_if_small, stage

WINDOW = 8
#: Grids, lenient to strict, in thousandths (long words: hundredths of a character per word). Fixed values.
CUTOFFS = {
    "symbols": [500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10],
    "dup_lines": [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
    "repeats": [290, 270, 250, 230, 210, 190, 170, 150, 130, 110],
    "long_words": [4000, 3000, 2500, 2000, 1800, 1600, 1400, 1200, 1100, 1000],
}
#: Limit of false rejections per stratum over all signals, and chance that any stratum breaks it.
ALPHA, DELTA = 0.02, 0.05
#: More strata than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_STRATA = 10_000


def _shifted(name: str, by: int) -> Column:
    """zip of an array of hashes with itself, `by` places on: the hash of each span twice as long."""
    n = F.greatest(F.size(name) - by, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(name, by + 1, n), lambda x, y: F.xxhash64(x, y))


def with_metrics(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Adds the base counts of a text, under the prefix, to any frame; null text counts as empty.

    Repeated 8-word windows are found by 64-bit hashes of the windows, built by doubling (2, 4, 8 words)."""
    p = prefix
    t, words, lines = f"{p}t", f"{p}words", f"{p}lines"
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({
        words: F.regexp_extract_all(t, F.lit(WORD), 0),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
        f"{p}word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        f"{p}n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
    })
    out = out.withColumns({
        f"{p}n_words": F.size(words).cast("bigint"),
        f"{p}n_lines": F.size(lines).cast("bigint"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        f"{p}h1": F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(words, lines, t)
    span, name = 1, f"{p}h1"
    while span < WINDOW:
        longer = f"{p}h{2 * span}"
        out = out.withColumn(longer, _shifted(name, span)).drop(name)
        span, name = 2 * span, longer
    # Positions of windows that occur twice or more: neighbours in hash order with equal hashes.
    order, twice = f"{p}order", f"{p}twice"
    out = out.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(name)) < F.size(name),
            F.array_sort(F.transform(name, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop(name)
    n = F.greatest(F.size(order) - 1, F.lit(0))
    out = out.withColumn(
        twice,
        F.array_sort(F.array_distinct(F.flatten(F.zip_with(
            F.slice(order, 1, n), F.slice(order, 2, n),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )))),
    ).drop(order)
    gaps = F.zip_with(
        twice, F.slice(twice, 2, F.greatest(F.size(twice) - 1, F.lit(0))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
    )
    out = out.withColumn(
        f"{p}n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint")
    ).drop(twice)
    n_words, repeats = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    return out.withColumns({
        f"{p}word_chars": F.col(f"{p}word_chars").cast("bigint"), f"{p}n_symbols": F.col(f"{p}n_symbols").cast("bigint"),
        f"{p}base_failed": (n_words < 20) | (100 * repeats > 30 * n_words),
    })


def signals(prefix: str = "_q_") -> dict[str, Column]:
    """Whole numbers, higher is worse; none where the base rule has failed already."""
    c = lambda x: F.col(f"{prefix}{x}")
    share = lambda x, y, k: F.floor(k * c(x) / F.greatest(c(y), F.lit(1)))
    return {
        "symbols": share("n_symbols", "word_chars", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000), "long_words": share("word_chars", "n_words", 100),
    }


def stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit("(none)"))


def _lgamma(x: Column) -> Column:
    """Stirling's series ten places up, then back down the recurrence."""
    z = x + 10.0
    down = reduce(lambda a, b: a + b, [F.log(x + float(i)) for i in range(10)])
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3.0)) + 1 / (1260 * F.pow(z, 5.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact to rounding where k < n p; 1 elsewhere.

    Summed downwards from k; twelve standard deviations below k nothing is left to add."""
    kd, nd = k.cast("double"), n.cast("double")
    top = _lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 + 12 * F.sqrt(nd * p)).cast("bigint"))
    odds = (1 - p) / p
    summed = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, j: F.struct(
            (s["term"] * (kd - j) * odds / (nd - kd + j + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return F.when(kd < nd * p, F.exp(top) * summed).otherwise(F.lit(1.0))


def cutoffs(measured: DataFrame, labels: DataFrame, prefix: str = "_q_") -> DataFrame:
    """(stratum, one column per signal; null where no cutoff is certified) from labelled rows.

    measured: doc_id, lang and the columns of with_metrics. labels: doc_id, quality. A document with
    contradictory labels counts as bad, one without a label or with a null label is not used."""
    verdict = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("good")
    )
    found = signals(prefix)
    rows = measured.where(~F.col(f"{prefix}base_failed")).select(
        "doc_id", stratum().alias("stratum"), *[v.alias(k) for k, v in found.items()]
    ).join(verdict, "doc_id")
    grid = F.array(*[
        F.struct(F.lit(s).alias("signal"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"))
        for s in found for i, c in enumerate(CUTOFFS[s])
    ])
    # Where each row first falls: rejected by every cutoff from that step on. Counts per step are then running sums.
    first = lambda s: sum((F.when(F.col(s) <= c, 1).otherwise(0) for c in CUTOFFS[s]), F.lit(0))
    fell = rows.select(
        "stratum", "good",
        F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), first(s).alias("step")) for s in found])).alias("x"),
    ).groupBy("stratum", "x.signal", "x.step").agg(
        F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(1 - F.col("good").cast("bigint")).alias("bad")
    )
    fell = stage(fell)
    totals = fell.groupBy("stratum", "signal").agg(F.sum("good").alias("n"))
    steps = totals.select("stratum", "n", F.explode(grid).alias("g"), F.col("signal").alias("own")).where(
        "g.signal = own"
    ).select("stratum", "n", "g.*")
    counts = steps.join(
        fell.select("stratum", "signal", F.col("step").alias("at"), "good", "bad"), ["stratum", "signal"]
    ).groupBy("stratum", "signal", "step", "cutoff", "n").agg(
        F.sum(F.when(F.col("at") <= F.col("step"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("at") <= F.col("step"), F.col("bad")).otherwise(0)).alias("caught"),
    )
    tests = totals.agg(F.greatest(F.count("*"), F.lit(1)).alias("tests"))
    judged = counts.crossJoin(F.broadcast(tests)).withColumn(
        "holds", binomial_tail(F.col("k"), F.col("n"), ALPHA / len(found)) <= DELTA / F.col("tests")
    )
    # Certified: before the first step that fails.
    failed = judged.groupBy("stratum", "signal").agg(F.min(F.when(~F.col("holds"), F.col("step"))).alias("stop"))
    usable = judged.join(failed, ["stratum", "signal"]).where(
        "(stop is null or step < stop) and caught > k and caught > 0"
    )
    best = usable.groupBy("stratum", "signal").agg(
        F.max_by("cutoff", F.struct(F.col("caught"), -F.col("step"))).alias("cutoff")
    )
    return stage(best.groupBy("stratum").agg(*[
        F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in found
    ]))


def with_verdict(measured: DataFrame, cuts: DataFrame, prefix: str = "_q_", out: str = "kept") -> DataFrame:
    """Adds the verdict: false where the base rule failed or a signal is above its stratum's cutoff."""
    names = {c: f"{prefix}{c}" for c in cuts.columns}
    own = broadcast_if_small(cuts.withColumnsRenamed(names), MAX_BROADCAST_STRATA)
    joined = measured.join(own, stratum() == F.col(f"{prefix}stratum"), "left")
    over = [F.coalesce(v > F.col(f"{prefix}cut_{s}"), F.lit(False)) for s, v in signals(prefix).items()]
    return joined.withColumn(out, ~(F.col(f"{prefix}base_failed") | reduce(lambda a, b: a | b, over))).drop(
        *names.values()
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every row of documents (doc_id, text, lang).

    Null or empty text: no words, base rule fails. Repeated rows each get their row. Null lang is a
    stratum of its own. No labels, or too few to certify a cutoff: the base rule alone decides."""
    p = "_q_"
    measured = stage(with_metrics(docs.select("doc_id", "text", "lang")).drop("text"))
    judged = with_verdict(measured, cutoffs(measured, labels))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc_id", *[F.col(f"{p}{c}").alias(c) for c in cols], "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Metrics are computed again rather than joined to the texts, so no
    text is shuffled."""
    p = "_q_"
    measured = stage(with_metrics(docs.select("doc_id", "text", "lang")).drop("text"))
    cuts = cutoffs(measured, labels)
    # The row number keeps the optimiser from pushing the verdict's base rule, with all its steps written out in full,
    # below the projections that compute them one after another.
    fixed = with_metrics(docs).withColumn(f"{p}row", F.monotonically_increasing_id())
    judged = with_verdict(fixed, cuts, out=f"{p}kept")
    return judged.where(F.col(f"{p}kept") & (F.col(f"{p}row") >= 0)).select(*docs.columns)
