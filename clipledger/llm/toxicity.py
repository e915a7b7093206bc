"""Toxicity by two class-conditional Kneser-Ney models of expressions.

An expression is a word's first STEM bytes, lower case, hashed into a table of fixed size (the documented bound of the
model). What is counted, in the manner of Kneser and Ney, is in how many contexts, here training texts, an expression
occurs, per class. A class's probability of an expression is its discounted share of the class; what the discounts free goes
to the shared backoff, the expression's contexts in both classes together. The discount grows with the root of the count,
so a rare expression is left to the backoff and judged alike by both models.

Toxic minus ordinary log-likelihood is compared per length: the mean over the whole text, and the largest mean over
any passage of 1 and of 8 words, so that length does not thin out one toxic passage. A logistic curve over the three, fitted on a
part of the training rows that the counts leave out, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.support import Rolling, stage

TABLE_BITS, STEM, SPAN = 18, 5, 4096
DISCOUNT, DISCOUNT_ROOT = 0.75, 1.0
PASSAGES = (1, 8)
#: Labelled rows the curve is fitted on, in order of a hash.
CALIBRATION_ROWS = 20_000
FOLDS, HELD_OUT, CURVE = 5, 0, 4

_SIZE = 1 << TABLE_BITS
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def expressions(text: str) -> np.ndarray:
    """Table slot of each word; words are runs of letters, digits and everything beyond ASCII."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return (Rolling(data).of(start, np.minimum(end, start + STEM)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text as the slots it holds, once each: what moves to the labels in place of the text."""
    for frame in frames:
        held = [np.unique(expressions(t or "")).astype(np.int32).tobytes() for t in frame["text"]]
        yield frame.drop(columns="text").assign(slots=held)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of the task's texts hold each expression, per class, in spans of the table; empty spans are left out."""
    counts = np.zeros((2, _SIZE), np.int64)
    for frame in frames:
        for slots, toxic in zip(frame["slots"], frame["toxic"]):
            counts[toxic][np.frombuffer(slots, np.int32)] += 1
    rows = [
        (c, at // SPAN, counts[c, at : at + SPAN].tobytes())
        for c in (0, 1) for at in range(0, _SIZE, SPAN) if counts[c, at : at + SPAN].any()
    ]
    yield pd.DataFrame(rows, columns=["toxic", "span", "data"])


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per span from any number of them."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for frame in frames:
        for toxic, span, data in zip(frame["toxic"], frame["span"], frame["data"]):
            new = np.frombuffer(data, np.int64)
            held[toxic, span] = held[toxic, span] + new if (toxic, span) in held else new
    yield pd.DataFrame([(c, s, x.tobytes()) for (c, s), x in held.items()], columns=["toxic", "span", "data"])


_ROWS = "toxic int, span int, data binary"


def gather(training: DataFrame) -> np.ndarray:
    """Counts over all training rows (slots, toxic), one row per class.

    What a task holds and what comes to the driver is one table (4 MB), however many rows there are; a span's counts are
    added up in two steps, so no task meets the tables of all."""
    local = training.mapInPandas(_counted, _ROWS).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    some = local.repartition("span", "part").drop("part").mapInPandas(_added, _ROWS)
    counts = np.zeros((2, _SIZE), np.int64)
    for toxic, span, data in some.repartition("span").mapInPandas(_added, _ROWS).collect():
        counts[toxic, span * SPAN : (span + 1) * SPAN] = np.frombuffer(data, np.int64)
    return counts


def evidence_table(counts: np.ndarray) -> np.ndarray:
    """log P(expression | toxic) - log P(expression | ordinary) of every slot."""
    both = counts.sum(0)
    shared = (both + 0.5) / (both.sum() + 0.5 * len(both))
    logs = []
    for own in counts.astype(np.float64):
        off = np.minimum(own, DISCOUNT + DISCOUNT_ROOT * np.sqrt(own))
        total = max(own.sum(), 1.0)
        logs.append(np.log((own - off) / total + max(off.sum() / total, 1e-9) * shared))
    return (logs[1] - logs[0]).astype(np.float32)


def evidence(table: np.ndarray, text: str) -> list[float]:
    """Best passage of each length, then the whole text; zeros for a text without words."""
    each = table[expressions(text)].astype(np.float64)
    if not len(each):
        return [0.0] * (len(PASSAGES) + 1)
    sums = np.r_[0.0, np.cumsum(each)]
    best = [float((sums[n:] - sums[:-n]).max() / n) for n in (min(p, len(each)) for p in PASSAGES)]
    return [*best, float(each.mean())]


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weight of each feature and offset of a logistic curve by Newton's steps, with a weak pull to 0."""
    width = x.shape[1] + 1
    if not len(x) or y.min() == y.max():
        return np.r_[np.zeros(width - 1), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))]
    scale = np.maximum(x.std(0), 1e-9)
    z, beta = np.c_[x / scale, np.ones(len(x))], np.zeros(width)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - q) - 0.1 * np.r_[beta[:-1], 0.0]
        step = np.clip(np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(width), grad), -1, 1)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[beta[:-1] / scale, beta[-1]]


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents (doc_id, text).

    Labels are learned from rows whose remainder is not HELD_OUT: counts from all but the remainder CURVE, the curve from up
    to CALIBRATION_ROWS of that. Contradictory labels count as toxic; null labels are not used. Null or empty text has no
    evidence and the curve's score for that. Null doc_id: scored, not held out. Where the curve's rows lack a class, every
    score is their share of toxic ones."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    ).where(remainder() != HELD_OUT)
    rows = docs.select("doc_id", "text")
    for_counts = ~remainder().isin(HELD_OUT, CURVE)
    held = rows.where(for_counts).mapInPandas(_slots, "doc_id bigint, slots binary")
    table = evidence_table(gather(held.join(known.where(for_counts), "doc_id").select("slots", "toxic")))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(evidence=[evidence(shared.value, t or "") for t in frame["text"]])

    judged = stage(rows.mapInPandas(run, "doc_id bigint, evidence array<double>"))
    curve = judged.where(remainder() == CURVE).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        CALIBRATION_ROWS
    ).select("evidence", "toxic").toPandas()
    x = np.array(curve["evidence"].tolist(), float).reshape(-1, len(PASSAGES) + 1)
    *weights, offset = fit_curve(x, curve["toxic"].to_numpy(float)).tolist()
    logit = sum((F.lit(w) * F.col("evidence")[i] for i, w in enumerate(weights)), F.lit(offset))
    score = 1 / (1 + F.exp(-logit))
    return judged.select(
        "doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )
