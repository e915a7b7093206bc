"""Exact repeats across documents by longest-previous-factor arrays.

A byte goes if it lies in a string of MATCH bytes that also starts in a document with a smaller id. A suffix array over
all bytes of a corpus is out of reach, so the positions that can matter are found first, without loss:

1. Anchors. In every stretch of MATCH bytes the GRAM-byte string with the smallest hash is an anchor, so a repeated
   stretch has its anchor in both documents. Anchors that one document only holds are done with.
2. Contexts. An anchor's context is all bytes of the stretches it can be the anchor of. Contexts meet in buckets of their
   anchors. One that an earlier document holds as well has all its stretches repeated; of equal contexts only the first
   goes on.
3. Suffixes. Contexts whose half, left or right of the anchor, no other document has go no further on that side. Of the
   stretches of what is left, runs of those whose hash a smaller document's has as well are looked for. The suffixes at
   the heads of the runs and their equals are sorted in suffix order. For each the previous and the next one from a smaller
   document give the longest previous factor, as long as the longer of the two common prefixes. Where it reaches MATCH the
   stretch is a repeat, and so is one more for each byte beyond; what is left of a run goes in again.

Anchors that more than about LARGE contexts have do not go into a bucket: their contexts and stretches are dealt out by
themselves, one by one. There, and for anchors, every step is taken inside a task first: what has an earlier equal there is
settled and only goes along under a key of its own, so the rows of one key are at most one per task and batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.support import Rolling, mix, release, stage, written

MATCH, GRAM = 50, 20
TURNS = 3  # stretches are compared in so many parts by their hash, so that the rows of one lie on disk at a time
PIECE = 1000  # documents whose contexts a task holds at once
BUCKET, LARGE = 20_000, 60_000  # contexts that a task compares at once, and those of one anchor
SHARE = 32  # of so many documents one is counted to find the anchors with more
_REACH = MATCH - GRAM  # how far before its anchor a stretch can start
_HALF = _REACH // 2
_KEY = MATCH - _HALF  # bytes that all stretches on one side of an anchor hold
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = pick(x[: len(x) - done], x[done:]), 2 * done
    rest = width - done
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The GRAM bytes at each position as three overlapping words."""
    n = max(len(data) - GRAM + 1, 0)
    if not n:
        return (np.zeros(0, np.uint64),) * 3
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    return words[:n], words[8 : 8 + n], words[GRAM - 8 : GRAM - 8 + n]


def _order(data: np.ndarray) -> np.ndarray:
    """What tells which of a stretch's grams is its anchor: the least. Of equal ones, each is."""
    x, y, z = _words(data)
    return (x * _FACTORS[0] + y * _FACTORS[1] + z * _FACTORS[2] >> np.uint64(32)).astype(np.uint32)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors; none in a text shorter than MATCH."""
    if len(data) < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _order(data)
    least = _sliding(grams, _REACH + 1, np.minimum)
    # A gram is an anchor if it is the least of some stretch it lies in: then the largest of those least values is its own.
    padded = np.concatenate([np.zeros(_REACH, np.uint32), least, np.zeros(_REACH, np.uint32)])
    at = np.flatnonzero(_sliding(padded, _REACH + 1, np.maximum) == grams)
    x, y, z = (word[at] for word in _words(data))
    return at, mix(mix(mix(x) + y) + z)


def _data(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _firsts(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, then document; whether each row in it has an equal key from a smaller document, and whether from any other."""
    order = np.lexsort([doc, *key])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    d = doc[order]
    low = d[starts][group]
    high = np.maximum.reduceat(d, starts)[group] if len(d) else d
    return order, d > low, low < high


def _anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        hashes, docs = [], []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            own = np.unique(anchors(_data(text))[1])
            hashes.append(own)
            docs.append(np.full(len(own), doc_id, np.int64))
        h, d = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(docs or [np.zeros(0, np.int64)])
        order, later, shared = _firsts([h], d)
        yield pd.DataFrame({
            "h": h[order].view(np.int64), "salt": np.where(later, 2 * d[order] + 1, 0), "doc_id": d[order], "local": shared,
        })


_CONTEXT = "h bigint, anchor int, ctx binary, salt bigint, doc_id bigint, tid bigint, start int, windows int, local boolean"


def _slices(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of data end to end."""
    return data[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls and its offsets in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
        data, offsets = _bytes_of(batch["text"])
        ends, wanted = batch["hs"].offsets.to_numpy(), batch["hs"].values.to_numpy(zero_copy_only=False)
        places, hashes, counts = [], [], []
        for i in range(batch.num_rows):
            at, h = anchors(data[offsets[i] : offsets[i + 1]])
            h = h.view(np.int64)
            keep = np.isin(h, wanted[ends[i] : ends[i + 1]])
            places.append(at[keep])
            hashes.append(h[keep])
            counts.append(len(places[-1]))
        row, p, h = np.repeat(np.arange(batch.num_rows), counts), np.concatenate(places), np.concatenate(hashes)
        low, high = np.maximum(p - _REACH, 0), np.minimum(p + MATCH, np.diff(offsets)[row])
        long = high - low >= MATCH
        row, p, h, low, high = row[long], p[long], h[long], low[long], high[long]
        ctx = _slices(data, offsets[row] + low, high - low)
        ctx = pa.Array.from_buffers(
            pa.large_binary(), len(row), [None, pa.py_buffer(np.r_[0, np.cumsum(high - low)].astype(np.int64)), pa.py_buffer(ctx)]
        ).cast(pa.binary())
        doc, tid = (batch[x].to_numpy(zero_copy_only=False)[row] for x in ("doc_id", "tid"))
        local = _settled(ctx, doc)
        columns = [h, (p - low).astype(np.int32), ctx, np.where(local, 2 * doc + 1, 0), doc, tid, low.astype(np.int32),
                   (high - low - MATCH + 1).astype(np.int32), local]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of bytes with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def longest_previous_factors(doc: list[int], lcp: list[int]) -> list[int]:
    """For suffixes in order, with their documents and the common prefix with the suffix before: the longest prefix that a suffix of
    a smaller document shares. It is shared with the previous or the next smaller one in suffix order; these are found by halving,
    from minima over runs of 1, 2, 4, ... suffixes."""
    n = len(doc)
    if not n:
        return []
    d, c, here, out = np.asarray(doc), np.asarray(lcp), np.arange(n), np.zeros(n, np.int64)
    for back in (False, True):
        if back:
            d, c = d[::-1], np.r_[0, c[:0:-1]]
        lows, cuts = [d], [c]
        while 2 << len(lows) - 1 < n:
            step = 1 << len(lows) - 1
            lows.append(np.r_[lows[-1][:step], np.minimum(lows[-1][step:], lows[-1][:-step])])
            cuts.append(np.r_[cuts[-1][:step], np.minimum(cuts[-1][step:], cuts[-1][:-step])])
        at, shared = here - 1, c.copy()
        for k in range(len(lows) - 1, -1, -1):  # over runs of documents that are not smaller
            over = (at >= (1 << k) - 1) & (lows[k][at] >= d)
            shared[over] = np.minimum(shared, cuts[k][at])[over]
            at[over] -= 1 << k
        shared = np.where(at >= 0, shared, 0)
        out = np.maximum(out, shared[::-1] if back else shared)
    return out.tolist()


def _repeated(suffixes: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and in it whether the longest previous factor reaches MATCH."""
    rows = np.frombuffer(b"".join(suffixes), np.uint8)
    order, factors = _factors(rows, np.arange(len(suffixes)) * MATCH, np.full(len(suffixes), MATCH), doc)
    return order, factors >= MATCH


def _factors(data: np.ndarray, low: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of slices of data, and in it their longest previous factors. Where a slice of another size lies between two
    with longer prefixes in common, the factor may come out shorter, but not under MATCH where each slice has MATCH bytes."""
    wide = np.zeros((len(low), -(-int(size.max(initial=0)) // 8) * 8), np.uint8)
    wide[np.arange(wide.shape[1]) < size[:, None]] = _slices(data, low, size)
    order = np.lexsort([doc, *wide.view(">u8").T[::-1]])
    lcp, size = common_prefixes(wide[order]), size[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    return order, np.array(longest_previous_factors(doc[order], lcp), np.int64)


def _stretches(
    flat: np.ndarray, begins: np.ndarray, counts: np.ndarray, anchor: np.ndarray, right: np.ndarray, left: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and offset of the stretches of each row's bytes that its anchor is the anchor of, on the sides that count."""
    row = np.repeat(np.arange(len(begins)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(row):
        return np.zeros(0, np.uint64), row, offset
    grams = _order(flat)
    own = _sliding(grams, _REACH + 1, np.minimum)[begins[row] + offset] == grams[begins + anchor][row]
    own &= np.where(anchor[row] - offset <= _HALF, right[row], left[row])
    row, offset = row[own], offset[own]  # the others belong to another anchor's context or are no one else's
    return Rolling(flat).every(MATCH)[begins[row] + offset], row, offset


def _window_rows(frames: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
    """Hash of each stretch of each context that another document may have, if the hash has its turn."""
    for frame in frames:
        flat = np.frombuffer(b"".join(frame["ctx"]), np.uint8)
        ends = np.cumsum(frame["ctx"].map(len).to_numpy(np.int64))
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        column = lambda x, kind=np.int64: frame[x].to_numpy(kind)
        w, row, offset = _stretches(flat, begins, column("windows"), column("anchor"), column("right", bool), column("left", bool))
        own = w % np.uint64(TURNS) == turn
        w, row, offset = w[own], row[own], offset[own]
        doc = frame["doc_id"].to_numpy(np.int64)[row]
        order, later, shared = _firsts([w], doc)
        yield pd.DataFrame({
            "w": w[order].view(np.int64), "salt": np.where(later, 2 * doc[order] + 1, 0), "doc_id": doc[order],
            "head": frame["head"].to_numpy(np.int64)[row[order]], "offset": offset[order].astype(np.int32), "local": shared,
        })


_SUFFIX = "suffix binary, salt bigint, doc_id bigint, tid bigint, start int, local boolean"


def _suffix_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        s, d, t, p = [], [], [], []
        for ctx, doc_id, tid, start, offsets in zip(frame["ctx"], frame["doc_id"], frame["tid"], frame["start"], frame["offsets"]):
            s += [ctx[i : i + MATCH] for i in offsets]
            d += [doc_id] * len(offsets)
            t += [tid] * len(offsets)
            p += (start + offsets).tolist()
        if s:
            d = np.array(d, np.int64)
            order, again = _repeated(s, d)
            yield pd.DataFrame({
                "suffix": [s[i] for i in order], "salt": np.where(again, 2 * d[order] + 1, 0), "doc_id": d[order],
                "tid": [t[i] for i in order], "start": [p[i] for i in order], "local": again,
            })


_RUN = "doc_id bigint, tid bigint, start int, windows int"


def _settled(ctx: pa.Array, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same."""
    same = ctx.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.full(len(same), np.iinfo(np.int64).max)
    np.minimum.at(first, same, doc)
    return first[same] < doc


def _halves(data: np.ndarray, at: np.ndarray, fits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the _KEY bytes from there on as well."""
    out, rows = np.zeros(len(at), bool), np.flatnonzero(fits)
    order, _, shared = _firsts([Rolling(data).of(at[rows], at[rows] + _KEY)], doc[rows])
    out[rows[order[shared]]] = True
    return out


def _bucket_runs(table: pa.Table) -> pa.Table:
    """Runs of repeated stretches in the contexts of a bucket, which has all contexts of its anchors.

    A stretch that starts up to _HALF bytes before its anchor holds the _KEY bytes from the anchor on (right), any other
    those from _HALF before the anchor on (left)."""
    table = table.combine_chunks()
    settled = _settled(table["ctx"].chunk(0), table["doc_id"].to_numpy())
    whole = table.filter(pa.array(settled)).select(["doc_id", "tid", "start", "windows"])
    table = table.filter(pa.array(~settled))
    data, offsets = _bytes_of(table["ctx"])
    data, begins = data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    doc, tid, start, anchor = (table[x].to_numpy() for x in ("doc_id", "tid", "start", "anchor"))
    right = _halves(data, begins + anchor, anchor + _KEY <= size, doc)
    left = _halves(data, begins + anchor - _HALF, anchor > _HALF, doc)
    w, row, offset = _stretches(data, begins, size - MATCH + 1, anchor, right, left)
    order, later, shared = _firsts([w], doc[row])
    order, later = order[shared], later[shared]
    w, row, offset = w[order], row[order], offset[order]
    group = np.cumsum(np.r_[False, w[1:] != w[:-1]])
    # Those a smaller document may have, by row and offset: `left` counts the stretches to the end of the run.
    asked = np.flatnonzero(later)
    asked = asked[np.lexsort([offset[asked], row[asked]])]
    breaks = np.r_[True, (np.diff(row[asked]) != 0) | (np.diff(offset[asked]) != 1)]
    at = np.flatnonzero(breaks[: len(asked)])
    left = np.diff(np.r_[at, len(asked)])
    runs = []
    while len(at):
        mine = np.zeros(int(group[-1]) + 1, bool)
        mine[group[asked[at]]] = True
        some = np.flatnonzero(mine[group])
        order, factors = _factors(data, begins[row[some]] + offset[some], size[row[some]] - offset[some], doc[row[some]])
        reached = np.zeros(len(group), np.int64)
        reached[some[order]] = factors
        done = np.clip(reached[asked[at]] - MATCH + 1, 0, left)
        hit = done > 0
        runs.append((asked[at][hit], done[hit]))
        step = np.maximum(done, 1)  # equal hashes of unequal stretches: on to the next one
        at, left = (at + step)[left > step], (left - step)[left > step]
    first, windows = (np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 2
    columns = [doc[row[first]], tid[row[first]], (start[row[first]] + offset[first]).astype(np.int32), windows.astype(np.int32)]
    return pa.concat_tables([whole, pa.table([pa.array(x) for x in columns], names=whole.column_names)])


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches that repeat, from suffixes in order (settled ones apart); the suffix that closes a batch is carried into the next."""
    last: tuple[bytes, int] | None = None
    for frame in frames:
        open_ = frame[~frame["local"].to_numpy(bool)]
        s, d = open_["suffix"].tolist(), open_["doc_id"].to_numpy(np.int64)
        again = np.zeros(len(s), bool)
        if s:
            carried = last is not None and last[0] == s[0]
            lines, docs = ([last[0], *s], np.r_[last[1], d]) if carried else (s, d)
            order, found = _repeated(lines, docs)
            again[order[order >= carried] - carried] = found[order >= carried]
            same = [x for x, y in zip(docs.tolist(), lines) if y == s[-1]]
            last = (s[-1], min(same))
        out = pd.concat([frame[frame["local"].to_numpy(bool)], open_[again]])
        yield out[["doc_id", "tid", "start"]]


def _cleaned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, copy, runs in zip(frame["doc_id"], frame["text"], frame["copy"], frame["runs"]):
            raw = (text or "").encode()
            gone = np.zeros(len(raw) + 1, np.int64)
            if copy is True and len(raw) >= MATCH:
                gone[0] = 1
            elif runs is not None and len(runs):
                starts = np.array([r["start"] for r in runs])
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + np.array([r["windows"] for r in runs]) + MATCH - 1, -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            rows.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _copies(named: DataFrame) -> DataFrame:
    """(doc_id, tid) of texts that a document with a smaller id holds whole; texts are told apart by md5."""
    ids = named.select("doc_id", "tid", F.md5("text").alias("same"))
    firsts = ids.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return stage(ids.distinct().join(firsts, "same").where("doc_id > first").select("doc_id", "tid"))


def _suspects(named: DataFrame) -> DataFrame:
    """(doc_id, hs): anchors that other documents hold as well."""
    each = Window.partitionBy("h", "salt")
    marked = named.select("doc_id", "text").mapInPandas(_anchor_rows, "h bigint, salt bigint, doc_id bigint, local boolean")
    low, high = F.min("doc_id").over(each), F.max("doc_id").over(each)
    shared = marked.withColumns({"low": low, "high": high}).where("local or low < high")
    return stage(shared.groupBy("doc_id").agg(F.collect_set("h").alias("hs")))


def _context_rows_of(named: DataFrame, copies: DataFrame, suspects: DataFrame) -> DataFrame:
    """Contexts of the shared anchors of all but whole copies."""
    skipped = copies.groupBy("doc_id").agg(F.collect_set("tid").alias("skipped"))
    wanted = suspects.join(skipped, "doc_id", "left")
    rows = named.join(wanted, "doc_id").where("skipped is null or not array_contains(skipped, tid)").select("doc_id", "tid", "text", "hs")
    return rows.mapInArrow(_context_rows, _CONTEXT)


def _large_anchors(suspects: DataFrame) -> DataFrame:
    """(h) of anchors that more than about LARGE documents have, by one in SHARE documents. Either way with them is exact; this is for memory."""
    some = suspects.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0).select(F.explode("hs").alias("h"))
    return stage(some.groupBy("h").count().where(F.col("count") > LARGE // SHARE).select("h"))


def _bucketed_runs(named: DataFrame, copies: DataFrame, suspects: DataFrame, large: DataFrame) -> DataFrame:
    """Runs of stretches that repeat one of a smaller document, of all anchors but the large ones."""
    buckets = (suspects.agg(F.sum(F.size("hs"))).first()[0] or 0) // BUCKET + 1
    rows = _context_rows_of(named, copies, suspects).drop("salt", "local").join(F.broadcast(large), "h", "left_anti")
    return written(rows.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).applyInArrow(_bucket_runs, _RUN))


def _contexts(named: DataFrame, copies: DataFrame, suspects: DataFrame) -> DataFrame:
    """Contexts of the shared anchors of all but whole copies; ctx only where no earlier document has the same."""
    rows = _context_rows_of(named, copies, suspects).withColumn("first", F.min("doc_id").over(Window.partitionBy("ctx", "salt")))
    settled = F.col("local") | (F.col("doc_id") > F.col("first"))
    return written(rows.select(
        "anchor", F.when(~settled, F.col("ctx")).alias("ctx"), "doc_id", "tid", "start", "windows", settled.alias("settled"),
        F.monotonically_increasing_id().alias("head"),
    ))


def _open_contexts(contexts: DataFrame) -> DataFrame:
    """First contexts that may share a stretch with another context of another document, and on which side of the anchor.

    A stretch that starts up to _HALF bytes before its anchor holds the _KEY bytes from the anchor on (right), any other
    those from _HALF before the anchor on (left)."""
    heads = contexts.where("not settled")
    part = lambda side, ok, back: F.when(
        ok, F.struct(F.xxhash64(F.lit(side), F.substring("ctx", F.col("anchor") + 1 - back, F.lit(_KEY))).alias("key"), F.lit(side).alias("side"))
    )
    sides = F.array_compact(F.array(
        part(0, F.col("anchor") + _KEY <= F.octet_length("ctx"), 0), part(1, F.col("anchor") >= _HALF, _HALF)
    ))
    each = Window.partitionBy("key")
    marked = heads.select(F.xxhash64("ctx").alias("c"), "doc_id", "head", F.explode(sides).alias("s")).select("c", "doc_id", "head", "s.*")
    split = (F.min("c").over(each) < F.max("c").over(each)) & (F.min("doc_id").over(each) < F.max("doc_id").over(each))
    live = marked.withColumn("split", split).where("split").groupBy("head").agg(
        F.max(F.col("side") == 0).alias("right"), F.max(F.col("side") == 1).alias("left")
    )
    return written(heads.select("ctx", "windows", "doc_id", "tid", "start", "anchor", "head").join(live, "head"))


def _shared_stretches(heads: DataFrame, turn: int) -> DataFrame:
    """(head, offsets): per open context the stretches of this turn whose hash another document has."""
    each = Window.partitionBy("w", "salt")
    rows = heads.select("head", "anchor", "ctx", "doc_id", "windows", "right", "left").mapInPandas(
        partial(_window_rows, turn=turn), "w bigint, salt bigint, doc_id bigint, head bigint, offset int, local boolean"
    )
    marked = rows.withColumns({"low": F.min("doc_id").over(each), "high": F.max("doc_id").over(each)}).where("local or low < high")
    return written(marked.groupBy("head").agg(F.collect_set("offset").alias("offsets")))


def _repeated_stretches(heads: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, tid, start) of the shared stretches that repeat one of a smaller document."""
    suffixes = heads.join(shared, "head").select("ctx", "doc_id", "tid", "start", "offsets").mapInPandas(
        _suffix_rows, _SUFFIX
    )
    return written(suffixes.repartition("suffix", "salt").sortWithinPartitions("suffix", "doc_id").mapInPandas(
        _judged, "doc_id bigint, tid bigint, start int"
    ))


def _large_runs(named: DataFrame, copies: DataFrame, suspects: DataFrame) -> list[DataFrame]:
    """The runs of the large anchors, (doc_id, h): contexts, their halves and their stretches are compared one after the other."""
    spark = named.sparkSession
    contexts = _contexts(named, copies, suspects.groupBy("doc_id").agg(F.collect_set("h").alias("hs")))
    heads = _open_contexts(contexts)
    release(spark)
    found = [contexts.where("settled").select("doc_id", "tid", "start", "windows")]
    for turn in range(TURNS):  # equal stretches have their turn together
        shared = _shared_stretches(heads, turn)
        release(spark)
        found.append(_repeated_stretches(heads, shared).withColumn("windows", F.lit(1)))
        release(spark)
    return found


def _lost(found: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, tid, copy, runs): what each text loses, as runs of starts of repeated stretches."""
    runs = found.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    whole = copies.withColumns({"copy": F.lit(True), "runs": F.lit(None).cast(runs.schema["runs"].dataType)})
    return written(runs.withColumn("copy", F.lit(False)).unionByName(whole))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of documents (doc_id, text).

    Null text is empty. Matches never cross documents. Rows with equal doc_id do not repeat each other; rows with null
    doc_id are no one's earlier document and lose nothing. Texts under MATCH bytes lose nothing."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    named = rows.where("doc_id is not null and octet_length(text) >= 50")
    copies, suspects = _copies(named), _suspects(named)
    release(spark)
    large = _large_anchors(suspects)
    found = [_bucketed_runs(named, copies, suspects, large)]
    if large.count():
        found += _large_runs(named, copies, suspects.select("doc_id", F.explode("hs").alias("h")).join(F.broadcast(large), "h"))
    del suspects
    release(spark)
    lost = _lost(reduce(DataFrame.unionByName, found), copies)
    release(spark)
    full = rows.join(lost, ["doc_id", "tid"], "left").select("doc_id", "text", "copy", "runs")
    return full.mapInPandas(_cleaned, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
