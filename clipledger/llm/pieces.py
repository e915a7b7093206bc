"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

White space is written as U+2581, with one put in front of the text. A word with its leading U+2581s is a chunk: no
piece of the model reaches from one chunk into the next (checked on loading), so chunks are merged apart. The agenda of a
chunk holds its neighbour pairs by score; a pair that comes up is skipped with the probability of the dropout, and comes
back only when a merge beside it makes it anew. Characters without a piece, and U+2581 itself, become byte pieces, so
decoding gives back every text.

Every pair that comes up is drawn for itself, at every place of a chunk in every row. The key of a place is (seed, row, place
in the text), that of a row its id, text and number among equal rows. What is drawn is how many pairs pass before the next one
is skipped, which is the same as drawing for each. A chunk's cuts make a tree: a node is a list of skipped pairs, with the ids
they lead to; a place walks from the root by its draws, so cuts that many places draw are merged once. With a number of
variants the key is (seed, variant, chunk, place, piece) and a chunk is cut in as many ways at most.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.llm.support import mix, stage

MARK = "▁"
DROPOUT, SEED = 0.1, 1
#: Cuts kept per worker.
KEPT = 400_000
#: Keys of repeated rows that are sent to every task; beyond that all rows are numbered, with the same result.
FEW_REPEATED = 100_000
PIECE = 1000  # rows whose ids a task holds at once
#: Characters that are cut together, and the longest chunk that is merged beside others.
BLOCK, SIDE_BY_SIDE = 2_000_000, 32

_NONE, _TABLE, _PAD, _SLOT_BITS = 1 << 30, 1 << 16, -(1 << 40), 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ESCAPED = "\ud800"  # a lone surrogate, which no text holds: stands for a literal U+2581 while a text is cut


class _Kept:
    """Ids of the chunks seen last, by variant. What a generation of KEPT / 2 chunks did not meet again goes with the next one."""

    def __init__(self, variants: int) -> None:
        self.slots: list[dict[bytes, int]] = [{} for _ in range(variants)]
        self.old: list[dict[bytes, int]] = [{} for _ in range(variants)]
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def lacking(self, v: int, chunks: set[bytes]) -> list[bytes]:
        """Of chunks that this generation has not met, those whose ids are not at hand."""
        slots, old = self.slots[v], self.old[v]
        again = chunks.intersection(old)
        slots.update(zip(again, map(old.__getitem__, again)))
        return list(chunks.difference(again))

    def add(self, v: int, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        if self.count + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.resize(x, 2 * (self.count + len(sizes))) for x in (self.starts, self.sizes))
        to = slice(self.count, self.count + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[to], self.sizes[to] = self.used + np.cumsum(sizes) - sizes, sizes
        self.slots[v].update(zip(chunks, range(to.start, to.stop)))
        self.used, self.count = self.used + len(ids), to.stop

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks end to end, and how many each has."""
        sizes = self.sizes[slots]
        return self.ids[np.repeat(self.starts[slots] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes

    def turn(self) -> None:
        """Starts a generation where this one is full, and lets go of what the one before held alone."""
        if sum(map(len, self.slots)) <= KEPT // 2:
            return
        slots = np.fromiter(chain.from_iterable(x.values() for x in self.slots), np.int64)
        ids, sizes = self.ids_of(slots)
        places = iter(range(len(slots)))
        self.old = [dict(zip(x, places)) for x in self.slots]
        self.slots = [{} for _ in self.old]
        self.ids, self.starts, self.sizes = ids, np.cumsum(sizes) - sizes, sizes
        self.used, self.count = len(ids), len(sizes)


class _Tree(_Kept):
    """Cuts of chunks as nodes; those of a chunk without a skip are roots, found by the chunk.

    pops: pairs that come up after the last skip of a node. Node i has as many places for children, from base[i] on, one for each of
    these pairs that is skipped next. stop: the pair a node skips last, counted from the first that comes up; parent: the node without it."""

    def __init__(self) -> None:
        super().__init__(1)
        self.roots, self.chunks = self.slots[0], []
        self.pops, self.parent, self.stop, self.root, self.met = (np.zeros(1 << 14, np.int32) for _ in range(5))
        self.base = np.zeros(1 << 14, np.int64)
        self.child, self.places = np.full(1 << 16, -1, np.int32), 0

    def grow(self, chunks: list[bytes], parent: np.ndarray, stop: np.ndarray, ids: np.ndarray, sizes: np.ndarray, pops: np.ndarray) -> np.ndarray:
        """Adds nodes; pops: all pairs that come up. Roots have the parent -1, the stop -1 and a chunk each."""
        new = np.arange(self.count, self.count + len(sizes))
        self.add(0, chunks, ids, sizes)
        for name in ("pops", "base", "parent", "stop", "root", "met"):
            if self.count > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * self.count))
        left = pops - stop - 1
        self.pops[new], self.parent[new], self.stop[new], self.met[new] = left, parent, stop, 0
        self.base[new] = self.places + np.cumsum(left) - left
        self.root[new] = np.where(parent < 0, new, self.root[parent])
        self.places += int(left.sum())
        if self.places > len(self.child):
            self.child = np.concatenate([self.child, np.full(2 * self.places - len(self.child), -1, np.int32)])
        self.chunks += chunks or [b""] * len(new)
        return new

    def texts(self, nodes: np.ndarray) -> list[str]:
        """The chunks that nodes cut."""
        return [_spaced(self.chunks[i]) for i in self.root[nodes].tolist()]

    def stops(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of nodes, and a pair it skips; a row for each of its skips."""
        at, of, stop = np.flatnonzero(self.parent[nodes] >= 0), [], []
        while len(at):
            now = nodes[at]
            of.append(at)
            stop.append(self.stop[now])
            nodes = nodes.copy()
            nodes[at] = self.parent[now]
            at = at[self.parent[nodes[at]] >= 0]
        return (np.concatenate(of), np.concatenate(stop)) if of else (at, at)

    def turn(self) -> None:
        """Beyond KEPT nodes, keeps the half of them that was met in most blocks. A node's parent was met whenever it was, and stands before it."""
        if self.count <= KEPT:
            return
        stay = np.sort(np.argsort(-self.met[: self.count], kind="stable")[: KEPT // 2])
        to = np.full(self.count + 1, -1, np.int64)  # the last for -1
        to[stay] = np.arange(len(stay))
        self.ids, self.sizes = self.ids_of(stay)
        self.starts, self.used, self.count = np.cumsum(self.sizes) - self.sizes, len(self.ids), len(stay)
        pops = self.pops[stay]
        base = np.cumsum(pops) - pops
        child = self.child[np.repeat(self.base[stay] - base, pops) + np.arange(pops.sum())]
        self.pops, self.base, self.child, self.places = pops, base, to[child].astype(np.int32), len(child)
        self.parent, self.root = to[self.parent[stay]].astype(np.int32), to[self.root[stay]].astype(np.int32)
        self.stop, self.met = self.stop[stay], np.zeros(len(stay), np.int32)
        self.roots = self.slots[0] = {c: int(to[i]) for c, i in self.roots.items() if to[i] >= 0}
        self.chunks = [self.chunks[i] for i in stay.tolist()]


def _gaps(keys: np.ndarray, draw: int | np.ndarray, dropout: float) -> np.ndarray:
    """How many pairs pass before the next is skipped, for the key of each place and the number of its draw."""
    drawn = mix(keys + (np.atleast_1d(draw).astype(np.uint64) + np.uint64(1)) * _STEP) >> np.uint64(11)
    with np.errstate(divide="ignore"):
        return np.minimum(np.log((drawn + 0.5) * 2.0**-53) / np.log1p(-dropout), _NONE).astype(np.int64)


def _place_keys(seed: int, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of places in texts, from the keys of their rows."""
    rows = mix(starts.astype(np.uint64) + mix(np.array([seed], np.int64).astype(np.uint64)))
    return mix(rows + (places.astype(np.uint64) + np.uint64(1)) * _STEP)


class Model:
    """Pieces of a BPE model of the sentencepiece library, from its serialised bytes."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(m.get_piece_size())
        self.bytes_of = [b""] * len(every)
        self.byte_ids = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in every:
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = m.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses white space; texts can't be merged chunk by chunk")
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces; unknown characters would be lost")
        #: Order of the pieces by falling score; equal scores share a rank.
        order = {x: r for r, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: order[x] for p, x in self.scores.items()}
        self.lengths = np.zeros(len(every), np.int64)
        self.char_ids = np.full(0x110000, -1, np.int64)
        pairs = []
        for p, i in self.ids.items():
            self.lengths[i] = len(p)
            if len(p) == 1:
                self.char_ids[ord(p)] = i
            for k in range(1, len(p)):
                x, y = self.ids.get(p[:k]), self.ids.get(p[k:])
                if x is not None and y is not None:
                    pairs.append((x * len(every) + y, self.ranks[p], i))
        self.pair_keys, self.pair_ranks, self.pair_ids = _hashed(np.array(sorted(pairs), np.int64))
        self.kept: dict[tuple[int, float, int], _Kept] = {}
        self.tree = _Tree()
        self.skips: dict[tuple[int, float], bytes] = {}
        self.pieces: pa.Array | None = None

    def cut(self, chunk: str, skips: bytes, key: int, gaps: Iterator[int] | None = None) -> tuple[int, ...]:
        """Ids of one chunk of any length. gaps: how many pairs pass before each that is skipped, in place of skips and key."""
        out: list[int] = []
        for s in self._heap(chunk, skips, key, gaps):
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else self._spelt(s)
        return tuple(out)

    def _spelt(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if char == _ESCAPED else char).encode()]

    def cut_all(self, chunks: list[str], skips: bytes, keys: list[int]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of many chunks: those of a length are merged side by side, each by its own agenda."""
        for places, ids, sizes, _ in self._cuts(chunks, skips, keys):
            ends = np.cumsum(sizes)
            for at, low, high in zip(places, (ends - sizes).tolist(), ends.tolist()):
                yield chunks[at], tuple(ids[low:high].tolist())

    def _cuts(
        self, chunks: list[str], skips: bytes, keys: list[int], stops: tuple[np.ndarray, np.ndarray] | None = None
    ) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """The same by groups of chunks: their places, their ids end to end, how many each has and how many pairs came up.

        stops: place of a chunk and which pair of it is skipped, in place of skips and keys; for chunks up to SIDE_BY_SIDE."""
        by_length: dict[int, list[int]] = {}
        for at, n in enumerate(map(len, chunks)):
            by_length.setdefault(n, []).append(at)
        for n, places in by_length.items():
            if n > SIDE_BY_SIDE and stops is None:
                own = [self.cut(chunks[at], skips, keys[at]) for at in places]
                yield places, np.fromiter(chain.from_iterable(own), np.int32), np.array([len(x) for x in own]), np.zeros(len(own), np.int64)
                continue
            codes = np.frombuffer("".join([chunks[at] for at in places]).encode("utf-32-le", "surrogatepass"), np.uint32)
            skipped = None
            if stops is not None:
                skipped, row = np.zeros((len(places), 3 * n), bool), np.full(len(chunks), -1)
                row[places] = np.arange(len(places))
                mine = (row[stops[0]] >= 0) & (stops[1] < 3 * n)  # a merge makes two pairs at most, so no more come up
                skipped[row[stops[0][mine]], stops[1][mine]] = True
            ids, sizes, pops = self._merged(codes.reshape(-1, n), skips, np.array([keys[at] for at in places], np.int64), skipped)
            lacking = ids < 0
            if lacking.any():  # characters without a piece
                spelt = [self._spelt(chr(-1 - i)) for i in ids[lacking].tolist()]
                counts = np.ones(len(ids), np.int64)
                counts[lacking] = [len(x) for x in spelt]
                sizes = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
                ids, lacking = np.repeat(ids, counts), np.repeat(lacking, counts)
                ids[lacking] = list(chain.from_iterable(spelt))
            yield places, ids.astype(np.int32), sizes, pops

    def _merged(
        self, codes: np.ndarray, skips: bytes, keys: np.ndarray, skipped: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of character codes merged to ids end to end, the number of ids of each row and of pairs that came up in it. A code
        without id stays as -1 - code. skipped: which pairs of a row are skipped, in the order in which they come up.

        Symbols stay where their first character stood; ahead and behind lead past those that were merged away."""
        m, n = codes.shape
        wide = n + 2  # a wall on either side
        symbols = np.full((m, wide), _PAD)
        symbols[:, 1:-1] = np.where(self.char_ids[codes] >= 0, self.char_ids[codes], -1 - codes.astype(np.int64))
        rank, piece = np.full((m, wide), _NONE, np.int32), np.zeros((m, wide), np.int32)
        rank[:, :-1], piece[:, :-1] = self._looked_up(symbols[:, :-1], symbols[:, 1:])
        flat = np.arange(m * wide, dtype=np.int32)
        ahead, behind, gone = flat + 1, flat - 1, np.zeros(m * wide, bool)
        symbols, ranks, piece = symbols.ravel(), rank.ravel(), piece.ravel()
        table, base, left = np.frombuffer(skips, np.uint8), np.arange(0, m * wide, wide), slice(None)
        pops = np.zeros(m, np.int64)
        for up in count():
            at = rank[left].argmin(axis=1) + base
            live = ranks[at] < _NONE
            if not live.all():
                pops[(base // wide)[~live]] = up
                at, base, keys = at[live], base[live], keys[live]
                left = base // wide
                if not len(at):
                    break
            new = piece[at].astype(np.int64)
            if len(table) or skipped is not None:
                if skipped is not None:
                    skip = skipped[left, up]
                else:
                    skip = table[(keys + (at - base - 1) * 769 + self.lengths[new] * 3079) & _TABLE - 1] > 0
                ranks[at[skip]] = _NONE
                at, new = at[~skip], new[~skip]
                if not len(at):
                    continue
            merged = ahead[at]
            symbols[at], gone[merged], ranks[merged] = new, True, _NONE
            after = ahead[merged]
            ahead[at], behind[after] = after, at
            first = behind[at]
            ranks[at], piece[at] = self._looked_up(new, symbols[after])
            ranks[first], piece[first] = self._looked_up(symbols[first], new)
        kept = ~gone.reshape(m, wide)[:, 1:-1]
        return symbols.reshape(m, wide)[:, 1:-1][kept], kept.sum(axis=1), pops

    def _looked_up(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each joined pair of ids; _NONE and 0 where no piece is."""
        key = np.where((x >= 0) & (y >= 0), x * len(self.bytes_of) + y, -1)
        slot = _slot(key)
        found = self.pair_keys[slot]
        astray = (found != key) & (found >= 0) & (key >= 0)  # another pair's slot: the next ones may have it
        while astray.any():
            slot[astray] += 1
            found[astray] = self.pair_keys[slot[astray]]
            astray &= (found != key) & (found >= 0)
        hit = found == key
        return np.where(hit, self.pair_ranks[slot], _NONE), np.where(hit, self.pair_ids[slot], 0)

    def _heap(self, chunk: str, skips: bytes, key: int, gaps: Iterator[int] | None = None) -> list[str]:
        """The same agenda as a heap, for chunks of any length."""
        ranks, symbols = self.ranks, list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(ranks[x + y], i, x + y) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in ranks]
        heapq.heapify(agenda)
        passing = next(gaps) if gaps is not None else -1
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue
            if skips and skips[(key + i * 769 + len(pair) * 3079) & _TABLE - 1]:
                continue
            if gaps is not None:
                passing -= 1
                if passing < 0:
                    passing = next(gaps)
                    continue
            symbols[i], symbols[j] = pair, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if pair + symbols[k] in ranks:
                    heapq.heappush(agenda, (ranks[pair + symbols[k]], i, pair + symbols[k]))
            h = left[i]
            if h >= 0 and symbols[h] + pair in ranks:
                heapq.heappush(agenda, (ranks[symbols[h] + pair], h, symbols[h] + pair))
        return symbols

    def encode(
        self, texts: list[str], dropout: float = 0.0, seed: int = SEED, variants: int | None = None, starts: list[int] | None = None
    ) -> Iterator[np.ndarray]:
        """Ids of whole texts, in blocks of about BLOCK characters. starts: what tells a text's draws, or variants, from another's."""
        if dropout and variants is None:
            one = lambda block: self._drawn(block, dropout, seed)
            starts = starts or list(range(len(texts)))
        else:
            variants = variants if dropout else 1
            kept = self.kept.setdefault((seed, dropout, variants), _Kept(variants))
            if (seed, dropout) not in self.skips:
                self.skips[seed, dropout] = skip_table(seed, dropout)
            one = lambda block: self._block(block, self.skips[seed, dropout], seed, kept)
        block, size = [], 0
        for text, start in zip(texts, starts or [0] * len(texts)):
            block.append((text, start))
            size += len(text)
            if size >= BLOCK:
                yield from one(block)
                block, size = [], 0
        yield from one(block)

    def _drawn(self, block: list[tuple[str, int]], dropout: float, seed: int) -> Iterator[np.ndarray]:
        """Each place of a chunk draws for itself; cuts that more than one of them draws become nodes of the tree."""
        if not block:
            return
        tree = self.tree
        chunks, counts = _chunks([text for text, _ in block])
        begins = np.cumsum(counts) - counts
        dictionary = chunks.dictionary_encode()
        which, words = (x.to_numpy(zero_copy_only=False) for x in (dictionary.indices, dictionary.dictionary))
        starts = np.array([start for _, start in block], np.int64)
        keys = _place_keys(seed, np.repeat(starts, counts), np.arange(len(which)) - np.repeat(begins, counts))
        words = words.tolist()
        nodes = np.fromiter(map(tree.roots.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(nodes < 0)
        texts = [_spaced(words[i]) for i in lacking.tolist()]
        short = np.fromiter(map(len, texts), np.int64, len(texts)) <= SIDE_BY_SIDE
        long = {int(i): texts[at] for at, i in zip(np.flatnonzero(~short).tolist(), lacking[~short])}
        lacking, texts = lacking[short], [texts[at] for at in np.flatnonzero(short).tolist()]
        for places, ids, sizes, pops in self._cuts(texts, b"", [0] * len(texts)):
            none = np.full(len(places), -1)
            nodes[lacking[places]] = tree.grow([words[i] for i in lacking[places].tolist()], none, none, ids, sizes, pops)
        own = nodes[which]
        met = np.zeros(0, bool)
        # Places that alone draw a cut in this block: the place, the node it left, the pair it skips there, the number of its next draw.
        alone: list[tuple[np.ndarray, ...]] = []
        at = np.flatnonzero(own >= 0)
        for draw in count():
            met = np.concatenate([met, np.zeros(tree.count - len(met), bool)])
            met[own[at]] = True
            gaps = _gaps(keys[at], draw, dropout)
            more = gaps < tree.pops[own[at]]
            at, gaps = at[more], gaps[more]
            if not len(at):
                break
            slots = tree.base[own[at]] + gaps
            missed = np.flatnonzero(tree.child[slots] < 0)
            if len(missed):
                asked, first, times = np.unique(slots[missed], return_index=True, return_counts=True)
                first, many = missed[first], times > 1
                parents, stops = own[at[first]], tree.stop[own[at[first]]] + 1 + gaps[first]
                self._branch(asked[many], parents[many], stops[many])
                single = first[~many]
                alone.append((at[single], parents[~many], stops[~many], np.full(len(single), draw + 1)))
                stay = np.ones(len(at), bool)
                stay[single] = False
                at, slots = at[stay], slots[stay]
            own[at] = tree.child[slots]
        tree.met[: len(met)] += met
        kept = tree.used, tree.count
        self._cut_alone(alone, keys, own, dropout)
        for i in np.flatnonzero(own < 0).tolist():
            ids = np.array(self.cut(long[int(which[i])], b"", 0, _gaps_of(keys[i], dropout)), np.int32)
            own[i] = tree.count
            tree.add(0, [], ids, np.array([len(ids)]))
        ids, sizes = tree.ids_of(own)
        yield from np.split(ids, np.r_[0, np.cumsum(sizes)][np.cumsum(counts)][:-1])
        tree.used, tree.count = kept  # what one place alone drew is not kept
        tree.turn()

    def _branch(self, slots: np.ndarray, parents: np.ndarray, stops: np.ndarray) -> None:
        """Grows the children at these slots: what their parents skip, and the pair at stops."""
        tree = self.tree
        of, before = tree.stops(parents)
        texts = tree.texts(parents)
        skipped = np.concatenate([of, np.arange(len(parents))]), np.concatenate([before, stops])
        for places, ids, sizes, pops in self._cuts(texts, b"", [0] * len(texts), skipped):
            tree.child[slots[places]] = tree.grow([], parents[places], stops[places], ids, sizes, pops)

    def _cut_alone(self, alone: list[tuple[np.ndarray, ...]], keys: np.ndarray, own: np.ndarray, dropout: float) -> None:
        """Cuts of places that nothing else draws, each merged once with all its skips."""
        if not alone:
            return
        tree = self.tree
        at, parents, stops, draws = (np.concatenate(x).astype(np.int64) for x in zip(*alone))
        of, before = tree.stops(parents)
        skipped = [(of, before), (np.arange(len(at)), stops.copy())]
        texts = tree.texts(parents)
        most = 3 * np.fromiter(map(len, texts), np.int64, len(texts))
        left = np.arange(len(at))
        while len(left):
            stops[left] += 1 + _gaps(keys[at[left]], draws[left], dropout)
            draws[left] += 1
            left = left[stops[left] < most[left]]
            skipped.append((left, stops[left]))
        pairs = tuple(np.concatenate(x) for x in zip(*skipped))
        for places, ids, sizes, _ in self._cuts(texts, b"", [0] * len(texts), pairs):
            own[at[places]] = tree.count + np.arange(len(places))
            tree.add(0, [], ids, sizes)

    def _block(self, block: list[tuple[str, int]], skips: bytes, seed: int, kept: _Kept) -> Iterator[np.ndarray]:
        """Each chunk of the block's texts is looked up once a variant, whatever the number of its places."""
        if not block:
            return
        variants = len(kept.slots)
        chunks, counts = _chunks([text for text, _ in block])
        begins = np.cumsum(counts) - counts
        dictionary = chunks.dictionary_encode()
        which, words = (x.to_numpy(zero_copy_only=False) for x in (dictionary.indices, dictionary.dictionary))
        variant = (np.arange(len(which)) + np.repeat([start for _, start in block] - begins, counts)) % variants
        own = np.empty(len(which), np.int64)
        for v in range(variants):
            mine = np.flatnonzero(variant == v)
            used = np.zeros(len(words), bool)
            used[which[mine]] = True
            used = np.flatnonzero(used)
            asked = words[used].tolist()
            slots = np.fromiter(map(kept.slots[v].get, asked, repeat(-1)), np.int64, len(asked))
            missed = np.flatnonzero(slots < 0)
            again = [asked[i] for i in missed.tolist()]
            lacking = kept.lacking(v, set(again))
            texts = [_spaced(c) for c in lacking]
            keys = [zlib.crc32(c.encode("utf-8", "surrogatepass"), seed * 64 + v) for c in texts]
            for places, ids, sizes, _ in self._cuts(texts, skips, keys):
                kept.add(v, [lacking[at] for at in places], ids, sizes)
            slots[missed] = np.fromiter(map(kept.slots[v].__getitem__, again), np.int64, len(again))
            of = np.empty(len(words), np.int64)
            of[used] = slots
            own[mine] = of[which[mine]]
        ids, sizes = kept.ids_of(own)
        yield from np.split(ids, np.r_[0, np.cumsum(sizes)][np.cumsum(counts)][:-1])
        kept.turn()

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded, whatever merges were dropped."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]

    def gives(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it; all are decoded at once."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if self.pieces is None:
            self.pieces = pa.array(self.bytes_of, pa.large_binary())
        _, offsets, data = self.pieces.take(pa.array(flat)).buffers()
        ends = np.frombuffer(offsets, np.int64)[np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]].tolist() if len(flat) else [0] * (len(ids) + 1)
        back = memoryview(data or b"")
        return [bytes(back[low + 1 : high]) == t.encode() for low, high, t in zip(ends, ends[1:], texts)]


def _gaps_of(key: np.uint64, dropout: float) -> Iterator[int]:
    """The gaps of one place, one after another."""
    for draw in count(step=64):
        yield from _gaps(np.full(64, key), np.arange(draw, draw + 64), dropout).tolist()


def _chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts as bytes, a space before each text that is not empty, and how many each text has.

    A chunk is spaces and what follows them up to the next space, with the line end behind it; spaces alone; or a line end alone."""
    raws = [b" " + text.encode() if text else b"" for text in texts]
    data = b"".join(raws)
    at = np.frombuffer(data, np.uint8)
    space, line = at == 0x20, at == 0x0A
    begins = np.r_[0, np.cumsum([len(x) for x in raws], dtype=np.int64)]
    new = np.zeros(len(at), bool)
    # Spaces not after spaces, line ends not after what belongs to a word, and the rest after a line end.
    new[1:] = np.where(space[1:], ~space[:-1], np.where(line[1:], space[:-1] | line[:-1], line[:-1]))
    new[begins[:-1][np.diff(begins) > 0]] = True
    starts = np.flatnonzero(new)
    offsets = pa.py_buffer(np.r_[starts, len(at)].astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]), np.diff(np.searchsorted(starts, begins))


def _spaced(chunk: bytes) -> str:
    """A chunk with U+2581 for its spaces; what is not for merging stands as an escape."""
    return chunk.decode().replace(MARK, _ESCAPED).replace(" ", MARK)


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _hashed(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ranks and ids of pairs of pieces, each in its slot or the next free one; a free slot has the key -2."""
    size = (1 << _SLOT_BITS) + len(pairs) + 1
    keys, ranks, ids = np.full(size, -2), np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
    slot, left = _slot(pairs[:, 0]), np.arange(len(pairs))
    while len(left):
        free = keys[slot] == -2
        keys[slot[free]] = pairs[left[free], 0]  # of several, the last
        done = keys[slot] == pairs[left, 0]
        ranks[slot[done]], ids[slot[done]] = pairs[left[done], 1], pairs[left[done], 2]
        slot, left = slot[~done] + 1, left[~done]
    return keys, ranks, ids


def skip_table(seed: int, dropout: float) -> bytes:
    """Whether the keyed hash says skip, for each value of a candidate's key: one byte each, a share `dropout` of them 1."""
    if not dropout:
        return b""
    drawn = mix(np.arange(_TABLE, dtype=np.uint64) + mix(np.array([seed], np.uint64))) >> np.uint64(11)
    return (drawn < dropout * 2.0**53).astype(np.uint8).tobytes()


_models: dict[bytes, Model] = {}


def _model(shared: Broadcast) -> Model:
    """One model per worker."""
    if shared.value not in _models:
        _models.clear()
        _models[shared.value] = Model(shared.value)
    return _models[shared.value]


def load(spark: SparkSession, path: str) -> Broadcast:
    """The model's bytes, half a megabyte, for all tasks; executors need no such file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(frames: Iterator[pd.DataFrame], own: Model, dropout: float, seed: int, variants: int | None) -> Iterator[pd.DataFrame]:
    for frame in (f.iloc[i : i + PIECE] for f in frames for i in range(0, len(f), PIECE)):
        starts = frame["_row"].tolist()
        yield frame.assign(ids=list(own.encode([t or "" for t in frame["text"]], dropout, seed, variants, starts)))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row) of every row of documents. _row is a key of id, text and the row's number among equal rows, so that rows
    that come more than once draw apart. Only rows whose key comes more than once move, or all where there are many of these."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))

    def numbered(df: DataFrame) -> DataFrame:
        # In the order of the texts, so that two texts with one key are not numbered by chance.
        number = F.row_number().over(Window.partitionBy("_row").orderBy("doc_id", "text"))
        return df.withColumn("_row", F.when(number == 1, F.col("_row")).otherwise(F.xxhash64("_row", number)))

    repeated = stage(rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row"))
    if repeated.count() > FEW_REPEATED:
        return numbered(rows)
    once = rows.join(F.broadcast(repeated), "_row", "left_anti")
    return once.unionByName(numbered(rows.join(F.broadcast(repeated), "_row", "left_semi")))


def encode(
    docs: DataFrame, model: Broadcast, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = None
) -> DataFrame:
    """(doc_id, text, ids) of every row of documents (doc_id, text); null or empty text has no ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _encoded(frames, _model(model), dropout, seed, variants):
            yield frame[["doc_id", "text", "ids"]]

    return _rows(docs).mapInPandas(run, "doc_id bigint, text string, ids array<int>")


def decode(tokens: DataFrame, model: Broadcast, out: str = "decoded") -> DataFrame:
    """Adds the text that the column `ids` stands for."""

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        own = _model(model)
        return ids.map(lambda x: own.decode(x.tolist()))

    return tokens.withColumn(out, run("ids"))


def tokens(
    docs: DataFrame, model: Broadcast, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = None
) -> DataFrame:
    """(doc_id, ids, n_ids, lossless): ids of every row, and whether decoding them gave the text back.

    One worker does both, so neither texts nor ids cross to another process in between."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _model(model)
        for frame in _encoded(frames, own, dropout, seed, variants):
            back = own.gives(list(frame["ids"]), [t or "" for t in frame["text"]])
            yield frame[["doc_id", "ids"]].assign(n_ids=frame["ids"].map(len).astype("int32"), lossless=back)

    return _rows(docs).mapInPandas(run, "doc_id bigint, ids array<int>, n_ids int, lossless boolean")
