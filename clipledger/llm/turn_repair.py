"""Repair of conversation structure by generalised LR parsing with weighted edits.

The roles of a conversation must read as Conv -> (nothing) | Pairs | s Pairs, Pairs -> Pair | Pairs Pair, Pair -> u a. Its
LR automaton runs over the rows with all stacks at once, kept as one graph: a stack is a cell above shared lower cells, and equal cells are
one object. A row can be kept, reroled or deleted, and turns can be inserted before it; each edit has a cost. Stack tops that
meet are merged: the smaller (cost, audit) stays, audit being the initials of the edits. Between rows no audit is the beginning of
another, so the order of two audits never changes later, and merging loses nothing.

What matters between rows is only the tops, their costs above the cheapest and the order of their audits; a step from one such
situation over one kind of row is worked out once and then looked up. Audits are chains of shared links.

A conversation is cut into segments of SPAN rows. A segment is parsed from every stack that can stand at its start; a fold over the
segments' (entry, exit, cost, audit) then picks the cheapest way. So a conversation with a third of all rows is many
tasks, and the fold sees a row per segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm import turns

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a segment.
SPAN = 4096

ROLES = {"u": "user", "a": "assistant"}
_SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (5, "u"): 2, (6, "u"): 2}
_REDUCE = {3: ("Pair", 2), 4: ("Pairs", 1), 7: ("Pairs", 2)}
_GOTO = {(0, "Pair"): 4, (1, "Pair"): 4, (5, "Pair"): 7, (6, "Pair"): 7, (0, "Pairs"): 5, (1, "Pairs"): 6}
_ACCEPT = {0, 5, 6}

_WHITE = " \t\n\x0b\f\r"


class Cell:
    """Top of a stack: an LR state above the rest of the stack. Equal stacks are one cell."""

    _all: dict[tuple, Cell] = {}

    def __init__(self, state: int, below: Cell | None) -> None:
        self.state, self.below = state, below
        self.stack = ((*below.stack, state) if below else (state,))
        self._moves: dict[str, Cell | None] = {}

    @classmethod
    def on(cls, state: int, below: Cell | None) -> Cell:
        key = (state, id(below))
        if key not in cls._all:
            cls._all[key] = cls(state, below)
        return cls._all[key]

    def move(self, role: str) -> Cell | None:
        """Shift a role, then reduce as far as the state says; None where the role cannot stand."""
        if role not in self._moves:
            at = _SHIFT.get((self.state, role))
            self._moves[role] = self._reduced(Cell.on(at, self)) if at is not None else None
        return self._moves[role]

    @staticmethod
    def _reduced(cell: Cell) -> Cell:
        while cell.state in _REDUCE:
            name, length = _REDUCE[cell.state]
            for _ in range(length):
                cell = cell.below
            cell = Cell.on(_GOTO[cell.state, name], cell)
        return cell


START = Cell.on(0, None)


def _reachable() -> list[Cell]:
    """Every stack that can stand between two rows."""
    found, work = [START], [START]
    while work:
        here = work.pop()
        for nxt in map(here.move, "sua"):
            if nxt is not None and nxt not in found:
                found.append(nxt)
                work.append(nxt)
    return sorted(found, key=lambda c: c.stack)


STACKS = _reachable()
_PLACE = {c: i for i, c in enumerate(STACKS)}


def _inserted(tops: tuple) -> dict:
    """Tops after any insertions: cell -> (cost, rank of the top it came from, edits)."""
    best = {cell: (cost, rank, "") for rank, (cell, cost) in enumerate(tops)}
    work = list(best)
    while work:
        here = work.pop()
        cost, rank, edits = best[here]
        for role in "ua":
            nxt = here.move(role)
            new = (cost + INSERT, rank, edits + "I")
            if nxt is not None and (nxt not in best or new < best[nxt]):
                best[nxt] = new
                work.append(nxt)
    return best


@lru_cache(maxsize=None)
def _step(tops: tuple, role: str, must_go: bool, extra: int) -> tuple[int, tuple, tuple]:
    """(cost all have in common, tops in the order of their audits with the cost above it, (rank before, edits) of each)."""
    best: dict[Cell, tuple] = {}

    def offer(cell: Cell | None, new: tuple) -> None:
        if cell is not None and (cell not in best or new < best[cell]):
            best[cell] = new

    for cell, (cost, rank, edits) in _inserted(tops).items():
        offer(cell, (cost + DELETE, rank, edits + "D"))
        if not must_go:
            offer(cell.move(role), (cost + KEEP + extra, rank, edits + "K"))
            for other in "ua":
                offer(cell.move(other), (cost + REROLE + extra, rank, edits + "R"))
    order = sorted(best.items(), key=lambda x: x[1][1:])
    low = min(v[0] for v in best.values())
    return low, tuple((c, v[0] - low) for c, v in order), tuple(v[1:] for _, v in order)


def _spelled(link: tuple | None) -> str:
    parts = []
    while link is not None:
        link, edits = link
        parts.append(edits)
    return "".join(reversed(parts))


class Run:
    """All cheapest ways from one stack over the rows fed to it."""

    def __init__(self, entry: Cell) -> None:
        self.cost, self.tops, self.links = 0, ((entry, 0),), [None]

    def feed(self, role: str, must_go: bool, extra: int) -> None:
        low, self.tops, came = _step(self.tops, role, must_go, extra)
        self.cost += low
        self.links = [(self.links[rank], edits) for rank, edits in came]

    def ways(self) -> list[tuple[int, int, str]]:
        """(exit, cost, audit) of each top."""
        return [(_PLACE[c], self.cost + d, _spelled(x)) for (c, d), x in zip(self.tops, self.links)]


def cheapest(segments: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of the best way through the segments' (entry, exit, cost, audit) to an accepting stack."""
    tops, links = [(_PLACE[START], 0)], [None]
    for ways in segments:
        best: dict[int, tuple] = {}
        for rank, (place, cost) in enumerate(tops):
            for entry, leave, more, audit in ways:
                if entry == place and (leave not in best or (cost + more, rank, audit) < best[leave]):
                    best[leave] = (cost + more, rank, audit)
        order = sorted(best.items(), key=lambda x: x[1][1:])
        tops = [(place, v[0]) for place, v in order]
        links = [(links[v[1]], v[2]) for _, v in order]
    ended = _inserted(tuple((STACKS[place], cost) for place, cost in tops))
    cost, rank, edits = min(v for c, v in ended.items() if c.state in _ACCEPT)
    return cost, _spelled(links[rank]) + edits


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, conv (never null), turn, at, role (initial), fault of every row (conv_id, turn, role, text). No text moves.

    fault: blank (nothing but white space), else duplicate (role and text seen earlier in the conversation), else truncated (the last
    character that is not white space is none of . ! ?), else empty."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    narrow = rows.select(
        "conv_id", F.struct("conv_id").alias("conv"), "turn", F.substring("role", 1, 1).alias("role"),
        turns.turn_key(F.col("role"), F.col("text")).alias("key"), tail.alias("tail"),
    )
    placed = turns.place(narrow, "conv")
    first = placed.groupBy("conv", "key").agg(F.min("at").alias("_first"))
    fault = (
        F.when(F.col("tail") == "", "blank").when(F.col("at") > F.col("_first"), "duplicate")
        .when(~F.col("tail").isin(".", "!", "?"), "truncated").otherwise("")
    )
    return placed.join(first, ["conv", "key"]).select("conv_id", "turn", "at", "role", fault.alias("fault"))


_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("seg", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("n_turns", pa.int64()), ("ways", pa.list_(_WAY)),
])
_SEGMENT_DDL = (
    "conv_id bigint, seg bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, "
    "first_turn bigint, last_turn bigint, n_turns bigint, ways array<struct<entry: int, exit: int, cost: bigint, audit: string>>"
)
_LEGAL = {"su", "ua", "au"}


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple] | None, bool]]:
    """(key, row, whether the row is the first of its key) over sorted batches; the key is the first so many columns."""
    last = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield row[:keys], row, row[:keys] != last
            last = row[:keys]


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _parse_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv_id, seg, at) to one row per segment."""

    def segments() -> Iterator[dict]:
        out, runs = None, []

        def closed() -> dict:
            out["ways"] = [
                {"entry": e, "exit": x, "cost": c, "audit": a} for e, run in runs for x, c, a in run.ways()
            ]
            return out

        for (conv, seg), (_, _, _, turn, role, fault), first in _groups(batches, 2):
            if first:
                if out is not None:
                    yield closed()
                out = dict.fromkeys(_SEGMENT.names, 0) | {
                    "conv_id": conv, "seg": seg, "first_role": role, "last_role": None, "first_turn": None, "last_turn": None,
                }
                runs = [(_PLACE[c], Run(c)) for c in ([START] if seg == 0 else STACKS)]
            if fault:
                out[fault] += 1
            if out["last_role"] is not None and out["last_role"] + role not in _LEGAL:
                out["illegal"] += 1
            out["last_role"] = role
            if turn is not None:
                out["n_turns"] += turn != out["last_turn"]
                out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
                out["last_turn"] = turn
            for _, run in runs:
                run.feed(role, fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)
        if out is not None:
            yield closed()

    return _batched(segments(), _SEGMENT)


_PLAN = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])
_PLAN_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (conv_id, seg) to one plan per conversation."""

    def plans() -> Iterator[dict]:
        held: list[dict] = []

        def closed() -> dict:
            out = {c: sum(s[c] for s in held) for c in ("blank", "duplicate", "truncated", "illegal")}
            timed = [s for s in held if s["first_turn"] is not None]
            gaps = 0
            if timed:
                again = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
                gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - (sum(s["n_turns"] for s in timed) - again)
            out["illegal"] += sum(a["last_role"] + b["first_role"] not in _LEGAL for a, b in zip(held, held[1:]))
            cost, audit = cheapest([(w["entry"], w["exit"], w["cost"], w["audit"]) for w in s["ways"]] for s in held)
            return out | {"conv_id": held[0]["conv_id"], "gaps": gaps, "cost": cost, "audit": audit}

        for _, row, first in _groups(batches, 1):
            if first and held:
                yield closed()
                held = []
            held.append(dict(zip(_SEGMENT.names, row)))
        if held:
            yield closed()

    return _batched(plans(), _PLAN)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows (see repair)."""
    cut = faults(rows).select("conv_id", F.floor((F.col("at") - 1) / F.lit(SPAN)).alias("seg"), "at", "turn", "role", "fault")
    parsed = cut.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "at").mapInArrow(_parse_segments, _SEGMENT_DDL)
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_fold, _PLAN_DDL)


_REPAIRED = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, then its rows in order, to its repaired rows."""

    def rows() -> Iterator[dict]:
        conv, edits, done, at, stack = None, "", 0, 0, START

        def put(role: str, initial: str, text: str, edit: str) -> dict:
            nonlocal at, stack
            at, stack = at + 1, stack.move(initial)
            return {"conv_id": conv, "at": at, "role": role, "text": text, "edit": edit}

        def inserted() -> Iterator[dict]:
            nonlocal done
            while done < len(edits) and edits[done] == "I":
                done += 1
                want = next(r for r in "ua" if stack.move(r) is not None)
                yield put(ROLES[want], want, "", "I")

        for _, (key, is_row, audit, role, text), _ in _groups(batches, 1):
            if not is_row:
                yield from inserted()
                conv, edits, done, at, stack = key, audit, 0, 0, START
                continue
            yield from inserted()
            edit, done = edits[done], done + 1
            if edit == "K":
                yield put(role, role[:1], text, "K")
            elif edit == "R":
                want = next(r for r in "ua" if stack.move(r) is not None)
                yield put(ROLES[want], want, text, "R")
        yield from inserted()

    return _batched(rows(), _REPAIRED, 500)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, at, role, text, edit (K, R or I) of the repaired conversations.

    A task streams a conversation in order and holds its audit and one batch of rows; the rows of a conversation leave together and
    in order of at."""
    texts = rows.select(
        "conv_id", F.lit(True).alias("is_row"), F.lit(None).cast("string").alias("audit"), "role", "text", "turn",
        turns.turn_key(F.col("role"), F.col("text")).alias("key"),
    )
    heads = planned.select("conv_id", F.lit(False).alias("is_row"), "audit")
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "key")
    ordered_rows = both.select("conv_id", "is_row", "audit", "role", "text")
    return ordered_rows.mapInArrow(_apply, "conv_id bigint, at bigint, role string, text string, edit string")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[dict]:
        conv, sha = None, None
        for (key,), (_, _, role, text, _), first in _groups(batches, 1):
            if first:
                if sha is not None:
                    yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}
                conv, sha = key, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}

    return _batched(digests(), _DIGEST)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows as repaired() leaves them: SHA-256 of role:text joined by line feeds, fed row by row."""
    return repaired_rows.mapInArrow(_sha, "conv_id bigint, repaired_sha256 string")


def cleaned(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, null role or text as one space; other columns, whatever their names, are not read."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired rows) of conversations (conv_id, turn, role, text).

    Rows stand in order of turn, null first; rows of one turn in order of the SHA-256 of role and text. A null role or text is one
    space, so such a text is blank. Null conv_id is one conversation. Repeated rows are duplicates. The role's first character
    decides; one that is none of s, u, a can only be reroled or deleted. An empty table gives no rows.
    plans: gaps (turn numbers missing between the smallest and the largest), the number of rows whose first fault is
    blank, duplicate or truncated, illegal (neighbours whose roles may not follow each other), and the cheapest edits with their cost.
    A cost is 3 for a rerole or an inserted empty turn, 4 for a deletion, 3 more for a truncated row that stays; blank and
    duplicate rows must go. Of equal costs the audit least in ASCII counts."""
    rows = cleaned(conversations)
    planned = plans(rows)
    return planned, repaired(rows, planned)
