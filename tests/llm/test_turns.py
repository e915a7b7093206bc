"""Operators over conversations against plain Python, with odd rows and with conversations longer than a segment."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clipledger.llm import chat, prefix_trie, turn_repair, turns

ROWS = "conv_id bigint, turn bigint, role string, text string, at string, key string, conv string, s string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], ROWS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows, blank=""):
    """conv_id -> [(turn, role, text)] in the defined order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = blank if role is None else role, blank if text is None else text
        out[conv].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), role, text, turn))
    return {c: [(t, r, x) for _, _, r, x, t in sorted(v)] for c, v in out.items()}


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes."), (1, 2, "user", ""), (2, 0, "user", "hi"), (2, 1, "assistant", "no."),
    (3, None, "system", "rules."), (3, None, "user", "q?"), (3, 5, None, None), (4, 1, "user", "same."), (4, 1, "user", "same."),
    (4, 1, "assistant", "tie"), (5, 0, "user", "hi"), (None, 0, "user", "lost."), (-7, 0, "tool", "x " * 50_000), (100, 0, "user", "hi"),
]


def brute_trie(paths):
    """Nodes of {conv: [(role, text)]}."""
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = set()
    for v, m in members.items():
        d = len(v)
        below = [u for u in members if u[:d] == v]
        kids = lambda u: [w for w in members if len(w) == len(u) + 1 and w[: len(u)] == u]
        out.add((
            m[0], d, members[v[:-1]][0] if d else None, len(m), len(kids(v)), sum(not kids(u) for u in below),
            sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u), sha(",".join(str(c) for c in m if len(paths[c]) == d)),
        ))
    return out


def nodes(df):
    return {tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect()}


@pytest.mark.parametrize("span", [4, 4096])
def test_trie_is_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(turns, "SPAN", span)
    rng = random.Random(span)
    rows = list(ODD)
    for c in range(200, 260):
        said = [("user", "first")] * rng.randint(0, 1) + [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(1, 14))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(said)]
    rows += [(c, t, r, x) for c in (300, 301, 302) for k, t, r, x in rows if k == 207]  # copies
    rows += [(c, t, r, x) for c in (303, 304) for k, t, r, x in rows if k == 207 and t < 4]  # one block of it
    paths = {c: [(r, t) for _, r, t in p] for c, p in in_order(rows).items() if c is not None}
    assert nodes(prefix_trie.prefix_trie(frame(spark, rows))) == brute_trie(paths)


def test_trie_of_shared_starts(spark):
    import zlib

    own = {c: [(r, t) for _, r, t in p] for c, p in in_order(ODD).items() if c is not None}
    paths = {}
    for c, p in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + p[h:]
    assert nodes(prefix_trie.trie(*prefix_trie.shared_starts(frame(spark, ODD)))) == brute_trie(paths)
    assert prefix_trie.trie(*prefix_trie.shared_starts(frame(spark, ODD).limit(0))).count() == 0


def legal(roles):
    if not roles:
        return True
    body = roles[1:] if roles[0] == "s" else roles
    return len(body) > 0 and len(body) % 2 == 0 and all(x == "ua"[i % 2] for i, x in enumerate(body))


def brute_repair(rows):
    """(counts, cost, audit, repaired) by trying every edit of rows [(turn, role, text)]."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        kinds.append("blank" if not bare.strip(" \t\n\x0b\f\r") else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    options = []
    for (_, role, text), kind in zip(rows, kinds):
        extra = 3 if kind == "truncated" else 0
        keep = [] if kind in ("blank", "duplicate") else [("K", extra, [(role, text)])] + [("R", 3 + extra, [(w, text)]) for w in ("user", "assistant")]
        options.append([("D", 4, []), *keep])
    said = [("", 0, [])] + [("I" * n, 3 * n, [(w, "") for w in ws]) for n in (1, 2) for ws in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*[list(itertools.product(said, o)) for o in options], said):
        flat = [x for pair in edits[:-1] for x in pair] + [edits[-1]]
        out = [row for x in flat for row in x[2]]
        if legal("".join(r[:1] if r[:1] in tuple("sua") else "?" for r, _ in out)):
            new = (sum(x[1] for x in flat), "".join(x[0] for x in flat), out)
            best = new if best is None or new[:2] < best[:2] else best
    count = {k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    stamps = [t for t, _, _ in rows if t is not None]
    gaps = max(stamps) - min(stamps) + 1 - len(set(stamps)) if stamps else 0
    return count | {"illegal": illegal, "gaps": gaps, "cost": best[0], "audit": best[1]}, best[2]


@pytest.mark.parametrize("span", [1, 2, 4096])
def test_repair_is_exhaustive_search(spark, monkeypatch, span):
    monkeypatch.setattr(turn_repair, "SPAN", span)
    monkeypatch.setattr(turns, "SPAN", span)
    rng = random.Random(span)
    rows = [(c, t, r, x) for c, t, r, x in ODD if c != -7]
    for c in range(500, 580):
        for i in range(rng.randint(1, 3)):
            turn = rng.choice([None, i, i, 2 * i])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "c!", " ", "", "d? "])))
    planned, fixed = turn_repair.repair(frame(spark, rows))
    got = {r.conv_id: r for r in planned.collect()}
    lines, digests = defaultdict(list), {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(fixed).collect()}
    for r in sorted(fixed.collect(), key=lambda r: r.at):
        lines[r.conv_id].append((r.role, r.text))
    want = in_order(rows, " ")
    assert set(got) == set(want)
    for c, said in want.items():
        figures, out = brute_repair(said)
        assert {k: got[c][k] for k in figures} == figures, (c, said)
        assert lines[c] == out
        if out:
            assert digests[c] == sha("\n".join(f"{r}:{t}" for r, t in out))


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """Cut into many segments or into one, the edits are the same."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", "", "?"])) for i in range(3000)]
    plans = []
    for span in (7, 100_000):
        monkeypatch.setattr(turn_repair, "SPAN", span)
        plans.append(turn_repair.plans(turn_repair.cleaned(frame(spark, rows))).collect())
    assert plans[0] == plans[1] and len(plans[0][0].audit) >= 3000


def test_stacks():
    assert [c.stack for c in turn_repair.STACKS] == [(0,), (0, 1), (0, 1, 2), (0, 1, 6), (0, 1, 6, 2), (0, 2), (0, 5), (0, 5, 2)]
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(6))):
        cell = turn_repair.START
        for x in word:
            cell = cell and cell.move(x)
        assert (cell is not None and cell.state in turn_repair._ACCEPT) == legal(word), word


def test_repair_of_nothing(spark):
    planned, fixed = turn_repair.repair(frame(spark, ODD).limit(0))
    assert planned.count() == fixed.count() == turn_repair.digests(fixed).count() == 0


def read(out):
    return out.select(
        "*", chat.read_turns(F.col("text"), F.col("attachments")).alias("turns"),
        chat.read_learned(F.col("text"), F.col("spans"), F.col("attachments")).alias("learned"),
    ).collect()


def test_chat_reads_back(spark):
    rng = random.Random(5)
    bits = ["<", "|", "<|", "|>", "<|end|>\n", "<|turn|>", "<|text|>", "\\", "</s>", "<s>", "[INST]", "[/INST]", "[", "<<SYS>>", "<</SYS>>", "é",
            "😀", "\n", "$1", "<|image|>", "![p|640x480](a/b.png)", "![](x.mp3)", "![d|3p](y.pdf)", "![n](z.txt)", "!["]
    rows = list(ODD)
    for c in range(600, 680):
        rows += [(c, i, rng.choice(["user", "assistant", "<|end|>\n\\", ""]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(rng.randint(1, 5))]
    want = in_order(rows)
    got = {r.conv_id: r for r in read(chat.chat(frame(spark, rows)))}
    assert set(got) == set(want)
    for c, said in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in said], c
        assert got[c].learned == "".join(t for _, r, t in said if r == "assistant")
        marks = got[c].text.count("<|turn|>"), got[c].text.count("<|text|>"), got[c].text.count("<|end|>\n")
        assert marks == (len(said),) * 3
        assert not any(x in got[c].text for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        for s in got[c].spans:
            assert got[c].text[s.start : s.start + s.length].encode() == got[c].text.encode()[s.start_byte : s.start_byte + s.n_bytes]
    assert chat.chat(frame(spark, rows).limit(0)).count() == 0


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [("text", "Look: <|", None, None, None, None, None, None), ("image", None, "i.png", None, 100, 57, None, None),
                        ("audio", None, "s.wav", None, None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "d.pdf", "{d}", None, None, None, 2), ("text", "done", None, None, None, None, None, None)]),
        (1, 2, "user", [("image", None, "u.png", None, None, None, None, None)]),
    ]
    parts = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}").withColumn("key", F.lit("k"))
    (r,) = read(chat.formatted(parts))
    assert r.text == (
        "<|turn|>user<|text|>Look: <\\|<|image|><|audio|><|end|>\n<|turn|>assistant<|text|><|document|>done<|end|>\n<|turn|>user<|text|><|image|><|end|>\n"
    )
    assert [(a.at, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, "image", "i.png", 4 * 3), (1, "audio", "s.wav", 38), (2, "document", "d.pdf", 2048), (3, "image", "u.png", 256)
    ]
    assert r.tokens == 12 + 38 + 2048 + 256 and r.learned == "{d}done" and [s.at for s in r.spans] == [2]


def test_text_parts(spark):
    text = "a ![x|640x480](p/q.png) b![](s.ogg)![r|2.5s](t.wav) ![k|7p](u.docx) ![no](v.txt)"
    (row,) = spark.createDataFrame([(text,)], "t string").select(chat.text_parts(F.col("t")).alias("p")).collect()
    assert "".join(p.text if p.kind == "text" else p.source for p in row.p) == text
    assert [(p.kind, p.ref, p.width, p.height, p.seconds, p.pages) for p in row.p if p.kind != "text"] == [
        ("image", "p/q.png", 640, 480, None, None), ("audio", "s.ogg", None, None, None, None),
        ("audio", "t.wav", None, None, 2.5, None), ("document", "u.docx", None, None, None, 7),
    ]
