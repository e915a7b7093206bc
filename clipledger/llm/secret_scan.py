"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

A candidate is a run of token characters that mixes letters and digits, or cases otherwise than words do. For each character class a window of
WINDOW characters slides over the class's runs in it; counts are kept as the window moves, so a step costs one
character in and one out. Windows whose entropy reaches the class's threshold are joined to one span. Of a candidate that the
allow-list knows (ids, dates, paths, alphabets, file names, placeholders) only the parts between '/', '=' and '.' that it
does not know are read. Spans inside a pattern's span are passed over.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds with their least lengths.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_text")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % WINDOW)
#: Class, its characters, threshold in bits. A random window of 20 has 3.5 of 4 bits (hex), 4.2 of 4.3 (base 64).
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{%d,}" % WINDOW), 3.0),
    ("entropy_text", re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 3.75),
)
#: What a candidate may look like without being a secret. Fixed values.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9T:.Z+/=_-]+"),
    re.compile(r"(?:[A-Za-z]+[/_.=+-]+)*[A-Za-z]+[0-9]{0,4}[/_.=+-]*"),
    re.compile(r"[\w/.+-]*\.(?:com|org|net|edu|gov|io|html?|php|pdf|png|jpe?g|gif|svg|css|js|json|xml|txt|csv|zip)(?:/.*)?"),
    re.compile(r".*(?:0123456789|abcdefghijkl|ABCDEFGHIJKL|EXAMPLE|example|xxxxx|XXXXX).*"),
)
#: Parts of an allowed candidate, and what one may look like besides: words and numbers.
PART = re.compile(r"[^/=.]{%d,}" % WINDOW)
SLUG = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[_+-]+(?:[A-Za-z]+|[0-9]+))*[_+-]*")
#: What words leave little of: letters beside runs of three of one case.
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}|[^A-Za-z]+")

_GAIN = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_spans(text: str, start: int, end: int, threshold: float) -> list[tuple[int, int]]:
    """Maximal joins of windows within text[start:end] whose entropy in bits is at least the threshold."""
    counts: dict[str, int] = {}
    mass, most, out = 0.0, (math.log2(WINDOW) - threshold) * WINDOW + 1e-9, []
    for i in range(start, end):
        c = counts.get(text[i], 0)
        counts[text[i]] = c + 1
        mass += _GAIN[c + 1] - _GAIN[c] if c < WINDOW else 0.0
        if i - start >= WINDOW:
            gone = text[i - WINDOW]
            c = counts[gone]
            counts[gone] = c - 1
            mass += _GAIN[c - 1] - _GAIN[c] if c <= WINDOW else 0.0
        if i - start >= WINDOW - 1 and mass <= most:
            low = i - WINDOW + 1
            if out and low <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((low, i + 1))
    return out


def _mixed(part: str) -> bool:
    return sum(c.isdigit() for c in part) >= 2 and sum(c.isalpha() for c in part) >= 2


def _no_words(part: str) -> bool:
    """Upper and lower case, changing so often that a quarter of the part is in no word."""
    return not part.islower() and not part.isupper() and 4 * len(_WORDS.sub("", part)) >= len(part)


def _suspect(part: str, *more: re.Pattern) -> bool:
    """Whether a candidate or a part of one is to be read; more: what it may look like besides the allow-list."""
    odd = _no_words(part)
    known = [a for a in (*ALLOWED, *more) if not (odd and a in (ALLOWED[2], SLUG))]
    return (odd or _mixed(part)) and not any(a.fullmatch(part) for a in known)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base kinds; matches that are too short are dropped after matching."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def entropy_hits(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        parts = [m] if _suspect(m[0]) else [x for x in PART.finditer(text, m.start(), m.end()) if _suspect(x[0], SLUG)]
        for kind, runs, threshold in CLASSES:
            for r in (r for x in parts for r in runs.finditer(text, x.start(), x.end())):
                out += [
                    (s, KINDS.index(kind), e)
                    for s, e in entropy_spans(text, r.start(), r.end(), threshold)
                    if _mixed(text[s:e]) or _no_words(text[s:e])
                ]
    return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and entropy spans that lie in no base span, by start, then kind."""
    base = base_spans(text)
    more = [x for x in entropy_hits(text) if not any(s <= x[0] and x[2] <= e for s, _, e in base)]
    return base, sorted(base + more) if more else base


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_SCAN = "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, every = spans(text or "")
        kinds = [k for _, k, _ in base]
        rows.append((
            kinds.count(0), kinds.count(1), kinds.count(2), len(every) - len(base),
            hashlib.sha256(_written(base).encode()).hexdigest(), _written(every),
        ))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _SCAN.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row of documents (doc_id, text).

    Positions are code points, ends exclusive. Null or empty text: no spans. Repeated rows each get their row."""
    return docs.select("doc_id", F.pandas_udf(_scan, _SCAN)("text").alias("s")).select("doc_id", "s.*")


def redacted_text(text: str, mask: str = "[SECRET]") -> str:
    """The text with every joined stretch of spans replaced by the mask."""
    every = spans(text)[1]
    out, at = [], 0
    joined: list[list[int]] = []
    for s, _, e in every:
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in joined:
        out += [text[at:s], mask]
        at = e
    return "".join(out) + text[at:] if joined else text


def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else redacted_text(x), na_action=None)


def redact(docs: DataFrame) -> DataFrame:
    """documents with secrets masked; n_chars follows the text where there is such a column. Null text stays null."""
    out = docs.withColumn("text", F.pandas_udf(_redact, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out
