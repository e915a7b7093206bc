"""Chat formatting of conversations with typed content parts, all in DataFrame functions.

A turn's content is an array of parts: text, image, audio or document. A visitor goes over the parts in order and writes each: text with
its control strings broken, the others as a placeholder, recorded as an attachment with its reference and the number of tokens
it expands to. Turns stand between marks no text can hold, and the loss mask is a list of spans over the assistant's contents, so
the output alone is enough to read everything back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm import turns

#: Marks of this template, and control strings of public ones; no text may hold any of them as it is.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The role whose contents are learned.
LEARNED = "assistant"

PARTS = "array<struct<kind: string, text: string, ref: string, source: string, width: bigint, height: bigint, seconds: double, pages: bigint>>"

#: File endings of a part written as ![name|size](reference) in a text.
ENDINGS = {"image": ("png", "jpg", "jpeg", "gif", "webp"), "audio": ("mp3", "wav", "flac", "ogg"), "document": ("pdf", "docx")}


def markup(endings: tuple[str, ...]) -> str:
    return rf"!\[[^\]\n]*\]\([^()\x20\x09-\x0D]+\.(?:{'|'.join(endings)})\)"


_ANY_MARKUP = markup(tuple(e for kind in ENDINGS.values() for e in kind))
_PLACEHOLDER = r"<\|(?:" + "|".join(ENDINGS) + r")\|>"


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put after the first character of every control string."""
    heads: dict[str, list[str]] = {}
    for c in CONTROLS:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    broken = "|".join(rf"{re.escape(h)}(?={'|'.join(rest)})" for h, rest in heads.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), broken, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass(frozen=True)
class Visitor:
    """What each kind of part becomes: text to write, and the tokens it expands to (null for text)."""

    patch: int = 28  # pixels a side of an image token
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 1024  # tokens a document page
    unknown: int = 256  # tokens of a part without a size

    def text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(None)

    def image(self, part: Column) -> tuple[Column, Column]:
        across, down = (F.ceil(part[side] / F.lit(self.patch)) for side in ("width", "height"))
        return F.lit("<|image|>"), across * down

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(part["seconds"] * F.lit(self.audio_rate))

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), part["pages"] * F.lit(self.page_tokens)

    def _visit(self, part: Column) -> tuple[Column, Column]:
        written, tokens = self.text(part)
        for kind in ENDINGS:
            content, n = getattr(self, kind)(part)
            mine = part["kind"] == kind
            written = F.when(mine, content).otherwise(written)
            tokens = F.when(mine, F.coalesce(n.cast("bigint"), F.lit(self.unknown).cast("bigint"))).otherwise(tokens)
        return written, tokens

    def content(self, parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: self._visit(p)[0]), "")

    def attachments(self, parts: Column, at: Column) -> Column:
        """The parts that are placeholders, in order."""
        other = F.filter(parts, lambda p: p["kind"].isin(*ENDINGS))
        return F.transform(other, lambda p: F.struct(
            at.alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["source"], F.lit("")).alias("source"),
            self._visit(p)[1].cast("bigint").alias("tokens"),
        ))


def text_parts(text: Column) -> Column:
    """Parts of a plain text: files it shows as ![name|size](reference) are parts of their kind, the rest is text.

    size is 640x480 for an image, 12.5s for audio, 3p for a document, and may be missing. source keeps the markup."""
    plain = F.split(text, _ANY_MARKUP, -1)
    shown = F.regexp_extract_all(text, F.lit(f"({_ANY_MARKUP})"), F.lit(1))

    def number(source: Column, pattern: str, kind: str) -> Column:
        return F.regexp_extract(source, rf"\|{pattern}\]\(", 1).try_cast(kind)

    def words(t: Column) -> Column:
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("ref", "string"), ("source", "string"), ("width", "bigint"),
                                                             ("height", "bigint"), ("seconds", "double"), ("pages", "bigint"))]
        return F.struct(F.lit("text").alias("kind"), t.alias("text"), *nothing)

    def file(s: Column) -> Column:
        ref = F.regexp_extract(s, r"\(([^()]*)\)$", 1)
        ending = F.substring_index(ref, ".", -1)
        kind = F.lit(None).cast("string")
        for name, endings in ENDINGS.items():
            kind = F.when(ending.isin(*endings), name).otherwise(kind)
        return F.struct(
            kind.alias("kind"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), s.alias("source"),
            number(s, r"(\d{1,9})x\d{1,9}", "bigint").alias("width"), number(s, r"\d{1,9}x(\d{1,9})", "bigint").alias("height"),
            number(s, r"(\d{1,9}(?:\.\d{1,9})?)s", "double").alias("seconds"), number(s, r"(\d{1,9})p", "bigint").alias("pages"),
        )

    pairs = F.zip_with(plain, F.concat(shown, F.array(F.lit(None).cast("string"))), lambda t, s: F.when(
        s.isNull(), F.array(words(t))
    ).otherwise(F.array(words(t), file(s))))
    return F.when(F.contains(text, F.lit("![")), F.flatten(pairs)).otherwise(F.array(words(text)))


def formatted(turn_parts: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """conv_id, text, spans, attachments, tokens of every conversation; turn_parts has conv_id, turn, key, role, parts.

    text: the turns between marks, in order of turn (null first), then key. spans: (at, start, length, start_byte, n_bytes) of each learned
    content, in code points and in UTF-8 bytes. attachments: (at, kind, ref, source, tokens) in order of the placeholders; tokens: what
    they expand to. One shuffle, by conversation; a conversation is a row, so it must fit one (2 GB)."""
    see = visitor or Visitor()
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    written = turn_parts.select("conv_id", "turn", "key", "role", "parts", head.alias("head"), see.content(F.col("parts")).alias("content"))
    chunk = F.concat("head", "content", F.lit(END))
    sized = written.select(
        "*", chunk.alias("chunk"), F.char_length(chunk).cast("bigint").alias("n"), F.octet_length(chunk).cast("bigint").alias("b"),
    )
    line = Window.partitionBy("conv_id").orderBy("turn", "key")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    placed = sized.select(
        "conv_id", "chunk", "role", "parts", F.row_number().over(line).alias("at"), F.char_length("content").cast("bigint").alias("length"),
        F.octet_length("content").cast("bigint").alias("n_bytes"), (start("n") + F.char_length("head")).alias("start"),
        (start("b") + F.octet_length("head")).alias("start_byte"),
    )
    span = F.when(F.col("role") == LEARNED, F.struct("at", "start", "length", "start_byte", "n_bytes"))
    gathered = placed.select("conv_id", "at", "chunk", span.alias("span"), see.attachments(F.col("parts"), F.col("at")).alias("files"))
    rows = gathered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "chunk", "span", "files"))).alias("t"))
    return rows.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["chunk"]), "").alias("text"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("spans"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    ).withColumn("tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def _restored(content: Column, at: Column, files: Column) -> Column:
    """Content as it was: unescaped, and every placeholder replaced by what stood there."""
    sources = F.transform(F.filter(files, lambda f: f["at"] == at), lambda f: f["source"])
    whole = F.zip_with(
        F.split(content, _PLACEHOLDER, -1), F.concat(sources, F.array(F.lit(""))), lambda t, s: F.concat(unescape(t), s)
    )
    return F.when(F.size(files) == 0, unescape(content)).otherwise(F.array_join(whole, ""))


def read_turns(text: Column, attachments: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    pieces = F.split(text, r"<\|end\|>\n", -1)

    def turn(piece: Column, i: Column) -> Column:
        body = F.split(piece, r"<\|text\|>", 2)
        role = F.substring(body[0], F.lit(len(TURN) + 1), F.char_length(body[0]))
        return F.struct(unescape(role).alias("role"), _restored(body[1], i + 1, attachments).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_learned(text: Column, spans: Column, attachments: Column) -> Column:
    """All text under the loss mask, one after the other."""
    octets = F.array(F.encode(text, "UTF-8"))  # bound once, so that a span costs its own length only
    cut = F.transform(octets, lambda o: F.transform(
        spans, lambda s: _restored(F.substring(o, (s["start_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string"), s["at"], attachments)
    ))
    return F.array_join(F.flatten(cut), "")


def turn_parts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key, role, parts of conversations (conv_id, turn, role, text), parts found in the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", turns.turn_key(role, text).alias("key"), role.alias("role"), text_parts(text).alias("parts"))


def chat(conversations: DataFrame, visitor: Visitor | None = None) -> DataFrame:
    """Formatted conversations of (conv_id, turn, role, text); see formatted.

    Null role or text is empty. Null conv_id is one conversation. Rows of one turn stand in order of the SHA-256 of role and text;
    repeated rows are repeated turns. Other columns, whatever their names, are not read. An empty table gives no rows."""
    return formatted(turn_parts(conversations), visitor)
