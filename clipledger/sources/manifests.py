"""Checksum manifests, XML (v1) and flat YAML (v2), to one table, a row per entry."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes, text
from clipledger.session import written
from clipledger.sources.documents import plain_path

_XML_TAGS = ["file", "size", "lastmodificationdate", *schemas.ALGORITHM_ALIASES]


#: Names of manifests.
GLOB = "*.{mhl,ascmhl}"


def manifest_files(spark: SparkSession, *roots: str, glob: str = GLOB) -> DataFrame:
    """(manifest_path, manifest_sha256) of every manifest. The listing takes no bytes; each file is then digested in chunks on the
    executors, so none has to fit a cell."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(list(roots))
    return file_hashes(files.select(plain_path(F.col("path")).alias("manifest_path")))


def file_hashes(paths: DataFrame) -> DataFrame:
    """(manifest_path, manifest_sha256) of manifest_path; null where the bytes could not be read."""
    asked = paths.select(F.col("manifest_path").alias("path"), F.lit("sha256").alias("alg"))
    return hashes.file_digests(asked).select(F.col("path").alias("manifest_path"), F.col("value").alias("manifest_sha256"))


def manifest_version(body: Column) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(body, r'<(?:\w+:)?hashlist[^>]*\sversion="([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(body, r"(?m)^Version:\s*(\S+)", 1), F.lit("")),
    )


def manifest_kind(body: Column) -> Column:
    """XML when the text starts with an XML declaration or a hashlist, YAML otherwise."""
    return F.when(F.ltrim(body).rlike(r"^(<\?xml|<hashlist)"), "v1").otherwise("v2")


#: What ends a record of the scan: the last characters of an entry's tags. A record is then what stands between two tags.
_RECORD_END = "hash>"
_CLOSES = r"</(?:[\w.-]+:)?\z"  # the record up to </hash>
_OPENS = r"(?s)^.*<(?:[\w.-]+:)?hash\s[^>]*>"  # an opening tag with attributes, which does not end a record


_RAW = "manifest_path string, block bigint, value string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds row, the place of a record in its block, and n, how many entries stand before it there. A task reads a block from its
    start, so two counters are all that is carried."""
    key, row, n = None, 0, 0
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        path, block = batch.column("manifest_path"), batch.column("block")
        ends = pc.match_substring_regex(batch.column("value"), _CLOSES).to_numpy(zero_copy_only=False).astype(np.int64)
        same = pc.and_(pc.equal(path[1:], path[:-1]), pc.equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False).astype(bool)
        first = np.concatenate([[True], ~same])
        begun = np.flatnonzero(first)
        carry = (path[0].as_py(), block[0].as_py()) == key
        before = np.cumsum(ends) - ends
        group = np.cumsum(first) - 1
        rows, counts = np.arange(size) - begun[group], before - before[begun][group]
        if carry:
            rows[group == 0] += row
            counts[group == 0] += n
        key, row, n = (path[size - 1].as_py(), block[size - 1].as_py()), int(rows[-1]) + 1, int(counts[-1] + ends[-1])
        columns = [*batch.columns, pa.array(rows, pa.int64()), pa.array(counts, pa.int64()), pa.array(ends == 1)]
        yield pa.RecordBatch.from_arrays(columns, ["manifest_path", "block", "value", "row", "n", "ends"])


def scan(spark: SparkSession, *roots: str, glob: str = GLOB) -> DataFrame:
    """(manifest_path, block, value): the records of the manifests. Splittable: one huge XML manifest is many tasks; a YAML manifest, which
    holds no tag, is one record. Small files share a task up to the bytes of a split: Spark counts 4 MB for each, so that a task would have
    some thirty, and most of its time would go into starting."""
    raw = spark.read.text(list(roots), lineSep=_RECORD_END, recursiveFileLookup=True, pathGlobFilter=glob)
    total = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return raw.select(
        plain_path(F.col("_metadata.file_path")).alias("manifest_path"), F.col("_metadata.file_block_start").alias("block"), "value"
    ).coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-total // split)))


_SURVEY = pa.schema([
    ("manifest_path", pa.string()), ("block", pa.int64()), ("entries", pa.int64()), ("closed", pa.bool_()), ("valid", pa.bool_()),
    ("bad", pa.bool_()), ("head", pa.string()),
])
_CLOSED = r"</(\w+:)?hashlist[ \t\n\x0B\f\r]*>|<(\w+:)?hashlist[^>]*/>"


def _valid(values: pa.Array) -> np.ndarray:
    """Whether each value is UTF-8."""
    try:
        values.validate(full=True)
        return np.ones(len(values), bool)
    except pa.ArrowInvalid:
        def good(data: bytes) -> bool:
            try:
                data.decode()
                return True
            except UnicodeDecodeError:
                return False

        return np.fromiter(map(good, values.cast(pa.binary()).to_pylist()), bool, len(values))


def _flags_of(values: pa.Array, first_block: np.ndarray) -> dict[str, np.ndarray]:
    """What each record says of its file."""
    valid = _valid(values)
    if not valid.all():  # replacement characters for what is not text
        values = pa.array([x.decode("utf-8", "replace") for x in values.cast(pa.binary()).to_pylist()], pa.string())
    closed = pc.match_substring(values, "hashlist").to_numpy(zero_copy_only=False).astype(bool)
    at = np.flatnonzero(closed)
    closed[at] = pc.match_substring_regex(values.take(pa.array(at)), _CLOSED).to_numpy(zero_copy_only=False)
    listed, bad = np.flatnonzero(first_block & pc.match_substring(values, "Hashes:").to_numpy(zero_copy_only=False)), np.zeros(len(values), bool)
    if len(listed):
        for low, texts in _some(values.take(pa.array(listed))):
            items, _, _, odd = yaml_parsed(texts)
            bad[listed[low + items[odd]]] = True
    return {"entries": pc.match_substring_regex(values, _CLOSES).to_numpy(zero_copy_only=False).astype(np.int64), "closed": closed, "valid": valid, "bad": bad}


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block. A task reads a block from its start, so what is carried is the row of the block at hand."""
    held: dict | None = None
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        path, block, value = batch.column("manifest_path"), batch.column("block"), batch.column("value")
        same = pc.and_(pc.equal(path[1:], path[:-1]), pc.equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False).astype(bool)
        begun = np.flatnonzero(np.concatenate([[True], ~same]))
        flags = _flags_of(value, block.to_numpy(zero_copy_only=False) == 0)
        paths, blocks = path.take(pa.array(begun)).to_pylist(), block.take(pa.array(begun)).to_pylist()
        entries = np.add.reduceat(flags["entries"], begun).tolist()
        closed, bad = (np.logical_or.reduceat(flags[k], begun).tolist() for k in ("closed", "bad"))
        valid = np.logical_and.reduceat(flags["valid"], begun).tolist()
        done = []
        for i, at in enumerate(begun.tolist()):
            if held is not None and (held["manifest_path"], held["block"]) == (paths[i], blocks[i]):
                held |= {
                    "entries": held["entries"] + entries[i], "closed": held["closed"] or closed[i], "valid": held["valid"] and valid[i], "bad": held["bad"] or bad[i],
                }
                continue
            if held is not None:
                done.append(held)
            head = bytes(memoryview(value[at].as_buffer())[: 4 * 4096]).decode("utf-8", "replace")[:4096] if blocks[i] == 0 else None
            held = {
                "manifest_path": paths[i], "block": blocks[i], "entries": entries[i], "closed": closed[i], "valid": valid[i], "bad": bad[i], "head": head,
            }
        if done:
            yield pa.RecordBatch.from_pylist(done, _SURVEY)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], _SURVEY)


def surveyed(records: DataFrame) -> DataFrame:
    """A table with a row for each block of scan: how many entries it has, whether it closes the list, is UTF-8 and holds an item that
    is not flat; kind and version stand in the first block of a file, from its first characters."""
    head = F.col("head")
    ddl = "manifest_path string, block bigint, entries bigint, closed boolean, valid boolean, bad boolean, head string"
    return written(records.mapInArrow(_surveyed, ddl).select(
        "manifest_path", "block", "entries", "closed", "valid", "bad",
        F.when(head.isNotNull(), manifest_kind(head)).alias("kind"), F.when(head.isNotNull(), manifest_version(head)).alias("version"),
    ))


def xml_entries(records: DataFrame) -> DataFrame:
    """(manifest_path, block, n, entry) of the XML entries in records. n: an entry's place among those of its block; entry: its tags, all text,
    because inferred types would turn digests of digits only into numbers."""
    value = F.col("value")
    # Most records are told by their last characters.
    ends = records.where((F.endswith(value, F.lit("</")) | F.endswith(value, F.lit(":"))) & value.rlike(_CLOSES))
    layout = ", ".join(f"`{t}` STRING" for t in _XML_TAGS)
    inner = F.regexp_replace(F.regexp_replace(value, _OPENS, ""), _CLOSES, "")
    tags = F.from_xml(F.concat(F.lit("<hash>"), inner, F.lit("</hash>")), layout, {"ignoreNamespace": "true", "rowTag": "hash"})
    entry = F.create_map(*[x for t in _XML_TAGS for x in (F.lit(t), F.col(f"_tags.{t}"))])
    placed = ends.mapInArrow(_placed, f"{_RAW}, row bigint, n bigint, ends boolean")
    return placed.select("manifest_path", "block", "n", tags.alias("_tags")).withColumn("entry", entry).drop("_tags")


# A flat line: key, colon, then nothing, a whole quoted value, or a plain one that opens no YAML structure.
_YAML_LINE = r"""^\s*[A-Za-z0-9_]+:(\s*|\s+"[^"]*"\s*|\s+'[^']*'\s*|\s+[^\s\[\]{}&*!|>%@`"'].*)$"""


def _yaml_chunks(text_: Column) -> Column:
    """The lines of every item of a YAML text's list."""
    body = F.concat(F.lit("\n"), F.replace(text_, F.lit("\r\n"), F.lit("\n")))
    tail = F.when(F.contains(body, F.lit("\nHashes:")), F.regexp_replace(body, r"(?s)^.*?\nHashes:[ \t]*", ""))
    chunks = F.slice(F.split(tail, r"\n\s*- "), 2, 1_000_000_000)
    return F.transform(chunks, lambda c: F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#"))))


def _yaml_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^\s*([^:]*):", 1)))


def _not_flat(lines: Column) -> Column:
    keys = _yaml_keys(lines)
    return ~F.forall(lines, lambda x: x.rlike(_YAML_LINE)) | (F.size(F.array_distinct(keys)) < F.size(keys))


def yaml_items(text_: Column) -> Column:
    """Array of (entry MAP, bad) of a flat YAML text; bad marks anything not flat."""

    def item(lines: Column) -> Column:
        values = F.transform(
            lines, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^([\"'])(.*)\\1$", "$2")
        )
        bad = _not_flat(lines)
        return F.struct(F.when(~bad, F.map_from_arrays(_yaml_keys(lines), values)).alias("entry"), bad.alias("bad"))

    return F.transform(_yaml_chunks(text_), item)


_BYTES, _ROWS = 4_000_000, 10_000  # of texts that are parsed together, and rows of a batch
_S = r"[ \t\n\x0B\f\r]"  # white space of Java's patterns
_END = r"[\r\x{85}\x{2028}\x{2029}]"  # what else ends a line there
#: _YAML_LINE with its key and what stands behind the colon.
_YAML_PARTS = (
    rf"^{_S}*(?P<key>[A-Za-z0-9_]+):(?P<value>(?:{_S}*|{_S}+\"[^\"]*\"{_S}*|{_S}+'[^']*'{_S}*"
    rf"|{_S}+[^ \t\n\x0B\f\r\[\]{{}}&*!|>%@`\"'][^\n\r\x{{85}}\x{{2028}}\x{{2029}}]*){_END}?)$"
)
_YAML_ITEM = re.compile(r"\n[ \t\n\x0b\f\r]*- ")


def yaml_parsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.StructArray, np.ndarray]:
    """yaml_items of many texts by whole-array steps: for each item its text and whether it is not flat; for each of their lines its item,
    and its key and value, null where the line is not flat."""
    bodies = ["\n" + t.replace("\r\n", "\n") for t in texts]
    mark = next(chr(c) for c in range(0xE000, 0xF8FF) if not any(chr(c) in b for b in bodies))  # a character that no text has stands for an item's dash
    tails = []
    for body in bodies:
        at = body.find("\nHashes:")
        tails.append(_YAML_ITEM.sub("\n" + mark, body[at + 8 :].lstrip(" \t")) if at >= 0 else "")
    split = pc.split_pattern(pa.array(tails, pa.large_string()), "\n")
    lines, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    begins = pc.starts_with(lines, mark).to_numpy(zero_copy_only=False).astype(bool)
    items = of[begins]
    item = np.cumsum(begins) - 1
    # What stands before a text's first item is not in its list.
    inside = np.flatnonzero((item >= 0) & (items[np.maximum(item, 0)] == of)) if len(items) else np.zeros(0, np.int64)
    lines, item = pc.utf8_ltrim(lines.take(pa.array(inside)), mark), item[inside]
    said = pc.utf8_trim(lines, " ")
    said = np.flatnonzero(~pc.or_(pc.equal(said, ""), pc.starts_with(said, "#")).to_numpy(zero_copy_only=False).astype(bool))
    item, lines = item[said], lines.take(pa.array(said))
    parts = pc.extract_regex(lines, _YAML_PARTS)
    bad = np.zeros(len(items), bool)
    bad[item[pc.is_null(parts).to_numpy(zero_copy_only=False)]] = True
    codes = pc.fill_null(pc.struct_field(parts, "key").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.sort((item * (len(codes) + 1) + codes)[codes >= 0])
    bad[pairs[1:][pairs[1:] == pairs[:-1]] // (len(codes) + 1)] = True
    return items, item, parts, bad


_YAML_QUOTED = r"^(?:\"({0}*)\"|'({0}*)')({1}?)$".format(r"[^\n\r\x{85}\x{2028}\x{2029}]", _END)


def _yaml_values(values: pa.Array) -> pa.Array:
    """What stands behind the colons, without spaces around and quotes."""
    return pc.replace_substring_regex(pc.utf8_trim(values, " "), _YAML_QUOTED, r"\1\2\3")


def _some(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts that are parsed together, about _BYTES of them, and the place of the first."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // _BYTES
    begins = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for low, high in zip(begins, [*begins[1:], len(texts)]):
        yield low, [x.decode("utf-8", "replace") for x in texts[low:high].cast(pa.binary()).to_pylist()]


def _yaml_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, texts in _some(batch.column("value")):
            items, item, parts, bad = yaml_parsed(texts)
            flat = np.flatnonzero(~bad[item])  # the lines of flat items
            ends = np.cumsum(np.bincount(item[flat], minlength=len(items)))
            key, value = (pc.struct_field(parts, x).take(pa.array(flat)) for x in ("key", "value"))
            entries = pa.MapArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), key.cast(pa.string()), _yaml_values(value).cast(pa.string()))
            counts = np.bincount(items, minlength=len(texts))
            places = np.arange(len(items)) - np.repeat(np.cumsum(counts) - counts, counts)
            for at in range(0, len(items), _ROWS):
                to = slice(at, at + _ROWS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("manifest_path").take(pa.array(low + items[to])), pa.array(places[to], pa.int32()), entries[to], pa.array(bad[to])],
                    ["manifest_path", "entry_ix", "entry", "bad"],
                )


def yaml_entries(records: DataFrame) -> DataFrame:
    """(manifest_path, entry_ix, entry, bad) of the YAML texts among records (manifest_path, value); entries of bad items are not to be used."""
    return records.select("manifest_path", "value").mapInArrow(_yaml_batches, "manifest_path string, entry_ix int, entry map<string, string>, bad boolean")


def _exploded(items: DataFrame) -> DataFrame:
    """The same of manifest_path and flat, an array of yaml_items."""
    # explode_outer and a filter on its output, as in flatten.groups: plain explode would infer one on the array.
    rows = items.select("manifest_path", F.posexplode_outer("flat").alias("entry_ix", "i")).where(F.col("entry_ix").isNotNull())
    return rows.select("manifest_path", "entry_ix", "i.entry", "i.bad")


def _shape(entries: DataFrame, known: Column, file: str, size: str, date: str) -> DataFrame:
    """Entry maps to manifest rows, the known hashes of an entry together in one map."""
    raw_size = _get(size)
    return entries.select(
        "manifest_path", "entry_ix", _get(file).alias("file"), text.lenient_int(raw_size).alias("size"),
        raw_size.alias("size_text"), _get(date).alias("last_modified"), known.alias("hashes"),
    )


def _get(key: str) -> Column:
    return F.try_element_at("entry", F.lit(key))


def _yaml_rows(entries: DataFrame) -> DataFrame:
    """Keys are case-sensitive here, and plain algorithm names count beside the aliases."""
    tags = {t: _get(t) for t in schemas.ALGORITHM_ALIASES}
    aliased = hashes.gather(tags)
    known = F.create_map(*[
        x for a in schemas.REGISTRY_ORDER for x in (F.lit(a), F.coalesce(F.try_element_at(aliased, F.lit(a)), _get(a)))
    ])
    placed = entries.where("not bad").withColumn("entry_ix", F.col("entry_ix").cast("bigint"))
    return _shape(placed, known, "File", "Size", "LastModificationDate").withColumn("kind", F.lit("v2"))


def _xml_rows(entries: DataFrame) -> DataFrame:
    known = hashes.gather({t: _get(t) for t in schemas.ALGORITHM_ALIASES})
    return _shape(entries, known, "file", "size", "lastmodificationdate").withColumn("kind", F.lit("v1"))


def _rejects(files: DataFrame, yml: DataFrame) -> DataFrame:
    """files: manifest_path, kind, closed, valid."""
    not_flat = yml.where("bad").select("manifest_path", F.lit("not_flat_yaml").alias("code"))
    cut = files.where("valid and kind = 'v1' and not closed").select("manifest_path", F.lit("truncated_xml").alias("code"))
    no_text = files.where("not valid").select("manifest_path", F.lit("not_utf8").alias("code"))
    return not_flat.unionByName(cut).unionByName(no_text).distinct()


def _good(rows: DataFrame, files: DataFrame, rejects: DataFrame, few: bool = False) -> DataFrame:
    """few: the manifests are few enough to be sent to every task."""
    sent = F.broadcast if few else lambda df: df
    heads = files.select("manifest_path", "kind", "manifest_sha256", "version").join(
        rejects.select("manifest_path").distinct(), "manifest_path", "left_anti"
    )
    return rows.join(sent(heads), ["manifest_path", "kind"]).drop("kind")


def heads(blocks: DataFrame) -> DataFrame:
    """manifest_path, kind, version, closed, valid, bad of every manifest surveyed."""
    first = blocks.where("block = 0").select("manifest_path", "kind", "version")
    flags = blocks.groupBy("manifest_path").agg(
        F.bool_or("closed").alias("closed"), F.bool_and("valid").alias("valid"), F.bool_or("bad").alias("bad")
    )
    return first.join(flags, "manifest_path")


#: Manifests whose paths and digests are sent to every task; beyond that their rows are shuffled to them, with the same result.
FEW_FILES = 500_000


def manifests(
    spark: SparkSession, *roots: str, glob: str = GLOB, keep: bool = True, scanned: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, rejected manifests). The two formats meet in one layout; entry_ix counts the entries of a manifest from 0.

    A first scan leaves a small table: what each block says of its file, and how many entries it has. Entries are numbered where they
    are read, from that count of the blocks before, so none of them moves. With keep the rows are a table, so that they are built once
    and not for every use of them; without it they are built by the step that reads them. scanned: scan and surveyed of the roots, where
    the caller has them."""
    if scanned is None:
        records = scan(spark, *roots, glob=glob)
        scanned = records, surveyed(records)
    records, blocks = scanned
    files = written(heads(blocks).join(file_hashes(blocks.select("manifest_path")), "manifest_path", "left"))
    few = files.count() <= FEW_FILES
    rejects = _rejects(files, files.where("kind = 'v2'").select("manifest_path", "bad"))
    yml = yaml_entries(records.where((F.col("block") == 0) & F.contains("value", F.lit("Hashes:"))))
    before = Window.partitionBy("manifest_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only manifests of several splits have later blocks: a row for each of the splits at most.
    later = blocks.select("manifest_path", "block", F.sum("entries").over(before).alias("_before")).where("block > 0")
    entries = xml_entries(records).join(F.broadcast(later), ["manifest_path", "block"], "left")
    # A split the first scan did not meet, because the session's split size changed in between, is an error and never a wrong number.
    start = F.when(F.col("block") == 0, F.lit(0).cast("bigint")).otherwise(
        F.coalesce("_before", F.raise_error(F.lit("a manifest was split otherwise by the second scan")).cast("bigint"))
    )
    xml = entries.select("manifest_path", (F.col("n") + start).alias("entry_ix"), "entry")
    rows = _good(_xml_rows(xml).unionByName(_yaml_rows(yml)), files, rejects, few)
    return (written(rows) if keep else rows), rejects


def rows_from_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for manifests already held as text: (manifest_path, manifest_sha256, text)."""
    body = F.col("text")
    files = texts.select(
        "manifest_path", "manifest_sha256", "text", manifest_kind(body).alias("kind"), manifest_version(body).alias("version"),
        F.coalesce(body.rlike(r"</(\w+:)?hashlist\s*>|<(\w+:)?hashlist[^>]*/>"), F.lit(False)).alias("closed"), body.isNotNull().alias("valid"),
    )
    yml = _exploded(files.where("kind = 'v2'").select("manifest_path", yaml_items(body).alias("flat")))
    rejects = _rejects(files, yml)
    item = ", ".join(f"`{t}`: STRING" for t in _XML_TAGS)
    parsed = F.from_xml("text", f"hash ARRAY<STRUCT<{item}>>", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    rows = files.where("kind = 'v1'").select("manifest_path", F.posexplode_outer(parsed["hash"]).alias("_ix", "h"))
    rows = rows.where(F.col("h").isNotNull())
    entry = F.create_map(*[x for t in _XML_TAGS for x in (F.lit(t), F.col(f"h.{t}"))])
    xml = rows.select("manifest_path", F.col("_ix").cast("bigint").alias("entry_ix"), entry.alias("entry"))
    return _good(_xml_rows(xml).unionByName(_yaml_rows(yml)), files, rejects), rejects
