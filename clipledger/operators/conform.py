"""Conformance rules as column predicates: each rule that fails is one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.operators.ledger import event_where, finding

Rule = tuple[str, Column]


def _name(what: str, path: str) -> str:
    return f"_{what}_{path.removeprefix('$').removeprefix('.').replace('.', '_')}"


def _kind(path: str) -> Column:
    """JSON type at a path of raw: null when the key is absent. Filled in by read_paths."""
    return F.col(_name("kind", path))


def _present(path: str) -> Column:
    return _kind(path).isNotNull()


def _is_text(path: str) -> Column:
    return _kind(path) == "STRING"


def _text(path: str) -> Column:
    return F.col(_name("text", path))


def read_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    """Kind and text of every path the rules look at, each read from raw once."""
    cols = []
    for p in paths:
        cols.append(F.schema_of_variant(F.try_variant_get("raw", p, "variant")).alias(_name("kind", p)))
        cols.append(F.try_variant_get("raw", p, "string").alias(_name("text", p)))
    return df.select("*", *cols)


def _extra(path: str, allowed: list[str]) -> Column:
    """Object at path has keys outside the allowed list."""
    keys = F.map_keys(F.try_variant_get("raw", path, "map<string,variant>"))
    return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0


def _required(keys: list[str], prefix: str = "$") -> list[Rule]:
    label = prefix.removeprefix("$").removeprefix(".").replace(".", "_")
    return [
        (f"missing_{label + '_' if label else ''}{key}", _present(prefix) & ~_present(f"{prefix}.{key}")) for key in keys
    ]


def _not_text(paths: list[str]) -> list[Rule]:
    return [
        (f"not_text_{p.removeprefix('$.').replace('.', '_')}", _present(p) & ~_is_text(p)) for p in paths
    ]


def _one_of(path: str, allowed: list[str]) -> Rule:
    return (f"vocabulary_{path.removeprefix('$.').replace('.', '_')}", _present(path) & ~F.coalesce(
        _is_text(path) & _text(path).isin(allowed), F.lit(False)))


def _matches(path: str, pattern: str) -> Rule:
    return (f"pattern_{path.removeprefix('$.').replace('.', '_')}", _is_text(path) & ~_text(path).rlike(pattern))


def _min_length(path: str, n: int) -> Rule:
    return (f"too_short_{path.removeprefix('$.').replace('.', '_')}", _is_text(path) & (F.length(_text(path)) < n))


def _signature() -> list[Rule]:
    return [
        *_required(["alg", "kid", "value"], "$.sig"),
        ("extra_sig_key", _extra("$.sig", ["alg", "kid", "value"])),
        _one_of("$.sig.alg", schemas.SIGNATURE_ALGS),
        *_not_text(["$.sig.kid", "$.sig.value"]),
        _min_length("$.sig.kid", 1),
        _min_length("$.sig.value", 1),
    ]


SIG_PATHS = ["$.sig", "$.sig.alg", "$.sig.kid", "$.sig.value"]
ARTIFACT_PATHS = [
    "$", "$.id", "$.role", "$.kind", "$.subtype", "$.path", "$.mhlEntry", "$.hash", "$.hash.alg", "$.hash.value", "$.immutable",
]
EVENT_PATHS = [
    "$", "$.seq", "$.ts", "$.actor", "$.actor.id", "$.actor.role", "$.tool", "$.tool.name", "$.tool.version", "$.action",
    "$.target", "$.prevHash", "$.hash", *SIG_PATHS,
]
LOCK_PATHS = ["$", "$.target", "$.scope", "$.field", "$.by", "$.at", "$.reason", *SIG_PATHS]


def artifact_rules() -> list[Rule]:
    """A row with no kind owes both conditional fields: a missing field meets any condition on it."""
    keys = ["id", "role", "kind", "subtype", "path", "mhlEntry", "hash", "immutable"]
    maybe_manifest = ~_present("$.kind") | (_text("$.kind") == "asc-mhl")
    maybe_export = ~_present("$.kind") | (_text("$.kind") == "resolve-export")
    flag = _text("$.immutable") == "true"
    return [
        *_required(["id", "role", "kind", "path", "hash"]),
        ("extra_key", _extra("$", keys)),
        *_not_text(["$.id", "$.subtype", "$.path", "$.mhlEntry", "$.hash.value"]),
        _matches("$.id", schemas.URN_PATTERN),
        _one_of("$.role", schemas.ARTIFACT_ROLES),
        _one_of("$.kind", schemas.ARTIFACT_KINDS),
        _min_length("$.path", 1),
        *_required(["alg", "value"], "$.hash"),
        ("extra_hash_key", _extra("$.hash", ["alg", "value"])),
        _one_of("$.hash.alg", schemas.REGISTRY_ORDER),
        _min_length("$.hash.value", 8),
        ("not_boolean_immutable", _present("$.immutable") & (_kind("$.immutable") != "BOOLEAN")),
        ("missing_mhlEntry", maybe_manifest & ~_present("$.mhlEntry")),
        ("manifest_not_immutable", maybe_manifest & _present("$.immutable") & ~F.coalesce(flag, F.lit(False))),
        ("missing_subtype", maybe_export & ~_present("$.subtype")),
        ("vocabulary_subtype", maybe_export & _present("$.subtype")
         & ~F.coalesce(_text("$.subtype").isin(schemas.EXPORT_SUBTYPES), F.lit(False))),
    ]


def event_rules() -> list[Rule]:
    keys = ["seq", "ts", "actor", "tool", "action", "target", "prevHash", "hash", "sig"]
    is_int = _kind("$.seq").isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    seq = _text("$.seq").try_cast("bigint")
    prev_null = _kind("$.prevHash") == "VOID"
    prev_ok = _is_text("$.prevHash") & _text("$.prevHash").rlike(schemas.CHAIN_HASH_PATTERN)
    maybe_first = ~_present("$.seq") | F.coalesce(seq == 1, F.lit(False))
    maybe_later = ~_present("$.seq") | ~F.coalesce(seq == 1, F.lit(False))
    return [
        *_required(keys),
        ("extra_key", _extra("$", keys)),
        ("not_integer_seq", _present("$.seq") & ~is_int),
        ("seq_below_one", is_int & (seq < 1)),
        *_not_text(["$.ts", "$.actor.id", "$.actor.role", "$.tool.name", "$.tool.version", "$.target", "$.hash"]),
        _matches("$.ts", schemas.DATE_TIME_PATTERN),
        *_required(["id"], "$.actor"),
        ("extra_actor_key", _extra("$.actor", ["id", "role"])),
        _matches("$.actor.id", schemas.URN_PATTERN),
        *_required(["name", "version"], "$.tool"),
        ("extra_tool_key", _extra("$.tool", ["name", "version"])),
        _min_length("$.tool.name", 1),
        _min_length("$.tool.version", 1),
        _one_of("$.action", schemas.EVENT_ACTIONS),
        _matches("$.target", schemas.URN_PATTERN),
        ("pattern_prevHash", _present("$.prevHash") & ~F.coalesce(prev_null | prev_ok, F.lit(False))),
        _matches("$.hash", schemas.CHAIN_HASH_PATTERN),
        ("first_has_prevHash", maybe_first & _present("$.prevHash") & ~F.coalesce(prev_null, F.lit(False))),
        ("later_without_prevHash", maybe_later & _present("$.prevHash") & ~F.coalesce(prev_ok, F.lit(False))),
        *_signature(),
    ]


def lock_rules() -> list[Rule]:
    keys = ["target", "scope", "field", "by", "at", "reason", "sig"]
    maybe_field = ~_present("$.scope") | (_text("$.scope") == "field")
    return [
        *_required(["target", "scope", "by", "at", "sig"]),
        ("extra_key", _extra("$", keys)),
        *_not_text(["$.target", "$.field", "$.by", "$.at", "$.reason"]),
        _matches("$.target", schemas.URN_PATTERN),
        _matches("$.by", schemas.URN_PATTERN),
        _one_of("$.scope", schemas.LOCK_SCOPES),
        _matches("$.field", schemas.POINTER_PATTERN),
        _matches("$.at", schemas.DATE_TIME_PATTERN),
        ("missing_field", maybe_field & ~_present("$.field")),
        *_signature(),
    ]


def failing(rules: list[Rule]) -> Column:
    """Codes of the rules a row breaks; a rule that is null does not fire."""
    return F.filter(
        F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda x: x.isNotNull()
    )


def broken(df: DataFrame, rules: list[Rule], paths: list[str]) -> DataFrame:
    """One row per broken rule, column code."""
    # What is no object at all breaks one rule, not each of an object's.
    codes = F.when(F.startswith(_kind("$"), F.lit("OBJECT")), failing(rules)).otherwise(F.array(F.lit("not_object")))
    hit = read_paths(df, paths).withColumn("code", F.explode_outer(codes)).where(F.col("code").isNotNull())
    return hit.select(*df.columns, "code")


def broken_artifacts(artifacts: DataFrame) -> DataFrame:
    return broken(artifacts, artifact_rules(), ARTIFACT_PATHS)


def broken_events(events: DataFrame) -> DataFrame:
    return broken(events, event_rules(), EVENT_PATHS)


def broken_locks(locks: DataFrame) -> DataFrame:
    return broken(locks, lock_rules(), LOCK_PATHS)


def payload_findings(groups: DataFrame, artifacts: DataFrame, events: DataFrame, locks: DataFrame) -> DataFrame:
    """Stage 2 over all three payloads, empty artifact and event groups included."""
    out = [
        found.select(*finding("2", F.col("code"), event_where(ix), F.to_json("raw")))
        for found, ix in (
            (broken_artifacts(artifacts), "artifact_ix"), (broken_events(events), "event_ix"), (broken_locks(locks), "lock_ix"),
        )
    ]
    size = F.size(F.col("value").try_cast("array<variant>"))
    where = F.concat(F.col("json_path"), F.lit("["), F.col("group_ix").cast("string"), F.lit("]"))
    known = [schemas.ARTIFACT_DOMAIN, schemas.EVENT_DOMAIN, schemas.LOCK_DOMAIN]
    code = F.when(size.isNull(), "group_not_array").when(
        (size == 0) & (F.col("domain") != schemas.LOCK_DOMAIN), "group_empty"
    )
    shape = groups.where(F.col("domain").isin(known)).withColumn("code", code).where(F.col("code").isNotNull())
    out.append(shape.select(*finding("2", F.col("code"), where, F.col("domain"))))
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def outside_vocabulary(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (where_, value) whose value is not listed for their where_; null values pass."""
    listed = vocabulary.select("where_", "value").distinct()
    governed = listed.select("where_").distinct()
    return (
        values.where(F.col("value").isNotNull())
        .join(governed, "where_", "left_semi")
        .join(listed, ["where_", "value"], "left_anti")
    )


# Fields every generated document carries: (path, JSON type, required); [*] asks it of every asset.
ENVELOPE_RULES = [
    ("$.Asset", "ARRAY", True),
    ("$.Asset[*].schemaVersion", "STRING", True),
    ("$.Asset[*].entityType", "STRING", True),
    ("$.Asset[*].identifier", "ARRAY", True),
    ("$.Asset[*].name", "STRING", False),
    ("$.Asset[*].description", "STRING", False),
    ("$.Asset[*].provenance", "OBJECT", False),
    ("$.Asset[*].assetFC", "OBJECT", False),
    ("$.Asset[*].AssetSC", "OBJECT", False),
]


def envelope_findings(parsed: DataFrame, cells: DataFrame, rules: list[tuple[str, str, bool]] = ENVELOPE_RULES) -> DataFrame:
    """Stage 1: rules are data, (path, JSON type, required), over the cells of those paths."""
    case = F.lit(None).cast("string")
    for path, kind, required in rules:
        wrong = F.when(F.col("kind").isNull() & F.lit(required), "missing").when(
            F.col("kind").isNotNull() & ~F.startswith("kind", F.lit(kind)), "wrong_type"
        )
        case = F.when(F.col("rule") == path, wrong).otherwise(case)
    unparsed = parsed.where("not parsed").select(
        *finding("1", F.lit("unparseable"), F.lit("$"), F.lit("document is not JSON"))
    )
    return (
        cells.withColumn("code", case)
        .where(F.col("code").isNotNull())
        .select(*finding("1", F.col("code"), F.col("where_"), F.coalesce("kind", F.lit("absent"))))
        .unionByName(unparsed)
    )


def vocabulary_findings(cells: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stage 7: strings only; vocabulary is (where_, value), where_ the path as it was asked for."""
    strings = cells.where("kind = 'STRING'").withColumnsRenamed({"where_": "place", "rule": "where_"})
    return outside_vocabulary(strings, vocabulary).select(
        *finding("7", F.lit("not_in_vocabulary"), F.col("place"), F.col("value"))
    )
