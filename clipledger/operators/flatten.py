"""Nested documents to flat payload tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.session import cut_lineage


_CUSTOM = "/assetFC/functionalProperties/customData"
_ENTRY = "array<struct<json_path: string, group_ix: int, entry: variant>>"


def _list(v: Column, path: str) -> Column:
    """Array at a path of a VARIANT, empty when there is none."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _custom_path() -> str:
    return "$" + _CUSTOM.replace("/", ".")


def _entries(asset: Column, prefix: Column) -> Column:
    where = F.concat(prefix, F.lit(_CUSTOM)).alias("json_path")
    return F.transform(
        _list(asset, _custom_path()), lambda e, i: F.struct(where, i.alias("group_ix"), e.alias("entry"))
    )


def _groups_of(body: Column) -> Column:
    """customData entries of the assets and of the assets inside them, as one array."""

    def of_asset(asset: Column, i: Column) -> Column:
        outer = F.concat(F.lit("Asset/"), i.cast("string"))
        inner = F.transform(
            _list(asset, "$.Asset"),
            lambda sub, j: _entries(sub, F.concat(outer, F.lit("/Asset/"), j.cast("string"))),
        )
        return F.concat(_entries(asset, outer), F.flatten(inner))

    return F.flatten(F.transform(_list(body, "$.Asset"), of_asset))


def _arrays_of(body: Column) -> Column:
    """How many customData arrays those assets hold, empty ones included."""
    here = lambda v: F.try_variant_get(v, _custom_path(), "array<variant>").isNotNull()
    assets = _list(body, "$.Asset")
    inner = F.flatten(F.transform(assets, lambda v: _list(v, "$.Asset")))
    return F.size(F.filter(F.concat(assets, inner), here))


def _declared(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r'"customData"\s*:\s*\['))


#: Start of a path that is asked of every asset, whatever its depth.
EACH = "$.Asset[*]."
_CELL = "array<struct<rule: string, where_: string, value: string, kind: string>>"


def _cell(rule: str, where: Column, node: Column, path: str) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), where.alias("where_"), F.try_variant_get(node, path, "string").alias("value"),
        F.schema_of_variant(F.try_variant_get(node, path, "variant")).alias("kind"),
    )


def _asset_cells(asset: Column, where: Column, rules: list[str]) -> Column:
    """One cell per rule of one asset; where is the asset's own path."""
    return F.array(*[
        _cell(r, F.concat(where, F.lit("." + r.removeprefix(EACH))), asset, "$." + r.removeprefix(EACH)) for r in rules
    ])


def _each_asset(body: Column, rules: list[str]) -> Column:
    """Cells of the assets and of the assets inside them; a document without any has the cells of an absent first one."""

    def of_asset(asset: Column, i: Column) -> Column:
        here = F.concat(F.lit("$.Asset["), i.cast("string"), F.lit("]"))
        inner = F.transform(
            _list(asset, "$.Asset"),
            lambda sub, j: _asset_cells(sub, F.concat(here, F.lit(".Asset["), j.cast("string"), F.lit("]")), rules),
        )
        return F.concat(_asset_cells(asset, here, rules), F.flatten(inner))

    assets = _list(body, "$.Asset")
    some = F.when(F.size(assets) > 0, assets).otherwise(F.array(F.lit(None).cast("variant")))
    return F.flatten(F.transform(some, of_asset))


def _asset_lists(body: Column) -> Column:
    """How many arrays of assets those two levels hold."""
    here = lambda v: F.try_variant_get(v, "$.Asset", "array<variant>").isNotNull()
    assets = _list(body, "$.Asset")
    return F.when(here(body), 1).otherwise(0) + F.size(F.filter(assets, here))


def parse(documents: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """One pass over the document text: (sidecar_path, parsed, cells, groups, deep_text, deep_assets).

    cells holds (rule, where_, value, kind) of each named path; a path that starts with $.Asset[*] is asked of every asset, and
    where_ is its place. deep_text is set only for documents that declare more customData arrays than the two asset levels hold,
    deep_assets for those with more arrays of assets.
    """
    single = [p for p in paths or [] if not p.startswith(EACH)]
    each = [p for p in paths or [] if p.startswith(EACH)]
    body = F.col("body")
    cells = F.array(*[_cell(p, F.lit(p), body, p) for p in single]) if single else F.array().cast(_CELL)
    if each:
        cells = F.concat(cells, _each_asset(body, each))
    deep = _declared(F.col("text")) != _arrays_of(body)
    nested = F.regexp_count("text", F.lit(r'"Asset"\s*:\s*\[')) != _asset_lists(body)
    return documents.select(
        "sidecar_path",
        body.isNotNull().alias("parsed"),
        F.when(body.isNotNull(), cells).otherwise(F.array()).cast(_CELL).alias("cells"),
        F.when(body.isNotNull() & ~deep, _groups_of(body)).cast(_ENTRY).alias("groups"),
        F.when(body.isNotNull() & deep, F.col("text")).alias("deep_text"),
        F.when(body.isNotNull() & nested, F.col("text")).alias("deep_assets"),
    )


def _deep_cells(texts: DataFrame, rules: list[str]) -> DataFrame | None:
    """Cells of the assets below the second level of (sidecar_path, deep_assets), a round for each level."""
    level = texts.select("sidecar_path", F.lit("$").alias("at"), F.try_parse_json("deep_assets").alias("node"))
    found, depth = [], 0
    while True:
        level = cut_lineage(
            level.select("sidecar_path", "at", F.posexplode(_list(F.col("node"), "$.Asset")).alias("i", "node")).select(
                "sidecar_path", F.concat("at", F.lit(".Asset["), F.col("i").cast("string"), F.lit("]")).alias("at"), "node"
            )
        )
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found) if found else None
        depth += 1
        if depth > 2:
            cells_ = _asset_cells(F.col("node"), F.col("at"), rules)
            found.append(level.select("sidecar_path", F.explode(cells_).alias("c")).select("sidecar_path", "c.*"))


def _children(nodes: DataFrame) -> DataFrame:
    """One level down: every member of every object and array, with its path."""
    inside = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode(F.col("node").outer()))
    step = F.coalesce("key", F.col("pos").cast("string"))
    return inside.select(
        "sidecar_path", F.concat_ws("/", F.when(F.col("json_path") != "", F.col("json_path")), step).alias("json_path"),
        F.col("key").eqNullSafe(F.lit("customData")).alias("named"), F.col("value").alias("node"),
    )


def _deep_groups(texts: DataFrame) -> DataFrame:
    """Entries of the customData arrays at any depth of (sidecar_path, deep_text), found level by level.

    There are as many rounds as the deepest document has levels; members without members of their own go no further.
    """
    level = texts.select("sidecar_path", F.lit("").alias("json_path"), F.try_parse_json("deep_text").alias("node"))
    found = []
    while not level.isEmpty():
        below = cut_lineage(_children(level))
        found.append(
            below.where("named").select(
                "sidecar_path", "json_path", F.posexplode_outer(_list(F.col("node"), "$")).alias("group_ix", "_entry")
            ).where(F.col("group_ix").isNotNull())
        )
        level = below.where(F.schema_of_variant("node").rlike("^(ARRAY|OBJECT)"))
    return reduce(DataFrame.unionByName, found) if found else None


def groups(parsed: DataFrame) -> DataFrame:
    """Every customData entry at any depth: one row per (document, json path, position).

    Documents with deep_text, if there are any, take a round for each of their levels.
    """
    # explode_outer and a filter on its output: a filter on the array itself, which plain explode
    # also infers, would be pushed below and evaluate the whole parse a second time.
    shallow = parsed.select("sidecar_path", F.explode_outer("groups").alias("g")).select(
        "sidecar_path", "g.json_path", "g.group_ix", F.col("g.entry").alias("_entry")
    )
    deep = _deep_groups(parsed.where("deep_text is not null").select("sidecar_path", "deep_text"))
    entries = shallow if deep is None else shallow.unionByName(deep)
    return (
        entries.select(
            "sidecar_path", "json_path", "group_ix",
            F.try_variant_get("_entry", "$.domain", "string").alias("domain"),
            F.try_variant_get("_entry", "$.value", "variant").alias("value"),
        )
        .where(F.col("domain").isNotNull())
    )


def custom_data(documents: DataFrame) -> DataFrame:
    """Group rows straight from documents: the text is parsed once and what it leaves is checkpointed."""
    return groups(cut_lineage(parse(documents)))


def cells(parsed: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(sidecar_path, rule, where_, value, kind), one row per document and path asked for, and per asset where the path says so.
    With the paths given to parse, assets below the second level are looked at as well."""
    rows = parsed.select("sidecar_path", F.explode_outer("cells").alias("c")).select("sidecar_path", "c.*")
    rows = rows.where(F.col("where_").isNotNull())
    each = [p for p in paths or [] if p.startswith(EACH)]
    deep = _deep_cells(parsed.where("deep_assets is not null").select("sidecar_path", "deep_assets"), each) if each else None
    return rows if deep is None else rows.unionByName(deep)


def payload(groups: DataFrame, domain: str, ix: str) -> DataFrame:
    """All values of one domain in document order."""
    return groups.where(F.col("domain") == domain).select(
        "sidecar_path",
        "json_path",
        "group_ix",
        F.posexplode_outer(F.col("value").try_cast("array<variant>")).alias(ix, "raw"),
    ).where(F.col(ix).isNotNull())


def _text(path: str) -> Column:
    return F.try_variant_get("raw", path, "string")


def _sig() -> Column:
    return F.struct(
        _text("$.sig.alg").alias("alg"), _text("$.sig.kid").alias("kid"), _text("$.sig.value").alias("value")
    )


def artifacts(groups: DataFrame) -> DataFrame:
    return payload(groups, schemas.ARTIFACT_DOMAIN, "artifact_ix").select(
        "sidecar_path", "json_path", "group_ix", "artifact_ix",
        _text("$.id").alias("id"), _text("$.role").alias("role"), _text("$.kind").alias("kind"),
        _text("$.subtype").alias("subtype"), _text("$.path").alias("path"),
        _text("$.mhlEntry").alias("mhl_entry"), _text("$.hash.alg").alias("alg"),
        _text("$.hash.value").alias("value"),
        F.try_variant_get("raw", "$.immutable", "boolean").alias("immutable"), "raw",
    )


def events(groups: DataFrame) -> DataFrame:
    """Event rows, each with the event before it in its array: chain checks then need no shuffle."""
    items = F.col("value").try_cast("array<variant>")
    # The array moved on by one, met once: a look-up of the one before inside a lambda would cast the whole array for every event.
    before = F.slice(F.concat(F.array(F.lit(None).cast("variant")), items), F.lit(1), F.size(items))
    paired = F.zip_with(items, before, lambda e, p: F.struct(e.alias("raw"), p.alias("prev_raw")))
    rows = (
        groups.where(F.col("domain") == schemas.EVENT_DOMAIN)
        .select("sidecar_path", "json_path", "group_ix", F.posexplode_outer(paired).alias("event_ix", "_e"))
        .where(F.col("event_ix").isNotNull())
        .select("sidecar_path", "json_path", "group_ix", "event_ix", "_e.raw", "_e.prev_raw")
    )
    return rows.select(
        "sidecar_path", "json_path", "group_ix", "event_ix",
        F.try_variant_get("raw", "$.seq", "bigint").alias("seq"), _text("$.ts").alias("ts"),
        F.try_to_timestamp(_text("$.ts")).alias("ts_utc"),
        F.struct(_text("$.actor.id").alias("id"), _text("$.actor.role").alias("role")).alias("actor"),
        F.struct(_text("$.tool.name").alias("name"), _text("$.tool.version").alias("version")).alias("tool"),
        _text("$.action").alias("action"), _text("$.target").alias("target"),
        _text("$.prevHash").alias("prev_hash"), _text("$.hash").alias("hash"), _sig().alias("sig"), "raw", "prev_raw",
    )


def locks(groups: DataFrame) -> DataFrame:
    return payload(groups, schemas.LOCK_DOMAIN, "lock_ix").select(
        "sidecar_path", "json_path", "group_ix", "lock_ix",
        _text("$.target").alias("target"), _text("$.scope").alias("scope"), _text("$.field").alias("field"),
        _text("$.by").alias("by"), _text("$.at").alias("at"), _text("$.reason").alias("reason"),
        _sig().alias("sig"), "raw",
    )


def corrupt(parsed: DataFrame, groups_: DataFrame) -> DataFrame:
    """Documents that do not parse, and documents without any payload domain."""
    known = [schemas.ARTIFACT_DOMAIN, schemas.EVENT_DOMAIN, schemas.LOCK_DOMAIN]
    carrying = groups_.where(F.col("domain").isin(known)).select("sidecar_path").distinct()
    broken = parsed.where("not parsed").select("sidecar_path", F.lit("unparseable").alias("code"))
    empty = (
        parsed.where("parsed").select("sidecar_path").join(carrying, "sidecar_path", "left_anti")
        .select("sidecar_path", F.lit("no_payload").alias("code"))
    )
    return broken.unionByName(empty)


def reel_members(documents: DataFrame) -> DataFrame:
    """Declared member count of a reel against the assets nested in it."""
    top = documents.select(
        "sidecar_path", F.explode(F.try_variant_get("body", "$.Asset", "array<variant>")).alias("a")
    )
    declared = F.try_variant_get("a", "$.AssetSC.structuralProperties.assetGroup.memberCount", "bigint")
    nested = F.size(F.coalesce(F.try_variant_get("a", "$.Asset", "array<variant>"), F.array()))
    return top.select(
        "sidecar_path", declared.alias("declared"), nested.cast("bigint").alias("nested")
    ).where(F.col("declared").isNotNull())


def document_order(ix: str) -> Column:
    """Sort key of a payload row: outer groups before nested ones, then position."""
    parts = F.split("json_path", "/")
    steps = F.transform(parts, lambda x: F.struct(x.try_cast("bigint").alias("n"), x.alias("key")))
    return F.struct(
        F.size(parts).alias("depth"), steps.alias("path"), F.col("group_ix").alias("group"), F.col(ix).alias("ix")
    )
