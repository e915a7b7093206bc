"""Findings to stage results, reports and fleet status; keep-last, settle and recent views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.operators import ordered


def severity_rank(col: Column) -> Column:
    return F.when(col == "fail", 2).when(col == "warn", 1).otherwise(0)


def stage_results(
    findings: DataFrame, targets: DataFrame, stages: list[str], keys: list[str] | None = None,
    skipped: dict[str, str] | None = None,
) -> DataFrame:
    """One row per (document, stage): errors, warnings, status; stages without findings pass.

    A hot document's findings are counted map-side before they move. With skipped (stage to what it lacked; may be empty)
    each row has its lines as well: one per finding in the order of places, else OK or that the stage was not checked.
    """
    keys = keys or ["sidecar_path"]
    line = F.struct("where_", F.concat_ws(" ", "where_", F.concat("severity", F.lit(":")), "code", "detail").alias("line"))
    told = [] if skipped is None else [F.array_sort(F.collect_list(line)).alias("found")]
    counts = findings.groupBy(*keys, "stage").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
        *told,
    )
    grid = targets.select(*keys).distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    errors = F.coalesce("errors", F.lit(0)).cast("bigint")
    warnings = F.coalesce("warnings", F.lit(0)).cast("bigint")
    status = F.when(errors > 0, "fail").when(warnings > 0, "warn").otherwise("pass")
    lines = []
    if skipped is not None:
        plain = F.lit("OK")
        for stage, lacking in skipped.items():
            plain = F.when(F.col("stage") == stage, f"not checked: no {lacking}").otherwise(plain)
        lines = [F.coalesce("found.line", F.array(plain)).alias("lines")]
    return grid.join(counts, [*keys, "stage"], "left").select(
        *keys, "stage", status.alias("status"), errors.alias("errors"), warnings.alias("warnings"), *lines
    )


def reports(stages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per document: total errors, summary, and the stages (nine at most) as an array, with their lines if given."""
    keys = keys or ["sidecar_path"]
    titles = F.create_map(*[F.lit(x) for kv in schemas.STAGE_TITLES.items() for x in kv])
    item = F.struct("stage", F.try_element_at(titles, F.col("stage")).alias("title"), "status", "errors", "warnings", *(["lines"] if "lines" in stages.columns else []))
    out = stages.groupBy(*keys).agg(
        F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
        F.array_sort(F.collect_list(item)).alias("stages"),
    )
    return out.withColumn("summary", summary(F.col("errors")))


def summary(errors: Column) -> Column:
    return F.when(errors == 0, "OK").otherwise(F.concat(F.lit("FAIL ("), errors.cast("string"), F.lit(" error(s))")))


def report_json(reports_: DataFrame, key: str = "sidecar_path") -> DataFrame:
    """A report as one JSON text per document; base_dir is told where the reports have it."""
    base = ["base_dir"] if "base_dir" in reports_.columns else []
    return reports_.select(
        key, F.to_json(F.struct(F.col(key).alias("target"), *base, "stages", "errors", "summary")).alias("report")
    )


def top_status(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Worst status per key."""
    worst = F.max(severity_rank(F.col(status)))
    return df.groupBy(*keys).agg(
        F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("status")
    )


def tint(status: Column, quarantined: Column) -> Column:
    """Fleet colour: red on fail, amber on warn or quarantined documents, green, grey when unknown."""
    return (
        F.when(status == "fail", "red")
        .when((status == "warn") | (quarantined > 0), "amber")
        .when(status == "pass", "green")
        .otherwise("grey")
    )


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key; a partial aggregate instead of a window over the key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def recent(df: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """Newest n rows: each task keeps n, the rest never moves."""
    return df.orderBy(*order).limit(n)


def settled(
    obs: DataFrame, seconds: int, segment: int = 3600, key: str = "path", seen: str = "observed_at",
    version: list[str] | None = None,
) -> DataFrame:
    """First sighting of each version that has stood unchanged for at least the given seconds.

    A version starts when size or time differ from the sighting before; the first never fires.
    """
    version = version or ["length", "mtime"]
    seg = ordered.time_segment(F.col(seen), segment)
    stepped = ordered.previous_row(obs, [key], seg, [seen], version, "_prev")
    same = F.col("_prev").isNotNull()
    for c in version:
        same = same & F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    started = ordered.running_last(
        stepped, [key], seg, [seen], F.when(~same, F.col(seen)), "changed_at"
    )
    waited = F.col(seen).cast("double") - F.col("changed_at").cast("double")
    return (
        started.where(waited >= seconds)
        .groupBy(key, "changed_at")
        .agg(F.min_by(F.struct(seen, *version), seen).alias("_f"))
        .select(key, "changed_at", F.col(f"_f.{seen}").alias("settled_at"), *[F.col(f"_f.{c}").alias(c) for c in version])
    )


def snapshot_drift(local: DataFrame, published: DataFrame) -> DataFrame:
    """Two (name, sha256) snapshots: ok, drift, missing_published or missing_local."""
    a = local.select("name", F.col("sha256").alias("_a"))
    b = published.select("name", F.col("sha256").alias("_b"))
    state = (
        F.when(F.col("_b").isNull(), "missing_published")
        .when(F.col("_a").isNull(), "missing_local")
        .when(F.col("_a") == F.col("_b"), "ok")
        .otherwise("drift")
    )
    return a.join(b, "name", "full").select("name", state.alias("state"))
