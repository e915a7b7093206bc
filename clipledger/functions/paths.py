"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger import schemas


def posix(path: Column) -> Column:
    """Back slashes to slashes."""
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(posix(path), r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(posix(path), r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    """Basename without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case last extension without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), r".\.([^.]+)$", 1))


def strip_double_extension(path: Column) -> Column:
    """Basename without '.omc.json', else without its last extension."""
    base = basename(path)
    return F.when(
        base.endswith(".omc.json"), F.regexp_replace(base, r"\.omc\.json$", "")
    ).otherwise(stem(path))


def relative_to(path: Column, base: Column) -> Column:
    """'./…' when path lies under base (whole components), the path itself otherwise."""
    root = F.regexp_replace(base, "/+$", "")
    return F.when(
        F.startswith(path, F.concat(root, F.lit("/"))),
        F.concat(F.lit("./"), F.substr(path, F.length(root) + 2)),
    ).otherwise(path)


def resolve(path: Column, base: Column) -> Column:
    """Join a document-relative path to its base folder; absolute paths stay."""
    rel = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), rel))


def sidecar_for_clip(path: Column) -> Column:
    """Same folder, same stem, '.omc.json'."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".omc.json"))


def is_clip(path: Column, exts: list[str] | None = None) -> Column:
    return extension(path).isin(exts or schemas.MANIFEST_CLIP_EXTS)


def _lookup(part: int) -> Column:
    pairs = [F.lit(x) for ext, value in schemas.MEDIA_TYPES.items() for x in (ext, value[part])]
    return F.create_map(*pairs)


def structural_type(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(0), ext), F.lit(schemas.DEFAULT_MEDIA_TYPE[0]))


def media_type(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(1), ext), F.lit(schemas.DEFAULT_MEDIA_TYPE[1]))


def codec(ext: Column) -> Column:
    pairs = [F.lit(x) for pair in schemas.CODECS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit(schemas.DEFAULT_CODEC))


def trailing_overlap(a: Column, b: Column) -> Column:
    """How many trailing path components two paths share."""
    left, right = F.reverse(F.split(posix(a), "/")), F.reverse(F.split(posix(b), "/"))
    same = F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(same, F.lit(False))
    return F.when(first_miss > 0, first_miss - 1).otherwise(F.size(same)).cast("bigint")


def trailing_suffixes(path: Column) -> Column:
    """Every run of trailing components as struct(depth, suffix): a/b/c -> c, b/c, a/b/c."""
    parts = F.split(posix(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.struct(
            k.cast("bigint").alias("depth"),
            F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/").alias("suffix"),
        ),
    )


def ancestors(folder: Column) -> Column:
    """The folder itself and every folder above it as struct(depth, dir)."""
    parts = F.split(folder, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.struct(
            k.cast("bigint").alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")
        ),
    )
