"""Field clean-up, names, times and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipledger import schemas

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
MAX_DETAIL = 220  # fixed value: longest finding text


def clean_cell(value: Column) -> Column:
    """Tab, CR and LF each become one space, so a cell can never split a row."""
    return F.translate(value, "\t\r\n", "   ")


def tape_id(name: Column) -> Column:
    """Leading camera letter and three digits, '' when absent."""
    return F.regexp_extract(name, r"^([A-Z][0-9]{3})", 1)


def first_name(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def bare_hash(value: Column) -> Column:
    """Drop everything up to the first colon."""
    return F.regexp_replace(value, r"^[^:]*:", "")


def short_hash(value: Column, length: int = 12) -> Column:
    return F.substring(bare_hash(value), 1, length)


def parse_iso(value: Column) -> Column:
    return F.try_to_timestamp(value)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO_SECONDS)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def log_file_name(ts: Column) -> Column:
    return F.concat(F.lit(schemas.ALE_FILE_PREFIX), F.date_format(ts, "yyyy-MM-dd"), F.lit(".ale"))


def lenient_int(value: Column) -> Column:
    """BIGINT when the text is all digits, null otherwise; keep the text beside it."""
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def clip_detail(value: Column) -> Column:
    """Finding text, at most 220 characters and a mark that it was cut."""
    return F.when(F.length(value) > MAX_DETAIL, F.concat(F.substring(value, 1, MAX_DETAIL), F.lit(" […]"))).otherwise(
        value
    )


def derived_id(*parts: Column) -> Column:
    """Stable urn:uuid from its inputs, so that a rerun writes the same documents."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "urn:uuid:$1-$2-$3-$4-$5")
