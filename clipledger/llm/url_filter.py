"""URL filters: prefix rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words. A URL's hash names its block; it sets, or tests, one bit in
each word. The number of blocks follows the list up to MAX_BLOCKS, so what is broadcast is at most 2^17 x 32 bytes; with a
longer list more URLs pass, and the exact hash join behind the filter takes false positives out all the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.support import stage

WORDS, WORD_BITS, BITS_PER_URL, MAX_BLOCKS = 8, 32, 16, 1 << 17

#: (verdict, host, path) of the contract. Fixed values.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, ASCII lower case, and path; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def canonical(host: Column, path: Column) -> Column:
    """Host and path without `index.html` and closing slashes; scheme, query and fragment don't count. Null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"(?:/index\.html?)?/*$", "")))


def under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [under(host, h) & path.startswith(p) for _, h, p in by_length]
    return (
        F.coalesce(*[F.when(f, h + p) for f, (_, h, p) in zip(fits, by_length)]),
        F.coalesce(*[F.when(f, v) for f, (v, _, _) in zip(fits, by_length)]),
    )


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), url), F.lit(WORD_BITS)).cast("int") for i in range(WORDS)]


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, words) of a materialised list of distinct canonical URLs, and the number of blocks."""
    n = listed.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_URL // (WORDS * WORD_BITS))))
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) for b in _bits(F.col("canon"))]
    return listed.groupBy(_block(F.col("canon"), blocks).alias("block")).agg(F.array(*words).alias("words")), blocks


def filtered(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, maybe_listed, listed for every row of pages (page_id, url).

    listed: URLs to block where no rule decides, column url. Null or empty url: empty host and path, allowed. Only rows
    that the filter lets through are joined with the list; a URL that many pages share meets one row of it."""
    host, path = host_and_path(F.col("url"))
    known = stage(listed.select(canonical(*host_and_path(F.col("url"))).alias("canon")).where("canon is not null").distinct())
    table, blocks = bloom(known)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("canon", canonical(F.col("host"), F.col("path")))
    probed = rows.withColumn("block", _block(F.col("canon"), blocks)).join(F.broadcast(table), "block", "left")
    inside = [F.col("words")[i].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) != 0 for i, b in enumerate(_bits(F.col("canon")))]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    maybe = F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    probed = stage(probed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), "canon", maybe.alias("maybe_listed")))
    hits = probed.where("maybe_listed").join(known.withColumn("listed", F.lit(True)), "canon", "left")
    rest = probed.where("not maybe_listed").withColumn("listed", F.lit(False))
    return hits.unionByName(rest).select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        "maybe_listed", F.coalesce("listed", F.lit(False)).alias("listed"),
    )
