"""One query per operator over the driver tables, with SQL where SQL can express it."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.bindings import Registry
from clipledger.llm import mixing, near, pieces, quality, repeats, secret_scan, toxicity, turn_queries, url_filter, vectors, wrappers
from clipledger.llm.support import table

R = Registry()
R.queries.update(turn_queries.R.queries)
R.sql.update(turn_queries.R.sql)

#: Vocabulary file of a public BPE model with byte pieces, read by the driver only.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

MIXTURE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             2 * source_size AS cap FROM s),
f AS (SELECT *, cap * 6 / weight AS fill, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 150 / 100.0
                 - coalesce(sum(cap) OVER (ORDER BY fill, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY fill, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
w AS (SELECT *, first_value(level) OVER (ORDER BY (weight * level <= cap) DESC, fill, rnk) AS water FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * water) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS times FROM p)
SELECT doc_id, size, source_size, target,
       (times * size + least(greatest(goal - times * source_size - ahead, 0), size))::BIGINT AS taken
FROM q
"""


def _quality_sql() -> str:
    grid = ", ".join(f"('{s}', {i}, {c})" for s, cuts in {
        "symbols": [500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10],
        "dup_lines": [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100],
        "repeats": [290, 270, 250, 230, 210, 190, 170, 150, 130, 110],
        "long_words": [4000, 3000, 2500, 2000, 1800, 1600, 1400, 1200, 1100, 1000],
    }.items() for i, c in enumerate(cuts))
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6),
          lambda i: array_to_string(words[i:i + 7], ' '))) AS g FROM d WHERE len(words) >= 8),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
          SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep ON rep.rid = d.rid),
q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS long_words
      FROM m),
v AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
u AS (UNPIVOT (SELECT q.rid, stratum, good, symbols, dup_lines, repeats, long_words FROM q JOIN v USING (doc_id)
               WHERE NOT base_failed) ON symbols, dup_lines, repeats, long_words INTO NAME signal VALUE x),
g(signal, step, cutoff) AS (VALUES {grid}),
c AS (SELECT stratum, u.signal, step, cutoff, sum(good) AS n, sum(CASE WHEN x > cutoff THEN good ELSE 0 END) AS k,
        sum(CASE WHEN x > cutoff THEN 1 - good ELSE 0 END) AS caught
      FROM u JOIN g ON g.signal = u.signal GROUP BY ALL),
tests AS (SELECT greatest(count(*), 1) AS tests FROM (SELECT DISTINCT stratum, signal FROM c)),
tail AS (SELECT c.*, CASE WHEN k < n * 0.005 THEN list_sum(list_transform(range(0, k::BIGINT + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(1 - 0.005)))) ELSE 1 END
           <= 0.05 / tests AS holds FROM c, tests),
stop AS (SELECT stratum, signal, min(step) FILTER (NOT holds) AS stop FROM tail GROUP BY ALL),
best AS (SELECT tail.stratum, tail.signal, arg_max(cutoff, caught * 1000 - step) AS cutoff
         FROM tail JOIN stop ON stop.stratum = tail.stratum AND stop.signal = tail.signal
         WHERE (stop IS NULL OR step < stop) AND caught > k AND caught > 0 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR EXISTS (SELECT 1 FROM best b WHERE b.stratum = q.stratum AND (
         (b.signal = 'symbols' AND q.symbols > b.cutoff) OR (b.signal = 'dup_lines' AND q.dup_lines > b.cutoff)
         OR (b.signal = 'repeats' AND q.repeats > b.cutoff) OR (b.signal = 'long_words' AND q.long_words > b.cutoff)))) AS kept
FROM q
"""


#: Domains whose pages make up the list of op5. Fixed values.
LISTED_DOMAINS = (
    "cheap-pills.example.com", "casino-win.example.org", "spam-farm.example.org", "free-bets.example.com", "ads-track.example.org",
)

URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '(?:/index\.html?)?/*$', '') END AS canon FROM h),
d(domain) AS (VALUES ('cheap-pills.example.com'), ('casino-win.example.org'), ('spam-farm.example.org'), ('free-bets.example.com'), ('ads-track.example.org')),
l AS (SELECT DISTINCT canon FROM c JOIN d ON host = domain OR ends_with(host, '.' || domain)),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
      FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(m.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canon IS NOT NULL AS listed
FROM c LEFT JOIN m USING (page_id) LEFT JOIN l ON l.canon = c.canon
"""


@R.add("op5_url_filter", URL_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """The list is every page's URL on the listed domains, so it grows with the pages."""
    pages = table(spark, sf, "pages")
    host = url_filter.host_and_path(F.col("url"))[0]
    listed = pages.where(reduce(lambda a, b: a | b, [url_filter.under(host, d) for d in LISTED_DOMAINS])).select("url")
    return url_filter.filtered(pages, listed).drop("maybe_listed")


@R.add("op6_near_vectors")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@R.add("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@R.add("op9_main_text")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract(table(spark, sf, "pages"))


@R.add("op7_mixture", MIXTURE_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@R.add("op10_quality", _quality_sql())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))


@R.add("op1_secrets")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


@R.add("op2_pieces")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.tokens(table(spark, sf, "documents"), pieces.load(spark, PIECE_MODEL))


@R.add("op3_repeats")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeats(table(spark, sf, "documents"))


@R.add("op4_near_duplicates")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf, "documents"))
