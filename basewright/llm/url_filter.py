"""URL filter: rules by host and path, then an exact list of canonical URLs behind a Bloom filter.

A rule decides alone where one fits; the longest fitting rule wins. All other URLs are
judged by the list: each is brought to canonical form and looked up in a blocked Bloom
filter (one row per block of `WORDS_PER_BLOCK` 64-bit words). Only URLs whose bits are
all set go on to the exact join, which removes the false hits. The filter is a table
like any other: Spark broadcasts it only if it is below its threshold.

Defined results: null URLs and URLs without `://` have an empty host and path, fit no
rule and are allowed unless their canonical form is listed (a null one never is).
Repeated rows are judged each on its own; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_own_shuffle
from .frames import lower_ascii

#: 256 bits a block, 16 a listed URL: about 1 false hit in 1,000.
WORDS_PER_BLOCK = 4
KEYS_PER_BLOCK = 16
#: Query parameters that do not choose a page.
TRACKING = r"(?i)(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?"


@dataclass(frozen=True)
class Rule:
    """`rule` is a host and the start of a path, such as `example.org/fr/`."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without a last `/`, the query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    found = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, found)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as a struct of its text and verdict, else null."""
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _bits(key: Column) -> list[Column]:
    """One bit in each word of a block, from independent hashes."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({i}, _key), 64) as int))") for i in range(1, WORDS_PER_BLOCK + 1)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per block that has a bit set; `listed` has a column `_key`."""
    words = [f"_w{i}" for i in range(WORDS_PER_BLOCK)]
    with_bits = listed.select(F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias("_block"), *(b.alias(w) for b, w in zip(_bits(F.col("_key")), words, strict=True)))
    return with_bits.groupBy("_block").agg(*(F.bit_or(w).alias(w) for w in words))


def possibly_listed(urls: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """`urls` with a boolean `_maybe`: false only if the column `_key` surely isn't in `listed`."""
    table = bloom_filter(listed, blocks).withColumnRenamed("_block", "_listed_block")
    # A URL without a key, or decided before, meets no block: it goes to a partition by its row's hash.
    block = F.when(F.col("_key").isNotNull(), F.pmod(F.xxhash64("_key"), F.lit(blocks))).otherwise(-1 - F.abs(F.xxhash64("_row") % 1_000_003))
    probed = urls.withColumn("_block", block).join(with_own_shuffle(table), F.col("_block") == F.col("_listed_block"), "left")
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("_key"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(bit) == bit)
    return probed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_listed_block", *(f"_w{i}" for i in range(WORDS_PER_BLOCK)))


def judged_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", row: str = "page_id") -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `canonical_url`, `listed` and `verdict`.

    `listed` has canonical URLs in its only column. `row` names a column that varies
    from row to row; it spreads rows that need no lookup.
    """
    keys = listed.toDF("_key").where("_key is not null").distinct()
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    added = ("host", "path", "rule", "canonical_url", "listed", "verdict")
    kept = [c for c in pages.columns if c not in added]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical_url"))
    parsed = parsed.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("_row", F.col(row))
    parsed = parsed.withColumn("_key", F.when(F.col("_rule").isNull(), F.col("canonical_url")))
    probed = possibly_listed(parsed, keys, blocks)
    # The exact join: a URL that cannot be listed gets a key that matches nothing and spreads evenly.
    exact = F.when(F.col("_maybe"), F.xxhash64("_key")).otherwise(F.xxhash64(F.lit("\0"), "_row"))
    probed = probed.withColumn("_hash", exact).withColumn("_exact", F.when(F.col("_maybe"), F.col("_key")))
    table = keys.select(F.xxhash64("_key").alias("_listed_hash"), F.col("_key").alias("_listed"))
    same = (F.col("_hash") == F.col("_listed_hash")) & (F.col("_exact") == F.col("_listed"))
    got = probed.join(with_own_shuffle(table), same, "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed").isNotNull(), "block").otherwise("allow"))
    return got.select(*kept, "host", "path", F.col("_rule.rule").alias("rule"), "canonical_url", F.col("_listed").isNotNull().alias("listed"), verdict.alias("verdict"))
