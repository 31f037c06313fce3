"""Judging URLs by host rules and by a list of canonical URLs.

A blocked Bloom filter of the list passes possible hits on; an exact join on the
canonical URL then removes its false positives. The filter's size is fixed from
the counted list and bounded, so it may be broadcast; a longer list only makes
it pass more rows on to the exact join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.session import hand_over

WORDS = 4                    # 64-bit words of one block, one bit set in each
BITS_PER_URL = 24
MAX_BLOCKS = 1 << 18         # 8 MB: the bound of what is broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that do not change what a page shows.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
            "ref", "fbclid", "gclid")
# The rules of the registered query, and the host labels whose pages it lists.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
SPAM_LABELS = ("spam-farm", "cheap-pills")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column, url: Column) -> Column:
    """One spelling per page: no scheme, ``www.``, port, fragment, tracking or closing slash."""
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^www\.", "")
    query_ = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query_, "&"), lambda p: (p != "")
                                   & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING)))
    return F.concat(name, F.regexp_replace(path, "/+$", ""), F.when(
        F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule (host and path prefix) that fits, and its verdict; NULLs if none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(text))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _probe(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL and the bit it sets in each word of that block."""
    where = F.pmod(F.xxhash64(url), F.lit(blocks))
    pattern = F.xxhash64(url, F.lit("pattern"))
    one = F.lit(1).cast("long")
    return where, [F.call_function("shiftleft", one, F.shiftrightunsigned(pattern, 6 * k).bitwiseAND(
        F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom(urls: DataFrame, column: str, n: int, bits_per_url: int = BITS_PER_URL) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``n`` URLs as rows (block, word0...); also its number of blocks.

    Bits are or-ed map-side. At most MAX_BLOCKS rows, whatever the list.
    """
    blocks = min(max(1, -(-n * bits_per_url // (64 * WORDS))), MAX_BLOCKS)
    where, bits = _probe(F.col(column), blocks)
    rows = urls.filter(F.col(column).isNotNull()).select(
        where.alias("_block"), *[b.alias(f"_w{k}") for k, b in enumerate(bits)])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(WORDS)]), blocks


def mark_listed(pages: DataFrame, column: str, listing: DataFrame, listing_column: str,
                out: str = "listed", bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """Add whether ``column`` occurs in the listing.

    Rows that miss the filter are done without moving; only possible hits are
    shuffled to the exact join. A NULL is never listed, an empty listing lists
    nothing, repeated list entries count once and repeated pages stay repeated.
    """
    # Written once: it is counted, made into the filter and joined.
    entries = hand_over(listing.select(F.col(listing_column).alias("_url"))
                        .filter("_url IS NOT NULL").distinct(), "listing")
    rows, blocks = bloom(entries, "_url", entries.count(), bits_per_url)
    where, bits = _probe(F.col(column), blocks)
    hit = F.col(column).isNotNull() & F.col("_w0").isNotNull()
    for k, bit in enumerate(bits):
        hit = hit & (F.coalesce(F.col(f"_w{k}"), F.lit(0)).bitwiseAND(bit) != 0)
    # At most MAX_BLOCKS rows of 48 bytes.
    probed = (pages.withColumn("_block", where).join(F.broadcast(rows), "_block", "left")
              .withColumn("_hit", hit).select(*pages.columns, "_hit"))
    missed = probed.filter(~F.col("_hit")).select(*pages.columns, F.lit(False).alias(out))
    possible = probed.filter("_hit").join(entries, F.col(column) == F.col("_url"), "left")
    return missed.unionByName(possible.select(*pages.columns, F.col("_url").isNotNull().alias(out)))


def judge(pages: DataFrame, listing: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          key: str = "page_id", url: str = "url", listing_url: str = "url") -> DataFrame:
    """Host, path, rule, canonical URL and verdict of every page.

    The longest fitting rule decides; else a listed canonical URL is blocked
    and any other allowed. A NULL URL, or one without ``://``, has an empty
    host and path, fits no rule and is never listed, so it is allowed. Repeated
    rows give repeated results; other columns are not read.
    """
    def parts(df: DataFrame, *cols: Column) -> DataFrame:
        host, path = split_url(F.col("_raw"))
        named = df.select(*cols).withColumns({"host": host, "path": path})
        return named.withColumn("canonical", F.when(F.col("host") != "", canonical(
            F.col("host"), F.col("path"), F.col("_raw"))))

    rows = parts(pages, F.col(key).alias("_id"), F.col(url).cast("string").alias("_raw")).drop("_raw")
    entries = parts(listing, F.col(listing_url).cast("string").alias("_raw")).select("canonical")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return mark_listed(rows, "canonical", entries, "canonical").select(
        F.col("_id").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "listed")


def spam_listing(pages: DataFrame, url: str = "url", labels: Sequence[str] = SPAM_LABELS) -> DataFrame:
    """URLs of all pages on a host that has one of the labels."""
    host, _ = split_url(F.col(url))
    return pages.select(url).filter(F.arrays_overlap(
        F.split(host, r"\."), F.array(*[F.lit(x) for x in labels])))


_CANONICAL = r"""
regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
|| CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END
"""

_SQL = rf"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'),
          lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({', '.join(f"'{t}'" for t in TRACKING)}))) AS params
      FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN {_CANONICAL} END AS canonical FROM b),
s AS (SELECT DISTINCT canonical FROM c
      WHERE len(list_intersect(string_split(host, '.'), ['{"', '".join(SPAM_LABELS)}'])) > 0),
r AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for k, r in RULES)})
      AS r(kind, rule, name, prefix)),
f AS (SELECT page_id, r.kind, r.rule FROM c JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.rule) = 1)
SELECT c.page_id, host, path, f.rule, canonical, canonical IS NOT NULL AND canonical IN (FROM s) AS listed,
       CASE WHEN f.kind IS NOT NULL THEN f.kind WHEN canonical IN (FROM s) THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN f USING (page_id)
"""


@query("op2_url_filter", _SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, spam_listing(pages))
