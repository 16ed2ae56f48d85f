"""URL filters (operator 1).

URLs are brought to a canonical form. The listed ones set bits in a blocked Bloom filter: each URL
belongs to one block, a 64-bit word, and sets a few bits there. The filter is a table of at
most `max_blocks` rows, small enough to be sent to every task, and lets through nearly only listed URLs;
those are joined with the list itself, which takes out false positives. Rules for hosts and paths go
before the list. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stash

#: Bits a URL sets in its block, and listed URLs a block is meant for.
BITS = 5
PER_BLOCK = 6
#: The filter has no more blocks: a table of 4 MB.
MAX_BLOCKS = 1 << 18

#: Rules of the query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Sites that the query's list is made of: every address seen there, on whatever mirror.
LISTED_SITES = ("spam-farm", "casino-win")


def host_of(url: Column) -> Column:
    """What follows `://` up to the path, A-Z lower-cased; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    """What follows the host up to the query; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` or `m.`, path without its last slashes, query without tracking, no fragment.

    Empty where there is no `://`.
    """
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(
        F.regexp_replace(host_of(url), r"^(www|m)\.", ""),
        F.regexp_replace(path_of(url), r"/+$", ""),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of `rule` and `verdict`; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        this = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, this).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _mask(key: Column) -> Column:
    """The bits of a URL in its block, six bits of a hash for each."""
    bits = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """`block` and `word`, for the keys in column `listed`; empty blocks are left out."""
    return listed.groupBy(_block(F.col("listed"), blocks).alias("block")).agg(
        F.bit_or(_mask(F.col("listed"))).alias("word")
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """A verdict for each row of `pages`: the longest fitting rule's, else `block` for listed URLs.

    Gives `page_id`, `host`, `path`, `rule` (null where none fits), `verdict`, `possible` (the filter
    let it through) and `listed`. A null URL or one without `://` has an empty host and path, fits no
    rule and is never listed. Repeated rows are judged each by itself; other columns are ignored. An empty
    list blocks nothing; an empty table gives no rows.
    """
    names = stash(
        listed.select(canonical(F.col(listed_col)).alias("listed"))
        .filter(F.col("listed") != "")
        .distinct(),
        "listed",
    )
    blocks = min(max_blocks, max(1, names.count() // PER_BLOCK))
    bloom = F.broadcast(bloom_filter(names, blocks))  # at most max_blocks rows
    url = F.col(url_col)
    judged = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        canonical(url).alias("_key"),
    ).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    probed = judged.withColumn("block", _block(F.col("_key"), blocks)).join(bloom, "block", "left")
    mask = _mask(F.col("_key"))
    possible = (F.col("_key") != "") & F.coalesce(
        F.col("word").bitwiseAND(mask) == mask, F.lit(False)
    )
    probed = probed.withColumn("possible", possible)
    # Only possible hits are shuffled to the list.
    hits = (
        probed.filter("possible")
        .join(names.withColumn("in_list", F.lit(True)), F.col("_key") == F.col("listed"), "left")
        .withColumn("is_listed", F.coalesce("in_list", F.lit(False)))
        .drop("listed", "in_list")
    )
    return (
        probed.filter(~F.col("possible"))
        .withColumn("is_listed", F.lit(False))
        .unionByName(hits)
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(
                F.col("_rule.verdict"), F.when(F.col("is_listed"), "block").otherwise("allow")
            ).alias("verdict"),
            "possible",
            F.col("is_listed").alias("listed"),
        )
    )


def listed_urls(pages: DataFrame, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """The URLs in `pages` that belong to one of the sites, by a label of the host."""
    label = F.split(host_of(F.col("url")), r"\.")
    return pages.filter(F.arrays_overlap(label, F.array(*map(F.lit, sites)))).select("url")
