"""URL filters: domain rules, and a list of canonical URLs behind a blocked Bloom filter.

*Rules* are (host, path) pairs with a verdict.  A rule fits its host and every
subdomain, if the path starts with the rule's; the one with the longest host,
then the longest path, wins.

*List*: URLs are brought to one canonical form and looked up in a list.  A
blocked Bloom filter - one 256-bit block a URL, eight bits in it, one in each
32-bit lane - answers for nearly all rows that they are not listed; the rest
are possible hits and go through an exact join on the canonical URL, which
removes the false positives.  The filter never exceeds ``MAX_BLOCKS`` blocks:
with a longer list it lets more rows through to the join, it never errs.  Its
words are built by a bitwise aggregate with map-side combining.

Listed URLs are made distinct before the join and possible hits are salted, so
one URL on a third of the pages is spread over ``SALT`` keys.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, no canonical form, and is allowed; null or blank lines of the list are
ignored; repeated rows are judged each for itself; an empty list blocks nothing;
a very long URL is read whole; all columns of the input are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import cut, free_name

MAX_BLOCKS = 1 << 18  # 8 MB of bits
BITS_PER_URL = 16
LANES = 8
SALT = 16
#: Odd multipliers of the split-block filter that Parquet specifies (fixed values).
LANE_FACTORS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(found, upper, upper.lower())


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r))
    fitting = [
        F.when(
            ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in ordered
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without index page and trailing
    slashes, query parameters in order without tracking ones; no scheme, no fragment.
    Null where there is no host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^(?:[^@]*@)?(?:www\.)?", ""), r"(?::80|:443|\.)$", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"/index\.(?:html?|php)$", "/"), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda x: (x != "") & ~x.rlike(r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)"),
        )
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host(url) != "", F.concat(name, place, tail))


def n_blocks(urls: int) -> int:
    """A power of two, with BITS_PER_URL bits a URL as long as MAX_BLOCKS allows."""
    need = max(1, -(-urls * BITS_PER_URL // (32 * LANES)))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def _words(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its bit in each lane."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(32)) & np.uint64(blocks - 1)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bit = (low[:, None] * np.array(LANE_FACTORS, np.uint32)) >> np.uint32(27)
    return block.astype(np.int64), bit


def build(listed: DataFrame, url_hash: str, blocks: int) -> np.ndarray:
    """The filter as an array of (blocks, LANES) 32-bit words."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((blocks, LANES), np.uint32)
        for batch in batches:
            block, bit = _words(batch.iloc[:, 0].to_numpy(np.int64), blocks)
            for lane in range(LANES):
                np.bitwise_or.at(bits[:, lane], block, np.uint32(1) << bit[:, lane])
        at = np.flatnonzero(bits.any(axis=1))
        words = bits[at].astype(np.int64)
        yield pd.DataFrame({"block": at.astype(np.int32)} | {f"w{k}": words[:, k] for k in range(LANES)})

    schema = "block int, " + ", ".join(f"w{k} bigint" for k in range(LANES))
    found = (
        listed.select(url_hash)
        .mapInPandas(partial, schema)
        .groupBy("block")
        .agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES)])
        .toPandas()  # at most MAX_BLOCKS rows
    )
    out = np.zeros((blocks, LANES), np.uint32)
    out[found["block"].to_numpy(np.int64)] = found.drop(columns="block").to_numpy(np.int64).astype(np.uint32)
    return out


def may_contain(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False where the filter knows that a 64-bit hash is not listed."""
    block, bit = _words(hashes, len(bits))
    return ((bits[block] >> bit) & np.uint32(1)).all(axis=1)


def possible(url_hash: Column, bits: np.ndarray, spark) -> Column:
    """False where the filter knows that a hash is not listed."""
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def probe(hashes: pd.Series) -> pd.Series:
        table = shared.value
        known = hashes.notna().to_numpy()
        return pd.Series(may_contain(hashes.fillna(0).to_numpy(np.int64), table) & known)

    return probe(url_hash)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, listed; ``listed`` has one column of URLs."""
    n = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "listed", "__fit", "__canonical", "__hash", "__maybe", "__salt", "__name", "__at", "__hit")}
    spark = pages.sparkSession
    names = cut(listed.select(canonical(F.col(listed.columns[0])).alias("name")).filter("name IS NOT NULL").distinct())
    bits = build(names.select(F.xxhash64("name").alias("h")), "h", n_blocks(names.count()))
    rows = pages.withColumns({n["host"]: host(F.col(f"`{url}`")), n["path"]: path(F.col(f"`{url}`")), n["__canonical"]: canonical(F.col(f"`{url}`"))})
    rows = rows.withColumn(n["__hash"], F.when(F.col(n["__canonical"]).isNotNull(), F.xxhash64(n["__canonical"])))
    rows = rows.withColumn(n["__maybe"], possible(F.col(n["__hash"]), bits, spark))
    # Only possible hits have a name to join by; the salt spreads a name that very many pages share.
    rows = rows.withColumns(
        {
            n["__canonical"]: F.when(F.col(n["__maybe"]), F.col(n["__canonical"])),
            n["__salt"]: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in pages.dtypes if "map<" not in t and "variant" not in t], F.spark_partition_id()), F.lit(SALT)).cast("int"),
        }
    )
    exact = names.select(
        F.col("name").alias(n["__name"]), F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias(n["__at"]), F.lit(True).alias(n["__hit"])
    )
    hits = rows.filter(F.col(n["__maybe"])).join(
        exact, (F.col(n["__canonical"]) == F.col(n["__name"])) & (F.col(n["__salt"]) == F.col(n["__at"])), "left"
    )
    done = hits.withColumn(n["listed"], F.coalesce(F.col(n["__hit"]), F.lit(False))).unionByName(
        rows.filter(~F.col(n["__maybe"])).withColumn(n["listed"], F.lit(False)), allowMissingColumns=True
    )
    done = done.withColumn(n["__fit"], match_rule(F.col(n["host"]), F.col(n["path"]), rules))
    fit = F.col(n["__fit"])
    return done.select(
        *[F.col(f"`{c}`") for c in pages.columns], n["host"], n["path"], fit["rule"].alias(n["rule"]),
        F.coalesce(fit["verdict"], F.when(F.col(n["listed"]), F.lit("block")).otherwise(F.lit("allow"))).alias(n["verdict"]), n["listed"],
    )
