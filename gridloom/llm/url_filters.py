"""URL lists: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A listed URL is a host and the beginning of a path; it fits that host and all its subdomains. A
page's URL is looked up under every key it could be listed by: each of its host's endings, as many
labels as the list has at most, with each beginning of its path of a length that the list has. The
filter lets possible hits pass (none of the listed is lost); the join drops its false positives.
The filter has about 16 bits a key up to a set size; beyond it passes more, and the join drops more.

Defined results: null urls, and urls without `://`, have an empty host and path and fit no rule;
of rules with one host and path the largest verdict counts (block before allow), whatever their order;
repeated rows each get a row; an empty table or an empty list is fine; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

BLOCK_WORDS = 8  # 64-bit words of a block: a cache line
BITS_SET = 8
MAX_BLOCKS = 1 << 17  # 8 MB of filter
BROADCAST_ROWS = 100_000  # a listed rule is at most some hundred bytes


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k)
    return lower_ascii(part(1)), part(2)


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and the block's words with its bits set (n x 8)."""
    h = h.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        second = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        second ^= second >> np.uint64(32)
        block = (h % np.uint64(blocks)).astype(np.int64)
    mask = np.zeros((len(h), BLOCK_WORDS), np.uint64)
    rows = np.arange(len(h))
    for k in range(BITS_SET):
        at = (second >> np.uint64(7 * k)) % np.uint64(64 * BLOCK_WORDS)
        np.bitwise_or.at(mask, (rows, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return block, mask


def bloom_filter(keys: DataFrame, n: int) -> np.ndarray:
    """The filter of the column `key`: tasks build blocks, which are combined by bit_or."""
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * 16 // (64 * BLOCK_WORDS)))))

    def build(batches):
        for pdf in batches:
            block, mask = _bits(pdf["h"].to_numpy(), blocks)
            yield pd.DataFrame({"block": block} | {f"w{k}": mask[:, k].view(np.int64) for k in range(BLOCK_WORDS)})

    schema = "block long, " + ", ".join(f"w{k} long" for k in range(BLOCK_WORDS))
    built = keys.select(F.xxhash64("key").alias("h")).mapInPandas(build, schema).groupBy("block").agg(*(F.expr(f"bit_or(w{k})").alias(f"w{k}") for k in range(BLOCK_WORDS)))
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    for r in built.toLocalIterator():  # at most MAX_BLOCKS rows, whatever the list
        out[r[0]] = np.array(r[1:], np.int64).view(np.uint64)
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) -> page_id, host, path, rule, verdict. The longest fitting rule wins."""
    spark = pages.sparkSession
    listed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("key"), "host", "path", "verdict")
    listed = listed.groupBy("key").agg(F.max("host").alias("host"), F.min("path").alias("path"), F.max("verdict").alias("verdict"))
    shape = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    filled = spark.sparkContext.broadcast(bloom_filter(listed, shape["n"]))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        block, mask = _bits(h.to_numpy(), len(filled.value))
        return pd.Series(((filled.value[block] & mask) == mask).all(axis=1))

    # The lengths are data, so the plan does not grow with the list.
    lengths = ", ".join(map(str, sorted(shape["lengths"])))
    ends = f"transform(sequence(1, least({shape['labels']}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))"
    starts = f"transform(filter(array({lengths}), n -> n <= length(path)), n -> substring(path, 1, n))"
    keys = F.expr(f"flatten(transform({ends}, e -> transform({starts}, s -> concat(e, s))))")
    # A URL's rule depends on its host and path alone: each is looked up once.
    asked = urls.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(keys).alias("key"))
    asked = asked.where(maybe(F.xxhash64("key")))
    exact = listed.select("key", "verdict")
    hits = asked.join(F.broadcast(exact) if shape["n"] <= BROADCAST_ROWS else exact, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("found"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
