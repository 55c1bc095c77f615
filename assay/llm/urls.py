"""URL filters: rules, and a blocked Bloom filter in front of an exact join (operator 7).

A list of canonical URLs becomes a Bloom filter of 256-bit blocks: a URL's hash names one block, and ``PROBES`` further
hashes name bits in it.  The filter never has more than ``blocks`` rows of four longs, whatever the length of the list, so its
size is bounded and it is broadcast.  URLs whose bits are all set are possible hits; an exact hash join of these against
the list removes the false positives.  Both sides of that join carry a salt, so that one hot URL spreads over ``SALTS`` tasks.

Rules (host and path prefixes, a short literal list) come before the list: a rule fits its host and all subdomains if the
path starts with its path, and the longest fitting rule decides.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is never listed; an empty list
blocks nothing; repeated rows are judged alike; ties of rules of one length cannot both fit unless they are equal, then the
first in the list decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import settle

PROBES = 6
SALTS = 16
#: Most blocks of a filter: 2**18 blocks of 32 bytes are 8 MB.
BLOCKS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, ``m.`` or ``blog.``; path without ``.html`` and slashes at its end; null without host."""
    bare = F.regexp_replace(host, r"^(?:www|m|blog)\.", "")
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Index of the longest fitting rule, or null."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    return F.coalesce(F.lit(None).cast("int"), *[
        F.when(((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i))
        for i in order])


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(0)), F.lit(blocks))


def _bits(url: Column, word: int) -> Column:
    """The bits that a URL sets in one of the four longs of its block."""
    probes = [F.pmod(F.xxhash64(url, F.lit(p)), F.lit(256)) for p in range(1, PROBES + 1)]
    bit = [F.when(F.floor(x / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int")))
           .otherwise(F.lit(0).cast("long")) for x in probes]
    return reduce(lambda a, b: a.bitwiseOR(b), bit)


def bloom_filter(listed: DataFrame, url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """``block, w0 .. w3``: at most ``blocks`` rows."""
    u = F.col(url)
    return listed.select(_block(u, blocks).alias("block"), *[_bits(u, w).alias(f"w{w}") for w in range(4)]).groupBy(
        "block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)])


def listed_hits(rows: DataFrame, listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` (column ``key`` a canonical URL or null) with ``possible`` and ``is_listed``.

    ``listed`` has one column ``url``, distinct and not null.
    """
    u = F.col(key)
    words = F.broadcast(bloom_filter(listed, "url", blocks))
    probed = rows.withColumn("__block", _block(u, blocks)).join(words.withColumnRenamed("block", "__block"), "__block", "left")
    all_set = reduce(lambda a, b: a & b, [
        F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")).bitwiseAND(_bits(u, w)) == _bits(u, w) for w in range(4)])
    marked = probed.select(*rows.columns, (u.isNotNull() & all_set).alias("possible"))
    # impossible rows take part with a null key: they match nothing and keep to their own salt
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    left = marked.withColumn("__salt", salt).withColumn("__url", F.when(F.col("possible"), u))
    right = listed.select(F.col("url").alias("__url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"),
                          F.lit(True).alias("__hit"))
    hit = left.where("possible").join(right, ["__url", "__salt"], "left").select(
        *rows.columns, "possible", F.coalesce("__hit", F.lit(False)).alias("is_listed"))
    return marked.where(~F.col("possible")).withColumn("is_listed", F.lit(False)).unionByName(hit)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), key: str = "page_id", url: str = "url",
                blocks: int = BLOCKS) -> DataFrame:
    """``key, host, path, rule, verdict`` and ``possible``, ``is_listed`` for every row of ``pages``.

    ``listed`` has a column ``url`` of canonical URLs (see :func:`canonical`); repeats and nulls in it do not matter.
    """
    wanted = settle(listed.select("url").where("url is not null").distinct(), "listed-urls")
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = parts.withColumn("__rule", rule_of(rules, F.col("host"), F.col("path"))).withColumn(
        "canonical", canonical(F.col("host"), F.col("path")))
    judged = listed_hits(rows, wanted, "canonical", blocks)
    by_rule = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("__rule") == i, r.verdict) for i, r in enumerate(rules)])
    name = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("__rule") == i, r.name) for i, r in enumerate(rules)])
    return judged.select(F.col("key").alias(key), "host", "path", name.alias("rule"),
                         F.coalesce(by_rule, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"),
                         "possible", "is_listed")
