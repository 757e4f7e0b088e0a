"""URL filter: rules by host and path, then a block list held as a Bloom filter cascade.

Keys are an address (host and path) and the host with its parent domains; a url is blocked if one of its keys is listed.
The list is encoded over the corpus's complete universe of keys: level 1 is a Bloom filter of the listed keys, level 2 of
the unlisted keys that pass level 1, level 3 of the listed ones that pass level 2, and so on until no key is mistaken. A key
of the universe is listed if the first level that does not know it is an even one, so membership is exact, and urls are
judged in one pass without a join.

The universe (distinct keys, each with the mark of the list; an aggregate, not a join) is dealt by hash into shards of a
bounded number of keys, and each shard's cascade is built in one task. Judging takes the cascades in groups of at most
``group_bytes``, each group in one more pass over the urls; one pass is enough until the list is some 30 million keys long.
Keys are known by two 64-bit hashes; two keys of the universe that share both are found when the shards are built, and
then all hashes are made anew with another seed, so no hash decides.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the
end. A rule fits its host and all subdomains, if the path starts with the rule's; the longest (host and path together) wins,
and of equally long ones a block.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule, and is allowed unless the empty
key is listed; null and repeated ids and urls are judged each; very long urls count whole (parents are taken as far as the
longest listed name has labels, beyond which none can be listed); an empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from segmentry.llm.common import ascii_lower, read, stored

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The query's listed domains: these names under these parents.
LISTED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: An address met under so many different urls is a crawl trap, and listed too.
TRAP_URLS = 2
SHARD_KEYS, GROUP_BYTES = 1_000_000, 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    host, path = host_and_path(pages[f"`{url}`"])
    return pages.select(pages[f"`{page_id}`"].alias("page_id"), pages[f"`{url}`"].alias("url"), host.alias("host"), path.alias("path"))


def by_rule(rules, host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, starts in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(starts)
        out = F.when(fits, F.struct(F.lit(on + starts).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def keys(host: Column, path: Column, labels: int) -> Column:
    """The address, and the host's last 1, 2, ... ``labels`` labels."""
    return F.array_distinct(F.array(F.concat(host, path), *[F.substring_index(host, ".", -n) for n in range(1, labels + 1)]))


def _hashes(key: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), key).alias("h1"), F.xxhash64(key, F.lit(2 * seed + 1)).alias("h2"))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """An integer mixer (two rounds of multiply and shift) over unsigned 64-bit words."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, turn: int, bits) -> np.ndarray:
    return (_mixed(h1, level) + np.uint64(turn + 1) * (_mixed(h2, level) | np.uint64(1))) % np.asarray(bits, np.uint64)


def cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hash functions, filter) of each level. The first level's rate of mistakes balances its size with that of the
    levels above; those have a rate of a half."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    rate = min(0.5, len(inside) * 2**0.5 / max(len(outside), 1))
    while len(inside):
        turns = max(1, round(-np.log2(rate)))
        bits = int(np.ceil(len(inside) * -np.log2(rate) / np.log(2))) + 1
        table, found = np.zeros(bits, bool), np.ones(len(outside), bool)
        for turn in range(turns):
            table[_place(h1[inside], h2[inside], len(levels), turn, bits).astype(np.int64)] = True
        for turn in range(turns):
            found &= table[_place(h1[outside], h2[outside], len(levels), turn, bits).astype(np.int64)]
        levels.append((bits, turns, np.packbits(table, bitorder="little").tobytes()))
        inside, outside, rate = outside[found], inside, 0.5
    return levels


class Cascades:
    """Some shards' cascades, level by level: where each shard's filter starts in the level's bytes, its bits and its turns."""

    def __init__(self, rows: list, first: int, shards: int):
        self.first, self.depth, self.levels = first, np.zeros(shards, np.int64), []
        for level, own in itertools.groupby(sorted(rows, key=lambda r: (r["level"], r["shard"])), key=lambda r: r["level"]):
            start, bits, turns, parts, at = np.zeros(shards, np.int64), np.ones(shards, np.uint64), np.zeros(shards, np.int64), [], 0
            for r in own:
                s = r["shard"] - first
                start[s], bits[s], turns[s], self.depth[s] = at, r["bits"], r["turns"], level + 1
                parts.append(r["filter"])
                at += 8 * len(r["filter"])
            self.levels.append((start, bits, turns, np.frombuffer(b"".join(parts), np.uint8)))

    def listed(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed; keys of other shards are not."""
        shard = shard - self.first
        out = np.zeros(len(shard), bool)
        at = np.flatnonzero((shard >= 0) & (shard < len(self.depth)))
        for level, (start, bits, turns, table) in enumerate(self.levels):
            at = at[self.depth[shard[at]] > level]
            s, known = shard[at], np.ones(len(at), bool)
            for turn in range(int(turns.max(initial=0))):
                place = start[s] + _place(h1[at], h2[at], level, turn, bits[s]).astype(np.int64)
                known &= (turn >= turns[s]) | (table[np.minimum(place >> 3, len(table) - 1)] >> (place & 7) & 1 > 0)
            at = at[known]
            out[at] = level % 2 == 0
        return out


def built(page_keys: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """Cascades (shard, level, bits, turns, filter) over all keys of ``page_keys`` (key), with those of ``listed`` (key)
    marked; the number of shards; the seed of the hashes."""
    marked = page_keys.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    universe = stored(marked.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "url-keys")
    shards = max(1, -(-universe.count() // shard_keys))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = own["h1"].to_numpy().view(np.uint64), own["h2"].to_numpy().view(np.uint64)
        clash = bool(own.duplicated(["h1", "h2"]).any())
        levels = [] if clash else cascade(h1, h2, own["listed"].to_numpy(bool))
        rows = [(int(own["shard"].iloc[0]), i, *level, False) for i, level in enumerate(levels)] or ([(int(own["shard"].iloc[0]), 0, 0, 0, b"", True)] if clash else [])
        return pd.DataFrame(rows, columns=["shard", "level", "bits", "turns", "filter", "clash"])

    for seed in itertools.count():
        hashed = universe.select(_hashes(F.col("key"), seed).alias("h"), "listed").select("h.*", "listed", _shard(F.col("h.h1"), shards).alias("shard"))
        made = stored(hashed.groupBy("shard").applyInPandas(build, "shard long, level int, bits long, turns int, filter binary, clash boolean"), "url-cascades")
        if made.where("clash").isEmpty():
            return made.drop("clash"), shards, seed


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 20), F.lit(shards))


def _groups(cascades: DataFrame, shards: int, group_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs of shards whose filters take at most ``group_bytes``, or of one shard."""
    sizes = {r["shard"]: r["n"] for r in cascades.groupBy("shard").agg(F.sum(F.length("filter")).alias("n")).collect()}
    first = taken = 0
    for s in range(shards):
        if taken and taken + sizes.get(s, 0) > group_bytes:
            yield first, s - first
            first, taken = s, 0
        taken += sizes.get(s, 0)
    yield first, shards - first


def _any_listed(cascades: Cascades):
    @F.arrow_udf(BooleanType())
    def any_listed(hashes: pa.Array) -> pa.Array:
        flat = hashes.flatten()
        h1, h2, shard = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        found = cascades.listed(shard, h1.view(np.uint64), h2.view(np.uint64))
        upto = np.concatenate([[0], np.cumsum(found)])
        ends = np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))
        return pa.array(upto[ends] > upto[ends - hashes.value_lengths().to_numpy(zero_copy_only=False)])

    return any_listed


def with_listed(urls: DataFrame, labels: int, cascades: DataFrame, shards: int, seed: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``urls`` (with host and path) with ``listed``: whether one of a url's keys is. One pass a group of cascades."""
    out = urls.withColumn("listed", F.lit(False))
    for first, n in _groups(cascades, shards, group_bytes):
        rows = cascades.where(F.col("shard").between(first, first + n - 1)).collect()  # group_bytes at most
        if not rows:
            continue
        hashes = F.transform(keys(F.col("host"), F.col("path"), labels), lambda k: F.struct(*_key_columns(k, seed, shards)))
        out = out.withColumn("listed", F.col("listed") | _any_listed(Cascades(rows, first, n))(hashes))
        if first + n < shards:
            out = stored(out, "urls-listed")
    return out


def _key_columns(key: Column, seed: int, shards: int) -> list[Column]:
    h = _hashes(key, seed)
    return [h["h1"].alias("h1"), h["h2"].alias("h2"), _shard(h["h1"], shards).alias("shard")]


def judged(pages: DataFrame, domains, addresses: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url",
           shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of ``pages``: by the longest rule that fits, else by the
    block list of ``domains`` (names; with their subdomains) and ``addresses`` (key: host and path)."""
    urls = parsed(pages, page_id, url)
    domains = [d.lower() for d in domains]
    labels = max((d.count(".") + 1 for d in domains), default=1)
    listed = pages.sparkSession.createDataFrame([(d,) for d in domains], "key string")
    listed = reduce(DataFrame.unionByName, [listed, *([addresses.select("key")] if addresses is not None else [])])
    of_pages = urls.select("host", "path").distinct().select(F.explode(keys(F.col("host"), F.col("path"), labels)).alias("key"))
    cascades, shards, seed = built(of_pages, listed, shard_keys)
    found = with_listed(urls.withColumn("r", by_rule(rules, F.col("host"), F.col("path"))), labels, cascades, shards, seed, group_bytes)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", method).alias("verdict"), "listed")


def traps(pages: DataFrame, least: int = TRAP_URLS, url: str = "url") -> DataFrame:
    """(key) of addresses that are met under at least ``least`` different urls."""
    urls = parsed(pages, url, url).where("url is not null").select("url", F.concat("host", "path").alias("key")).distinct()
    return urls.groupBy("key").count().where(F.col("count") >= least).select("key")


def op12_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, LISTED, traps(pages))


ORACLE = rf"""
with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
t as (select host || path as key from u where url is not null group by 1 having count(distinct url) >= {TRAP_URLS}),
d(name) as (values {", ".join(f"('{d}')" for d in LISTED)}),
l as (select *, host || path in (select key from t) or exists (select 1 from d where host || path = name or host = name or ends_with(host, '.' || name))
             or host in (select key from t) as listed,
             ends_with('.' || host, '.org') as org, ends_with('.' || host, '.example.org') as example_org, ends_with('.' || host, '.com') as com from u),
r as (select *, case when example_org and starts_with(path, '/es/') then 'example.org/es/' when example_org and starts_with(path, '/en/1') then 'example.org/en/1'
                     when com and starts_with(path, '/fr/') then 'com/fr/' when com and starts_with(path, '/de/') then 'com/de/'
                     when org and starts_with(path, '/') then 'org/' end as rule from l)
select page_id, host, path, rule, listed,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict from r
"""
