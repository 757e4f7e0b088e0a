"""The cascade against a plain set; rules, hosts and paths against plain Python."""

import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.llm import url_filter as uf

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, listed string, key string, r string, h1 long, shard long"


def plain(url):
    found = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")


def plain_rule(host, path):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in uf.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_listed(host, path, domains, addresses):
    parents = [".".join(host.split(".")[i:]) for i in range(len(host.split(".")))]
    return any(k in domains | addresses for k in [host + path, *parents])


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://ORG"), (6, "http://org/"), (7, "https://a.Example.ORG/es/1?x=/en/1"), (8, "https://example.org/en/12#t"),
    (9, "https://notexample.org/es/1"), (10, "x://com/fr/"), (11, "x://a.com/de/x?y"), (12, "x://a.com/de"), (13, "x://a.com?/fr/"), (14, "x://spam-farm.example.net/"), (None, "x://a.b.spam-farm.example.net"),
    (14, "x://spam-farm.example.net/"), (15, "x://xspam-farm.example.net/a\nb"), (16, "x://É.example.net/É"), (17, "x://twice.net/a?1"), (18, "x://twice.net/a?2"), (18, "x://twice.net/a?2"),
    (19, "x://" + "a." * 20000 + "free-bets.example.com/" + "p" * 50000), (20, "x://one.net/a?1"), (20, "x://one.net/a?1"), (21, "x://.net//"), (22, "x://a.net/://spam-farm.example.net/"),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_urls_like_plain_python(spark, rows):
    pages = spark.createDataFrame([(i, u, *"abcdefg", 1, 2) for i, u in rows], SCHEMA)
    traps = uf.traps(pages)
    under = {}
    for u in {u for _, u in rows if u is not None}:
        under.setdefault("".join(plain(u)), set()).add(u)
    trapped = {k for k, us in under.items() if len(us) > 1}
    assert {r["key"] for r in traps.collect()} == trapped
    want = []
    for i, u in rows:
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        listed = plain_listed(host, path, set(uf.LISTED), trapped)
        want.append((i, host, path, rule, verdict or ("block" if listed else "allow"), listed))
    got = uf.judged(pages, uf.LISTED, traps, shard_keys=7, group_bytes=8)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("n_listed,n_other", [(0, 100), (1, 5000), (300, 5000), (3000, 10), (500, 0), (2000, 2000)])
def test_cascade_is_exact(n_listed, n_other):
    rng = np.random.default_rng(n_listed)
    h1, h2 = rng.integers(0, 2**63, (2, n_listed + n_other), dtype=np.uint64)
    h1[: min(50, len(h1))] = h1[0]  # keys that share one of their hashes
    listed = np.arange(len(h1)) < n_listed
    levels = uf.cascade(h1, h2, listed)
    rows = [{"shard": 4, "level": i, "bits": b, "turns": t, "filter": f} for i, (b, t, f) in enumerate(levels)]
    own = uf.Cascades(rows, 3, 4)
    assert (own.listed(np.full(len(h1), 4), h1, h2) == listed).all() and not own.listed(np.full(len(h1), 5), h1, h2).any()
    assert not own.listed(np.full(len(h1), 2), h1, h2).any() and not own.listed(np.full(len(h1), 9), h1, h2).any()
    if n_listed == 300:
        assert sum(len(f) for _, _, f in levels) < 2 * 300 * (np.log2(5000 / 300) + 3) / 8


@pytest.mark.parametrize("shard_keys,group_bytes", [(10**6, 10**6), (50, 10**6), (50, 40)])
def test_shards_and_groups_make_no_difference(spark, shard_keys, group_bytes):
    """One host has a third of all rows; a block list of a fifth of the addresses, and domains of one to four labels."""
    urls = [f"http://{'hot' if i % 3 == 0 else f'h{i % 90}'}.d{i % 4}.net/{i // 2}?q={i % 5}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(6)
    addresses = {"".join(plain(u)) for u in urls[::10]} | {"not.in.the.corpus/"}
    domains = {"h7.d3.net", "h13.d1.net", "a.hot.d1.net", "elsewhere"}
    got = uf.judged(pages, domains, spark.createDataFrame([(a,) for a in addresses], "key string"), (), shard_keys=shard_keys, group_bytes=group_bytes)
    want = {i: plain_listed(*plain(u), domains, addresses) for i, u in enumerate(urls)}
    assert {r["page_id"]: r["listed"] for r in got.collect()} == want and 300 < sum(want.values()) < 2500
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Cartesian"))


def test_keys_that_share_hashes_get_others(spark, monkeypatch):
    real = uf._hashes
    monkeypatch.setattr(uf, "_hashes", lambda key, seed: real(F.length(key).cast("string") if seed == 0 else key, seed))
    keys = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    cascades, shards, seed = uf.built(keys, keys.where("key like '%7%'"))
    assert (shards, seed) == (1, 1) and cascades.count() > 0
    assert reduce(max, (r["level"] for r in cascades.collect())) >= 0
