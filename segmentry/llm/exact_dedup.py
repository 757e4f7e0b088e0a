"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. The distinct blocks are dealt out by hash, sorted, and
numbered: equal blocks get one integer, different blocks get different ones. Adjacent names are then paired, the
distinct pairs sorted and numbered, and so on until each text has one name. With the number of blocks this name is a
collision-free identity: two texts share it only if all their characters are equal.

Whole texts are shuffled once (for the sort of distinct blocks, after map-side removal of copies). The way back from a
block to its name goes by a 128-bit print; the sorted blocks show whether any two share one, and if so all prints are
made anew with another seed, so the print never decides.

Defined cases: null text counts as empty; empty texts are equal to each other; null doc_id is the smallest id; of rows
with the same doc_id and text one stays (the one with the largest row key); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import ascii_lower, read, stored, text_or_empty, with_row_key

BLOCK_CHARS = 4096
KEY = ["key_file", "key_row"]


def _blocks(text: Column, block_chars: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))


def _prints(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(block, F.lit(seed + 1)).alias("h2")]


def _named(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys``, sorted within hash partitions and numbered: partition, then place in it."""
    return parts.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def identities(keyed: DataFrame, text: Column, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key_file, key_row, doc_id, text_sha256, n_blocks, name) for rows of ``with_row_key``."""
    normal = ascii_lower(text_or_empty(text))
    for seed in itertools.count():
        blocks = keyed.select(F.explode(_blocks(normal, block_chars)).alias("block"))
        names = stored(_named(blocks, ["block"]).select(*_prints(F.col("block"), seed), "name"), "block-names")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
    rows = stored(
        keyed.select(*KEY, F.col("row.doc_id").alias("doc_id"), normal.alias("normal")).select(
            *KEY,
            "doc_id",
            F.sha2("normal", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("normal"), block_chars), lambda b: F.struct(*_prints(b, seed))).alias("prints"),
        ),
        "prints",
    )
    n_blocks = F.size("prints")
    most = rows.agg(F.max(n_blocks)).first()[0] or 0
    at = rows.select(*KEY, n_blocks.alias("n"), F.posexplode("prints").alias("at", "p"))
    at = at.select(*KEY, "n", "at", "p.h1", "p.h2").join(names, ["h1", "h2"]).select(*KEY, "n", "at", "name")
    finished = []
    while most > 1:
        at = stored(at, "names")
        finished.append(at.where("n = 1").select(*KEY, "name"))
        pairs = (
            at.where("n > 1")
            .groupBy(*KEY, ((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("at") / 2).cast("int").alias("at"))
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        at = pairs.join(_named(pairs, ["a", "b"]), ["a", "b"]).select(*KEY, "n", "at", "name")
        most = (most + 1) // 2
    finished.append(at.select(*KEY, "name"))
    name = finished[0]
    for part in finished[1:]:
        name = name.unionByName(part)
    return rows.select(*KEY, "doc_id", "text_sha256", n_blocks.alias("n_blocks")).join(name, KEY, "left").fillna({"name": -1})


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS, scan_only: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): key, doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(with_row_key(docs, scan_only), block_chars)


def _groups(keyed: DataFrame, block_chars: int) -> DataFrame:
    known = stored(identities(keyed, F.col("row.text"), block_chars), "identities")
    group = ["n_blocks", "name"]
    best = known.groupBy(*group).agg(
        F.max(F.struct("doc_id", *KEY)).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # stored, so that the join below reads plain shuffles and a large group can be split
    best = stored(best.where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    stays = (F.col("key_file") == F.col("best.key_file")) & (F.col("key_row") == F.col("best.key_row"))
    return known.join(best, group, "left").select(
        *KEY,
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | stays).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS, scan_only: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keyed = with_row_key(docs, scan_only)
    dropped = _groups(keyed, block_chars).where("not kept").select(*KEY)
    return keyed.join(dropped, KEY, "left_anti").select("row.*")


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents"), scan_only=True).drop(*KEY)


ORACLE = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""
