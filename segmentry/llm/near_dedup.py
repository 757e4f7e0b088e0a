"""SimHash near duplicates, paired by a vantage-point tree over Hamming distance.

Fingerprint: the bit majority of XXH64 (seed 42) over a text's shingles of three words. Rows of one fingerprint are one
class, so copies never meet each other. Classes go into a tree: every node of more than a shard's classes has a vantage
point of its own, one of its classes, and deals the others to children by their Hamming distance to it within the level's
eight bits. A shard that is still too large is split again by the next level, so dense regions get deeper branches.

By the triangle inequality the distances of two classes to a vantage point differ by no more than their own distance
within the level's bits. As the levels' bits are disjoint, these differences along a path are together at most the
radius: a class goes down into every child whose distance still fits into what is left of the radius, and all other
branches are pruned. (With whole distances each level would only be bounded by the radius itself, and far more branches
would be left.) Each meeting in a shard is verified on all 64 bits, so no pair is lost and none is wrong.

Linked classes become components by minimum labels that are passed over links to both ends and to their labels, then
shortened (labels of labels), until no link joins two labels.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer than three words are one
shingle; null doc_ids do not become a component's id unless it has no other; repeated rows share their class; an empty
table gives an empty result. Long texts are hashed in pieces, all of their shingles counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from segmentry.llm.common import in_small_batches, read, stored, with_row_key

SHINGLE, RADIUS, BITS = 3, 2, 64
#: A node of more classes is split, while bits are left (eight levels of eight bits).
SHARD_CLASSES, WIDTH = 128, 8
#: A level's vantage points (16 bytes each) are broadcast up to so many; more are joined by shuffle.
BROADCAST_NODES = 200_000
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, piece by piece; fewer words than a shingle has are one."""
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    n, carry = 0, []
    for piece in _pieces(text):
        tokens = carry + piece
        shingles = [b" ".join(x) for x in zip(*(tokens[i:] for i in range(shingle)))]
        if shingles:
            yield np.fromiter(map(hashed, shingles), np.uint64, len(shingles))
            n += len(shingles)
        carry = tokens[len(tokens) - min(len(tokens), shingle - 1) :]
    if not n and carry:
        yield np.array([hashed(b" ".join(carry))], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts: a bit is 1 if set in over half of them."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


@F.arrow_udf(LongType())
def _simhash(texts: pa.Array) -> pa.Array:
    prints = [simhash(t.as_buffer().to_pybytes()) if t.is_valid and t.as_py() else 0 for t in texts.cast(pa.binary())]
    return pa.array(np.array(prints, np.uint64).view(np.int64))


def fingerprints(keyed: DataFrame) -> DataFrame:
    """(doc_id, key_file, key_row, print: the 64 bits as a signed long) for rows of ``with_row_key``."""
    keyed = in_small_batches(keyed).select("key_file", "key_row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    return keyed.select("doc_id", "key_file", "key_row", _simhash("text").alias("print"))


def _small(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def _ring(point: Column, level: int) -> Column:
    """Hamming distance to the vantage point within the level's bits."""
    mask = ((1 << WIDTH) - 1) << WIDTH * level
    mask -= (mask >> 63) << 64
    return F.bit_count(point.bitwiseXOR(F.col("vantage")).bitwiseAND(F.lit(mask)))


def _child(ring: Column) -> Column:
    """A node's name is its path: a digit of four bits (1 + ring) for each level."""
    return F.shiftleft("node", 4).bitwiseOR((ring + 1).cast("long"))


def tree(classes: DataFrame, aim: int = SHARD_CLASSES) -> tuple[DataFrame, list[DataFrame]]:
    """(print, node: its shard) of all ``classes`` (print, distinct), and (node, vantage) of the nodes split at each level."""
    placed, splits = classes.select("print", F.lit(0).cast("long").alias("node")), []
    point = F.min(F.struct(F.xxhash64("print"), "print"))["print"]
    for level in range(BITS // WIDTH):
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), point.alias("vantage"))
        found = stored(sizes.where(F.col("n") > aim).select("node", "vantage"), "vantage-points")
        if found.isEmpty():
            break
        splits.append(found)
        ring = _ring(F.col("print"), level)
        placed = placed.join(_small(found), "node", "left").select("print", F.when(F.col("vantage").isNull(), F.col("node")).otherwise(_child(ring)).alias("node"))
        placed = stored(placed, "shards")
    return placed, splits


def _asks(classes: DataFrame, splits: list[DataFrame], radius: int) -> DataFrame:
    """(a, node, apart): the shards that a class has to look into, its own one with apart false.

    ``left`` is what remains of the radius. Until a path leaves the class's own one, it may only leave it outwards, so of
    two classes one looks for the other."""
    asks = classes.select(F.col("print").alias("a"), F.lit(0).cast("long").alias("node"), F.lit(radius).alias("left"), F.lit(False).alias("apart"))
    for level, split in enumerate(splits):
        at = asks.join(_small(split), "node", "left").withColumn("ring", _ring(F.col("a"), level))
        first = F.when(F.col("apart"), F.greatest(-F.col("left"), -F.col("ring"))).otherwise(0)
        steps = F.when(F.col("vantage").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, F.greatest(first, F.least(F.col("left"), WIDTH - F.col("ring")))))
        at = at.withColumn("step", F.explode(steps))
        asks = at.select(
            "a",
            F.when(F.col("vantage").isNull(), F.col("node")).otherwise(_child(F.col("ring") + F.col("step"))).alias("node"),
            (F.col("left") - F.abs("step")).alias("left"),
            (F.col("apart") | (F.col("step") != 0)).alias("apart"),
        )
    return asks.select("a", "node", "apart")


def links(classes: DataFrame, radius: int = RADIUS, aim: int = SHARD_CLASSES) -> DataFrame:
    """(a, b) for every two prints of ``classes`` (print, distinct) that differ in 1 to ``radius`` bits."""
    placed, splits = tree(classes, aim)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    met = _asks(classes, splits, radius).join(placed.withColumnRenamed("print", "b"), "node")
    return met.where(near & (F.col("apart") | (F.col("a") < F.col("b")))).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label: the smallest node that can be reached) for the nodes of ``pairs`` (a, b)."""
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    of = lambda name, node: labels.select(F.col("node").alias(node), F.col("label").alias(name))
    while True:
        across = stored(both.join(of("la", "a"), "a").join(of("lb", "b"), "b").where("lb < la").select("a", "la", "lb").distinct(), "across")
        told = across.select(F.explode(F.array("a", "la")).alias("node"), "lb").groupBy("node").agg(F.min("lb").alias("lb"))
        lower = stored(labels.join(told, "node", "left").select("node", F.least("label", "lb").alias("label")), "lower")
        labels = stored(
            lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
            .select("node", F.least("label", "next").alias("label")),
            "labels",
        )
        if across.isEmpty() and labels.join(of("l2", "label"), "label").where("l2 < label").isEmpty():
            return labels


def near_groups(docs: DataFrame, radius: int = RADIUS, scan_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, print, component_id, label (the component's smallest print)."""
    return _groups(with_row_key(docs, scan_only), radius)


def _groups(keyed: DataFrame, radius: int) -> DataFrame:
    known = stored(fingerprints(keyed), "prints")
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = stored(links(classes.select("print"), radius), "near-links")
    return placed_rows(known, classes, components(linked))


def placed_rows(known: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``known`` (doc_id, key, print) with component_id and label, from ``classes`` (print, first_id) and ``components``."""
    reached = labels.withColumnRenamed("node", "print")
    labelled = classes.join(reached, "print", "left").select("print", "first_id", F.coalesce("label", "print").alias("label"))
    first = stored(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "components")
    places = stored(labelled.select("print", "label").join(first, "label"), "places")
    return known.join(places, "print").select("doc_id", "key_file", "key_row", "print", "component_id", "label")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, scan_only: bool = False) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id, then the smallest row key."""
    keyed = with_row_key(docs, scan_only)
    return keep_first(keyed, stored(_groups(keyed, radius), "near-groups"))


def keep_first(keyed: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``keyed`` without those of ``grouped`` (stored) that are not the first of their label."""
    me = F.struct(F.col("doc_id").isNull(), "doc_id", "key_file", "key_row")
    best = stored(grouped.groupBy("label").agg(F.min(me).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), "best")
    dropped = grouped.join(best, "label").where((F.col("key_file") != F.col("best.key_file")) | (F.col("key_row") != F.col("best.key_row")))
    return keyed.join(dropped.select("key_file", "key_row"), ["key_file", "key_row"], "left_anti").select("row.*")


def op7_near_dedup(spark, sf_dir):
    grouped = near_groups(read(spark, sf_dir, "documents"), scan_only=True)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
