"""Near copies by shingle similarity: SimHash and MinHash candidates, each verified by the exact Jaccard index.

Two texts are near copies if their sets of shingles (five words each, as XXH64 of seed 42) have a Jaccard index of 0.8 or
more. Rows of one set are one class. A class has a SimHash fingerprint of its shingles, and the vantage-point tree of
``near_dedup`` finds all fingerprints within two bits; a fingerprint's bucket holds its classes and those of its links.
At an index of 0.8 texts differ in about 10 bits, where no tree prunes. For pairs beyond the two bits a class has a MinHash
signature too, cut into bands, each of them a bucket. Classes that share a bucket of either kind meet in it. With 24 bands of
5, a pair of index 0.8 shares no band with a probability of 0.00007.

What two sets can share is bounded without looking at them: a shingle that no other candidate has (a lone one) is in no
common part, so with n and m shingles, u and v of them lone, the common part is at most k = min(n - u, m - v) and the index
at most k / (k + u + v). Pairs below that bound do not meet. Copies with edits of their own have many lone shingles, so of
a large group only those meet that can be similar.

Meetings are made twice, so that a large group of copies does not meet in all its pairs. First each member of a bucket
meets its most central one, that with the least share of lone shingles; what is linked becomes components. Then in every
bucket that still holds several components, the members outside its largest component meet those of other components
within the bound, and within the one that follows from how both were found to differ from a central one (counts, and
masks of 256 bits of what each lacks and has beyond it). No pair of a bucket that could join two components is left out.

Defined cases: null and empty texts are one class; fewer than five words are one shingle; repeated rows share their class;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from segmentry.llm.common import in_small_batches, stored, with_row_key
from segmentry.llm.near_dedup import RADIUS, components, keep_first, links, majority, placed_rows, shingle_hashes

SHINGLE, LEAST = 5, 0.8
BANDS, BAND_ROWS = 24, 5
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)
#: Shingles that are hashed at once for all parts of the signature.
CHUNK = 2048
MASK_LONGS = 4


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    found = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> list[int]:
    """A print of the set, its size, its SimHash fingerprint, and a hash of each band; no bands for the empty set."""
    if not len(shingles):
        return [0, 0, 0]
    low = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    chunks = [shingles[at : at + CHUNK] for at in range(0, len(shingles), CHUNK)]
    for chunk in chunks:
        low = np.minimum(low, (chunk[:, None] * _FACTORS + _TERMS).min(axis=0))
    bands = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, BAND_ROWS))]
    signed = np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 42), majority(chunks), *bands], np.uint64).view(np.int64).tolist()
    return [signed[0], len(shingles), *signed[1:]]


def _sets(texts: pa.Array, shingle: int):
    return (shingle_set(t.as_buffer().to_pybytes() if t.is_valid and t.as_py() else b"", shingle) for t in texts.cast(pa.binary()))


def _udfs(shingle: int):
    longs = ArrayType(LongType())
    sign = F.arrow_udf(lambda texts: pa.array([signature(s) for s in _sets(texts, shingle)], pa.list_(pa.int64())), longs)
    given = F.arrow_udf(lambda texts: pa.array([s.view(np.int64) for s in _sets(texts, shingle)], pa.list_(pa.int64())), longs)
    return sign, given


def _mask(shingles) -> Column:
    """Which of 256 buckets hold shingles, as four longs."""
    one = F.lit(1).cast("long")
    bits = lambda k: F.aggregate(F.filter(shingles, lambda x: F.pmod(F.shiftright(x, 6), F.lit(MASK_LONGS)) == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(x, F.lit(64)).cast("int"))))
    return F.array(*[bits(k) for k in range(MASK_LONGS)])


def _common(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with the number of their common shingles, whether they have an index of ``least`` or more, and
    masks of what of b is missing in a, and of what a has beyond b."""
    of = lambda name: sets.select(F.col("print").alias(name), F.col("shingles").alias(f"s{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("both"), _mask(F.array_except("sb", "sa")).alias("lacks"), _mask(F.array_except("sa", "sb")).alias("extra"))
    return counted.select("a", "b", "common", "lacks", "extra", (F.col("common") >= least * (F.col("both") - F.col("common"))).alias("similar"))


def _fits(n, u, m, v, least: float):
    """Whether sets of ``n`` and ``m`` shingles, ``u`` and ``v`` of them lone, can have an index of ``least``."""
    most = F.least(F.col(n) - F.col(u), F.col(m) - F.col(v))
    return (most >= least * (most + F.col(u) + F.col(v))) & (F.least(n, m) >= least * F.greatest(n, m))


def _bits(of) -> Column:
    return sum((F.bit_count(of(k)) for k in range(MASK_LONGS)), F.lit(0))


def _fits_by(pivot: str, least: float):
    """Whether a member and an outsider (names with ``_``) can be similar, by how both differ from one pivot of ``size``.

    What two sets share is part of the pivot that neither lacks, or is beyond it in both. Different bits of a mask are
    different shingles. ``i`` shingles are common with the pivot, ``e`` are beyond it, ``o`` of them not lone. True if a
    number is not known."""
    x, y = (lambda c: F.col(f"{pivot}.{c}")), (lambda c: F.col(f"_{pivot}.{c}"))
    lacking = _bits(lambda k: F.get(x("lacks"), k).bitwiseOR(F.get(y("lacks"), k)))
    own = lambda p, q: p("e") - _bits(lambda k: F.get(p("extra"), k).bitwiseAND(F.bitwise_not(F.get(q("extra"), k))))
    most = F.least(x("i"), y("i"), x("size") - lacking) + F.least(x("o"), y("o"), own(x, y), own(y, x))
    return F.coalesce((x("q") != y("q")) | (most >= least * (F.col("n") + F.col("_n") - most)), F.lit(True))


def _sorted(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of (p, q)."""
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _lone(sets: DataFrame) -> DataFrame:
    """(p, u): the number of shingles of each print that no other print of ``sets`` has, where there are any."""
    seen = sets.select("print", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("p"))
    return seen.where("n = 1").groupBy("p").agg(F.count(F.lit(1)).alias("u"))


def _near_prints(one: DataFrame, radius: int) -> DataFrame:
    """(p, n, bucket) of the classes ``one`` (print, n, fingerprint): a fingerprint's bucket holds its own classes and those of
    the fingerprints within ``radius`` bits that ``links`` gives it; every two that are linked share one."""
    one = stored(one.where("n > 0").select("print", "n", "fingerprint"), "fingerprints")
    found = links(stored(one.select(F.col("fingerprint").alias("print")).distinct(), "distinct-fingerprints"), radius)
    near = stored(found.select(F.col("a").alias("bucket"), F.col("b").alias("fingerprint")), "print-links")
    own = one.select(F.col("print").alias("p"), "n", F.col("fingerprint").alias("bucket"))
    return own.unionByName(one.join(near, "fingerprint").select(F.col("print").alias("p"), "n", "bucket"))


def similar_groups(keyed: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, print, component_id, label for each row of ``with_row_key``."""
    sign, given = _udfs(shingle)
    rows = in_small_batches(keyed).select("key_file", "key_row", F.col("row.doc_id").alias("doc_id"), sign(F.col("row.text")).alias("s"))
    rows = stored(rows.select("*", F.col("s")[0].alias("print"), F.col("s")[1].alias("n"), F.col("s")[2].alias("fingerprint"), F.slice("s", 4, BANDS).alias("bands")).drop("s"), "signatures")
    known = rows.select("doc_id", "key_file", "key_row", "print")
    key = F.struct("key_file", "key_row")
    classes = stored(known.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.min(key).alias("key")), "classes")
    one = rows.join(classes.select("key.*"), ["key_file", "key_row"], "left_semi")
    banded = one.select(F.col("print").alias("p"), "n", F.explode("bands").alias("bucket"))
    placed = stored(_near_prints(one, radius).unionByName(banded), "buckets")

    met = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"), "met")
    placed = stored(placed.join(met, "bucket"), "shared")
    texts = keyed.join(classes.join(placed.select(F.col("p").alias("print")).distinct(), "print", "left_semi").select("print", "key.*"), ["key_file", "key_row"])
    sets = stored(texts.select("print", given(F.col("row.text")).alias("shingles")), "shingles")
    # a print without a partner that it could be similar to is left out from here on
    shared = placed.join(stored(_lone(sets), "lone"), "p", "left").withColumn("u", F.coalesce("u", F.lit(0).cast("long")))
    shared = stored(shared.where(F.col("n") - F.col("u") >= least * F.col("n")), "bounded")

    central = F.min(F.struct(F.col("u") / F.col("n"), F.xxhash64("bucket", "p"), F.col("p").alias("q"), F.col("n").alias("m"), F.col("u").alias("v")))
    chosen = stored(shared.groupBy("bucket").agg(central.alias("one"), F.min("u").alias("least_u")).select("bucket", "one.q", "one.m", "one.v", "least_u"), "chosen")
    first = shared.join(chosen, "bucket").where((F.col("p") != F.col("q")) & _fits("n", "u", "m", "v", least))
    first = stored(first.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "first-pairs")
    first = stored(_common(first, sets, least), "first-links")
    linked = first.where("similar").select("a", "b")

    labels = components(linked).select(F.col("node").alias("p"), "label")
    members = shared.join(labels, "p", "left").withColumn("label", F.coalesce("label", "p")).join(chosen, "bucket")
    met = first.select(F.col("a").alias("p"), F.col("b").alias("q"), "common", "lacks", "extra")
    members = members.join(met, ["p", "q"], "left")
    itself = F.col("p") == F.col("q")
    i = F.when(itself, F.col("n")).otherwise(F.col("common"))
    none = F.array_repeat(F.lit(0).cast("long"), MASK_LONGS)
    own = [F.when(itself, none).otherwise(F.col(c)).alias(c) for c in ("lacks", "extra")]
    beyond = F.when(itself, F.lit(0)).otherwise(F.col("n") - i - F.col("u"))
    near = F.struct("q", i.alias("i"), (F.col("n") - i).alias("e"), beyond.alias("o"), F.col("m").alias("size"), *own)
    members = stored(members.select("p", "n", "u", "bucket", "label", "least_u", (F.col("v") / F.col("m")).alias("share"), near.alias("near")), "members")
    # the most central of all that a print has met, so that a group's members have one pivot in all buckets
    best = members.where("near.i is not null").groupBy("p").agg(F.min(F.struct("share", "near"))["near"].alias("best"))
    # the bucket's central one has met all others
    members = stored(members.where("p != near.q").join(best, "p", "left").drop("share"), "others")
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("parts"))
    most = stored(most.where("parts > 1").select("bucket", "most"), "most")
    outside = members.join(most, "bucket").where((F.col("label") != F.col("most")) & (F.col("n") - F.col("u") >= least * (F.col("n") + F.col("least_u"))))
    outside = stored(outside.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("p", "n", "u", "label", "near", "best")]), "outside")
    fit = (F.col("label") != F.col("_label")) & _fits("n", "u", "_n", "_u", least) & _fits_by("near", least) & _fits_by("best", least)
    rest = _sorted(members.join(outside, "bucket").where(fit).select("p", F.col("_p").alias("q")))
    rest = rest.join(_sorted(met), ["a", "b"], "left_anti")
    more = stored(_common(stored(rest, "other-pairs"), sets, least).where("similar").select("a", "b"), "other-links")
    return placed_rows(known, classes, components(linked.unionByName(more)))


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, radius: int = RADIUS, scan_only: bool = False) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest doc_id, then the smallest row key."""
    keyed = with_row_key(docs, scan_only)
    return keep_first(keyed, stored(similar_groups(keyed, shingle, least, radius), "similar-groups"))
