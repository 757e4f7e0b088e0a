"""The split job: train and validation sets without a leak, each shuffled by a seed and written as ordered files.

Videos are split by group, images by path; of each kind the first floor(units * ratio) units in the order of a keyed hash are
for validation. Where that order ends is found by histograms of the hash's leading digits, refined in the bucket where the
count is reached; the split is then a comparison with that hash, without a sort or a join of rows. The shuffle is a range
partition over another keyed hash, so the files of a set, one after another, are one fixed order of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.text import group_key
from segmentry.operators.dataprep import numbered

RATIO, SEED = 0.05, 42
#: Hex digits of a histogram, and how many hashes are looked at one by one in the end.
DIGITS, FEW = 3, 1000


def _keyed(seed: int, what: str, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), value))


def nth_smallest(hashes: DataFrame, n: int, digits: int = DIGITS, few: int = FEW) -> str | None:
    """The ``n``-th smallest of distinct hex strings ``hashes`` (h), or null if ``n`` is 0."""
    if n <= 0:
        return None
    prefix = ""
    while True:
        inside = hashes.where(F.col("h").startswith(prefix))
        size = len(prefix) + digits
        counts = sorted((r["p"], r["count"]) for r in inside.groupBy(F.left("h", F.lit(size)).alias("p")).count().collect())  # 16 ** digits at most
        for p, count in counts:
            if n <= count:
                prefix = p
                break
            n -= count
        if count <= few or size >= 32:
            return sorted(r["h"] for r in hashes.where(F.col("h").startswith(prefix)).select("h").collect())[n - 1]


def with_split(samples: DataFrame, ratio: float = RATIO, seed: int = SEED, group: Column | None = None, **histogram) -> DataFrame:
    """Adds split to ``samples`` (path, media_type). ``group`` names what must stay together (of videos; by default the path's
    group key); rows of one path do in any case. Rows without a path are a unit of their own kind, in train."""
    image = F.coalesce(F.col("media_type") == "image", F.lit(False))
    unit = F.when(image, F.col("path")).otherwise(group_key(F.col("path")) if group is None else group)
    keyed = samples.withColumn("_image", image).withColumn("_h", _keyed(seed, "unit", unit))
    val = F.lit(False)
    for kind in (False, True):
        hashes = keyed.where((F.col("_image") == kind) & F.col("_h").isNotNull()).select(F.col("_h").alias("h")).distinct()
        last = nth_smallest(hashes, int(hashes.count() * ratio), **histogram)
        if last is not None:
            val = val | ((F.col("_image") == kind) & (F.col("_h") <= last))
    return keyed.withColumn("split", F.when(F.coalesce(val, F.lit(False)), "val").otherwise("train")).drop("_image", "_h")


def shuffled(rows: DataFrame, seed: int = SEED, name: str = "nth") -> DataFrame:
    """Adds each row's place, from 0, in the shuffled order of its split."""
    order = _keyed(seed, "order", F.col("path"))
    placed = numbered(rows.withColumn("_o", order), "split", "_o", "path", name=name)
    before = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = F.when(F.col("split") == "val", before.get("train", 0)).otherwise(0)
    return placed.withColumn(name, F.col(name) - first).drop("_o")


def write_split(rows: DataFrame, path: str, seed: int = SEED) -> dict[str, int]:
    """Writes ``rows`` (path, split, ...) as JSON lines under ``path``/split=train and ``path``/split=val, in shuffled order
    through the sorted files of each; the number of rows of each set."""
    ordered = rows.withColumn("_o", _keyed(seed, "order", F.col("path")))
    ordered = ordered.repartitionByRange("split", "_o", "path").sortWithinPartitions("split", "_o", "path").drop("_o")
    ordered.write.partitionBy("split").json(path)
    return {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}


def read_split(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/split={split}")


def leaks(train: DataFrame, val: DataFrame, unit: Column) -> DataFrame:
    """Units that stand on both sides."""
    return train.select(unit.alias("unit")).intersect(val.select(unit.alias("unit")))


def sampled(rows: DataFrame, key: Column, n: int, seed: int = SEED, **histogram) -> DataFrame:
    """The rows of ``n`` different values of ``key``, or of all if there are no more: those first in the order of a keyed hash, so
    equal on every run and whatever the partitions. Rows of one value are taken together; null is a value."""
    keyed = rows.withColumn("_h", _keyed(seed, "sample", F.coalesce(key.cast("string"), F.lit("\0"))))
    hashes = keyed.select(F.col("_h").alias("h")).distinct()
    if hashes.limit(n + 1).count() > n:
        last = nth_smallest(hashes, n, **histogram)
        keyed = keyed.where(F.lit(False) if last is None else F.col("_h") <= last)
    return keyed.drop("_h")
