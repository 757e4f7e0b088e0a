"""Running values over the rows of a key in an order, with a key of any size in many tasks.

Rows are range-partitioned by key and order and written; a key's rows in one partition are a slice of it. Running values are taken
within slices, and what the earlier slices of a key add up to is carried in: it exists only for keys that cross a partition's edge,
at most one row a partition, so it is small whatever the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.sources.files import stored

_HOW = {"sum": F.sum, "max": F.max}


def sliced(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` in slices (_slice), for ``before``; equal rows of ``order`` stay in one slice."""
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored(ranged.withColumn("_slice", F.spark_partition_id()), "sliced")


def before(slices: DataFrame, keys: list[str], order: list[str], how: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum or the maximum of ``value`` over the earlier rows of the key in ``order``; null where there is none."""
    f = _HOW[how]
    marked = slices.withColumn("_v", value)
    inside = f("_v").over(Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    of_slices = marked.groupBy(*keys, "_slice").agg(f("_v").alias("_t"))
    upto = f("_t").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = of_slices.withColumn("_c", upto).where("_c is not null").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"), "_c")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_slice") == F.col("_s"))
    joined = marked.withColumn("_i", inside).join(F.broadcast(carried), same, "left")  # a row a partition at most
    both = F.greatest("_i", "_c") if how == "max" else F.when(F.col("_i").isNotNull() | F.col("_c").isNotNull(), F.coalesce("_i", F.lit(0)) + F.coalesce("_c", F.lit(0)))
    return joined.withColumn(name, both).drop("_v", "_i", "_c", "_s", *[f"_k{i}" for i in range(len(keys))])


def blocked(df: DataFrame, keys: list[str], place: str, back: int, ahead: int, block: int = 4096) -> tuple[DataFrame, list[str]]:
    """(rows, columns to partition windows by) for windows over at most ``back`` rows before and ``ahead`` after a row, where
    ``place`` counts a key's rows without gaps: a key is cut into blocks of ``block`` places, and a row that rows of another
    block need stands there once more. The window is taken, then ``own`` keeps each row once."""
    at = F.col(place)
    low, high = F.floor((at - ahead) / block), F.floor((at + back) / block)
    spread = df.withColumn("_block", F.explode(F.sequence(low, high))).withColumn("_own", F.col("_block") == F.floor(at / block))
    return spread, [*keys, "_block"]


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_block", "_own")
