"""Vectors in tiles: a row holds up to some thousand of them, so that two tables of vectors meet as blocks, not row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a tile, and the bytes of tiles that are broadcast (the driver holds some copies of them); beyond that both sides
#: are shuffled.
TILE, BROADCAST_BYTES = 4096, 16 << 20
#: Numbers of a matrix that a task holds at once; a pair of tiles is worked on in steps of so many.
AT_ONCE = 1 << 19
#: Tiles of each side in a task of ``crossed``, where there are more of them than tasks at once.
SIDE = 4


def size_of(df: DataFrame, vec: str = "vec") -> tuple[int, int]:
    """How many rows have a vector, and the size of the largest."""
    n, dim = df.agg(F.count(vec), F.max(F.size(vec))).first()
    return n, dim if dim and dim > 0 else 0


def whole(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """``df`` with ``vec`` in double, without rows whose vector is null or has a null in it; another size is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"size of a vector, not {dim}: "), F.size(vec).cast("string"))).cast("array<double>")
    some = F.col(vec).isNotNull() & ~F.coalesce(F.exists(vec, lambda x: x.isNull()), F.lit(False))
    return df.where(some).withColumn(vec, F.when(F.size(vec) == dim, F.col(vec).cast("array<double>")).otherwise(wrong))


def where_they_lie(df: DataFrame, dim: int, by: str | None = None) -> DataFrame:
    """``df`` (id, vec, ``by``) as tiles (``by``, ids, vecs), made of what lies together; nothing is shuffled."""
    names = ["id", "vec", *([by] if by else [])]
    kinds = {n: df.schema[n].dataType.simpleString() for n in names}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if by:
                batch = batch.take(pa.compute.sort_indices(batch.column(by)))
                keys = batch.column(by).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            else:
                edges = np.zeros(min(len(batch), 1), int)
            runs = [(a, z) for s, e in zip(edges, [*edges[1:], len(batch)]) for a in range(s, e, TILE) for z in [min(a + TILE, e)]]
            offsets = np.array([0, *(z for _, z in runs)], np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets), batch.column("id")), pa.ListArray.from_arrays(pa.array(offsets * dim), batch.column("vec").flatten())]
            if by:
                columns.append(batch.column(by).take(pa.array([a for a, _ in runs], pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["ids", "vecs", *names[2:]])

    return df.select(*names).mapInArrow(pack, f"ids array<{kinds['id']}>, vecs array<double>" + (f", {by} {kinds[by]}" if by else ""))


def by_key(df: DataFrame, key: str, tiles: int = 1, *keep: str) -> DataFrame:
    """``df`` (key, id, vec) as tiles (key, tile, ids, vecs): ``tiles`` of each key, by a hash of id; lists of ``keep`` too."""
    tile = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile")
    rows = df.groupBy(key, tile).agg(F.collect_list(F.struct("id", "vec", *keep)).alias("r"))  # a tile's
    return rows.select(key, "tile", F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs"), *[F.col(f"r.{c}").alias(c) for c in keep])


def met(left: DataFrame, right: DataFrame, on: list[str], right_bytes: int) -> DataFrame:
    """Tiles of both sides with equal ``on``: the right side is broadcast if it is small, else both are shuffled. That is said to
    Spark, whose own estimate is that of files: a vector that stands under many keys takes their room there only once."""
    right = F.broadcast(right) if right_bytes <= BROADCAST_BYTES else right.hint("merge")
    return left.join(right, on)


def crossed(left: DataFrame, right: DataFrame, left_rows: int, right_rows: int) -> DataFrame:
    """Every tile of ``left`` with every tile of ``right``, which hold about so many vectors. Each side is dealt out once, and
    a task fetches a part of each, so what is stored grows with the input, not with the pairs."""
    least = int((2 * left.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1
    tasks = [max(1, min(n, max(-(-n // SIDE), least))) for n in (-(-left_rows // TILE), -(-right_rows // TILE))]
    return left.repartition(tasks[0]).crossJoin(right.repartition(tasks[1]).hint("shuffle_replicate_nl"))


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, np.float64).reshape(n, -1)


def steps(rows: int, width: int) -> list[slice]:
    """``rows`` in runs, so that a matrix of a run by ``width`` has ``AT_ONCE`` numbers at most (or one row)."""
    own = max(1, AT_ONCE // max(width, 1))
    return [slice(at, at + own) for at in range(0, rows, own)]


def each_pair(pairs: DataFrame, body: Callable[[pd.Series], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``body(row)`` yields for every row of ``pairs``, one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield from body(row)

    return pairs.mapInPandas(run, schema)
