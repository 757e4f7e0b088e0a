"""Centroid clustering by bit planes and popcounts.

A vector of 64 integers is kept as its bit planes: plane b packs bit b of all components into one unsigned 64-bit word, and
the last plane holds the signs (two's complement). The dot product of two vectors is then the sum of
``weight_i * weight_j * popcount(plane_i AND plane_j)``, exactly, and so is a squared distance; no component is unpacked to
find the nearest centroid. The planes are written once; every round is one pass over them in which each task sums its
vectors' components by cluster (again by plane: how often bit b is set in component d), Spark adds these sums, and the
driver gets one row a cluster and component, however many vectors there are.

Defined cases: vectors of another size, null, or with a null or non-finite component are left out; null and repeated ids and
repeated vectors count each; a null id, which has no decimal form, comes last among the starting candidates, and equal ids
are ordered by their components; with fewer vectors than ``k`` there are as many centroids as vectors; ties go to the smaller
number; an empty cluster keeps its centroid; other columns of any name are ignored; an empty table gives an empty result.
Components whose integers reach 2^27 are an error, as squared distances would leave the range of a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import read, stored

DIMS, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
MOST = 1 << 27
#: Vectors whose pairs of planes are held at once.
BLOCK = 4096


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(vec_id, v: array of 64 longs) of the rows whose vector is whole and finite."""
    value = F.col("raw").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = df.select(df[f"`{vec_id}`"].alias("vec_id"), df[f"`{embedding}`"].alias("raw")).where((F.size("raw") == DIMS) & F.coalesce(finite, F.lit(False)))
    return found.select("vec_id", F.transform(value, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def pack(v: np.ndarray, bits: int) -> np.ndarray:
    """Planes [vector, bit] of integers [vector, 64]; component d is bit d of a word."""
    set_ = (v[:, None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(set_.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(bits: int) -> np.ndarray:
    """What a set bit of each plane adds to its component."""
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products [vector of a, vector of b] of planes."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(b.shape[1]):
        for i in range(a.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64) * (wa[i] * wb[j])
    return out


def norms(a: np.ndarray) -> np.ndarray:
    w = weights(a.shape[1])
    return sum((np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64) * (w[i] * w[j]) for i in range(a.shape[1]) for j in range(a.shape[1])), np.zeros(len(a), np.int64))


def nearest(planes: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and the squared distance to it."""
    d = norm[:, None] - 2 * dots(planes, centroids) + norms(centroids)
    return d.argmin(axis=1), d.min(axis=1)


def sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Exact sums of the components [cluster, 64], by how often each bit is set."""
    n, bits = planes.shape
    out = np.zeros((k, DIMS), np.int64)
    for c in np.unique(cluster):
        own = np.ascontiguousarray(planes[cluster == c]).view(np.uint8).reshape(-1, bits, 8)
        out[c] = weights(bits) @ np.unpackbits(own, axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _blocks(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    planes = batch.column("planes").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, bits)
    norm = batch.column("norm").to_numpy(zero_copy_only=False)
    for at in range(0, len(planes), BLOCK):
        yield (part := slice(at, at + BLOCK)), planes[part], norm[part]


def packed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, planes, norm) written to the shared folder, and the number of planes, which the largest integer needs."""
    bounds = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, high = (x or 0 for x in bounds)
    if low < -MOST or high >= MOST:
        raise ValueError(f"components from {low} to {high}: squared distances would not fit into a long")
    bits = max(int(-low - 1).bit_length() if low < 0 else 0, int(high).bit_length()) + 1

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            planes = [pack(v[at : at + BLOCK], bits) for at in range(0, len(v), BLOCK)]
            planes = np.concatenate([*planes, np.zeros((0, bits), np.uint64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, planes.size + 1, bits, dtype=np.int32)), pa.array(planes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists, pa.array(norms(planes))], ["vec_id", "planes", "norm"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return stored(vectors.mapInArrow(pack_all, f"vec_id {kind}, planes array<long>, norm long"), "planes"), bits


def starts(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in ascending order of it."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("hash"), "v").orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMS)


def moved(planes: DataFrame, bits: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of sum / count of their vectors, exactly."""
    given = pack(centroids, bits)

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((len(given), DIMS), np.int64), np.zeros(len(given), np.int64)
        for batch in batches:
            for _, own, norm in _blocks(batch, bits):
                cluster, _ = nearest(own, norm, given)
                total += sums(own, cluster, len(given))
                counts += np.bincount(cluster, minlength=len(given))
        c, d = np.divmod(np.arange(total.size), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(d), pa.array(total.ravel()), pa.array(np.repeat(counts, DIMS))], ["cluster", "d", "total", "n"])

    found = planes.select("planes", "norm").mapInArrow(part_sums, "cluster long, d long, total long, n long")
    out = centroids.copy()
    for r in found.groupBy("cluster", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        out[r["cluster"], r["d"]] = r["total"] // r["n"]
    return out


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: float = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids [cluster, 64]."""
    vectors = integer_vectors(df, vec_id, embedding, scale)
    centroids = starts(vectors, k, seed)
    planes, bits = packed(vectors)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(planes, bits, centroids)
    given = pack(centroids, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, norm in _blocks(batch, bits):
                cluster, distance = nearest(own, norm, given)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[part], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = planes.schema["vec_id"].dataType.simpleString()
    return stored(planes.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def op11_bit_clusters(spark, sf_dir):
    found, centroids = clusters(read(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = [F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>") for values, kind in (([inertia.get(c, 0) for c in range(len(digest))], "long"), (digest, "string"))]
    return found.select(
        "vec_id", "cluster", "distance", F.get(by_cluster[0], F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(by_cluster[1], F.col("cluster")).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """Each round as two tables: the nearest centroid of every vector, and the floors of the means."""
    nearest_to = (
        "select r, vec_id, v, arg_min(c.n, (d, c.n)) as cluster, min(d) as distance from (select x.*, c.n, "
        "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from x, {c} c) c group by r, vec_id, v"
    )
    parts = [
        """with x as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as v from embeddings
  where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda e: e is not null and coalesce(isfinite(e::double), false)))),
c0 as materialized (select row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, v) - 1 as n, v from x order by n limit 8)"""
    ]
    for i in range(ROUNDS):
        parts.append(f"a{i} as materialized ({nearest_to.format(c=f'c{i}')})")
        parts.append(
            f"m{i} as materialized (select cluster, list(m order by d) as v from (select cluster, d, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m "
            f"from (select cluster, unnest(v) as e, unnest(range(64)) as d from a{i}) group by cluster, d) group by cluster)"
        )
        parts.append(f"c{i + 1} as materialized (select n, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on m.cluster = c.n)")
    parts.append(f"a as materialized ({nearest_to.format(c=f'c{ROUNDS}')})")
    return (
        ",\n".join(parts)
        + f"""
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from a join c{ROUNDS} c on c.n = a.cluster"""
    )


ORACLE = _oracle()
