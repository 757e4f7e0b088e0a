"""Bit planes against integer arithmetic, and whole runs against plain numpy."""

import hashlib
import math
import random

import numpy as np
import pytest

from segmentry.llm import bit_clusters as bc

SCHEMA = "vec_id long, embedding array<double>, v long, planes long, norm long, cluster long, distance long, hash string, raw string"


def brute(rows, k=8, rounds=10, scale=1024, seed=3):
    """(vec_id, cluster, distance) of the kept rows, and the centroids, by plain integers."""
    kept = [(i, np.array([math.floor(scale * x) for x in v], object)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [v for _, v in order[:k]]

    def assigned():
        for i, v in kept:
            d = [int(((v - c) ** 2).sum()) for c in centroids]
            yield i, d.index(min(d)), min(d), v

    for _ in range(rounds if kept else 0):
        own = list(assigned())
        for c in range(len(centroids)):
            if members := [v for _, n, _, v in own if n == c]:
                centroids[c] = sum(members) // len(members)
    return sorted((str(i), c, d) for i, c, d, _ in assigned()) if kept else [], [list(c) for c in centroids]


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    for bits, low, high in ((28, -bc.MOST, bc.MOST), (11, -1024, 1024), (1, -1, 1), (3, -4, 4)):
        a, b = (rng.integers(low, high, (20, 64)) for _ in range(2))
        a[0], a[1], b[0] = low, high - 1, low
        pa, pb = bc.pack(a, bits), bc.pack(b, bits)
        assert (bc.dots(pa, pb) == a @ b.T).all() and (bc.norms(pa) == (a * a).sum(axis=1)).all()
        cluster, distance = bc.nearest(pa, bc.norms(pa), pb)
        d = ((a[:, None].astype(object) - b[None]) ** 2).sum(axis=2)
        assert distance.tolist() == d.min(axis=1).tolist() and cluster.tolist() == d.argmin(axis=1).tolist()
        assert (bc.sums(pa, cluster, len(b)) == np.stack([a[cluster == c].sum(axis=0) for c in range(len(b))])).all()


def vectors(n, seed=5):
    rng = random.Random(seed)
    return [(i, [rng.choice((-1, 1)) * rng.random() * (1 + i % 3) for _ in range(64)]) for i in range(n)]


ODD = [
    *vectors(40), *vectors(6), (None, [0.5] * 64), (None, None), (50, None), (51, []), (52, [0.1] * 63), (53, [0.1] * 65), (54, [None] + [0.1] * 63),
    (55, [float("nan")] + [0.1] * 63), (56, [float("inf")] + [0.1] * 63), (57, [-float("inf")] * 64), (58, [-0.0] * 64), (59, [1e-300, -1e-300] * 32), (60, [5000.0] * 64), (60, [-5000.0] * 64),
]


@pytest.mark.parametrize("rows", [ODD, vectors(3), vectors(1) * 30, []], ids=["odd", "few", "equal", "empty"])
def test_clusters_like_plain_integers(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "h", "r") for i, v in rows], SCHEMA).repartition(5)
    found, centroids = bc.clusters(df)
    want, want_centroids = brute(rows)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.tolist() == want_centroids


def test_other_parameters_and_types(spark):
    rows = [(str(i), [float(np.float32(x)) for x in v]) for i, v in vectors(30, 9)]
    df = spark.createDataFrame(rows, "name string, e array<float>")
    found, centroids = bc.clusters(df, k=3, rounds=2, seed=7, scale=100, vec_id="name", embedding="e")
    want, want_centroids = brute(rows, 3, 2, 100, 7)
    assert sorted(map(tuple, found.collect())) == want and centroids.tolist() == want_centroids


def test_integers_out_of_range_are_an_error(spark):
    with pytest.raises(ValueError, match="would not fit"):
        bc.clusters(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))
