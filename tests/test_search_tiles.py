"""Search by tiles: shuffled or broadcast, odd vectors, other id types, and an index whose rows have moved."""

import numpy as np
import pytest

from segmentry.operators import index, search, tiles


def vectors(spark, n, name="id", seed=1, shift=0.0, dim=8, start=0, kind="long"):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim)) + shift
    data = [(start + i, (centers[i % 12] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(data, f"{name} long, vec array<double>").withColumn(name, _cast(name, kind)).repartition(4)


def _cast(name, kind):
    from pyspark.sql import functions as F

    return F.col(name).cast(kind)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_shuffled_tiles_give_what_broadcast_ones_do(spark, monkeypatch, metric):
    rows, asked = vectors(spark, 300), vectors(spark, 40, "query_id", 2)
    want = sorted(map(tuple, search.knn_exact(rows, asked, 4, metric).collect()))
    x = {r["id"]: np.array(r["vec"]) for r in rows.collect()}
    unit = lambda v: v / np.linalg.norm(v)
    for r in asked.limit(5).collect():
        q = np.array(r["vec"])
        score = {i: round(float(unit(q) @ unit(v)), 6) if metric == "ip" else round(float(((q - v) ** 2).sum()), 6) for i, v in x.items()}
        best = sorted(score, key=lambda i: (-score[i] if metric == "ip" else score[i], i))[:4]
        assert [w[1] for w in sorted((w for w in want if w[0] == r["query_id"]), key=lambda w: w[3])] == best
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tiles, "TILE", 16)
    for block in (1, 7, 10**6):
        got = search.top_k(search.scores(rows, asked, 4, metric, block=block), 4, ascending=metric != "ip")
        assert sorted(map(tuple, got.collect())) == want


def test_ivf_shuffled(spark, tmp_path, monkeypatch):
    built = index.build(vectors(spark, 300), str(tmp_path / "i"), cells=6)
    asked = vectors(spark, 40, "query_id", 2)
    want = sorted(map(tuple, index.search(built, asked, 4, 2).collect()))
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    for block in (3, 10**6):
        assert sorted(map(tuple, search.knn_ivf(built.rows(spark), asked, built.centroids, 4, 2, block).collect())) == want
    assert index.search(built, asked.where("false"), 4).count() == 0


def test_odd_vectors_and_ids(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", [0.0, 0.0]), (None, [0.9, 0.1]), ("a2", [1.0, 0.0])], "id string, vec array<float>")
    asked = spark.createDataFrame([("q1", [2.0, 0.0]), ("q2", None), ("q3", [0.0, 0.0])], "query_id string, vec array<float>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in search.knn_exact(rows, asked, 2).orderBy("query_id", "rank").collect()]
    assert got[:2] == [("q1", "a", 1), ("q1", "a2", 2)] and {q for q, _, _ in got} == {"q1", "q3"}
    assert {r["n"] for r in search.counts_over(rows, asked, 0.5).where("query_id = 'q1'").collect()} == {3}
    with pytest.raises(ValueError, match="empty"):
        search.knn_exact(rows.where("false"), asked, 2)
    with pytest.raises(Exception, match="size of a vector, not 2: 1"):
        search.knn_exact(rows, asked, 2).unionByName(search.knn_exact(rows.selectExpr("id", "array(1f) as vec"), asked, 2)).collect()


def test_cells_do_not_depend_on_tasks(spark):
    rows = vectors(spark, 600)
    (a, one), (b, two) = (search.train_cells(rows.repartition(n), 12) for n in (1, 9))
    assert np.allclose(a, b) and one == pytest.approx(two)
    x = np.array([r["vec"] for r in rows.collect()])
    near = ((x[:, None] - np.array(a)[None]) ** 2).sum(axis=2)
    assert search.spread(rows, a) == pytest.approx(near.min(axis=1).mean())
    for c in set(near.argmin(axis=1)):  # k-means has settled: a centroid is the mean of its rows
        assert np.allclose(x[near.argmin(axis=1) == c].mean(axis=0), a[c], atol=0.05)


def test_a_shifted_batch_asks_for_new_training(spark, tmp_path):
    old, alike, moved = vectors(spark, 600), vectors(spark, 200, seed=1, start=1000), vectors(spark, 900, seed=8, start=2000)
    built = index.build(old, str(tmp_path / "old"), cells=12)
    index.add(built, alike, 1)
    assert index.drift(built, spark, 1) < 1.5 and index.trained_again(built, spark, str(tmp_path / "same")) is built
    index.add(built, moved, 2)
    assert index.drift(built, spark, 2) > 3 and index.drift(built, spark, 7) is None
    again = index.trained_again(index.load(spark, built.path), spark, str(tmp_path / "new"), cells=40)
    assert again.path != built.path and again.rows(spark).count() == 1700 and again.spread < built.spread * 3
    everything = old.unionByName(alike).unionByName(moved)
    asked = everything.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = search.knn_exact(everything, asked, 5)
    r = search.recall_at_k(index.search(again, asked, 5), exact).selectExpr("sum(hits) / sum(truth) as recall").first()
    assert r["recall"] >= 0.9 and again.nprobe < 40
