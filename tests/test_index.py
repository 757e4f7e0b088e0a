import pytest

from segmentry.operators import index, search


def test_index_adds_and_reloads(spark, tmp_path):
    near = [(i, [1.0, i / 100]) for i in range(20)] + [(100 + i, [-1.0, i / 100]) for i in range(20)]
    rows = spark.createDataFrame(near, "id long, vec array<double>")
    built = index.build(rows, str(tmp_path / "index"), cells=2)
    again = index.load(spark, built.path)
    assert (again.dim, again.nprobe, again.centroids) == (built.dim, built.nprobe, built.centroids)
    later = spark.createDataFrame([(500, [-1.0, 0.055])], "id long, vec array<double>")
    for _ in range(2):  # the second run replaces the first
        index.add(again, later, 1)
    assert again.rows(spark).count() == 41
    asked = spark.createDataFrame([(1, [2.0, 0.1]), (2, [-3.0, 0.165])], "query_id long, vec array<double>")
    everything = rows.unionByName(later)
    want = search.knn_exact(everything, asked, 3).collect()
    for block in (1, 7, 4096):
        found = search.knn_ivf(again.rows(spark), asked, again.centroids, 3, 1, block)
        assert sorted(found.collect()) == sorted(want)
    with pytest.raises(Exception, match="size of a vector: 1"):
        index.add(again, spark.createDataFrame([(9, [1.0])], "id long, vec array<double>"), 2)
    with pytest.raises(ValueError):
        index.build(rows.where("false"), str(tmp_path / "none"))
