"""Faults that only larger tables showed, made small."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmentry.functions.vectors import rounded
from segmentry.operators import index, scoring, search, tiles
from segmentry.plans import registry
from tests.test_queries import plain
from tests.test_search_tiles import vectors


def same_as_sql(spark, folder, name, **tables):
    """The registered query and its SQL, on ``tables`` written under ``folder``."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)), con.sql(registry.SQL[name])
    names = sorted(got.columns)
    assert plain(got.select(names).collect()) == plain(want.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall())


def test_events_of_videos_that_share_a_query(spark):
    truth = spark.createDataFrame([(1, v, e, 10 * e, 10 * e + 5) for v in "ab" for e in (1, 2)], "query_id long, video_id string, event_index int, s int, e int")
    said = spark.createDataFrame([(1, "a", 1, 12), (1, "a", 2, 22), (1, "b", 1, 12), (1, "c", 1, None)], "query_id long, video_id string, event_index int, frame int")
    assert {r["video_id"]: r["r_score"] for r in scoring.trake_score(said, truth).collect()} == {"a": 0.5, "b": 0.25, "c": 0.0}


def test_more_segments_than_query_numbers(spark, tmp_path):
    """From 4,000 segments of a label on, numbers of queries are met under two labels."""
    rows = spark.range(8400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    same_as_sql(spark, tmp_path, "rscore_trake", embeddings=rows)


def test_lines_of_a_manifest_lie_by_their_order(spark, tmp_path):
    """Documents that do not lie by doc_id: the first line of a path is that of the smallest."""
    rows = spark.range(600).select(F.col("id").alias("doc_id")).repartitionByRange(6, F.xxhash64("doc_id")).sortWithinPartitions(F.desc("doc_id"))
    same_as_sql(spark, tmp_path, "manifest_job", documents=rows)


def test_queries_of_many_cells_are_shuffled(spark, tmp_path, monkeypatch):
    """By the size of its file, a table of vectors that stand under many cells is small; Spark must not broadcast it."""
    built, asked = index.build(vectors(spark, 300), str(tmp_path / "i"), cells=6), vectors(spark, 40, "query_id", 2)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    plan = index.search(built, asked, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_task_holds_few_scores_at_once(spark):
    rows, asked = vectors(spark, 1200).coalesce(1), vectors(spark, 1200, "query_id", 2)
    each = lambda names, ids, score: pd.DataFrame({"query_id": names, "n": score.size})
    got = search._by_blocks(rows, asked, "ip", True, search.BLOCK, each, "query_id, n long").agg(F.max("n"), F.countDistinct("query_id")).first()
    assert tuple(got) == (tiles.AT_ONCE // 1200 * 1200, 1200)


def test_a_probed_query_stands_once(spark):
    asked = vectors(spark, 50, "query_id", 2)
    near = search.with_cells(asked, [r["vec"] for r in asked.limit(20).collect()], 20)
    assert near.count() == 50 and {tuple(sorted(r["cells"])) for r in near.collect()} == {tuple(range(20))}


def of_any_length(spark):
    """Vectors of lengths 0.5 to 3, some twice, and products of which many are halves of the fourth digit."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 3)) * rng.uniform(0.5, 3, size=(150, 1))
    x[140:] = x[:10]
    x[::20] = [1, 0, 0]
    x[:, 0] = np.floor(x[:, 0] * 1e4) / 1e4 + 0.00005
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("name", ["index_incremental", "index_roundtrip", "stream_ingest"])
def test_index_answers_by_vectors_as_given(spark, tmp_path, name):
    """Unit vectors of floats are not quite of unit length; the stored ones were, so scores differed from SQL in the last digit."""
    same_as_sql(spark, tmp_path, name, embeddings=of_any_length(spark))


def test_rounded_like_duckdb(spark):
    """Of the halves of the fourth digit, Spark's own round gives the other neighbour for 573."""
    at = spark.range(-1000000, 1000000).where("id % 100 = 50").select((F.col("id") / 1e6).alias("x"))
    got = {r["x"]: r["y"] for r in at.select("x", rounded("x", 4).alias("y")).collect()}
    halves = duckdb.connect().sql("select x, round(x, 4) from (select i / 1e6::double as x from range(-1000000, 1000000) t(i) where i % 100 in (50, -50)) t").fetchall()
    assert all(got[x] == y for x, y in halves if x in got) and len(got) == 10000


@pytest.mark.parametrize("most", [tiles.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("name, rows", [("paired_recall", 149), ("pairwise_similarity", 150 * 150)])
def test_every_row_asks(spark, tmp_path, monkeypatch, name, rows, most):
    """Not only every twentieth."""
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", most)
    same_as_sql(spark, tmp_path, name, embeddings=of_any_length(spark))
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert (got.first()["n"] if "n" in got.columns else got.count()) == rows


def test_places_of_repeated_and_null_pairs(spark):
    rows = [(1, [1.0], [2.0]), (1, [3.0], [1.0]), (2, [1.0], [2.0]), (3, [1.0], [2.0]), (4, None, [9.0]), (5, [1.0], None)]
    got = search.own_places(spark.createDataFrame(rows, "id long, x array<double>, y array<double>"))
    # 1: its best product is 6; of those with 1.0 nothing, of those with 3.0 one (27) is greater. 2, 3: after 9, and after equal ones
    assert {r["id"]: r["place"] for r in got.collect()} == {1: 1 + 1 + 1, 2: 1 + 1 + 1, 3: 1 + 1 + 2, 4: 1, 5: 1}
