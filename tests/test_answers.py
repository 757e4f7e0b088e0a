"""Nested results, finer segments, extracted answers, the hashed encoder and seeded samples."""

import json
import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from segmentry.operators import answers, encoding, split


def test_envelopes(spark, tmp_path):
    hits = spark.createDataFrame([(1, 2, 7, 0.5), (1, 1, 9, None), (1, 3, 8, 0.1), (None, 1, 9, 0.2)], "query_id long, rank int, id long, score double")
    totals = spark.createDataFrame([(1, 3), (None, 1), (2, 0)], "query_id long, total long")
    asked = spark.createDataFrame([(1,), (None,), (2,), (3,), (3,)], "query_id long")
    found = answers.envelopes(hits, totals, 2, asked)
    answers.write_envelopes(found.coalesce(1), str(tmp_path / "r"))
    lines = {r["query_id"]: r for f in (tmp_path / "r").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert lines[1] == {"query_id": 1, "results": [{"id": 9, "score": None}, {"id": 7, "score": 0.5}], "total_results": 3, "has_next": True}
    assert lines[None] == {"query_id": None, "results": [{"id": 9, "score": 0.2}], "total_results": 1, "has_next": False}
    assert lines[2] == {"query_id": 2, "results": [], "total_results": 0, "has_next": False} and lines[3]["results"] == [] and len(lines) == 4
    read = answers.read_envelopes(spark, str(tmp_path / "r"), found.schema)
    assert sorted(map(repr, read.collect())) == sorted(map(repr, found.collect()))
    assert answers.envelopes(hits, totals, 2).count() == 3


def test_refined(spark):
    hits = spark.createDataFrame([(1, 5, "a", 0, 1000), (1, 6, "a", 1000, 1010), (2, 5, "a", 0, 1000), (2, 7, "c", 0, 9)], "query_id long, id long, video_id string, start_frame int, end_frame int")
    fine = spark.createDataFrame([(1, "a", 0, 300, [1.0, 0.0]), (2, "a", 300, 1001, [0.0, 1.0]), (3, "b", 0, 9, [9.0, 9.0]), (4, "a", 999, 1000, [1.0, 0.0])], "fine_id long, video_id string, start_frame int, end_frame int, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 1.0]), (2, [0.0, 3.0])], "query_id long, vec array<double>")
    got = {(r["query_id"], r["id"]): (r["fine_id"], r["fine_score"], r["n_fine"]) for r in answers.refined(hits, fine, queries).collect()}
    assert got == {(1, 5): (1, 2.0, 3), (1, 6): (2, 1.0, 1), (2, 5): (2, 3.0, 3)}


def test_extracted(spark):
    texts = spark.createDataFrame([(1, "A red car. The red Car stops. red car stops"), (2, None), (3, "")], "id long, text string")
    questions = spark.createDataFrame([(1, "where does the CAR stop, car stops"), (2, None)], "query_id long, text string")
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "query_id long, id long")
    got = {(r["query_id"], r["id"]): (r["pos"], r["score"], r["answer"]) for r in answers.extracted(hits, texts, questions).collect()}
    assert got == {(1, 1): (1, 3, "The red Car stops"), (1, 3): (0, 0, ""), (2, 1): (0, 0, "A red car")}


@pytest.mark.parametrize("places", [64, 5])
def test_hashed_encoder(spark, places):
    texts = {1: "Một con mèo, một", 2: "a a a", 3: " ", 4: None}
    want = {}
    for i, text in texts.items():
        words = (text or "").lower().replace(",", " ").split()
        counts = Counter((xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (xxhash.xxh64_intdigest(w, 42) >> 63)) % places for w in words)
        want |= {(i, p): round(n / math.sqrt(sum(c * c for c in counts.values())), 6) for p, n in counts.items()}
    found = encoding.hashed(spark.createDataFrame(list(texts.items()), "id long, text string"), places)
    assert {(r["id"], r["pos"]): r["v"] for r in found.collect()} == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 1, 37, 200, 500])
def test_seeded_sample(spark, n):
    rows = spark.range(200).select(F.col("id"), F.when(F.col("id") < 199, F.col("id")).alias("key"))
    take = lambda df, seed=1: sorted(r["id"] for r in split.sampled(df, F.col("key"), n, seed, digits=1, few=5).collect())
    got = take(rows)
    assert len(got) == min(n, 200) == len(set(got)) and take(rows.repartition(7)) == got
    assert take(rows.union(rows)) == sorted(got * 2)
    assert not 0 < n < 200 or take(rows, 2) != got
