"""Windows over blocks of a key, against lists; frame samples, audits of tiles, masked means."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.operators import store, streams


def clip(n, vid="a"):
    rnd = random.Random(n)
    return [(vid, i, rnd.random()) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
@pytest.mark.parametrize("kernel", [1, 3, 5])
def test_smoothing_like_slices(spark, block, kernel):
    rows = clip(23) + clip(1, "b")
    df = spark.createDataFrame(rows, "video_id string, window_idx int, value double")
    half, by = kernel // 2, {}
    for v, i, x in rows:
        by.setdefault(v, []).append(x)
    want = {(v, i): float(np.mean(by[v][max(i - half, 0) : i + half + 1])) for v, i, _ in rows}
    got = {(r[0], r[1]): r[2] for r in streams.smooth(df, kernel, block=block).select("video_id", "window_idx", "value").collect()}
    assert got == pytest.approx(want)
    vecs = streams.smooth_vectors(df.select("video_id", "window_idx", F.array("value", -F.col("value")).alias("vec")), kernel, block).collect()
    assert len(vecs) == len(want)
    assert {(r["video_id"], r["window_idx"]): r["vec"][0] for r in vecs} == pytest.approx(want) and all(r["vec"][1] == -r["vec"][0] for r in vecs)


@pytest.mark.parametrize("n, window, stride", [(1, 4, 2), (4, 4, 2), (9, 4, 2), (10, 4, 3), (23, 8, 5)])
def test_pooling_like_slices(spark, n, window, stride):
    rows = clip(n)
    x = [v for _, _, v in rows] + [rows[-1][2]] * max(window - n, 0)
    starts = [0] if n <= window else sorted({*range(0, n - window + 1, stride), n - window})
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, value double")
    want = [(k, s, float(np.mean(x[s : s + window]))) for k, s in enumerate(starts)]
    for got in (streams.pool_windows(df, window, stride), streams.pool_vectors(df.withColumn("vec", F.array("value")), window, stride).withColumn("value", F.col("vec")[0])):
        found = sorted(tuple(r) for r in got.select("window_idx", "window_start", "value").collect())
        assert [f[:2] for f in found] == [w[:2] for w in want] and [f[2] for f in found] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_next_valid_over_blocks(spark, block):
    good = {3, 4, 11}
    df = spark.createDataFrame([("a", i, i in good) for i in range(14)], "video_id string, frame_idx int, ok boolean")
    got = {r["frame_idx"]: r["use_idx"] for r in streams.next_valid(df, F.col("ok"), 5, block=block).collect()}
    assert got == {i: next(((i + s) % 14 for s in range(5) if (i + s) % 14 in good), None) for i in range(14)}


def test_no_valid_sample_is_an_error(spark):
    df = spark.createDataFrame([("a", i, i == 0) for i in range(6)], "video_id string, frame_idx int, ok boolean")
    assert streams.next_valid(df, F.col("ok"), 6, strict=True).count() == 6
    with pytest.raises(Exception, match="no valid sample near a:1"):
        streams.next_valid(df, F.col("ok"), 5, strict=True).collect()


def test_frame_samples(spark):
    videos = spark.createDataFrame([("a", 10), ("b", 3), ("image", 1), ("none", 0)], "video_id string, num_frames int")

    def got(n, how="even"):
        found = {}
        for r in streams.sample_frames(videos, n, how).orderBy("video_id", "k").collect():
            found.setdefault(r["video_id"], []).append(r["frame_idx"])
        return found

    assert got(4) == {"a": [0, 3, 6, 9], "b": [0, 1, 1, 2], "image": [0, 0, 0, 0]}
    assert got(4, "first") == {"a": [0, 1, 2, 3], "b": [0, 1, 2], "image": [0]}
    assert got(1) == {"a": [0], "b": [0], "image": [0]}
    with pytest.raises(ValueError, match="not a sample"):
        streams.sample_frames(videos, 4, "odd")
    at = streams.sample_frames(videos.where("video_id = 'a'"), 4)
    use = lambda bad: [r["use_idx"] for r in streams.readable_before(at, ~F.col("frame_idx").isin(*bad)).orderBy("k").collect()]
    assert use([3, 6]) == [0, 0, 0, 9] and use([0, 9]) == [None, 3, 6, 6]


@pytest.mark.parametrize("parts", [1, 5])
def test_tiling(spark, parts):
    rows = [("good", 0, 5, 9), ("good", 5, 9, 9), ("hole", 0, 4, 9), ("hole", 5, 9, 9), ("over", 0, 6, 9), ("over", 5, 9, 9), ("late", 1, 9, 9), ("short", 0, 8, 9), ("empty", 0, 0, 9), ("empty", 0, 9, 9)]
    told = streams.tiling(spark.createDataFrame(rows, "video_id string, start_frame int, end_frame int, num_frames int"), parts).collect()
    assert {r["video_id"] for r in told if r["tiles"]} == {"good"} and len(told) == 6
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 1)], "video_id string, label int")
    assert [tuple(r) for r in streams.reappearing(runs).collect()] == [("a", 1, 2)]


def test_masked_mean(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 0, [9.0, 9.0]), ("a", None, [9.0, 9.0]), ("a", 1, None), ("b", 0, [5.0, 5.0])]
    found = streams.masked_mean(spark.createDataFrame(rows, "k string, mask int, vec array<double>"), ["k"])
    assert {r["k"]: r["vec"] for r in found.collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


@pytest.mark.parametrize("parts", [1, 4])
def test_last_spoken_over_slices(spark, parts):
    rnd = random.Random(3)
    spoken = [(v, rnd.randrange(40), k, f"t{k}") for k in range(60) for v in ("a", "b")] + [("c", 30, 1, "late")]
    segs = [(i, v, i % 45) for i, v in enumerate(["a", "b", "c"] * 30)]
    want = {i: max(((sf, k, t) for w, sf, k, t in spoken if w == v and sf <= at), default=(None, None, None)) for i, v, at in segs}
    found = store.last_spoken(spark.createDataFrame(segs, "segment_id long, video_id string, midpoint_frame int"), spark.createDataFrame(spoken, "video_id string, sf int, k int, text string"), "k", parts)
    assert {r["segment_id"]: (r["text_start"], r["k"], r["text"]) for r in found.collect()} == want
