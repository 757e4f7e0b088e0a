"""The functions for SQL, used from SQL alone."""

import pytest

from segmentry.functions import sql
from segmentry.operators import streams


def test_window_starts_in_sql(spark):
    assert "window_starts" in sql.register(spark)
    sizes = [(n,) for n in (1, 7, 8, 9, 64, 65, 100)]
    videos = spark.createDataFrame(sizes, "num_frames int")
    for window, stride in ((8, 4), (64, 8), (5, 7)):
        got = spark.sql("select v.num_frames, w.* from {v} v, lateral window_starts(v.num_frames, {w}, {s}) w", v=videos, w=window, s=stride)
        want = streams.window_starts(videos, window, stride).select("num_frames", "window_idx", "window_start")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in spark.sql("select * from window_starts(20, 8, 8)").collect()] == [(0, 0), (1, 8), (2, 12)]


def test_scalars_in_sql(spark):
    sql.register(spark)
    one = lambda e: spark.sql(f"select {e}").first()[0]
    assert one("segment_midpoint(10, 21)") == 15 and one("segment_midpoint(3, 4)") == 3
    assert one("frame_seconds(50, 30D)") == 1.67 and one("frame_of(0.1D, 25D)") == 2 and one("timecode(3661.2509D)") == "01:01:01,250"
    assert one("cosine(array(3D, 4D), array(6D, 8D))") == pytest.approx(1) and one("sq_l2(array(1D, 2D), array(3D, 0D))") == 8 and one("cosine(array(0D), array(1D))") is None
    assert [one(f"split_group_key('{p}')") for p in ("a/abc_12.mp4", "a/abc.mp4", "a/_x.mp4")] == ["abc", "a/abc.mp4", ""]
    pieces = [x for r in spark.sql("select * from interval_pieces(0D, 25D, 10D)").collect() for x in r]
    assert pieces == pytest.approx([0, 0, 25 / 3, 1, 25 / 3, 50 / 3, 2, 50 / 3, 25])
