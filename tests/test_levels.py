"""Two levels from frames to search, with a poisoned video."""

import numpy as np

from segmentry.operators import levels


def test_two_levels(spark, tmp_path):
    rng = np.random.default_rng(1)
    scene = {"a": [0, 1, 2], "b": [3, 4], "bad": [5], "short": [6]}
    vectors = np.eye(8) * 30
    rows = [(v, i, (vectors[scenes[i // 40]] + 0.01 * rng.normal(size=8)).tolist()) for v, scenes in scene.items() for i in range(3 if v == "short" else 40 * len(scenes))]
    rows = [(v, i, [float("nan")] * 8 if (v, i) == ("bad", 7) else x) for v, i, x in rows]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, vec array<double>")
    built, status = levels.build(frames, str(tmp_path / "built"), {"coarse": (8, 4), "fine": (4, 2)}, 1, 15.0, measure=False)
    assert {r["level"]: (r["ok"], r["skipped"]) for r in levels.summary(status).collect()} == {"coarse": (3, 1), "fine": (3, 1)}
    told = {(r["video_id"], r["level"]): (r["error"], r["segments"]) for r in status.collect()}
    assert told["bad", "fine"] == ("missing or infinite values", 0) and told["short", "coarse"] == (None, 1) and len(told) == 8
    ids = [r["segment_id"] for r in built.segments(spark).collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and sum(n for _, n in told.values()) == len(ids)
    again = levels.Built(built.path, built.levels)
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in (1, 4, 6)], "query_id long, vec array<double>")
    for level in ("coarse", "fine"):
        best = {r["query_id"]: r for r in levels.search(again, asked, level, 1, 99).collect()}
        assert {q: r["video_id"] for q, r in best.items()} == {1: "a", 4: "b", 6: "short"}
        assert 36 <= best[1]["midpoint_frame"] <= 84 and best[4]["midpoint_frame"] >= 36
    assert levels.search(again, asked, "coarse", 1, 99).count() == 3 and levels.search(again, asked, "no such level").count() == 0


def test_nothing_to_cut(spark, tmp_path):
    frames = spark.createDataFrame([("bad", 0, None)], "video_id string, frame_idx int, vec array<double>")
    built, status = levels.build(frames, str(tmp_path / "built"), {"coarse": (8, 4)})
    assert built.levels == {"coarse": False} and [(r["error"] is None, r["segments"]) for r in status.collect()] == [(False, 0)]
    assert levels.search(built, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>"), "coarse").count() == 0
