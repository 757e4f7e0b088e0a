"""Event chains against all chains of small videos."""

from itertools import combinations

import numpy as np
import pytest

from segmentry.operators import chains


def plain(frames, scores):
    """The best chain of scores [event, frame], by trying all."""
    n, best = len(scores), None
    for at in combinations(range(len(frames)), n):
        own = [int(frames[i]) for i in at]
        if all(x < y for x, y in zip(own, own[1:])):
            s = [int(scores[e, i]) for e, i in enumerate(at)]
            rank = (sum(s), tuple(-f for f in reversed(own)))
            if best is None or rank > best[0]:
                best = (rank, own, s)
    return best and best[1:]


def table(spark, sizes, queries, dim=2, seed=1):
    """Few different vectors, so that totals tie; frames that repeat."""
    rng = np.random.default_rng(seed)
    videos = {f"v{i}": (np.sort(rng.integers(0, 3 * n + 1, n)), rng.integers(-1, 3, (n, dim)) / 4) for i, n in enumerate(sizes)}
    asked = {q: rng.integers(-1, 3, (n, dim)) / 4 for q, n in queries.items()}
    segments = spark.createDataFrame([(v, int(f), x.tolist(), 1) for v, (fs, xs) in videos.items() for f, x in zip(fs, xs)], "video_id string, frame int, vec array<double>, n int").repartition(3)
    events = spark.createDataFrame([(q, j + 1, x.tolist()) for q, xs in asked.items() for j, x in enumerate(xs)], "query_id long, event_index int, vec array<double>").repartition(2)
    return videos, asked, segments, events


@pytest.mark.parametrize("span,at_once", [(10**6, 256), (5, 2), (1, 1)])
def test_chains_like_trying_all(spark, span, at_once):
    videos, asked, segments, events = table(spark, [9, 10, 2, 1], {1: 1, 2: 2, 3: 3, 4: 4, 5: 3})
    got = {}
    for r in chains.align(segments, events, None, span=span, queries_at_once=at_once).collect():
        got.setdefault((r["query_id"], r["video_id"]), {})[r["event_index"]] = r
    assert set(got) == {(q, v) for q in asked for v in videos}
    for (q, v), rows in got.items():
        frames, x = videos[v]
        score = np.round(asked[q] @ x.T * 10**6).astype(int)
        assert sorted(rows) == list(range(1, len(asked[q]) + 1)), "a row for each event"
        # frames that repeat hold several segments: the sum of the chain is what counts
        want = plain(frames, score)
        chain = [rows[j]["frame"] for j in sorted(rows)]
        if want is None:
            assert chain == [None] * len(rows) and not any(r["found"] for r in rows.values()) and rows[1]["overall_score"] is None
            continue
        values = [rows[j]["score"] for j in sorted(rows)]
        assert chain == want[0] and sum(values) == pytest.approx(sum(want[1]) / 10**6)
        good = [s for s in values if s >= 0.5]
        assert [r["found"] for _, r in sorted(rows.items())] == [s >= 0.5 for s in values]
        assert rows[1]["overall_score"] == pytest.approx(np.mean(good or values), abs=1e-6)


def test_best_videos_only(spark):
    _, _, segments, events = table(spark, [8, 8, 8, 2], {1: 3, 2: 3})
    every, two = (chains.align(segments, events, k).collect() for k in (None, 2))
    for q in (1, 2):
        order = sorted({(r["overall_score"] is None, -(r["overall_score"] or 0), r["video_id"]) for r in every if r["query_id"] == q})
        assert {r["video_id"] for r in two if r["query_id"] == q} == {v for _, _, v in order[:2]} and len([r for r in two if r["query_id"] == q]) == 6
    assert chains.align(segments, events.where("false")).count() == 0 and chains.align(segments.where("false"), events).count() == 0
