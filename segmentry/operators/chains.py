"""Ordered event chains in videos: for each query of any number of events the best segments, frames strictly rising.

A video is cut into slices of frames. In a slice all events' scores are one product of matrices, and a running maximum over its
frames gives, for every run of events a..b, the best chain that lies in the slice. The slices of a video are then joined in
order: the best chain of the first j events is the one so far, or the first i of it and a run i+1..j of the next slice. So a
video of any length is many tasks, and what is kept of a slice does not grow with it.

Scores are inner products in units of 1e-6, added as integers. Of equal totals the chain with the earliest last frame is taken, then
the one with the earliest frame before it, and so on. Every query has a row for each of its events in each video that is
returned; a video with too few segments for a chain comes last, with null frames, and not found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.operators import tiles

#: Frames of a slice, queries that meet a slice at once, parts of a score.
SPAN, QUERIES, UNIT = 100_000, 256, 10**6
_NONE = np.iinfo(np.int64).min // 4


def _before(cur: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and frame: the greatest value at the first ``upto`` frames, and the earliest place of it."""
    best = np.maximum.accumulate(cur, axis=1)
    fresh = np.ones(cur.shape, bool)
    fresh[:, 1:] = best[:, 1:] > best[:, :-1]
    at = np.maximum.accumulate(np.where(fresh, np.arange(cur.shape[1]), 0), axis=1)
    none = upto == 0
    take = np.maximum(upto - 1, 0)
    return np.where(none, _NONE, best[:, take]), at[:, take]


def slice_chains(frames: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For scores [query, event, frame]: (a, b, totals [query], places [query, b - a + 1]) of the best chains of events a..b
    (from 0), places in ``frames``, which rise but may repeat; a total under zero parts of ``_NONE`` is no chain."""
    upto = np.searchsorted(frames, frames, side="left")
    n, out, every = scores.shape[1], [], np.arange(len(scores))
    for a in range(n):
        cur, back = scores[:, a], []
        for b in range(a, n):
            if b > a:
                best, at = _before(cur, upto)
                back.append(at)
                cur = np.where(best > _NONE // 2, scores[:, b] + best, _NONE)
            places = [cur.argmax(axis=1)]
            totals = cur[every, places[0]]
            for at in reversed(back):
                places.append(at[every, places[-1]])
            out.append((a, b, totals, np.stack(places[::-1], axis=1)))
    return out


def joined(slices: list[dict]) -> tuple[int, tuple, tuple] | None:
    """The best chain of all events over slices in order; each: (a, b) -> (total, frames, scores); ``n`` is under "n"."""
    key = lambda c: (c[0], tuple(-f for f in reversed(c[1])))
    n, state = slices[0]["n"], {0: (0, (), ())}
    for own in slices:
        new = dict(state)
        for j in range(1, n + 1):
            for i in range(j):
                if i in state and (i, j - 1) in own:
                    total, frames, scores = own[i, j - 1]
                    chain = (state[i][0] + total, state[i][1] + frames, state[i][2] + scores)
                    if j not in new or key(chain) > key(new[j]):
                        new[j] = chain
        state = new
    return state.get(n)


def align(segments: DataFrame, events: DataFrame, k: int | None = 3, found_threshold: float = 0.5, span: int = SPAN, queries_at_once: int = QUERIES) -> DataFrame:
    """(query_id, video_id, event_index, frame, score, found, overall_score) for the ``k`` best videos of each query (all, if
    null): ``segments`` (video_id, frame, vec), ``events`` (query_id, event_index from 1, vec). overall_score is the mean of the found
    events' scores, or of all where none is found; ties go to the smaller video_id."""
    n, dim = tiles.size_of(events)
    query, video = (df.schema[c].dataType.simpleString() for df, c in ((events, "query_id"), (segments, "video_id")))
    parts = max(1, -(-events.select("query_id").distinct().count() // queries_at_once))
    asked = tiles.whole(events, dim).groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("query_id", "event_index", "vec"))).alias("e"))
    asked = asked.select("part", F.col("e.query_id").alias("query_ids"), F.flatten("e.vec").alias("event_vecs"))
    lying = tiles.whole(segments, dim).groupBy("video_id", F.floor(F.col("frame") / span).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("frame", "vec"))).alias("s"))
    lying = lying.select("video_id", "slice", F.col("s.frame").alias("frames"), F.flatten("s.vec").alias("vecs"))
    lying = lying.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    fields = ["video_id", "part", "slice", "query_id", "n", "a", "b", "total", "frames", "scores"]

    def of_slice(row: pd.Series) -> Iterator[pd.DataFrame]:
        frames, ids = np.asarray(row["frames"]), np.asarray(row["query_ids"])
        vecs, asks = tiles.matrix(row["vecs"], len(frames)), tiles.matrix(row["event_vecs"], len(ids))
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sizes = np.diff(np.append(first, len(ids)))
        for size in np.unique(sizes):
            alike = first[sizes == size]
            for some in tiles.steps(len(alike), size * len(frames)):
                own, out = alike[some], []
                of_events = np.round(asks[(own[:, None] + np.arange(size)).ravel()] @ vecs.T * UNIT).astype(np.int64).reshape(len(own), size, -1)
                for a, b, totals, places in slice_chains(frames, of_events):
                    for q in np.flatnonzero(totals > _NONE // 2):
                        at = places[q]
                        out.append((row["video_id"], row["part"], row["slice"], ids[own[q]], int(size), a, b, totals[q], frames[at], of_events[q, np.arange(a, b + 1), at]))
                yield pd.DataFrame(out, columns=fields)

    def of_video(own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, rows in own.groupby("query_id", sort=False):
            slices = [{"n": int(part["n"].iloc[0])} | {(a, b): (t, tuple(f), tuple(s)) for a, b, t, f, s in zip(part["a"], part["b"], part["total"], part["frames"], part["scores"])} for _, part in rows.groupby("slice")]
            chain = joined(slices)
            out.append((q, own["video_id"].iloc[0], slices[0]["n"], list(chain[1]) if chain else None, [s / UNIT for s in chain[2]] if chain else None))
        return pd.DataFrame(out, columns=["query_id", "video_id", "n", "frames", "scores"])

    kinds = f"video_id {video}, part int, slice long, query_id {query}, n int, a int, b int, total long, frames array<long>, scores array<long>"
    pieces = tiles.each_pair(tiles.met(lying, asked, ["part"], 8 * n * dim), of_slice, kinds)
    found = pieces.groupBy("video_id", "part").applyInPandas(of_video, f"query_id {query}, video_id {video}, n int, frames array<long>, scores array<double>")
    good = F.filter("scores", lambda s: s >= found_threshold)
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.size(c))
    scored = found.withColumn("overall_score", F.round(F.when(F.size(good) > 0, mean(good)).otherwise(mean(F.col("scores"))), 6))
    if k is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("overall_score"), "video_id"))
        scored = scored.withColumn("place", place).where(F.col("place") <= k)
    rows = scored.withColumn("event_index", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = lambda c: F.get(c, F.col("event_index") - 1)
    return rows.select("query_id", "video_id", "event_index", at(F.col("frames")).alias("frame"), at(F.col("scores")).alias("score"), F.coalesce(at(F.col("scores")) >= found_threshold, F.lit(False)).alias("found"), "overall_score")
