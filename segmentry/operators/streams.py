"""Windows over ordered streams, segmentation, intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.operators import running
from segmentry.sources.files import stored


def starts(total: Column, window: int, stride: int) -> Column:
    """0, s, 2s ... and one window anchored at the end; a short stream has the one at 0; without frames it is an error."""
    steps = F.sequence(F.lit(0), total - window, F.lit(stride))
    return F.when(total <= 0, F.raise_error(F.concat(F.lit("no frames: "), total.cast("string"))).cast("array<int>")).when(total <= window, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(total - window))))


def window_starts(df: DataFrame, window: int, stride: int, total: str = "num_frames") -> DataFrame:
    return df.select("*", F.posexplode(starts(F.col(total).cast("int"), window, stride)).alias("window_idx", "window_start"))


def _in_windows(frames: DataFrame, window: int, stride: int) -> DataFrame:
    """``frames`` (video_id, frame_idx, ...) once for each window they lie in, with window_start, num_frames and w, how often a
    frame counts: the last one of a short stream fills the window.

    A frame names its windows itself, so nothing is joined but a row a video."""
    total = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).cast("int").alias("num_frames"))
    at, n = F.col("frame_idx"), F.col("num_frames")
    low = F.greatest(F.ceil((at - window + 1) / stride), F.lit(0)).cast("int")
    high = F.floor(F.least(at, n - window) / stride).cast("int")
    none = F.array().cast("array<int>")
    regular = F.when(high >= low, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(none)
    final = F.when(at >= n - window, F.array((n - window).cast("int"))).otherwise(none)
    inside = F.when(n <= window, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, final)))
    weight = F.when((at == n - 1) & (n < window), (window - n + 1).cast("double")).otherwise(F.lit(1.0))
    return frames.join(total, "video_id").withColumn("window_start", F.explode(inside)).withColumn("w", weight)


def _window_idx(stride: int) -> Column:
    """The last window may start off the grid of strides; it is the next one all the same."""
    return F.ceil(F.col("window_start") / stride).cast("int")


def pool_windows(frames: DataFrame, window: int, stride: int, value: str = "value") -> DataFrame:
    """Mean of ``value`` in each window of (video_id, frame_idx); a short stream repeats its last frame. Sums are taken before
    the shuffle."""
    spread = _in_windows(frames.select("video_id", "frame_idx", value), window, stride)
    mean = (F.sum(F.col(value) * F.col("w")) / window).alias("value")
    return spread.groupBy("video_id", "window_start", "num_frames").agg(mean).withColumn("window_idx", _window_idx(stride))


def smooth(df: DataFrame, kernel: int = 3, value: str = "value", block: int = 4096) -> DataFrame:
    """Centred mean over an odd kernel (even ones grow by 1); fewer rows at the edges. A video may lie in any number of tasks."""
    half = kernel // 2
    near, by = running.blocked(df, ["video_id"], "window_idx", half, half, block)
    mean = F.avg(value).over(Window.partitionBy(*by).orderBy("window_idx").rowsBetween(-half, half))
    return running.own(near.withColumn(value, mean))


def checked_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames of good videos, videos with an error) of (video_id, frame_idx, vec): frames count from 0 without gaps or
    repeats, and all vectors of a video have one size above 0 and finite numbers."""
    odd = F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    seen = frames.groupBy("video_id").agg(
        F.bool_or(odd).alias("odd"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("frame_idx").alias("places"), F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"),
    )
    error = (
        F.when(F.col("odd") | (F.col("least") < 1), "missing or infinite values").when(F.col("least") != F.col("most"), "vectors of unequal size")
        .when((F.col("first") != 0) | (F.col("n") != F.col("places")) | (F.col("last") + 1 != F.col("n")), "gaps or repeats in frames")
    )
    told = stored(seen.select("video_id", F.col("n").alias("num_frames"), error.alias("error")), "checked")  # a row a video, read twice
    bad = told.where("error is not null")
    return frames.join(bad, frames["video_id"].eqNullSafe(bad["video_id"]), "left_anti"), told


def pool_vectors(frames: DataFrame, window: int, stride: int) -> DataFrame:
    """(video_id, window_idx, window_start, num_frames, vec): as ``pool_windows``, for vec."""
    spread = _in_windows(frames.select("video_id", "frame_idx", "vec"), window, stride)
    vectors = spread.withColumn("v", array_to_vector(F.col("vec").cast("array<double>")))
    pooled = vectors.groupBy("video_id", "num_frames", "window_start").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("w"))).alias("vec"))
    return pooled.withColumn("window_idx", _window_idx(stride))


def smooth_vectors(windows: DataFrame, kernel: int = 3, block: int = 4096) -> DataFrame:
    """As ``smooth``, for vec."""
    half = kernel // 2
    spread, by = running.blocked(windows, ["video_id"], "window_idx", half, half, block)
    near = F.collect_list("vec").over(Window.partitionBy(*by).orderBy("window_idx").rowsBetween(-half, half))  # at most the kernel
    added = F.aggregate(F.slice("_near", 2, kernel + 1), F.get("_near", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return running.own(spread.withColumn("_near", near)).withColumn("vec", F.transform(added, lambda x: x / F.size("_near"))).drop("_near")


def masked_mean(states: DataFrame, by: list[str], vec: str = "vec", mask: str = "mask") -> DataFrame:
    """(by, vec): the sum of the vectors whose ``mask`` is 1 over their number, 0 if it is 0 for all; a null mask is 0, and rows
    without a vector count for nothing. Summed before the shuffle."""
    kept = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    rows = states.where(F.col(vec).isNotNull()).withColumn("_w", kept)
    rows = rows.withColumn("_v", array_to_vector(F.transform(F.col(vec).cast("array<double>"), lambda x: x * F.col("_w"))))
    total = rows.groupBy(*by).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"), F.greatest(F.sum("_w"), F.lit(1e-6)).alias("_n"))
    return total.select(*by, F.transform("_s", lambda x: x / F.col("_n")).alias("vec"))


def tiling(segments: DataFrame, parts: int | None = None) -> DataFrame:
    """(video_id, segments, frames, first, last, tiles): do a video's segments (start_frame, end_frame, num_frames) begin at 0,
    each where the one before ends, and end with the video. A video may lie in any number of tasks."""
    of, order = ["video_id"], ["start_frame", "end_frame"]
    before = running.before(running.sliced(segments, of, order, parts), of, order, "max", F.struct("start_frame", "end_frame"), "_before")
    meets = F.coalesce(F.col("_before.end_frame"), F.lit(0)) == F.col("start_frame")
    found = before.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"), F.min("start_frame").alias("first"),
        F.max("end_frame").alias("last"), F.bool_and(meets & (F.col("end_frame") > F.col("start_frame"))).alias("_meet"), F.max("num_frames").alias("_n"))
    return found.withColumn("tiles", F.coalesce(F.col("_meet") & (F.col("last") == F.col("_n")), F.lit(False))).drop("_meet", "_n")


def reappearing(runs: DataFrame) -> DataFrame:
    """(video_id, label, runs) of labels with more than one run."""
    return runs.groupBy("video_id", "label").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")


def sample_frames(videos: DataFrame, n: int, how: str = "even") -> DataFrame:
    """``videos`` (num_frames, ...) with k, from 0, and frame_idx: ``n`` frames spread evenly from the first to the last, half
    going to the even one (a short video repeats frames, an image, of one frame, is repeated), or with ``how`` first the first
    ``n`` that there are. Videos without frames give no row."""
    if n < 1 or how not in ("even", "first"):
        raise ValueError(f"not a sample of frames: {n}, {how}")
    last = F.col("num_frames") - 1
    placed = videos.where("num_frames > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1) if how == "even" else F.least(F.lit(n - 1), last))))
    at = F.bround(F.col("k") * last / max(n - 1, 1)) if how == "even" else F.col("k")
    return placed.withColumn("frame_idx", at.cast("int"))


def readable_before(samples: DataFrame, ok: Column) -> DataFrame:
    """Adds use_idx to ``samples`` (video_id, k, frame_idx): the frame itself if ``ok``, else that of the last earlier sample that
    is; null where none is, and then the video has no readable first frame."""
    of, order = ["video_id"], ["k"]
    held = samples.withColumn("_ok", F.when(F.coalesce(ok, F.lit(False)), F.struct("k", "frame_idx")))
    before = running.before(running.sliced(held, of, order), of, order, "max", F.col("_ok"), "_before")
    return before.withColumn("use_idx", F.coalesce("_ok.frame_idx", "_before.frame_idx")).drop("_ok", "_before", "_slice")


def segment_videos(frames: DataFrame, window: int = 64, stride: int = 8, kernel: int = 3, threshold: float = 15.0, level: str = "coarse") -> tuple[DataFrame, DataFrame]:
    """(segments, status) of (video_id, frame_idx, vec).

    Windows, mean vectors, smoothing, Ward clusters of neighbours, runs. Segments (video_id, start_frame, end_frame,
    midpoint_frame, embedding, level) tile every good video; embedding is the mean of a segment's windows. Status is a row a
    video: video_id, num_frames, error (null if it is cut); a video with an error does not stop the others."""
    good, status = checked_frames(frames)
    labels = ward_segments(smooth_vectors(pool_vectors(good, window, stride), kernel), threshold, keep_vec=True)
    mean = labels.groupBy("video_id", "label").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("embedding"))
    mid = F.least(F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("int"), F.col("end_frame") - 1)
    runs = runs_from_labels(labels.drop("vec")).withColumn("midpoint_frame", mid)
    return runs.join(mean, ["video_id", "label"]).select("video_id", "start_frame", "end_frame", "midpoint_frame", "embedding", F.lit(level).alias("level")), status


def runs_from_labels(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Segments of equal labels: (video_id, window_idx, window_start, label, num_frames). A video may lie in any number of tasks."""
    of, order = ["video_id"], ["window_idx"]
    last = running.before(running.sliced(df, of, order, parts), of, order, "max", F.struct("window_idx", "label"), "last")
    marked = last.withColumn("new", F.coalesce((F.col("label") != F.col("last.label")).cast("int"), F.lit(1)))
    counted = running.before(marked, of, order, "sum", F.col("new"), "runs").withColumn("run", F.coalesce("runs", F.lit(0)) + F.col("new"))
    runs = counted.groupBy("video_id", "run", "num_frames").agg(
        F.min("window_start").alias("start_frame"), F.min("window_idx").alias("first_window"), F.max("window_idx").alias("last_window"), F.min("label").alias("label"))
    after = F.lead("start_frame").over(Window.partitionBy("video_id").orderBy("run"))
    return runs.withColumn("end_frame", F.coalesce(after, F.col("num_frames"))).drop("num_frames")


def ward_labels(x: np.ndarray, threshold: float = 15.0) -> np.ndarray:
    """Ward clusters of a sequence where only neighbours merge; labels in time order.

    The full merge list is made first; 1 + number of heights at or over the threshold clusters remain."""
    import heapq

    n = len(x)
    total, size, nxt, prv, alive = x.astype(np.float64).copy(), np.ones(n), list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n

    def cost(a: int, b: int) -> float:
        d = total[a] / size[a] - total[b] / size[b]
        return float(np.sqrt(2 * size[a] * size[b] / (size[a] + size[b]) * (d @ d)))

    heap = [(cost(i, i + 1), i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    merges = []
    while heap:
        h, a, b, va, vb = heapq.heappop(heap)
        if alive[a] != va or alive[b] != vb:
            continue
        merges.append((h, b))
        total[a] += total[b]
        size[a] += size[b]
        alive[a], alive[b] = alive[a] + 1, -1
        nxt[a] = nxt[b]
        if nxt[a] < n:
            prv[nxt[a]] = a
            heapq.heappush(heap, (cost(a, nxt[a]), a, nxt[a], alive[a], alive[nxt[a]]))
        if prv[a] >= 0:
            heapq.heappush(heap, (cost(prv[a], a), prv[a], a, alive[prv[a]], alive[a]))
    k = 1 + sum(h >= threshold for h, _ in merges)
    cut = np.zeros(n, int)
    for _, b in merges[len(merges) - (k - 1) :]:
        cut[b] = 1
    return np.cumsum(cut)


def ward_segments(windows: DataFrame, threshold: float = 15.0, keep_vec: bool = False) -> DataFrame:
    """Labels for (video_id, window_idx, vec array<double>, ...): a video is the unit of work."""
    schema = windows if keep_vec else windows.drop("vec")
    names = schema.columns

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_idx")
        return rows[names].assign(label=ward_labels(np.stack(rows["vec"]), threshold))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return windows.groupBy("video_id").applyInPandas(one, f"{fields}, label long")


def next_valid(df: DataFrame, ok: Column, most: int = 32, strict: bool = False, block: int = 4096) -> DataFrame:
    """Adds use_idx: the frame_idx (from 0, without gaps) of the first row with ``ok`` among a row and the ``most`` - 1 after
    it in its video, going on at the video's start after its end; null if there is none, or with ``strict`` an error. A video
    may lie in any number of tasks."""
    good = df.withColumn("_good", F.when(ok, F.col("frame_idx"))).withColumn("_at", F.col("frame_idx")).withColumn("_first", F.lit(True))
    total = df.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    again = good.where(F.col("frame_idx") < most - 1).join(total, "video_id").withColumn("_at", F.col("_at") + F.col("_n")).withColumn("_first", F.lit(False)).drop("_n")
    spread, by = running.blocked(good.unionByName(again), ["video_id"], "_at", 0, most - 1, block)
    ahead = Window.partitionBy(*by).orderBy("_at").rowsBetween(0, most - 1)
    found = running.own(spread.withColumn("use_idx", F.first("_good", ignorenulls=True).over(ahead))).where("_first").drop("_good", "_at", "_first")
    none = F.raise_error(F.concat(F.lit("no valid sample near "), F.col("video_id").cast("string"), F.lit(":"), F.col("frame_idx").cast("string"))).cast("int")
    return found.withColumn("use_idx", F.coalesce("use_idx", none)) if strict else found


def merge_intervals(df: DataFrame, pad=0, gap=0, parts: int | None = None) -> DataFrame:
    """(video_id, start_s, end_s) padded (start not below 0) and merged where a start is at most ``gap`` past all earlier ends.
    A video's intervals may lie in any number of tasks; ``parts`` is that of the range partitions."""
    padded = df.select("video_id", F.greatest(F.col("start_s") - pad, F.lit(0)).alias("s"), (F.col("end_s") + pad).alias("e"))
    of, order = ["video_id"], ["s", "e"]
    reached = running.before(running.sliced(padded, of, order, parts), of, order, "max", F.col("e"), "reach")
    marked = reached.withColumn("new", F.coalesce((F.col("s") - F.col("reach") > gap).cast("int"), F.lit(1)))
    runs = running.before(marked, of, order, "sum", F.col("new"), "runs").withColumn("run", F.coalesce("runs", F.lit(0)) + F.col("new"))
    return runs.groupBy("video_id", "run").agg(F.min("s").alias("start_s"), F.max("e").alias("end_s"))


def split_intervals(df: DataFrame, most) -> DataFrame:
    """Equal pieces of at most ``most``; the last ends exactly at the end. None or 0 leaves all whole."""
    if not most:
        return df.withColumn("piece", F.lit(0))
    n = F.greatest(F.ceil((F.col("end_s") - F.col("start_s")) / most), F.lit(1)).cast("int")
    pieces = df.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    size = (F.col("end_s") - F.col("start_s")) / F.col("n")
    end = F.when(F.col("piece") == F.col("n") - 1, F.col("end_s").cast("double")).otherwise(F.col("start_s") + size * (F.col("piece") + 1))
    return pieces.withColumn("e", end).withColumn("start_s", F.col("start_s") + size * F.col("piece")).withColumn("end_s", F.col("e")).drop("e", "n")
