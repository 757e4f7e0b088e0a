"""A caller's model over texts or windows of frames: loaded once a worker, fed in batches of similar length.

``make_encoder()`` gives a function from a list of inputs to vectors [n, d], or to a pair (hidden states [n, t, d], mask [n, t])
that is pooled here. Inputs of one Arrow batch are sorted by length before they are cut into batches, so little is padded, and
put back in their order. A null input has a null vector and is not given to the model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions.text import tokens
from segmentry.operators.streams import starts

BATCH = 32
#: The models of this worker process, by job; the last one only, as they are large.
_LOADED: dict = {}


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """The first state of each input, or the mean of those that ``mask`` keeps."""
    if how == "first":
        return hidden[:, 0]
    if how == "mean":
        kept = mask[:, :, None].astype(np.float64)
        return (hidden * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-6)
    raise ValueError(f"unknown pooling: {how}")


def encoded(df: DataFrame, inputs: str, make_encoder: Callable, pooling: str = "first", weights=None, bias=None, batch: int = BATCH, out: str = "vec") -> DataFrame:
    """``df`` with ``out``, the vector of column ``inputs``; ``weights`` [d, shared] and ``bias`` project it."""
    job = uuid.uuid4().hex
    w = None if weights is None else np.asarray(weights, np.float64)
    shift = 0.0 if bias is None else np.asarray(bias, np.float64)

    def vectors(values: list) -> np.ndarray:
        found = _LOADED[job](values)
        found = pooled(*map(np.asarray, found), pooling) if isinstance(found, tuple) else np.asarray(found)
        return found if w is None else found @ w + shift

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if job not in _LOADED and len(rows):
                _LOADED.clear()
                _LOADED[job] = make_encoder()
            values, made = rows[inputs].to_list(), [None] * len(rows)
            order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: len(values[i]))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                for i, v in zip(part, vectors([values[i] for i in part])):
                    made[i] = v.tolist()
            yield rows.assign(**{out: made})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` array<double>")


def frame_windows(frames: DataFrame, window: int, stride: int, value: str = "value") -> DataFrame:
    """(video_id, window_idx, window_start, num_frames, frames): the ``window`` values of each window of (video_id, frame_idx,
    ``value``), in order; a short stream repeats its last frame."""
    totals = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).cast("int").alias("num_frames"))
    cut = totals.select("video_id", "num_frames", F.posexplode(starts(F.col("num_frames"), window, stride)).alias("window_idx", "window_start"))
    places = cut.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("frame_idx", F.least(F.col("window_start") + F.col("at"), F.col("num_frames") - 1))
    held = places.join(frames.select("video_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.col(value).alias("value")), ["video_id", "frame_idx"])
    own = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return held.groupBy("video_id", "window_idx", "window_start", "num_frames").agg(own.alias("frames"))


def encoded_windows(frames: DataFrame, make_encoder: Callable, window: int = 64, stride: int = 8, value: str = "value", **how) -> DataFrame:
    """(video_id, window_idx, window_start, num_frames, vec): the model's vector of each window, as ``streams.smooth_vectors``
    and ``streams.ward_segments`` take them."""
    return encoded(frame_windows(frames, window, stride, value), "frames", make_encoder, **how).drop("frames")


def text_inputs(text: Column, longest: int) -> Column:
    """Whitespace-separated tokens, at most ``longest`` of them."""
    return F.slice(F.filter(F.split(text, r"\s+"), lambda t: t != ""), 1, longest)


def hashed(texts: DataFrame, places: int = 64) -> DataFrame:
    """(id, pos, v), where v is not 0: the encoder that is at hand without a model. Words are counted in ``places`` by their hash, and
    counts scaled to unit length. A text without words gives no row."""
    words = texts.select("id", F.explode(tokens(F.col("text"))).alias("term"))
    n = words.groupBy("id", F.pmod(F.xxhash64("term"), F.lit(places)).alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))  # at most ``places`` rows
    return n.withColumn("v", F.round(F.col("n") / length, 6)).drop("n")
