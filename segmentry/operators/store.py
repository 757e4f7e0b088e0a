"""The segment store as a table: insert, keyed text, lookups, spoken text by time.

Columns: segment_id, video_id, start_frame, end_frame, midpoint_frame, level, asr_text and whatever else a store carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.operators import running
from segmentry.operators.dataprep import numbered


def midpoint(start: Column, end: Column) -> Column:
    """The middle frame, inside [start, end)."""
    return F.least(F.floor((start + end) / 2).cast("int"), end - 1)


def seconds(frame: Column, fps: Column) -> Column:
    return F.round(frame / fps.cast("double"), 2)


def frame_at(seconds: Column, fps: Column) -> Column:
    """Half goes to the even frame."""
    return F.bround(seconds * fps).cast("int")


def insert(store: DataFrame, new: DataFrame, *order: str, high_water: int = 0) -> DataFrame:
    """``new`` with segment_id, in ``order``: they follow the highest id of ``store`` and ``high_water``, the highest ever given,
    so the id of a deleted row is not given again; ``segment_table`` keeps that mark on disk."""
    highest = max(store.agg(F.max("segment_id")).first()[0] or 0, high_water)
    return numbered(new, *order, start=highest + 1, name="segment_id")


def lookup(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose segment_id is in ``ids``; unknown and repeated ids add nothing."""
    return store.join(ids.select("segment_id"), "segment_id", "left_semi")


def by_video(store: DataFrame, video_id: str) -> DataFrame:
    return store.where(F.col("video_id") == video_id).orderBy("start_frame")


def missing_text(store: DataFrame, field: str = "asr_text") -> DataFrame:
    return store.where(F.col(field).isNull())


def counts(store: DataFrame, *by: str) -> DataFrame:
    return store.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def update_text(store: DataFrame, updates: DataFrame, field: str = "asr_text") -> tuple[DataFrame, DataFrame]:
    """(store with new text in ``field``, ids that the store lacks) for ``updates`` (segment_id, text).

    A null text changes nothing; of several texts for one id the greatest is taken."""
    one = updates.groupBy("segment_id").agg(F.max("text").alias("_text"))
    updated = store.join(one, "segment_id", "left").withColumn(field, F.coalesce("_text", field)).drop("_text")
    return updated, one.select("segment_id").join(store.select("segment_id"), "segment_id", "left_anti")


def overlapping(store: DataFrame, spoken: DataFrame, bin_frames: int = 250) -> DataFrame:
    """Each segment with each row of ``spoken`` (video_id, sf, ef, ...) that shares a frame with it.

    Both sides are cut into bins of ``bin_frames``, so a long video is many keys; a pair counts in the first bin of both."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_frames), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / bin_frames)))
    left = store.withColumn("_bin", bins("start_frame", "end_frame"))
    right = spoken.withColumn("_bin", bins("sf", "ef"))
    first = F.floor(F.greatest("start_frame", "sf") / bin_frames) == F.col("_bin")
    return left.join(right, ["video_id", "_bin"]).where((F.col("sf") < F.col("end_frame")) & (F.col("ef") > F.col("start_frame")) & first).drop("_bin")


def spoken_text(store: DataFrame, spoken: DataFrame, tie: str) -> DataFrame:
    """(segment_id, n, first, last, text): what is said during a segment, in order of sf and ``tie``."""
    pairs = overlapping(store.select("segment_id", "video_id", "start_frame", "end_frame"), spoken)
    said = F.array_sort(F.collect_list(F.struct("sf", tie, "text")))
    return pairs.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sf").alias("first"), F.max("ef").alias("last"),
        F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"),
    )


def last_spoken(store: DataFrame, spoken: DataFrame, tie: str, parts: int | None = None) -> DataFrame:
    """Adds text_start and the text of the latest row of ``spoken`` that starts at or before the midpoint; of equal starts
    the greatest ``tie``; null if there is none. A video may lie in any number of tasks."""
    none = F.lit(None)
    said = F.struct(F.col("sf"), F.col(tie), F.col("text"))
    kind = spoken.select(said.alias("s")).schema["s"].dataType
    events = store.select("segment_id", "video_id", F.col("midpoint_frame").alias("at"), F.lit(1).alias("kind"), none.cast(kind).alias("said"))
    events = events.unionByName(spoken.select(none.cast("long").alias("segment_id"), "video_id", F.col("sf").alias("at"), F.lit(0).alias("kind"), said.alias("said")))
    of, order = ["video_id"], ["at", "kind"]
    # the greatest (start, tie) so far is the latest
    found = running.before(running.sliced(events, of, order, parts), of, order, "max", F.col("said"), "latest").where("kind = 1")
    return found.select("segment_id", F.col("latest.sf").alias("text_start"), F.col(f"latest.{tie}").alias(tie), F.col("latest.text").alias("text"))
