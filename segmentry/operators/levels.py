"""From videos to search in one call: for each level videos are cut, their segments stored with ids, and an index built.

A level that finds no segment has no index and says so; a video whose frames are broken is skipped on every level, and counted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import index, segment_table, streams
from segmentry.sources.files import stored

#: Window and stride of each level, in frames.
LEVELS = {"coarse": (64, 8), "fine": (20, 4)}
_FIELDS = "video_id string, start_frame int, end_frame int, midpoint_frame int, level string, embedding array<double>"


@dataclass
class Built:
    path: str
    #: level -> (batch of its segments, whether it has an index)
    levels: dict[str, bool] = field(default_factory=dict)

    def segments(self, spark: SparkSession) -> DataFrame:
        return segment_table.SegmentTable(spark, f"{self.path}/segments").rows()

    def index(self, spark: SparkSession, level: str) -> index.Index:
        return index.load(spark, f"{self.path}/index-{level}")


def build(frames: DataFrame, path: str, levels: dict[str, tuple[int, int]] = LEVELS, kernel: int = 3, threshold: float = 15.0, measure: bool = True) -> tuple[Built, DataFrame]:
    """Segments and an index of each of ``levels`` under ``path``, from (video_id, frame_idx, vec); and the status of every video on every
    level: video_id, level, num_frames, error, segments."""
    spark, told = frames.sparkSession, []
    table, built = segment_table.create(spark, f"{path}/segments", _FIELDS), Built(path)
    for batch, (level, (window, stride)) in enumerate(levels.items()):
        cut, status = streams.segment_videos(frames, window, stride, kernel, threshold, level)
        cut = stored(cut, f"segments-{level}")
        table.append(cut, batch, "video_id", "start_frame")
        own = table.rows().where(F.col("level") == level)
        built.levels[level] = not own.isEmpty()
        if built.levels[level]:
            index.build(own.select(F.col("segment_id").alias("id"), F.col("embedding").alias("vec")), f"{path}/index-{level}", measure=measure)
        n = cut.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments"))
        told.append(status.join(n, "video_id", "left").select("video_id", F.lit(level).alias("level"), "num_frames", "error", F.coalesce("segments", F.lit(0)).alias("segments")))
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return built, stored(out, "status")


def summary(status: DataFrame) -> DataFrame:
    """(level, ok, skipped, segments)"""
    return status.groupBy("level").agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("skipped"), F.sum("segments").alias("segments"))


def search(built: Built, queries: DataFrame, level: str, k: int = 5, nprobe: int | None = None) -> DataFrame:
    """(query_id, rank, score, segment_id, video_id, start_frame, end_frame, midpoint_frame): the ``k`` best segments of a level for each of
    ``queries`` (query_id, vec); no rows where the level has no index."""
    spark = queries.sparkSession
    if not built.levels.get(level):
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, score double, segment_id long, video_id string, start_frame int, end_frame int, midpoint_frame int")
    hits = index.search(built.index(spark, level), queries, k, nprobe).withColumnRenamed("id", "segment_id")
    return hits.join(built.segments(spark), "segment_id").select("query_id", "rank", "score", "segment_id", "video_id", "start_frame", "end_frame", "midpoint_frame")
