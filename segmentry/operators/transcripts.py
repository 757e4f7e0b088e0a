"""The transcript job: speech regions merged, padded and split, texts trimmed and blanks dropped, a file a video written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.text import strip, timecode
from segmentry.operators import running
from segmentry.operators.streams import merge_intervals, split_intervals


def regions(speech: DataFrame, pad: float = 0.2, gap: float = 0.3, most: float | None = 30.0) -> DataFrame:
    """(video_id, start_s, end_s) of ``speech`` padded, merged and cut into pieces of at most ``most`` seconds, for a recogniser."""
    return split_intervals(merge_intervals(speech, pad, gap), most).select("video_id", "start_s", "end_s")


def kept(recognised: DataFrame) -> DataFrame:
    """``recognised`` (video_id, start_s, end_s, text) with trimmed texts and times to the millisecond; without blank texts."""
    tidy = recognised.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return tidy.withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


def frame(seconds: Column, fps: Column) -> Column:
    """Half goes to the even frame."""
    return F.bround(seconds * fps).cast("int")


def cues(segments: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds cue, from 1 within each video in order of time, and its lines of SubRip."""
    order = ["start_s", "end_s", "text"]
    slices = running.sliced(segments, ["video_id"], order, parts)
    numbered = running.before(slices, ["video_id"], order, "sum", F.lit(1), "cue").withColumn("cue", F.coalesce("cue", F.lit(0)) + 1).drop("_slice")
    times = F.concat(timecode(F.col("start_s")), F.lit(" --> "), timecode(F.col("end_s")))
    return numbered.withColumn("lines", F.concat_ws("\n", F.col("cue").cast("string"), times, "text", F.lit("")))


def write_srt(segments: DataFrame, path: str) -> None:
    """A folder a video under ``path`` (video_id=...), whose files in order are its SubRip cues; a long video is several files."""
    ordered = cues(segments).repartitionByRange("video_id", "cue").sortWithinPartitions("video_id", "cue")
    ordered.select("video_id", F.col("lines").alias("value")).write.partitionBy("video_id").text(path)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, cue, start_s, end_s, text) of ``write_srt``; cues are parted by blank lines, so a text has none."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    line = F.split(F.regexp_replace("value", r"^\n+", ""), "\n")
    clock = lambda c: F.split(F.replace(c, F.lit(","), F.lit(".")), ":")
    seconds = lambda c: F.round(clock(c)[0].cast("double") * 3600 + clock(c)[1].cast("double") * 60 + clock(c)[2].cast("double"), 3)
    times = F.split(line[1], " --> ")
    return raw.select("video_id", line[0].cast("long").alias("cue"), seconds(times[0]).alias("start_s"), seconds(times[1]).alias("end_s"), F.array_join(F.slice(line, 3, F.size(line)), "\n").alias("text"))


def write_json(segments: DataFrame, fps: DataFrame, path: str) -> None:
    """A JSON document a video: video_id, video_fps and its segments (text, start_frame, end_frame) in order; ``fps``: video_id,
    video_fps. Videos of ``fps`` without a segment have an empty list."""
    held = segments.join(fps, "video_id").select("video_id", F.struct("start_s", "text", frame(F.col("start_s"), F.col("video_fps")).alias("start_frame"), frame(F.col("end_s"), F.col("video_fps")).alias("end_frame")).alias("s"))
    lists = held.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    rows = fps.join(lists, "video_id", "left").select("video_id", "video_fps", F.transform(F.coalesce("s", F.array().cast(lists.schema["s"].dataType)), lambda s: F.struct(s["text"].alias("text"), s["start_frame"].alias("start_frame"), s["end_frame"].alias("end_frame"))).alias("segments"))
    rows.withColumn("video", F.col("video_id")).repartition("video").write.partitionBy("video").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, video_fps, start_frame, end_frame, text), a row a segment."""
    docs = spark.read.schema("video_id string, video_fps double, segments array<struct<text: string, start_frame: int, end_frame: int>>").json(path)
    return docs.select("video_id", "video_fps", F.explode("segments").alias("s")).select("video_id", "video_fps", "s.start_frame", "s.end_frame", "s.text")
