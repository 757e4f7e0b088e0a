"""Preparing training data: outcomes, deduplication, leak-free splits, request and query-pack parsing."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions.text import strip
from segmentry.sources.files import shared_folder


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first by ``order``."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def outcome(duplicate: Column, missing: Column, corrupt: Column) -> Column:
    """The first failing check names the outcome."""
    return F.when(duplicate, "duplicate").when(missing, "missing").when(corrupt, "corrupt").otherwise("ok")


def numbered(df: DataFrame, *order: str, start: int = 0, name: str = "number") -> DataFrame:
    """Adds each row's place in ``order``, from ``start``: rows are sorted in range partitions, which are counted; a
    partition's first place is added to the place within it. Written first, so that both passes see the same partitions."""
    spark = df.sparkSession
    path = shared_folder(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at") + start).drop("_part", "_at", "_before")


def grouped_split(df: DataFrame, group: str, val_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds split: the first floor(groups * ratio) groups in hash order are val; no group is on both sides."""
    groups = df.select(group).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group))))
    ordered = numbered(groups, "h", group)
    n = int(ordered.count() * val_ratio)
    return df.join(ordered.where(F.col("number") < n).select(group, F.lit("val").alias("split")), group, "left").fillna({"split": "train"})


_CLIPS = "array<struct<start: string, end: string, caption: string>>"


def _literal_clips(timestamps: pd.Series, captions: pd.Series) -> pd.Series:
    def one(times, texts):
        try:
            times, texts = ast.literal_eval(times), ast.literal_eval(texts)
            return [{"start": str(start), "end": str(end), "caption": str(text).strip()} for (start, end), text in zip(times, texts)]
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return pd.Series([one(t, c) for t, c in zip(timestamps, captions)])


def expand_clip_tasks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected rows) of (video_id, url, timestamps, captions), the last two as text of Python lists: both kinds of
    quotes and all escapes are read; the shorter list ends the row; rows that do not parse are rejected."""
    parsed = df.withColumn("clips", F.pandas_udf(_literal_clips, _CLIPS)("timestamps", "captions"))
    clips = parsed.where("clips is not null").select("video_id", "url", F.posexplode("clips").alias("i", "p"))
    return clips.select(F.format_string("%s_%03d", "video_id", "i").alias("clip_id"), "video_id", "url", "p.*"), parsed.where("clips is null").drop("clips")


def parse_query_pack(files: DataFrame) -> DataFrame:
    """``files`` (file_name with or without a path, content) -> query_id, task, query, events, scene, question, top_k, error,
    preview. A question stands after the last ``Hỏi``."""
    base = F.regexp_extract("file_name", r"([^/\\]*)$", 1)
    stem = F.split(F.regexp_replace(base, r"\.txt$", ""), "-")
    task = F.lower(F.element_at(stem, -1))
    named = F.size(stem) >= 4
    text = strip(F.col("content"))
    events = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: strip(F.regexp_extract(strip(x), r"(?i)^E\d+:(.*)$", 1))), lambda x: x != "")
    scene, question = (strip(F.regexp_extract(text, r"(?s)^(.*)Hỏi(.*)$", i)) for i in (1, 2))
    error = (
        F.when(~named, "bad file name").when(~task.isin("kis", "trake", "qa"), "unknown task")
        .when((task == "kis") & (text == ""), "empty query").when((task == "qa") & ((scene == "") | (question == "")), "no question")
        .when((task == "trake") & (F.size(events) == 0), "no events")
    )
    return files.select(
        "file_name", F.when(named, F.concat_ws("-", F.get(stem, F.lit(1)), F.get(stem, F.lit(2)))).alias("query_id"), task.alias("task"),
        F.when(task == "kis", text).alias("query"), F.when(task == "trake", events).alias("events"),
        F.when(task == "qa", scene).alias("scene"), F.when(task == "qa", question).alias("question"),
        F.when(task == "kis", 5).otherwise(3).alias("top_k"), error.alias("error"), F.left("content", F.lit(100)).alias("preview"),
    )


def read_query_pack(spark: SparkSession, path: str) -> DataFrame:
    """``parse_query_pack`` of the whole text files under ``path``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
    return parse_query_pack(files)
