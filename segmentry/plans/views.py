"""The given tables as domain tables: once as SQL (both engines read it) and as DataFrames from that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmentry.plans.registry import table

SEGMENTS = """
numbered as (select vec_id, embedding, label, row_number() over (partition by label order by vec_id) - 1 as i from {embeddings}),
segments as (
  select vec_id as segment_id, concat('L', lpad(cast(label as string), 2, '0'), '_V001') as video_id,
         cast(i * 20 as int) as start_frame, cast(i * 20 + 20 as int) as end_frame, cast(i * 20 + 10 as int) as midpoint_frame,
         embedding, 'coarse' as level, case when label % 3 = 0 then 30 else 25 end as fps, label, cast(i as int) as i
  from numbered)"""
FRAMES = """
frames as (select user_id as video_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx,
                  value, event_type from {events})"""
#: Integer seconds, so both engines round alike.
REGIONS = """
regions as (select event_type as video_id, event_id, s as start_s, s + cast(floor(value * 60) as bigint) as end_s
            from (select *, cast(floor(epoch_s) as bigint) as s from (select *, %s as epoch_s from {events}) t) u)"""
REGIONS_SPARK = REGIONS % "unix_micros(cast(ts as timestamp)) / 1000000"
REGIONS_DUCK = REGIONS % "epoch_us(ts) / 1000000"
SAMPLES = """
samples as (select concat(source, '/', cast(doc_id as string), '.txt') as path, trim(text) as caption,
                   case when doc_id % 3 = 0 then 'image' else 'video' end as media_type, source, doc_id,
                   cast(n_chars as int) as num_frames from {documents})"""


def duck(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")


def view(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    import re

    tables = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", ctes))}
    return spark.sql(f"with {ctes} select * from {name}", **tables)


def segments(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, SEGMENTS, "segments")


def frames(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, FRAMES, "frames")


def regions(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, REGIONS_SPARK, "regions")


def samples(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, SAMPLES, "samples")
