"""Segments, windows, intervals and transcripts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from segmentry.functions import sql
from segmentry.functions import text as t
from segmentry.operators import dataprep, encoding, levels, segment_table, store, transcripts
from segmentry.operators import streams as op
from segmentry.plans.registry import query, table
from segmentry.plans.views import FRAMES, REGIONS_DUCK, REGIONS_SPARK, SEGMENTS, duck, frames, regions, segments, view
from segmentry.sources import files

SEG, FRM, REG = duck(SEGMENTS), duck(FRAMES), duck(REGIONS_DUCK)
N = "n as (select video_id, cast(count(*) as int) as num_frames from frames group by video_id)"
WS = f"""with {FRM}, {N},
ws as (select video_id, num_frames, cast(unnest(case when num_frames <= 20 then [0] else list_sort(list_distinct(list_concat(range(0, num_frames - 20 + 1, 4), [num_frames - 20]))) end) as int) as window_start from n),
w as (select *, cast(row_number() over (partition by video_id order by window_start) - 1 as int) as window_idx from ws),
p as (select w.video_id, window_idx, window_start, num_frames, avg(value) as value from w join frames f on f.video_id = w.video_id and frame_idx >= window_start and frame_idx < window_start + 20 group by all)"""


def counted(spark, d):
    return frames(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("num_frames"))


@query("sliding_window_starts", WS + " select video_id, window_idx, window_start from w")
def sliding_window_starts(spark, d):
    return op.window_starts(counted(spark, d), 20, 4).select("video_id", "window_idx", "window_start")


POOL64 = f"""with {FRM}, {N}, ws as (select video_id, num_frames, cast(unnest(case when num_frames <= 64 then [0] else list_distinct(list_concat(range(0, num_frames - 64 + 1, 8), [num_frames - 64])) end) as int) as window_start from n),
l as (select video_id, arg_max(value, frame_idx) as last from frames group by video_id)
select w.video_id, window_start, round(sum(value) + greatest(64 - max(num_frames), 0) * max(last), 3) as total from ws w join frames f on f.video_id = w.video_id and frame_idx >= window_start and frame_idx < window_start + 64 join l on l.video_id = w.video_id group by w.video_id, window_start"""


@query("window_pool", POOL64)
def window_pool(spark, d):
    return op.pool_windows(frames(spark, d), 64, 8).select("video_id", "window_start", F.round(F.col("value") * 64, 3).alias("total"))


@query("denoise_moving_avg", WS + " select video_id, window_idx, round(avg(value) over (partition by video_id order by window_idx rows between 1 preceding and 1 following), 5) as value from p")
def denoise_moving_avg(spark, d):
    smooth = op.smooth(op.pool_windows(frames(spark, d), 20, 4), 3)
    return smooth.select("video_id", "window_idx", F.round("value", 5).alias("value"))


LAB = f"""with {FRM}, {N}, x as (select f.video_id, frame_idx as window_idx, frame_idx as window_start, event_type as label, num_frames from frames f join n on n.video_id = f.video_id),
c as (select *, case when label = lag(label) over (partition by video_id order by window_idx) then 0 else 1 end as new from x), r as (select *, sum(new) over (partition by video_id order by window_idx) as run from c),
g as (select video_id, run, min(num_frames) as num_frames, min(window_start) as start_frame, min(window_idx) as first_window, max(window_idx) as last_window, min(label) as label from r group by video_id, run)"""


def labelled(spark, d):
    f = frames(spark, d)
    return f.join(counted(spark, d), "video_id").select("video_id", F.col("frame_idx").alias("window_idx"), F.col("frame_idx").alias("window_start"), F.col("event_type").alias("label"), "num_frames")


@query("label_runs", LAB + " select video_id, cast(run as bigint) as run, start_frame, coalesce(lead(start_frame) over (partition by video_id order by run), num_frames) as end_frame, first_window, last_window, label from g")
def label_runs(spark, d):
    return op.runs_from_labels(labelled(spark, d)).select("video_id", "run", "start_frame", "end_frame", "first_window", "last_window", "label")


@query("label_reappear_check", LAB + " select video_id, label, count(*) as runs from g group by video_id, label having count(*) > 1")
def label_reappear_check(spark, d):
    return op.reappearing(op.runs_from_labels(labelled(spark, d)))


@query("tiling_audit", LAB + ", e as (select *, coalesce(lead(start_frame) over (partition by video_id order by run), num_frames) as end_frame from g) select video_id, count(*) as segments, cast(sum(end_frame - start_frame) as bigint) as frames, min(start_frame) as first, max(end_frame) as last, true as tiles from e group by video_id")
def tiling_audit(spark, d):
    runs = op.runs_from_labels(labelled(spark, d)).join(counted(spark, d), "video_id")
    return op.tiling(runs)


MERGED = f"""with {REG}, o as (select *, max(end_s) over (partition by video_id order by start_s, end_s rows between unbounded preceding and 1 preceding) as reach from regions),
g as (select *, sum(case when start_s - reach <= 30 then 0 else 1 end) over (partition by video_id order by start_s, end_s rows unbounded preceding) as run from o),
m as (select video_id, cast(run as bigint) as run, min(start_s) as start_s, max(end_s) as end_s from g group by video_id, run)"""


@query("interval_merge", MERGED + " select * from m")
def interval_merge(spark, d):
    return op.merge_intervals(regions(spark, d), 0, 30)


@query("interval_split", MERGED + """, k as (select *, greatest(ceil((end_s - start_s) / 600), 1)::int as n from m), x as (select *, unnest(range(n))::int as piece from k)
select video_id, run, piece, round(start_s + (end_s - start_s) / n * piece, 3) as start_s, round(case when piece = n - 1 then end_s else start_s + (end_s - start_s) / n * (piece + 1) end, 3) as end_s from x""")
def interval_split(spark, d):
    pieces = op.split_intervals(op.merge_intervals(regions(spark, d), 0, 30), 600)
    return pieces.select("video_id", "run", "piece", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query("segment_mean_vector", "select label, cast(pos as int) as pos, round(avg(v), 6) as v from (select label, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) t group by label, pos")
def segment_mean_vector(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vec = table(spark, d, "embeddings").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    mean = vec.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    return mean.select("label", F.posexplode("m").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("masked_mean_pool", f"with {SEG} select label, cast(pos as int) as pos, round(sum(v * k) / greatest(sum(k), 0.000001), 6) as v from (select label, (i % 3 > 0)::int as k, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) - 1 as pos from segments) t group by label, pos")
def masked_mean_pool(spark, d):
    s = segments(spark, d).select("label", (F.col("i") % 3 > 0).cast("int").alias("mask"), F.col("embedding").alias("vec"))
    return op.masked_mean(s, ["label"]).select("label", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


def windows(spark, d):
    smooth = op.smooth(op.pool_windows(frames(spark, d), 20, 4), 3)
    return smooth.withColumn("vec", F.array("value"))


@query("ward_segments")
def ward_segments(spark, d):
    return op.ward_segments(windows(spark, d).drop("value"), 15.0)


def _videos(spark, d):
    """Segment vectors as frames of one video a label; labels 3 and 7 are spoilt."""
    s = segments(spark, d).select("label", F.col("video_id"), F.col("i").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("vec"))
    vec = F.when((F.col("label") == 3) & (F.col("frame_idx") == 2), F.array(F.lit(1.0))).when((F.col("label") == 7) & (F.col("frame_idx") == 1), F.lit(None)).otherwise(F.col("vec"))
    return s.withColumn("vec", vec).drop("label")


@query("segment_pipeline", f"""with {SEG}, v as (select video_id, label, count(*) as n from segments group by video_id, label)
select video_id, n as num_frames, case label when 3 then 'vectors of unequal size' when 7 then 'missing or infinite values' end as error, case when label not in (3, 7) then n end as covered, case when label not in (3, 7) then 0 end as holes from v""")
def segment_pipeline(spark, d):
    """Every good video is tiled: its segments cover all frames and each starts where the one before ends."""
    cut, status = op.segment_videos(_videos(spark, d), 8, 4, 3, 1.0)
    before = F.coalesce(F.lag("end_frame").over(op.Window.partitionBy("video_id").orderBy("start_frame")), F.lit(0))
    tiles = cut.withColumn("hole", (before != F.col("start_frame")).cast("int")).groupBy("video_id").agg(F.sum(F.col("end_frame") - F.col("start_frame")).alias("covered"), F.sum("hole").alias("holes"))
    return status.join(tiles, "video_id", "left")


@query("build_levels", f"""with {SEG}, v as (select video_id, label, count(*) as n from segments group by video_id, label), l(level) as (values ('coarse'), ('fine'))
select video_id, level, n as num_frames, case label when 3 then 'vectors of unequal size' when 7 then 'missing or infinite values' end as error, label not in (3, 7) as has_segments, case when label not in (3, 7) then n end as covered, label not in (3, 7) as found from v, l""")
def build_levels(spark, d):
    """From frames to search on two levels in one call: each video's status, the frames that its stored segments cover, and whether
    its first segment's own vector finds it in the level's index."""
    built, status = levels.build(_videos(spark, d), files.shared_folder(spark, "levels"), {"coarse": (8, 4), "fine": (4, 2)}, threshold=1.0, measure=False)
    rows = built.segments(spark)
    covered = rows.groupBy("video_id", "level").agg(F.sum(F.col("end_frame") - F.col("start_frame")).alias("covered"))
    found = None
    for level in built.levels:
        first = rows.where((F.col("level") == level) & (F.col("start_frame") == 0)).select(F.col("video_id").alias("query_id"), F.col("embedding").alias("vec"))
        hits = levels.search(built, first, level, 1, levels.index.MOST_CELLS).where("query_id = video_id").select("video_id", F.lit(level).alias("level"), F.lit(True).alias("found"))
        found = hits if found is None else found.unionByName(hits)
    told = status.withColumn("has_segments", F.col("segments") > 0).drop("segments")
    return told.join(covered, ["video_id", "level"], "left").join(found, ["video_id", "level"], "left").fillna({"found": False})


@query("window_pool_vectors", f"""with {SEG}, n as (select video_id, count(*)::int as n from segments group by video_id),
w as (select video_id, n, unnest(case when n <= 8 then [0] else list_distinct(list_concat(range(0, n - 8 + 1, 4), [n - 8])) end)::int as window_start from n),
m as (select w.video_id, window_start, n, i, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as pos from w join segments s on s.video_id = w.video_id and i >= window_start and i < window_start + 8),
k as (select *, case when i = n - 1 and n < 8 then 9 - n else 1 end as weight from m)
select video_id, window_start, pos::int as pos, round(sum(x * weight) / 8, 5) as v from k group by video_id, window_start, pos""")
def window_pool_vectors(spark, d):
    rows = segments(spark, d).select("video_id", F.col("i").alias("frame_idx"), F.col("embedding").alias("vec"))
    return op.pool_vectors(rows, 8, 4).select("video_id", "window_start", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 5))


DOC = f"""{SEGMENTS}, told as (select s.*, d.text as asr_text from segments s left join {{documents}} d on d.doc_id = s.segment_id and s.segment_id % 4 > 0),
spoken as (select concat('L', lpad(cast(doc_id % 10 as string), 2, '0'), '_V001') as video_id, cast(doc_id * 3 % 900 as int) as sf, cast(doc_id * 3 % 900 + 25 as int) as ef, doc_id, text from {{documents}})"""
TOLD = "with " + duck(DOC)


def told(spark, d):
    return view(spark, d, DOC, "told")


def spoken(spark, d):
    return view(spark, d, DOC, "spoken")


@query("segment_midpoint", TOLD + " select segment_id, least(((start_frame + end_frame) // 2)::int, end_frame - 1) as midpoint_frame from segments")
def segment_midpoint(spark, d):
    return segments(spark, d).select("segment_id", store.midpoint(F.col("start_frame"), F.col("end_frame")).alias("midpoint_frame"))


@query("segment_lookup", TOLD + " select segment_id, video_id, start_frame from segments where segment_id % 20 = 0 and segment_id in (select doc_id from documents)")
def segment_lookup(spark, d):
    ids = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("segment_id"))
    return store.lookup(segments(spark, d), ids).select("segment_id", "video_id", "start_frame")


@query("segments_by_video", TOLD + " select segment_id, start_frame from segments where video_id = 'L03_V001'")
def segments_by_video(spark, d):
    return store.by_video(segments(spark, d), "L03_V001").select("segment_id", "start_frame")


@query("segments_missing_text", TOLD + " select segment_id, video_id, start_frame from segments where segment_id % 4 = 0 or segment_id not in (select doc_id from documents where text is not null)")
def segments_missing_text(spark, d):
    return store.missing_text(told(spark, d)).select("segment_id", "video_id", "start_frame")


@query("segment_count", "select 'coarse' as level, count(*) as n from embeddings")
def segment_count(spark, d):
    return store.counts(segments(spark, d), "level")


def _updates(spark, d, shift=0):
    rows = table(spark, d, "documents").where("doc_id % 6 = 0")
    return rows.select((F.col("doc_id") + shift).alias("segment_id"), F.upper("source").alias("text"))


@query("text_update", TOLD + " select segment_id, case when segment_id % 6 = 0 and segment_id in (select doc_id from documents) then (select upper(source) from documents where doc_id = segment_id) else asr_text end as asr_text from told")
def text_update(spark, d):
    return store.update_text(told(spark, d), _updates(spark, d))[0].select("segment_id", "asr_text")


@query("text_update_unknown", "select doc_id + 60 as segment_id from documents where doc_id % 6 = 0 and doc_id + 60 not in (select vec_id from embeddings)")
def text_update_unknown(spark, d):
    return store.update_text(told(spark, d), _updates(spark, d, 60))[1]


@query("range_join_overlap", TOLD + " select s.segment_id, count(*) as n, min(p.sf) as first, max(p.ef) as last, md5(string_agg(p.text, ' ' order by p.sf, p.doc_id)) as text from segments s join spoken p on p.video_id = s.video_id and p.sf < s.end_frame and p.ef > s.start_frame group by s.segment_id")
def range_join_overlap(spark, d):
    return store.spoken_text(segments(spark, d), spoken(spark, d), "doc_id").withColumn("text", F.md5("text"))


@query("frame_time_convert", TOLD + " select segment_id, round(midpoint_frame / fps, 2) as seconds, round_even(round(midpoint_frame / fps, 2) * fps, 0)::int as frame from segments")
def frame_time_convert(spark, d):
    s = segments(spark, d).withColumn("seconds", store.seconds(F.col("midpoint_frame"), F.col("fps")))
    return s.select("segment_id", "seconds", store.frame_at(F.col("seconds"), F.col("fps")).alias("frame"))


@query("group_counts", "select label::bigint as label, count(*) as n from embeddings group by label")
def group_counts(spark, d):
    return store.counts(segments(spark, d).withColumn("label", F.col("label").cast("long")), "label")


@query("media_path", TOLD + " select segment_id, 'media/' || substr(video_id, 1, 3) || '/video/' || video_id || '.mp4' as path from segments")
def media_path(spark, d):
    return segments(spark, d).select("segment_id", t.media_path(F.col("video_id")).alias("path"))


@query("asof_text", TOLD + """, c as (select segment_id, sf, doc_id, row_number() over (partition by segment_id order by sf desc nulls last, doc_id desc) as r from segments s left join spoken p on p.video_id = s.video_id and p.sf <= s.midpoint_frame)
select segment_id, sf as text_start, doc_id, md5(text) as text from c left join documents using (doc_id) where r = 1""")
def asof_text(spark, d):
    return store.last_spoken(segments(spark, d), spoken(spark, d), "doc_id").withColumn("text", F.md5("text"))


@query("segment_assign_ids", f"with {SEG} select (select max(vec_id) from embeddings) + row_number() over (order by video_id, start_frame) as segment_id, video_id, start_frame from segments")
def segment_assign_ids(spark, d):
    """All segments once more: their ids follow the highest one given so far."""
    rows = segments(spark, d)
    return store.insert(rows, rows.select("video_id", "start_frame"), "video_id", "start_frame")


@query("sql_window_starts", WS + " select video_id, window_idx, window_start from w")
def sql_window_starts(spark, d):
    """By the table function, from SQL alone."""
    sql.register(spark)
    return spark.sql("select v.video_id, w.window_idx, w.window_start from {v} v, lateral window_starts(v.num_frames, 20, 4) w", v=counted(spark, d))


@query("encode_windows", f"""with {SEG}, n as (select video_id, count(*)::int as n from segments group by video_id),
w as (select video_id, n, unnest(case when n <= 8 then [0] else list_distinct(list_concat(range(0, n - 8 + 1, 4), [n - 8])) end)::int as window_start from n)
select w.video_id, window_start, round(sum(2 * embedding[1]::double) / 8 + 1, 5) as x, round(sum(embedding[2]::double) / 8 - 1, 5) as y from w join segments s on s.video_id = w.video_id and i >= window_start and i < window_start + 8 where n >= 8 group by w.video_id, window_start""")
def encode_windows(spark, d):
    """Windows of segment vectors through a plugged model (here their states as they are), pooled and projected to two numbers."""
    weights = np.zeros((64, 2))
    weights[0, 0], weights[1, 1] = 2, 1
    rows = segments(spark, d).select("video_id", F.col("i").alias("frame_idx"), F.col("embedding").alias("value"))
    found = encoding.encoded_windows(rows, _as_they_are, 8, 4, pooling="mean", weights=weights, bias=[1, -1]).where("num_frames >= 8")
    return found.select("video_id", "window_start", *[F.round(F.col("vec")[k], 5).alias(c) for k, c in enumerate("xy")])


def _as_they_are():
    """A model whose states are the given vectors."""
    return lambda windows: (np.stack([np.stack(w) for w in windows]).astype(float), np.ones((len(windows), len(windows[0]))))


@query("stored_segments", TOLD + """, k as (select *, row_number() over (order by video_id, start_frame) as a from segments where segment_id % 3 <> 0), m as (select max(a) as top from k),
l as (select *, (select top from m) + row_number() over (order by video_id, start_frame) as a from segments where segment_id % 3 = 0)
select a as segment_id, video_id, start_frame, case when a % 5 = 0 then 'said ' || a end as asr_text, case when a % 7 = 0 then 'sign ' || a end as ocr_text from (select a, video_id, start_frame from k union all select a, video_id, start_frame from l) t where a % 11 <> 0""")
def stored_segments(spark, d):
    """Two batches into a stored table, the first one again, texts of both kinds, deletes; read by its path."""
    rows = segments(spark, d).select("video_id", "start_frame", "segment_id")
    made = segment_table.create(spark, files.shared_folder(spark, "segments"), "video_id string, start_frame int")
    for batch, own in ((0, rows.where("segment_id % 3 <> 0")), (0, rows.where("segment_id % 3 <> 0")), (1, rows.where("segment_id % 3 = 0"))):
        made.append(own.drop("segment_id"), batch, "video_id", "start_frame")
    ids = made.rows().select("segment_id")
    made.set_text(ids.where("segment_id % 5 = 0").withColumn("text", F.concat(F.lit("said "), "segment_id")), "asr_text", 0)
    made.set_text(ids.where("segment_id % 7 = 0").withColumn("text", F.concat(F.lit("sign "), "segment_id")), "ocr_text", 1)
    made.delete(ids.where("segment_id % 11 = 0"), 0)
    return segment_table.SegmentTable(spark, made.path).rows().select("segment_id", "video_id", "start_frame", "asr_text", "ocr_text")


@query("batch_assign", f"with {SEG}, b as (select segment_id, cast(floor((row_number() over (order by segment_id) - 1) / 32) as int) as batch from segments) select segment_id, batch, epoch from b join (select 0 as epoch union all select 1) e on true")
def batch_assign(spark, d):
    """Two epochs of the same batches of 32."""
    placed = dataprep.numbered(segments(spark, d).select("segment_id"), "segment_id")
    return placed.select("segment_id", F.floor(F.col("number") / 32).cast("int").alias("batch"), F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))


@query("segment_validate", f"""with {SEG}, x as (select segment_id, start_frame, case when segment_id % 11 = 0 then start_frame else end_frame end as end_frame, case when segment_id % 13 = 0 then -1 else midpoint_frame end as midpoint_frame, case when segment_id % 17 = 0 then 'odd' else level end as level from segments)
select segment_id, coalesce(start_frame < end_frame and midpoint_frame between start_frame and end_frame - 1 and level in ('coarse', 'fine'), false) as valid from x""")
def segment_validate(spark, d):
    s = segments(spark, d)
    broken = s.withColumn("end_frame", F.when(F.col("segment_id") % 11 == 0, F.col("start_frame")).otherwise(F.col("end_frame")))
    broken = broken.withColumn("midpoint_frame", F.when(F.col("segment_id") % 13 == 0, -1).otherwise(F.col("midpoint_frame"))).withColumn("level", F.when(F.col("segment_id") % 17 == 0, "odd").otherwise(F.col("level")))
    good, bad = files.validate_segments(broken, 64)
    return good.select("segment_id", F.lit(True).alias("valid")).unionByName(bad.select("segment_id", F.lit(False).alias("valid")))


@query("scan_segments_jsonl", f"with {SEG} select video_id, start_frame, end_frame, midpoint_frame, level, len(embedding)::int as dim from segments")
def scan_segments_jsonl(spark, d):
    path = files.shared_folder(spark, "segments")
    files.write_segments(segments(spark, d), path)
    good, _ = files.read_segments(spark, path, 64)
    return good.select("video_id", "start_frame", "end_frame", "midpoint_frame", "level", F.size("embedding").alias("dim"))


CUES = f"with {REG}, c as (select *, row_number() over (partition by video_id order by start_s, event_id) as cue, start_s % 86400 as a, end_s - start_s + start_s % 86400 as b from regions)"


@query("srt_cues", CUES + " select video_id, cue, format('{:02d}:{:02d}:{:02d},000 --> {:02d}:{:02d}:{:02d},000', (a // 3600)::bigint, (a // 60)::bigint % 60, a::bigint % 60, (b // 3600)::bigint, (b // 60)::bigint % 60, b::bigint % 60) as line from c")
def srt_cues(spark, d):
    w = op.Window.partitionBy("video_id").orderBy("start_s", "event_id")
    r = regions(spark, d).withColumn("cue", F.row_number().over(w).cast("long"))
    a = F.col("start_s") % 86400
    return r.select("video_id", "cue", F.concat(t.timecode(a), F.lit(" --> "), t.timecode(F.col("end_s") - F.col("start_s") + a)).alias("line"))


@query("transcript_nested", f"with {REG} select video_id, count(*) as n, min(start_s * 25) as first_frame, max(end_s * 25) as last_frame from regions group by video_id")
def transcript_nested(spark, d):
    r = regions(spark, d).withColumn("hour", F.floor(F.col("start_s") / 3600))
    nested = r.groupBy("video_id", "hour").agg(F.array_sort(F.collect_list(F.struct((F.col("start_s") * 25).alias("start_frame"), (F.col("end_s") * 25).alias("end_frame")))).alias("segments"))
    flat = nested.select("video_id", F.explode("segments").alias("s"))
    return flat.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("s.start_frame").alias("first_frame"), F.max("s.end_frame").alias("last_frame"))


@query("transcript_postprocess", MERGED + " select video_id, run, cast(round((start_s - (select min(start_s) from m)) * 25) as bigint) as start_frame, cast(end_s - start_s as bigint) as seconds from m")
def transcript_postprocess(spark, d):
    m = op.merge_intervals(regions(spark, d), 0, 30)
    origin = m.agg(F.min("start_s")).first()[0] or 0
    return m.select("video_id", "run", F.bround((F.col("start_s") - origin) * 25).cast("long").alias("start_frame"), (F.col("end_s") - F.col("start_s")).cast("long").alias("seconds"))


@query("transcript_files", f"""with {REG}, p as (select *, row_number() over (partition by video_id order by start_s, end_s, event_id) as k from regions where event_id % 7 <> 0)
select video_id, count(*) as cues, max(k) as last_cue, sum(round(start_s - o, 3))::double as starts, sum((start_s - o) * 25)::bigint as first_frames, sum((end_s - o) * 25)::bigint as last_frames, count(*) as in_json from p, (select min(start_s) as o from regions) group by video_id""")
def transcript_files(spark, d):
    """Texts of the regions, blank ones among them, written as SubRip and nested JSON and read back."""
    r = regions(spark, d)
    origin = r.agg(F.min("start_s")).first()[0] or 0
    said = F.when(F.col("event_id") % 7 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("  said "), F.col("event_id"), F.lit(" ")))
    kept = transcripts.kept(r.select("video_id", (F.col("start_s") - origin).cast("double").alias("start_s"), (F.col("end_s") - origin).cast("double").alias("end_s"), said.alias("text")))
    srt, nested = files.shared_folder(spark, "srt"), files.shared_folder(spark, "transcripts")
    transcripts.write_srt(kept, srt)
    transcripts.write_json(kept, r.select("video_id", F.lit(25.0).alias("video_fps")).distinct(), nested)
    lines = transcripts.read_srt(spark, srt).groupBy("video_id").agg(F.count(F.lit(1)).alias("cues"), F.max("cue").alias("last_cue"), F.sum("start_s").alias("starts"))
    objects = transcripts.read_json(spark, nested).groupBy("video_id").agg(F.sum("start_frame").alias("first_frames"), F.sum("end_frame").alias("last_frames"), F.count(F.lit(1)).alias("in_json"))
    return lines.join(objects, "video_id")


@query("frame_sampling", f"with {FRM}, {N}, x as (select *, unnest(range(8))::int as k from n) select video_id, k, cast(round_even(k * (num_frames - 1) / 7, 0) as int) as frame_idx from x")
def frame_sampling(spark, d):
    return op.sample_frames(counted(spark, d), 8).select("video_id", "k", "frame_idx")


@query("frame_sampling_readable", f"""with {FRM}, {N}, x as (select *, unnest(range(8))::int as k from n), y as (select video_id, k, cast(round_even(k * (num_frames - 1) / 7, 0) as int) as frame_idx from x),
z as (select y.*, case when value >= 20 then frame_idx end as own from y join frames f using (video_id, frame_idx))
select video_id, k, frame_idx, last_value(own ignore nulls) over (partition by video_id order by k) as use_idx from z""")
def frame_sampling_readable(spark, d):
    """A frame that cannot be read (here of a value under 20) is that of the sample before it."""
    sampled = op.sample_frames(counted(spark, d), 8).join(frames(spark, d).select("video_id", "frame_idx", "value"), ["video_id", "frame_idx"])
    return op.readable_before(sampled, F.col("value") >= 20).select("video_id", "k", "frame_idx", "use_idx")


@query("next_valid_sample", f"""with {FRM}, {N}, x as (select f.*, num_frames from frames f join n using (video_id)), ok as (select video_id, frame_idx from frames where value >= 20),
c as (select x.video_id, x.frame_idx, ok.frame_idx as other, (ok.frame_idx - x.frame_idx + num_frames) % num_frames as step from x join ok on ok.video_id = x.video_id)
select x.video_id, x.frame_idx, t.use_idx from x left join (select video_id, frame_idx, arg_min(other, step) as use_idx from c where step < 32 group by video_id, frame_idx) t on t.video_id = x.video_id and t.frame_idx = x.frame_idx""")
def next_valid_sample(spark, d):
    return op.next_valid(frames(spark, d), F.col("value") >= 20).select("video_id", "frame_idx", "use_idx")
