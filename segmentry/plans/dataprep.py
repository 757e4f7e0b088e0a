"""Training-data preparation, sources, sinks and query packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions import text as t
from segmentry.operators import dataprep as op
from segmentry.operators import manifest, split
from segmentry.plans.registry import query, table
from segmentry.plans.views import SAMPLES, duck, samples
from segmentry.sources import files, readers

SMP = duck(SAMPLES)
ROWS = f"""{SAMPLES},
raw as (select *, 0 as ord from samples union all select path, caption, media_type, source, doc_id + 5000000, num_frames, 1 from samples where doc_id % 9 = 0),
known as (select path, caption, media_type, source, doc_id, num_frames, row_number() over (partition by path order by ord, doc_id) as place from raw where coalesce(trim(caption), '') <> ''),
told as (select *, case when place > 1 then 'duplicate' when doc_id % 8 = 0 then 'missing' when num_frames < 200 then 'corrupt' else 'ok' end as outcome from known)"""
TOLD = "with " + duck(ROWS)


@query("source_union", TOLD + " select path, media_type, 0 as src from samples where media_type = 'image' union all select path, media_type, 1 from samples where media_type = 'video' and source < 'src5' union all select path, media_type, 2 from samples where media_type = 'video' and source >= 'src5'")
def source_union(spark, d):
    s = samples(spark, d).select("path", "media_type", "source")
    video = s.where("media_type = 'video'")
    return manifest.in_order(s.where("media_type = 'image'"), video.where("source < 'src5'"), video.where("source >= 'src5'")).drop("source")


@query("missing_file_anti", TOLD + " select source, count(case when l.doc_id is null then 1 end) as missing, count(l.doc_id) as present from samples s left join (select distinct doc_id from labels) l on l.doc_id = s.doc_id group by source")
def missing_file_anti(spark, d):
    return manifest.presence(samples(spark, d), table(spark, d, "labels"), "doc_id", "source")


@query("missing_url_lookup", TOLD + " select s.path, p.url from samples s left join (select distinct doc_id from labels) l on l.doc_id = s.doc_id left join pages p on p.page_id = s.doc_id where l.doc_id is null")
def missing_url_lookup(spark, d):
    pages = table(spark, d, "pages").withColumnRenamed("page_id", "doc_id")
    return manifest.missing_urls(samples(spark, d), table(spark, d, "labels"), pages, "doc_id").select("path", "url")


@query("ordered_distinct", TOLD + " select source, min(doc_id) as place from samples group by source")
def ordered_distinct(spark, d):
    return manifest.ordered_distinct(samples(spark, d), "source", "doc_id").select("source", "place")


@query("sample_validate", TOLD + " select path, (left(path, 1) <> '/' and media_type in ('image', 'video') and num_frames > 150 and coalesce(caption, '') <> '') as valid from samples")
def sample_validate(spark, d):
    return samples(spark, d).select("path", manifest.sample_error(least_frames=151).isNull().alias("valid"))


@query("request_validate", TOLD + " select doc_id, case when doc_id % 7 - 1 <= 0 or coalesce(trim(caption), '') = '' then 'INVALID_REQUEST' else 'OK' end as code from samples")
def request_validate(spark, d):
    good, rejected = manifest.validate_requests(samples(spark, d).select("doc_id", (F.col("doc_id") % 7 - 1).alias("top_k"), F.col("caption").alias("query")))
    return good.select("doc_id", F.lit("OK").alias("code")).unionByName(rejected.select("doc_id", "code"))


@query("substring_search", TOLD + " select doc_id from samples where contains(lower(path), 'src1') or contains(cast(num_frames as string), '77') or contains(lower(caption), 'the')")
def substring_search(spark, d):
    s = samples(spark, d).withColumn("events", F.array("caption"))
    has = lambda text, field: manifest.contains_any(s, text, field)
    return s.where(has(" SRC1 ", "path") | has("77", "num_frames") | has("The", "events")).select("doc_id")


@query("ground_truth_validate", TOLD + " select source, count(case when num_frames < 0 then 1 end) as bad_frame, count(case when media_type not in ('image', 'video') then 1 end) as bad_type, count(case when coalesce(trim(caption), '') = '' then 1 end) as empty from samples group by source")
def ground_truth_validate(spark, d):
    """The rules for frames and texts as they are; the media type stands for the two enums, whose values no table has."""
    cases = samples(spark, d).withColumnsRenamed({"num_frames": "frame", "caption": "query_text"})
    rules = manifest.case_rules()
    kept = {name: rules[name] for name in ("bad_frame", "empty")}
    return manifest.rule_counts(cases, ["source"], bad_type=~F.col("media_type").isin("image", "video"), **kept)


@query("caption_tsv_clean", TOLD + " select trim(translate(s.caption, chr(9) || chr(10), '  ')) as caption, trim(p.url) as url from samples s join pages p on p.page_id = s.doc_id where trim(s.caption) <> ''")
def caption_tsv_clean(spark, d):
    """Written as TSV in the shared folder and read back."""
    rows = samples(spark, d).join(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), "doc_id").select("caption", "url")
    path = files.shared_folder(spark, "tsv")
    files.write_caption_tsv(rows, path)
    return files.read_caption_tsv(spark, path)


def _rows(spark, d):
    """Samples, and every ninth once more under its path."""
    s = samples(spark, d).withColumn("ord", F.lit(0))
    return s.unionByName(s.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 5_000_000).withColumn("ord", F.lit(1)))


def _told(spark, d):
    return manifest.told(_rows(spark, d), "path", ["ord", "doc_id"], F.col("doc_id") % 8 == 0, F.col("num_frames") < 200, keep=["path", "ord", "doc_id", "num_frames", "source", "media_type"])


@query("manifest_summary", TOLD + " select source, media_type, count(*) as total, count(case when outcome = 'ok' then 1 end) as ok, count(case when outcome = 'duplicate' then 1 end) as duplicate, count(case when outcome = 'missing' then 1 end) as missing, count(case when outcome = 'corrupt' then 1 end) as corrupt from told group by source, media_type")
def manifest_summary(spark, d):
    return manifest.summary(_told(spark, d), "source", "media_type")


@query("manifest_rollup", TOLD + " select source, media_type, count(*) as total, count(case when outcome = 'ok' then 1 end) as ok from told group by rollup(source, media_type)")
def manifest_rollup(spark, d):
    return manifest.rollup(_told(spark, d), "source", "media_type")


@query("manifest_build", TOLD + " select path, source, media_type, num_frames from told where outcome = 'ok'")
def manifest_build(spark, d):
    return _told(spark, d).where("outcome = 'ok'").select("path", "source", "media_type", "num_frames")


JOB = """with docs as (select doc_id, case when doc_id % 3 = 0 then 'stills' else 'clips' end as source, doc_id // 10 * 10 + doc_id % 3 as k from documents where doc_id is not null),
given as (select *, row_number() over (partition by source, k order by doc_id) as place from docs where doc_id % 11 > 0 and (source = 'clips' or doc_id % 7 > 0)),
told as (select *, case when place > 1 then 'duplicate' when k % 4 = 1 then 'missing' when k % 4 = 2 then 'corrupt' else 'ok' end as outcome from given)"""


@query("manifest_job", JOB + """ select source, outcome, count(*) as n, count(*) filter (outcome = 'ok') as in_manifest, coalesce(sum(doc_id) filter (outcome = 'ok' and source = 'clips'), 0)::bigint as durations from told group by source, outcome
union all select source, 'rejected', count(*), 0, 0 from docs where doc_id % 11 = 0 and source = 'clips' group by source""")
def manifest_job(spark, d):
    """Metadata lines of two sources and their media files, written and then joined into a manifest: broken lines, rows without a
    caption, repeated ids, files that are missing, empty or no pictures. Every ten documents share three files."""
    docs = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "stills").otherwise("clips").alias("source"), (F.floor(F.col("doc_id") / 10) * 10 + F.col("doc_id") % 3).alias("k"))
    media, listed, target = (files.shared_folder(spark, name) for name in ("media", "listed", "manifest"))
    good, broken = F.unhex(F.lit("FFD8FFE0FFD9")), F.unhex(F.lit("00"))
    content = F.when(F.col("source") == "stills", F.when(F.col("k") % 4 == 2, broken).otherwise(good)).otherwise(F.when(F.col("k") % 4 == 2, F.unhex(F.lit(""))).otherwise(broken))
    path = F.concat("source", F.lit("/"), "k", F.when(F.col("source") == "stills", ".jpg").otherwise(".mp4"))
    files.write_files(docs.where("k % 4 <> 1").select(path.alias("path"), content.alias("content")).dropDuplicates(["path"]), media)
    line = F.to_json(F.struct(F.col("k").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise("said").alias("caption"), F.lit(8).alias("num_frames"), F.col("doc_id").cast("double").alias("duration")))
    rows = docs.withColumn("value", F.when(F.col("doc_id") % 11 > 0, line).when(F.col("source") == "clips", '{"id": "1", "cap'))
    # a write by source sorts by it; an order that does not begin with source would be dropped for that
    rows.where("value is not null").repartitionByRange("doc_id").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(listed)
    sources = [manifest.Source("stills", f"{listed}/source=stills", "image", "jpg", "jpeg", captioned=True), manifest.Source("clips", f"{listed}/source=clips", "video", "mp4", strict=False)]
    outcomes, rejects = manifest.build(spark, sources, media)
    kept = manifest.merge_into(outcomes, manifest.previous(spark, target), target)
    counts = outcomes.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(rejects.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("rejected")))
    read = kept.groupBy("source").agg(F.count(F.lit(1)).alias("in_manifest"), F.coalesce(F.sum("duration"), F.lit(0)).cast("long").alias("durations")).withColumn("outcome", F.lit("ok"))
    return counts.join(read, ["source", "outcome"], "left").fillna({"in_manifest": 0, "durations": 0})


@query("source_completion", TOLD + " select source, count(*) as planned, count(case when doc_id % 50 < 49 then 1 end) as done from samples group by source having count(case when doc_id % 50 < 49 then 1 end) >= count(*)")
def source_completion(spark, d):
    s = samples(spark, d)
    return manifest.complete_groups(s, s.where("doc_id % 50 < 49"), "source", "doc_id")


@query("quality_filter_strict", TOLD + " select s.path from samples s left join labels l on l.doc_id = s.doc_id where coalesce(l.quality, 0) >= 1 and trim(s.caption) <> ''")
def quality_filter_strict(spark, d):
    return manifest.by_quality(samples(spark, d), table(spark, d, "labels"), "doc_id").select("path")


@query("quality_filter_lenient", TOLD + " select s.path from samples s left join labels l on l.doc_id = s.doc_id where l.quality is null or l.quality >= 1")
def quality_filter_lenient(spark, d):
    return manifest.by_quality(samples(spark, d), table(spark, d, "labels"), "doc_id", strict=False).select("path")


@query("resume_anti_join", TOLD + " select s.path from samples s left join (select distinct doc_id from labels) l on l.doc_id = s.doc_id where l.doc_id is null")
def resume_anti_join(spark, d):
    return manifest.remaining(samples(spark, d), table(spark, d, "labels"), "doc_id").select("path")


@query("run_cap_counters", TOLD + " select path, n_new from (select path, keep, sum(keep) over (partition by source order by doc_id) as n_new, source from (select *, case when doc_id % 8 = 0 then 0 else 1 end as keep from samples) a) b where keep = 1 and n_new <= 20")
def run_cap_counters(spark, d):
    return manifest.capped(samples(spark, d).where("doc_id % 8 <> 0"), "source", "doc_id", 20).select("path", F.col("n_new").cast("long").alias("n_new"))


@query("manifest_upsert", TOLD + " select coalesce(n.path, o.path) as path, coalesce(n.v, o.v) as v from (select path, 'old' as v from samples where doc_id % 2 = 0) o full join (select path, 'new' as v from samples where doc_id % 3 = 0) n on n.path = o.path")
def manifest_upsert(spark, d):
    s = samples(spark, d)
    version = lambda step, name: s.where(F.col("doc_id") % step == 0).select("path", F.lit(name).alias("v"))
    return manifest.upsert(version(2, "old"), version(3, "new"), "path")


@query("dedup_first_wins", TOLD + " select path, doc_id from known where place = 1")
def dedup_first_wins(spark, d):
    return op.first_wins(_rows(spark, d).where("trim(caption) <> ''"), "path", "ord", "doc_id").select("path", "doc_id")


@query("group_split", f"with {SMP}, g as (select source, row_number() over (order by md5('42:' || source), source) as place, count(*) over () as n from (select distinct source from samples) t) select s.path, case when place <= floor(n * 0.3) then 'val' else 'train' end as split from samples s join g using (source)")
def group_split(spark, d):
    return op.grouped_split(samples(spark, d), "source", 0.3).select("path", "split")


@query("group_split_leak_check", f"""with {SMP}, g as (select source, row_number() over (order by md5('42:' || source), source) as place, count(*) over () as n from (select distinct source from samples) t),
p as (select s.path, s.source, case when place <= floor(n * 0.3) then 'val' else 'train' end as split from samples s join g using (source)), k as (select source, count(distinct split) as n from p group by source)
select count(*) as groups, count(*) filter (n > 1) as leaked from k""")
def group_split_leak_check(spark, d):
    sides = op.grouped_split(samples(spark, d), "source", 0.3).groupBy("source").agg(F.countDistinct("split").alias("n"))
    return sides.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("leaked"))


SPLIT = f"""with {SMP}, u as (select *, case when media_type = 'image' then path else source end as unit from samples),
h as (select *, media_type = 'image' as image, md5('42:unit:' || unit) as h from u),
k as (select image, h, row_number() over (partition by image order by h) as place, count(*) over (partition by image) as n from (select distinct image, h from h) t),
sp as (select h.*, case when k.place <= floor(k.n * 0.3::double) then 'val' else 'train' end as split from h join k on k.image = h.image and k.h = h.h)"""


def _split(spark, d):
    return split.with_split(samples(spark, d), 0.3, group=F.col("source"))


@query("split_job", SPLIT + " select path, split, row_number() over (partition by split order by md5('42:order:' || path), path) - 1 as nth from sp")
def split_job(spark, d):
    """Videos by source, images by row; each row's place in its set's shuffled order."""
    return split.shuffled(_split(spark, d)).select("path", "split", "nth")


@query("split_files", SPLIT + ", t as (select unit from sp where split = 'train' intersect select unit from sp where split = 'val') select split, count(*) as rows, sum(num_frames)::bigint as frames, (select count(*) from t) as leaked from sp group by split")
def split_files(spark, d):
    """Written as two file sets and read back."""
    folder = files.shared_folder(spark, "split")
    rows = _split(spark, d).withColumn("unit", F.when(F.col("media_type") == "image", F.col("path")).otherwise(F.col("source")))
    split.write_split(rows.drop("caption"), folder)
    train, val = (split.read_split(spark, folder, s, "path string, unit string, num_frames int") for s in ("train", "val"))
    leaked = split.leaks(train, val, F.col("unit")).agg(F.count(F.lit(1)).alias("leaked"))
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    counted = both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("num_frames").alias("frames"))
    return counted.join(leaked)  # a table of one row


@query("split_group_key", "select doc_id, case when doc_id % 4 = 0 then source || '/' || doc_id || '.txt' else (doc_id % 30)::varchar end as k from documents")
def split_group_key(spark, d):
    docs = table(spark, d, "documents")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id") % 30, F.lit("_"), "doc_id", F.lit(".txt")))
    return docs.select("doc_id", t.group_key(path).alias("k"))


@query("clip_id_sanitize", "select doc_id, 'v' || doc_id || '_0-00-' || lpad((doc_id % 60)::varchar, 2, '0') || '-500_0-01-00-000' as clip_id from documents")
def clip_id_sanitize(spark, d):
    start = F.format_string("0:00:%02d.500", F.col("doc_id") % 60)
    return table(spark, d, "documents").select("doc_id", t.clip_id(F.concat(F.lit("v"), "doc_id"), start, F.lit("0:01:00.000")).alias("clip_id"))


@query("fps_parse", "select doc_id, case when doc_id % 5 = 4 then null when doc_id % 5 = 1 then round(30000.0 / (1000 + doc_id % 2), 6) when doc_id % 5 = 2 then (doc_id % 50) + 0.5 else (doc_id % 60)::double end::double as fps from documents")
def fps_parse(spark, d):
    k = F.col("doc_id") % 5
    line = (
        F.when(k == 4, F.lit("Audio: aac, 44100 Hz")).when(k == 1, F.concat(F.lit("Video: h264, 30000/"), 1000 + F.col("doc_id") % 2, F.lit(" fps, 25 tbr")))
        .when(k == 2, F.concat(F.lit("stream "), F.col("doc_id") % 50, F.lit(".5 fps"))).otherwise(F.concat(F.lit("Video: vp9, 640x480, "), F.col("doc_id") % 60, F.lit(" fps")))
    )
    return table(spark, d, "documents").select("doc_id", F.round(t.parse_fps(line), 6).alias("fps"))


@query("clip_task_explode", "select 'v' || doc_id || '_' || lpad(i::varchar, 3, '0') as clip_id, '0:00:0' || i as start, 'c' || i as caption from (select doc_id, unnest(range(least(1 + doc_id % 3, 1 + doc_id % 2)))::int as i from documents where doc_id % 7 > 0) t")
def clip_task_explode(spark, d):
    docs = table(spark, d, "documents")
    listed = lambda n, f: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), n), f), ", "), F.lit("]"))
    rows = docs.select(
        F.concat(F.lit("v"), "doc_id").alias("video_id"), F.lit("u").alias("url"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("[broken")).otherwise(listed((F.col("doc_id") % 3).cast("int"), lambda i: F.format_string("['0:00:0%d', '0:00:09']", i))).alias("timestamps"),
        listed((F.col("doc_id") % 2).cast("int"), lambda i: F.format_string("' c%d '", i)).alias("captions"),
    )
    return op.expand_clip_tasks(rows)[0].select("clip_id", "start", "caption")


def _written(spark, df, name):
    path = files.shared_folder(spark, name)
    df.write.text(path)
    return path


def _lines(spark, d):
    ok = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source")))
    return table(spark, d, "documents").select(F.when(F.col("doc_id") % 6 == 0, '{"id": 1, "sour').when(F.col("doc_id") % 6 == 1, '{"source": "x"}').otherwise(ok).alias("value"))


@query("scan_jsonl_tolerant", "select case when doc_id % 6 > 1 then doc_id end as id, case when doc_id % 6 = 1 then 'x' else source end as source, 'row' as kind from documents where doc_id % 6 > 0 union all select null, null, 'reject' from documents where doc_id % 6 = 0")
def scan_jsonl_tolerant(spark, d):
    rows, rejects = files.read_jsonl_tolerant(spark, _written(spark, _lines(spark, d), "jsonl"), "id bigint, source string")
    none = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("source"), F.lit("reject").alias("kind")]
    return rows.withColumn("kind", F.lit("row")).unionByName(rejects.select(*none))


@query("jsonl_repair", "select doc_id as id, source from documents where doc_id % 6 > 1")
def jsonl_repair(spark, d):
    target = files.shared_folder(spark, "repaired")
    files.repair_jsonl(spark, _written(spark, _lines(spark, d), "jsonl"), target)
    return spark.read.schema("id bigint, source string").option("mode", "FAILFAST").json(target)


@query("parquet_caption_fallback", "select doc_id, case when doc_id % 3 = 0 then 'org' else 'new' end as caption, 'k' || doc_id as row_key from documents")
def parquet_caption_fallback(spark, d):
    path = files.shared_folder(spark, "captions")
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise("new").alias("re_caption"), F.lit("org").alias("org_caption"), F.concat(F.lit("k"), "doc_id").alias("key"), F.lit("u").alias("url"))
    rows.write.parquet(path)
    return files.read_caption_parquet(spark, path).select("doc_id", "caption", "row_key")


@query("scan_list_file", "select case when page_id % 4 = 2 then '# ' || url else url end as path from pages where page_id % 4 > 0")
def scan_list_file(spark, d):
    k = F.col("page_id") % 4
    lines = table(spark, d, "pages").select(F.when(k == 0, F.concat(F.lit("# "), "url")).when(k == 2, F.concat(F.lit("  # "), "url")).otherwise(F.concat(F.lit(" "), "url", F.lit("  "))).alias("value"))
    return files.read_list_file(spark, _written(spark, lines, "list"))


@query("discover_files")
def discover_files(spark, d):
    path = files.shared_folder(spark, "media")
    table(spark, d, "documents").select("source", F.lit("x").alias("value")).write.partitionBy("source").text(path)
    return files.discover_files(spark, path, exts=("txt",)).select(F.regexp_extract("path", r"(source=[^/]*)/", 1).alias("place"), "length")


@query("file_signatures", "select 'fast' as mode, true as valid, true as few_bytes union all select 'none', true, true union all select 'strict', true, false union all select 'fast of another kind', false, true")
def file_signatures(spark, d):
    """Files of the documents' numbers, checked from their first and last bytes, by their being there, and in whole."""
    path = files.shared_folder(spark, "parts")
    table(spark, d, "documents").select("doc_id").repartition(4).write.parquet(path)
    listed = files.discover_files(spark, path, ("parquet",)).select("path")
    checks = [("fast", "parquet", "fast"), ("none", "parquet", "none"), ("strict", "parquet", "strict"), ("fast of another kind", "jpeg", "fast")]
    told = [readers.check_files(listed, kind, mode).agg(F.lit(name).alias("mode"), F.min("valid").alias("valid"), (F.max("bytes_read") <= 8).alias("few_bytes")) for name, kind, mode in checks]
    return reduce(DataFrame.unionByName, told)


@query("binary_magic_check")
def binary_magic_check(spark, d):
    path = files.shared_folder(spark, "parts")
    table(spark, d, "documents").select("doc_id").repartition(4).write.parquet(path)
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.check_signature(parts, "50415231", "50415231").select("length", "valid")


def _pack(spark, d):
    k = F.col("item_id") % 5
    name = F.concat(F.lit("query-p1-"), F.col("item_id"), F.when(k == 0, "-kis").when(k == 1, "-qa").when(k == 2, "-trake").when(k == 3, "-odd").otherwise("-qa"), F.lit(".txt"))
    text = F.when(k == 1, F.concat(F.lit("Scene Hỏi "), "text", F.lit(" Hỏi what?"))).when(k == 2, F.concat(F.lit("E1: a\nnote\ne2:  b \nE3:"), F.lit(" "))).when(k == 4, F.lit("no question")).otherwise(F.concat(F.lit(" "), "text"))
    return table(spark, d, "benchmark").select(name.alias("file_name"), text.alias("content"), "item_id")


PACK = """select 'p1-' || item_id as query_id, case item_id % 5 when 0 then 'kis' when 2 then 'trake' when 3 then 'odd' else 'qa' end as task, case item_id % 5 when 3 then 'unknown task' when 4 then 'no question' end as error,
case item_id % 5 when 2 then 2 end as n_events, case item_id % 5 when 1 then 'what?' when 4 then '' end as question, case when item_id % 5 = 0 then 5 else 3 end as top_k from benchmark"""


@query("query_pack_parse", PACK)
def query_pack_parse(spark, d):
    return op.parse_query_pack(_pack(spark, d)).select("query_id", "task", "error", F.when(F.col("task") == "trake", F.size("events")).alias("n_events"), "question", "top_k")


@query("query_pack_dedup", "select 'p1-' || item_id as query_id, (item_id % 2)::int as batch from (select item_id, row_number() over (partition by item_id % 20 order by item_id % 2, item_id) as r from benchmark) t where r = 1")
def query_pack_dedup(spark, d):
    files_ = _pack(spark, d).withColumn("key", F.col("item_id") % 20).withColumn("batch", (F.col("item_id") % 2).cast("int"))
    kept = op.first_wins(files_, "key", "batch", "item_id")
    return kept.select(F.concat(F.lit("p1-"), "item_id").alias("query_id"), "batch")


@query("query_pack_group", f"select task, count(*) as n, string_agg(query_id, ',' order by query_id) as ids from ({PACK}) t where error is null group by task")
def query_pack_group(spark, d):
    good = op.parse_query_pack(_pack(spark, d)).where("error is null")
    return good.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("ids"))


@query("ground_truth_explode", "select item_id as query_id, i as event_index, item_id * 10 + i as frame from (select item_id, unnest(range(3)) as i from benchmark) t")
def ground_truth_explode(spark, d):
    path = files.shared_folder(spark, "truth")
    events = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(i.cast("long").alias("event_index"), (F.col("item_id") * 10 + i).alias("frame")))
    table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.struct(events.alias("events")).alias("expected")).write.json(path)
    read = spark.read.schema("query_id long, expected struct<events: array<struct<event_index: long, frame: long>>>").json(path)
    return read.select("query_id", F.explode("expected.events").alias("e")).select("query_id", "e.event_index", "e.frame")
