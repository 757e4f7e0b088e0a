"""Streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from segmentry.functions.vectors import rounded
from segmentry.operators import index, search
from segmentry.plans.registry import query, table
from segmentry.plans.retrieval import IP, asked, corpus
from segmentry.plans.streams import MERGED
from segmentry.plans.views import regions
from segmentry.sources.files import shared_folder
from segmentry.streaming import jobs


def timed(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@query("stream_ingest", IP + " select query_id, id, round(score, 4) as score, rank from ranked where rank <= 5")
def stream_ingest(spark, d):
    """Vectors that arrive are added to an index built from others; it then answers as exact search over all."""
    rows = corpus(spark, d)
    built = index.build(rows.where("id % 5 <> 0"), shared_folder(spark, "index"), measure=False)
    arriving = jobs.source(rows.where("id % 5 = 0"), "arrivals")
    jobs.run_batches(arriving, lambda batch, n: index.add(built, batch, n + 1), "ingest")
    found = index.search(built, asked(spark, d), 5, len(built.centroids), normalize=False)
    return found.select("query_id", "id", rounded("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("stream_dedup", "select source, 1::bigint as kept from documents group by source")
def stream_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    new = jobs.first_arrivals(jobs.source(rows, "documents"), ["source"])
    kept = jobs.append_once(new, shared_folder(spark, "seen"), "dedup")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_sessions", MERGED + " select video_id, start_s, end_s from m")
def stream_sessions(spark, d):
    """Sessions close at start + length + gap + 1; a last far-off row moves the watermark past all others."""
    rows = regions(spark, d).select("start_s", "video_id", "end_s")
    folder = shared_folder(spark, "regions")
    rows.repartitionByRange(3, "start_s").write.parquet(folder)
    done = jobs.all_sessions(rows, folder, 0, 31)
    return done.select("video_id", F.unix_seconds("w.start").alias("start_s"), (F.unix_seconds("w.end") - 31).alias("end_s"))


@query("stream_sliding", """with s as (select epoch_us(ts) // 1000000 as t, value from events), w as (select (t // 3600 - unnest(range(6))) * 3600 as start_s, value from s)
select start_s, count(*) as n, round(sum(value), 3) as value from w group by start_s""")
def stream_sliding(spark, d):
    rows = timed(spark, d)
    out = jobs.totals(jobs.sliding(jobs.source(rows, "events"), "6 hours", "1 hour", jobs.span(rows)), ["w"], "sliding")
    return out.select(F.unix_seconds("w.start").alias("start_s"), "n", "value")


@query("stream_counters", "select (epoch_us(ts) // 86400000000) * 86400 as start_s, count(*) as n, count(*) filter (value < 20) as low from events group by 1")
def stream_counters(spark, d):
    rows = timed(spark, d)
    out = jobs.totals(jobs.counters(jobs.source(rows, "events"), "1 day", jobs.span(rows)), ["w"], "counters")
    return out.select(F.unix_seconds("w.start").alias("start_s"), "n", "low")


@query("stream_kis", IP + " select query_id, id, score, rank from ranked where rank <= 5")
def stream_kis(spark, d):
    stream = jobs.source(asked(spark, d), "queries")
    found = jobs.live_top_k(spark, stream, lambda batch: search.knn_exact(corpus(spark, d), batch, 5, normalize=False), shared_folder(spark, "answers"))
    return found.withColumn("rank", F.col("rank").cast("long"))
