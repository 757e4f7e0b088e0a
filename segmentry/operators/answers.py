"""What a search gives back: nested results with totals, finer segments inside hits, answers out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.text import tokens
from segmentry.functions.vectors import inner_product
from segmentry.operators import store


def envelopes(hits: DataFrame, totals: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, results, total_results, has_next): of ``hits`` (query_id, rank, ...) the first ``k`` as a list of structs in order
    of rank, and how many there are in all, by ``totals`` (query_id, total). A query without hits has an empty list; null ids are a
    query like any other. ``queries`` names all that were asked; by default those that have a total."""
    fields = [c for c in hits.columns if c not in ("query_id", "rank")]
    best = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_r"))  # k at most
    asked = (totals if queries is None else queries).select("query_id").distinct()
    for part in (best, totals.select("query_id", "total")):
        part = part.withColumnRenamed("query_id", "_q")
        asked = asked.join(part, F.col("query_id").eqNullSafe(F.col("_q")), "left").drop("_q")
    plain = F.transform("_r", lambda r: F.struct(*[r[c].alias(c) for c in fields]))
    total = F.coalesce("total", F.lit(0)).cast("long")
    return asked.select("query_id", F.coalesce(plain, F.array().cast(hits.select(F.array(F.struct(*fields))).schema[0].dataType)).alias("results"), total.alias("total_results"), (total > k).alias("has_next"))


def write_envelopes(found: DataFrame, path: str) -> None:
    """A JSON object a query; fields that are null are written as null."""
    found.write.option("ignoreNullFields", False).json(path)


def read_envelopes(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def refined(hits: DataFrame, fine: DataFrame, queries: DataFrame, score: Column | None = None) -> DataFrame:
    """(query_id, id, fine_score, n_fine, fine_id): for each of ``hits`` (query_id, id, video_id, start_frame, end_frame) its best
    segment of ``fine`` (fine_id, video_id, start_frame, end_frame, vec), among those that share a frame with it; of equal scores
    the smallest fine_id. Only ids meet, in bins of frames; vectors are joined last. A hit without a finer segment gives no row.
    ``score`` is over q and vec, by default their inner product."""
    spans = fine.select("fine_id", "video_id", F.col("start_frame").alias("sf"), F.col("end_frame").alias("ef"))
    near = store.overlapping(hits.select("query_id", "id", "video_id", "start_frame", "end_frame"), spans).select("query_id", "id", "fine_id")
    scored = near.join(fine.select("fine_id", "vec"), "fine_id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    of = F.round(inner_product("q", "vec"), 6) if score is None else score
    best = scored.groupBy("query_id", "id").agg(F.max(of).alias("fine_score"), F.count(F.lit(1)).alias("n_fine"), F.max_by("fine_id", F.struct(of, -F.col("fine_id"))).alias("fine_id"))
    return best


def extracted(hits: DataFrame, texts: DataFrame, questions: DataFrame, source: str = "asr") -> DataFrame:
    """(query_id, id, pos, score, answer_source, answer): the sentence of each hit's text (``texts``: id, text) that has the most
    different words of its question (query_id, text), the first of equal ones; a hit whose text is null gives no row."""
    terms = questions.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    s = hits.select("query_id", "id").join(texts.select("id", "text"), "id").select("query_id", "id", F.posexplode(F.split("text", r"\.")).alias("pos", "sentence")).join(terms, "query_id")
    s = s.withColumn("score", F.coalesce(F.size(F.array_intersect("terms", tokens(F.col("sentence")))), F.lit(0)).cast("long"))
    best = s.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("pos")).alias("neg"), F.trim("sentence").alias("t"))).alias("b"))
    return best.select("query_id", "id", (-F.col("b.neg")).alias("pos"), "b.score", F.lit(source).alias("answer_source"), F.col("b.t").alias("answer"))
