"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Words and pairs of neighbouring words are hashed into buckets; two multinomials over the buckets are counted, one over
all documents (raw) and one over all trusted ones, both smoothed. A document's score is the mean over its n-grams of
ln(trusted / raw); it is kept if it passes the base rules and its score reaches the threshold.

The threshold is the lower whisker of the trusted documents' own scores: the lowest score that lies within ``fence``
interquartile ranges below the lower quartile (of documents of 50 words or more, in steps of 0.0005). So no trusted
document is lost but an outlier, and the same counts give the same threshold.

Trusted ids are broadcast up to a number that is checked (8 bytes each); more are joined by one shuffle, whose result is
stored. Counts and scores are added up by bucket and by step before they leave a task.

Defined cases: null and empty texts have no words, and fail the base rules; without trusted documents the ratio is 0
everywhere and the threshold is 0; null ids are never trusted; an id that several trusted rows name is trusted once;
repeated rows count each; very long texts count whole; a score equal to the threshold is kept; columns other than doc_id
and text are not looked at; an empty table gives an empty result. Repeated three-word windows are found by hash and then
compared word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import WORD, let, read, stored, text_or_empty, words

BUCKETS, SMOOTH, FENCE, SCORE_STEP = 8192, 1.0, 6.0, 0.0005
MIN_WORDS, MOST_REPEATED = 50, 50
BROADCAST_IDS = 4_000_000
SYMBOLS = "[#*$%&|<>]+"


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def _trusted_docs(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    ids = stored(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted-ids")
    rows = docs.select("doc_id", "text")
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi")
    return stored(rows.join(ids, "doc_id", "left_semi"), "trusted-texts")


def bucket_counts(docs: DataFrame) -> list[float]:
    """Smoothed counts of the n-grams of ``docs`` (text) in each bucket."""
    grams = (
        docs.select(words(text_or_empty()).alias("w"))
        .select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w") + 1).alias("b"))).alias("g"))
        .select(F.xxhash64("g.a").alias("a"), F.when(F.col("g.b").isNotNull(), F.xxhash64("g.b")).alias("b"))
        .select(F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.xxhash64("a", "b"))))).alias("bucket"))
        .where("bucket is not null")
    )
    found = [SMOOTH] * BUCKETS
    for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a bucket
        found[r["bucket"]] += r["n"]
    return found


def log_ratios(docs: DataFrame, good_docs: DataFrame) -> list[float]:
    """ln(trusted / raw) for each bucket; ``good_docs``: the trusted ones of ``docs``."""
    raw, good = bucket_counts(docs), bucket_counts(good_docs)
    if sum(good) == SMOOTH * BUCKETS:
        return [0.0] * BUCKETS
    scale = math.log(sum(raw) / sum(good))
    return [math.log(g / r) + scale for g, r in zip(good, raw)]


def mean_ratio(h: Column, ratios: Column) -> Column:
    """The mean ratio of the words (given by their hashes ``h``) and pairs of a text; 0 without words."""

    def term(x: Column, i: Column) -> Column:
        """A word's ratio and that of the pair it begins."""
        return F.get(ratios, _bucket(x)) + F.when(i + 1 < F.size(h), F.get(ratios, _bucket(F.xxhash64(x, F.get(h, i + 1))))).otherwise(0.0)

    total = F.aggregate(F.transform(h, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).otherwise(0.0)


def whisker(steps: list[tuple[int, int]], fence: float = FENCE) -> float:
    """The lowest of (step, number of scores) that is within ``fence`` interquartile ranges below the lower quartile."""
    steps = sorted(steps)
    total, running, quartiles = sum(n for _, n in steps), 0, []
    for step, n in steps:
        running += n
        while len(quartiles) < 2 and running >= total * (0.25, 0.75)[len(quartiles)]:
            quartiles.append(step)
    if not quartiles:
        return 0.0
    lower, upper = quartiles
    return min(step for step, _ in steps if step >= lower - fence * (upper - lower)) * SCORE_STEP


def threshold_of(good_docs: DataFrame, ratios: Column) -> float:
    """The whisker of the trusted documents' scores."""
    hashed = good_docs.select(F.transform(words(text_or_empty()), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= MIN_WORDS)
    step = F.floor(mean_ratio(F.col("h"), ratios) / SCORE_STEP).alias("step")
    # scores lie between -20 and 20, so the steps are at most 80,000
    return whisker([tuple(r) for r in hashed.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()])


def windows(hashed: Column) -> Column:
    """A hash of each window of three words."""
    return F.transform(F.slice(hashed, 1, F.greatest(F.size(hashed) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashed, i + 1), F.get(hashed, i + 2)))


def covered(h: Column, w: Column) -> Column:
    """Words inside windows (hashes ``h``) that occur at least twice; windows of one hash are compared by their words ``w``."""
    word = lambda i: F.get(w, i)

    def repeated(s: Column) -> Column:
        """Windows whose hash occurs again, by hash, words and place."""
        twice = F.filter(s, lambda y, j: (F.get(s, j - 1)["h"] == y["h"]) | (F.get(s, j + 1)["h"] == y["h"]))
        return F.sort_array(F.transform(twice, lambda y: F.struct(y["h"], F.struct(word(y["i"]), word(y["i"] + 1), word(y["i"] + 2)).alias("words"), y["i"])))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda y, j: (F.get(s, j - 1)["words"] == y["words"]) | (F.get(s, j + 1)["words"] == y["words"]))
        return F.sort_array(F.transform(twice, lambda y: y["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda q, j: F.coalesce(F.least(F.lit(3), q - F.get(p, j - 1)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = let(ordered, lambda s: let(repeated(s), lambda r: let(places(r), total)))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeats)


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts and the hashes of its words."""
    told = docs.select("doc_id", text_or_empty().alias("text"))
    told = told.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    told = told.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashed"),
        "w",
    )
    told = told.select("*", windows(F.col("hashed")).alias("windows"))
    return told.withColumn("n_repeat_words", covered(F.col("windows"), F.col("w"))).drop("windows", "w")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, llr (0 without words), base_failed, kept.

    ``threshold``: the least score, by default the whisker of the trusted scores."""
    good_docs = _trusted_docs(docs, trusted)
    ratios = F.lit(log_ratios(docs, good_docs))
    least = threshold_of(good_docs, ratios) if threshold is None else threshold
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = base_counts(docs).withColumn("llr", mean_ratio(F.col("hashed"), ratios)).drop("hashed")
    return told.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= least))


def op5_quality_rules(spark, sf_dir):
    trusted = read(spark, sf_dir, "labels").where("quality = 1")
    return judged(read(spark, sf_dir, "documents"), trusted)
