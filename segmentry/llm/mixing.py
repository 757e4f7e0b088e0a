"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text, and another of its place that parts equal rows. Tokens are summed by source and hash bucket (the leading 12 bits);
the running sums give the bucket in which a source's budget ends, and only that bucket is summed again by its next 12
bits, until it holds one document (the bits of the place follow those of id and text). The mix is then a filter ``hash < threshold``: no sort, and a smaller budget takes a
subset of a larger one. Budgets beyond one pass over a source take every document once and the threshold for the rest.

Defined cases: a text without words (null, empty or blank) has size 0 and is never taken; null source is a source of its own, last in order; null and
repeated doc_ids are allowed; of rows equal in id and text as many are taken as the budget asks for, by their place;
very long texts count whole; other columns of any name are kept as they are; an empty table gives an empty mix. Sources are a catalogue: their table (a row each) is ordered in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.llm.common import WORD, read, stored, text_or_empty, with_row_key, words

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
HASH_BITS, STEP = 60, 12
#: Source tables of up to so many rows (about 50 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _hash():
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), text_or_empty(F.col("row.text"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _hashed(keyed: DataFrame, *columns) -> DataFrame:
    tie = F.xxhash64("key_file", "key_row").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    return keyed.select(*columns, F.col("row.source").alias("source"), _hash().alias("hash"), tie.alias("tie"))


def _prefix(steps: int):
    """The first ``steps`` digits of 12 bits, in two columns: those of the hash, then those of the tie."""
    shift = 2 * HASH_BITS - STEP * steps
    return F.shiftright("hash", max(shift - HASH_BITS, 0)), F.shiftright("tie", min(shift, HASH_BITS))


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _by_source(docs: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    sources = sources.withColumnRenamed("source", "of_source")
    return docs.join(sources, docs["source"].eqNullSafe(sources["of_source"]), how).drop("of_source")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes, dealt by weight and stopped at ``cap`` times the
    source's size, the excess dealt again. With sources by rising cap / weight, the level of the water is that of the
    first source that is not filled."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights)) + 1)
    capped = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    water = F.min(fits).over(everything)["level"]
    return levels.withColumn("water", water).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most"))).alias("target")
    )


def _refined(sized: DataFrame, edge: DataFrame, steps: int) -> DataFrame:
    """The bucket of ``steps`` digits in which each source's budget ends; ``edge`` has that of one digit less."""
    inside = _by_source(sized, _small(edge.select("source", "rest", "below", "first", "second")))
    first, second = _prefix(steps - 1)
    inside = inside.where((first == F.col("first")) & (second == F.col("second")))
    first, second = _prefix(steps)
    sums = inside.groupBy("source", first.alias("first"), second.alias("second")).agg(
        F.sum("size").alias("mass"), F.sum((F.col("size") > 0).cast("long")).alias("n"),
        F.first("rest").alias("rest"), F.first("below").alias("start"),
    )
    # a source has at most 4,096 rows here
    running = F.col("start") + F.sum("mass").over(Window.partitionBy("source").orderBy("first", "second"))
    return (
        sums.withColumn("upto", running)
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("mass") <= F.col("rest")))
        .select("source", "rest", (F.col("upto") - F.col("mass")).alias("below"), "first", "second", "mass", "n")
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> tuple[DataFrame, int]:
    """Per source: full passes, and the digits (their number is given beside) where the rest of the budget ends."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = budgets.withColumn("passes", passes.cast("long"))
    zero = F.lit(0).cast("long")
    edge = budgets.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"), zero.alias("below"), zero.alias("first"), zero.alias("second"))
    for steps in range(1, 2 * HASH_BITS // STEP + 1):
        edge = stored(_refined(sized, edge, steps), "edge")
        if (edge.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    left = F.col("rest") - F.col("below")
    edge = edge.select("source", F.col("first").alias("edge"), F.col("second").alias("edge_tie"), (F.col("mass") - left <= left).alias("takes_edge"))
    return _by_source(budgets, edge, "left"), steps


def _taken(hashed: DataFrame, limits: DataFrame, steps: int) -> DataFrame:
    """Adds times. ``hashed`` has ``some``: whether the row has a word at all; one without is not taken."""
    first, second = _prefix(steps)
    at_edge = (second < F.col("edge_tie")) | ((second == F.col("edge_tie")) & F.col("takes_edge"))
    once_more = (first < F.col("edge")) | ((first == F.col("edge")) & at_edge)
    times = F.when(F.col("some"), F.col("passes") + F.coalesce(once_more, F.lit(False)).cast("long")).otherwise(0)
    return _by_source(hashed, _small(limits)).withColumn("times", times)


def _limits(keyed: DataFrame, weights, share, cap) -> tuple[DataFrame, DataFrame, int]:
    size = F.size(words(text_or_empty(F.col("row.text")))).cast("long").alias("size")
    sized = stored(_hashed(keyed, F.col("row.doc_id").alias("doc_id"), size), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = stored(targets(sizes, weights, share, cap), "targets")
    limits, steps = thresholds(sized, budgets)
    return sized, stored(limits, "limits"), steps


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, scan_only: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) for every row of ``docs`` (doc_id, text, source)."""
    keyed = with_row_key(docs.select("doc_id", "text", "source"), scan_only)
    sized, limits, steps = _limits(keyed, weights, share, cap)
    return _taken(sized.withColumn("some", F.col("size") > 0), limits, steps).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, scan_only: bool = False) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    keyed = with_row_key(docs, scan_only)
    _, limits, steps = _limits(keyed, weights, share, cap)
    some = text_or_empty(F.col("row.text")).rlike(WORD).alias("some")
    taken = _taken(_hashed(keyed, "row", some), limits, steps).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")


def op1_mix_sources(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"), scan_only=True).drop("times", "source")


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight,
             source_size * 2.0::double as most from s),
l as (select *, (sum(source_size) over () * 1.5::double
                 - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level,
             row_number() over (order by most / weight, source nulls last) as place from w),
t as (select source, source_size, least(most, coalesce((select arg_min(level, place) from l where level * weight <= most) * weight, most)) as target from l),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from t),
c as (select d.*, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size as rest,
             sum(size) over (partition by d.source order by h, r rows unbounded preceding) - size as below
      from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       ((passes + (below + size <= rest or (below <= rest and size - (rest - below) <= rest - below))::bigint) * size)::bigint as taken
from c
"""
