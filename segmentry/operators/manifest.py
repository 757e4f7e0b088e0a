"""Training manifests: outcomes of samples, what is left to do, merging, caps and filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.text import strip
from segmentry.operators import running
from segmentry.operators.dataprep import outcome
from segmentry.sources import files, readers

OUTCOMES = ("ok", "duplicate", "missing", "corrupt")


def told(rows: DataFrame, key: str, order: list[str], missing: Column, corrupt: Column, parts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with a caption, each with its outcome: after the first row of a key (by ``order``) come duplicates. A key may lie
    in any number of tasks; its slices are written, so ``keep`` names the columns to carry, by default all."""
    named = rows.where(F.coalesce(F.trim("caption"), F.lit("")) != "")
    named = named.select(*keep) if keep else named
    marked = running.before(running.sliced(named, [key], order, parts), [key], order, "sum", F.lit(1), "_earlier")
    return marked.withColumn("outcome", outcome(F.col("_earlier").isNotNull(), missing, corrupt)).drop("_earlier", "_slice")


def summary(outcomes: DataFrame, *by: str, names=OUTCOMES) -> DataFrame:
    """Rows in all and by outcome."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def rollup(outcomes: DataFrame, *by: str) -> DataFrame:
    """Total and ok for each prefix of ``by``, down to all rows."""
    return outcomes.rollup(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "ok").alias("ok"))


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is planned and not yet done; lines of ``done`` without a key are passed over."""
    return planned.join(done.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def complete_groups(planned: DataFrame, done: DataFrame, group: str, key: str) -> DataFrame:
    """(group, planned, done) of groups of which everything is done."""
    marked = planned.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left")
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("planned"), F.count("_done").alias("done")).where("done >= planned")


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, as a whole; an empty ``old`` is a first run. A null key is a
    key like any other; of several rows of ``new`` with one key the last by ``order`` (by default all columns) is taken."""
    last = F.struct(F.struct(*(order or new.columns)).alias("by"), F.struct(*new.columns).alias("row"))
    newest = new.groupBy(key).agg(F.max(last).alias("last")).select("last.row.*")
    same = old[key].eqNullSafe(newest[key])
    return old.join(newest.select(key), same, "left_anti").unionByName(newest, allowMissingColumns=True)


def capped(df: DataFrame, group: str, order: str, most: int | None, parts: int | None = None, weight: Column | None = None, budget=None) -> DataFrame:
    """The rows of each group up to where a run stops: after ``most`` rows, or before the row with which the sum of ``weight``
    would pass ``budget``. Adds n_new, a row's place, and spent, the sum with it. A group may lie in any number of tasks."""
    slices = running.sliced(df, [group], [order], parts)
    counted = running.before(slices, [group], [order], "sum", F.lit(1), "n_new").withColumn("n_new", (F.coalesce("n_new", F.lit(0)) + 1).cast("int"))
    if weight is not None:
        spent = running.before(counted, [group], [order], "sum", F.coalesce(weight, F.lit(0)), "spent")
        counted = spent.withColumn("spent", F.coalesce("spent", F.lit(0)) + F.coalesce(weight, F.lit(0)))
    stop = F.lit(False) if most is None else F.col("n_new") > most
    stop = stop if budget is None else stop | (F.col("spent") > budget)
    return counted.where(~stop).drop("_slice")


def by_quality(samples: DataFrame, labels: DataFrame, key: str, least: int = 1, strict: bool = True) -> DataFrame:
    """Samples of quality ``least`` or more; without a label they stay only if not ``strict``. Strict needs a caption too."""
    known = labels.groupBy(key).agg(F.max("quality").alias("_quality"))
    joined = samples.join(known, key, "left")
    good = F.col("_quality") >= least
    keep = F.coalesce(good, F.lit(False)) & (F.trim("caption") != "") if strict else F.coalesce(good, F.lit(True))
    return joined.where(keep).drop("_quality")


def in_order(*sources: DataFrame) -> DataFrame:
    """All rows of ``sources``, with src, the number of the source."""
    return reduce(DataFrame.unionByName, [df.withColumn("src", F.lit(i)) for i, df in enumerate(sources)])


def presence(samples: DataFrame, listing: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, missing, present): samples counted by whether ``listing`` has their key."""
    marked = samples.join(listing.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    return marked.groupBy(*by).agg(F.count_if(F.col("_there").isNull()).alias("missing"), F.count("_there").alias("present"))


def missing_urls(samples: DataFrame, listing: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """Samples that ``listing`` lacks, each with its url of ``urls`` (key, url); null where none is known."""
    return remaining(samples, listing, key).join(urls.select(key, "url"), key, "left")


def ordered_distinct(df: DataFrame, value: str, place: str, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(value, place, nth): each value once, where it first stands; a name in ``groups`` stands for the values listed there,
    the ``nth`` of them in turn."""
    each = F.array(F.col(value))
    for name, members in (groups or {}).items():
        each = F.when(F.col(value) == name, F.array(*[F.lit(m) for m in members])).otherwise(each)
    named = df.select(F.col(place).alias("place"), F.posexplode(each).alias("nth", value))
    return named.groupBy(value).agg(F.min(F.struct("place", "nth")).alias("first")).select(value, "first.*")


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def sample_error(media=("image", "video"), least_frames: int = 1) -> Column:
    """The first rule that a sample (path, media_type, num_frames, caption) breaks, or null."""
    return (
        F.when(_blank(F.col("path")), "no path").when(F.col("path").startswith("/"), "absolute path")
        .when(~F.coalesce(F.col("media_type").isin(*media), F.lit(False)), "unknown media type")
        .when(F.coalesce("num_frames", F.lit(0)) < least_frames, "too few frames").when(_blank(F.col("caption")), "no caption")
    )


def validate_requests(requests: DataFrame, texts=("query",), events: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): top_k must be over 0, each of ``texts`` not blank, and there must be an event, none of them blank,
    where ``events`` names a list of them. Rejected rows have code and message."""
    message = F.when(F.coalesce("top_k", F.lit(0)) <= 0, "top_k must be positive")
    for name in texts:
        message = message.when(_blank(F.col(name)), f"{name} must not be blank")
    if events:
        none = F.coalesce(F.size(events), F.lit(0)) <= 0
        message = message.when(none, "no event").when(F.exists(events, _blank), "blank event")
    told = requests.withColumn("message", message)
    return told.where("message is null").drop("message"), told.where("message is not null").withColumn("code", F.lit("INVALID_REQUEST"))


def contains_any(df: DataFrame, text: str, *fields: str) -> Column:
    """Whether one of ``fields`` has ``text`` in it, in whatever case; numbers count as written, and of a list any item may
    have it. A blank text is in all rows."""
    if not text.strip():
        return F.lit(True)
    wanted = F.lit(text.strip().lower())
    inside = lambda c: F.coalesce(F.contains(F.lower(c.cast("string")), wanted), F.lit(False))
    is_list = lambda f: df.schema[f].dataType.typeName() == "array"
    parts = [F.coalesce(F.exists(f, inside), F.lit(False)) if is_list(f) else inside(F.col(f)) for f in fields]
    return reduce(Column.__or__, parts, F.lit(False))


def rule_counts(df: DataFrame, by: list[str], **broken: Column) -> DataFrame:
    """How many rows of each group break each rule."""
    return df.groupBy(*by).agg(*[F.count_if(rule).alias(name) for name, rule in broken.items()])


# What a case of the ground truth may say.
DIFFICULTIES, CASE_SOURCES = ("easy", "medium", "hard"), ("sample", "synthetic")


def case_rules() -> dict[str, Column]:
    """Rules for test cases (query_text, difficulty, source, frame), each true where it is broken."""
    not_in = lambda name, allowed: ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))
    return {
        "bad_difficulty": not_in("difficulty", DIFFICULTIES), "bad_source": not_in("source", CASE_SOURCES),
        "bad_frame": F.coalesce("frame", F.lit(-1)) < 0, "empty": _blank(F.col("query_text")),
    }


# The columns of a manifest.
MANIFEST = "data_path string, caption string, media_type string, num_frames int, duration double, source string"


@dataclass(frozen=True)
class Source:
    """Where samples come from: JSON lines (id, caption, num_frames, duration) at ``path``, a media file each, named ``id``.``ext``
    in the folder ``name``. ``kind`` is a format of ``readers.SIGNATURES``, or None for files that must only be there and not be
    empty; of ``strict`` sources a broken line is an error, of others a reject; with ``captioned`` a row without caption is no sample."""

    name: str
    path: str
    media_type: str
    ext: str
    kind: str | None = None
    strict: bool = True
    captioned: bool = False


def scanned(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected lines) of ``source``. Samples have the columns of a manifest, and place, their order in the source."""
    fields = "id string, caption string, num_frames int, duration double"
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    rows, rejects = (files.read_jsonl_strict if source.strict else files.read_jsonl_tolerant)(spark, source.path, fields, at)
    image = source.media_type == "image"
    told = rows.where(strip(F.coalesce("id", F.lit(""))) != "").withColumn("caption", strip(F.col("caption")))
    told = told.where("caption <> ''") if source.captioned else told
    return told.select(
        F.concat(F.lit(f"{source.name}/"), "id", F.lit(f".{source.ext}")).alias("data_path"), "caption", F.lit(source.media_type).alias("media_type"),
        (F.lit(1) if image else F.col("num_frames")).alias("num_frames"), (F.lit(None).cast("double") if image else F.col("duration")).alias("duration"),
        F.lit(source.name).alias("source"), "place"), rejects


def build(spark: SparkSession, sources: list[Source], root: str, mode: str = "fast", wanted: list[str] | None = None, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rejects) of ``sources``, of which only those named in ``wanted`` if given: every sample with its outcome, the
    first that holds of duplicate (a path that an earlier row of its source has), missing (no such file under ``root``), corrupt
    (``mode``, as of ``readers.check_files``) and ok, and the error of its file. Files are opened once a path, by the tasks that
    hold the rows; a path that many rows share may lie in any number of tasks. Outcomes are stored, so later steps see one check.
    Rejects are (source, value), the lines that do not parse."""
    names = [s.name for s in sources]
    if unknown := set(wanted or []) - set(names):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    if len(set(names)) < len(names):
        raise ValueError(f"sources named twice: {names}")
    told, rejects = [], []
    for source in (s for s in sources if wanted is None or s.name in wanted):
        rows, bad = scanned(spark, source)
        slices = running.sliced(rows, ["data_path"], ["place"], parts)
        marked = running.before(slices, ["data_path"], ["place"], "sum", F.lit(1), "_earlier").drop("_slice", "place")
        fresh, again = marked.where("_earlier is null").drop("_earlier"), marked.where("_earlier is not null").drop("_earlier")
        checked = readers.check_files(fresh.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "data_path")), source.kind or "any", mode if source.kind else "none")
        bad_file = ~F.col("valid") | (F.col("size") == 0) if source.kind is None else ~F.col("valid")
        name = outcome(F.lit(False), F.coalesce(F.col("error") == "missing", F.lit(False)), bad_file)
        told.append(checked.withColumn("outcome", name).drop("path", "size", "bytes_read", "valid"))
        told.append(again.withColumn("error", F.lit(None).cast("string")).withColumn("outcome", F.lit("duplicate")))
        rejects.append(bad.select(F.lit(source.name).alias("source"), "value"))
    if not told:
        none = spark.createDataFrame([], f"{MANIFEST}, error string, outcome string")
        return none, spark.createDataFrame([], "source string, value string")
    return files.stored(reduce(DataFrame.unionByName, told), "outcomes"), reduce(DataFrame.unionByName, rejects)


def previous(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at ``path``; one that is not there, or has a line that cannot be read, counts as empty."""
    try:
        rows, rejects = files.read_jsonl_tolerant(spark, path, MANIFEST)
        return rows.limit(0) if rejects.take(1) else rows
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def merge_into(outcomes: DataFrame, before: DataFrame, path: str) -> DataFrame:
    """Writes the samples of ``outcomes`` that are ok as JSON lines to the new folder ``path``, together with those of ``before``
    whose path they do not have, and reads them back."""
    good = outcomes.where("outcome = 'ok'").select(*[f.split()[0] for f in MANIFEST.split(", ")])
    upsert(before, good, "data_path").write.json(path)
    return outcomes.sparkSession.read.schema(MANIFEST).json(path)
