"""File sources and sinks. Rejected rows are returned, never lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segmentry.functions.text import strip

SEGMENT = "video_id string, start_frame int, end_frame int, midpoint_frame int, embedding array<float>, level string"
MEDIA = ("mp4", "mkv", "mov", "avi", "webm")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where none is named, local mode makes
    one; a cluster needs the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``shared_root``."""
    return f"{shared_root(spark)}/segmentry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into a new shared folder and reads it back: lineage ends there, and lost executors reread it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validate_segments(df: DataFrame, dim: int = 1536) -> tuple[DataFrame, DataFrame]:
    """(good, bad): dimension, start < end, start <= midpoint < end, level, required fields."""
    ok = (
        F.col("video_id").isNotNull() & (F.size("embedding") == dim) & (F.col("start_frame") < F.col("end_frame"))
        & F.col("midpoint_frame").between(F.col("start_frame"), F.col("end_frame") - 1) & F.col("level").isin("coarse", "fine")
    )
    marked = df.withColumn("valid", F.coalesce(ok, F.lit(False)))
    return marked.where("valid").drop("valid"), marked.where("not valid").drop("valid")


def write_segments(df: DataFrame, path: str) -> None:
    df.select("video_id", "start_frame", "end_frame", "midpoint_frame", "embedding", "level").write.json(path)


def read_segments(spark: SparkSession, path: str, dim: int = 1536) -> tuple[DataFrame, DataFrame]:
    return validate_segments(spark.read.schema(SEGMENT).json(path), dim)


def _parsed(spark: SparkSession, path: str, schema: str | StructType, place: Column | None) -> tuple[DataFrame, Column]:
    """(lines with value, their fields in r, and place if one is named; whether a line is broken)."""
    lines = spark.read.text(path).select("value", *([] if place is None else [place.alias("place")])).where(F.trim("value") != "")
    fields = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    parsed = lines.withColumn("r", F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed, F.col("r").isNull() | F.col("r._bad").isNotNull()


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType, place: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects as text); blank lines are skipped. ``place``, over the lines as they are read, comes as a column of rows."""
    parsed, bad = _parsed(spark, path, schema, place)
    return parsed.where(~bad).select("r.*", *([] if place is None else ["place"])).drop("_bad"), parsed.where(bad).select("value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str | StructType, place: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``read_jsonl_tolerant``, but a broken line ends the job with an error that shows it; there are no rejects."""
    parsed, bad = _parsed(spark, path, schema, place)
    line = F.raise_error(F.concat(F.lit("broken line: "), F.left("value", F.lit(200)))).cast(parsed.schema["r"].dataType)
    checked = parsed.withColumn("r", F.when(bad & (F.trim("value") != ""), line).otherwise(F.col("r")))  # filters may be merged
    return checked.select("r.*", *([] if place is None else ["place"])).drop("_bad"), parsed.where("false").select("value")


def dealt(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` (path, ...) over ``tasks`` partitions, by default the session's shuffle partitions; a given number is kept, where
    partitions of few bytes would be joined into one. By a hash, as a table that lies by path already would not be dealt again."""
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))


def write_files(df: DataFrame, root: str, tasks: int | None = None) -> int:
    """A file under ``root`` for each row of ``df`` (path, content binary), written by the task that holds the row, so that one
    that runs again writes the same; their number. For paths that pyarrow can open."""

    def write(batches):
        from pyarrow import fs

        for rows in batches:
            for path, content in zip(rows["path"], rows["content"]):
                full = f"{root.rstrip('/')}/{path}"
                store, name = fs.FileSystem.from_uri(full) if "://" in full or full.startswith("file:") else (fs.LocalFileSystem(), full)
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(name) as out:
                    out.write(content)
            yield rows[["path"]]

    return dealt(df.select("path", "content"), tasks).mapInPandas(write, "path string").count()


def repair_jsonl(spark: SparkSession, source: str, target: str, key: str = "id") -> tuple[int, int]:
    """Keeps lines that parse and have ``key``, if only with a null; (kept, dropped)."""
    lines = spark.read.text(source).where(F.trim("value") != "")
    good = F.coalesce(F.array_contains(F.json_object_keys("value"), key), F.lit(False)) & F.col("value").rlike(r"\}\s*$")
    n = lines.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped")).first()
    lines.where(good).write.text(target)
    return n["kept"], n["dropped"]


def read_caption_parquet(spark: SparkSession, path: str, caption_col: str = "re_caption", fallback: str = "org_caption") -> DataFrame:
    """Adds caption (the wanted column, by row else the fallback) and key (key, else sha256, else a hash of the url)."""
    df = spark.read.parquet(path)
    text = [F.when(F.trim(c) != "", F.col(c)) for c in (caption_col, fallback) if c in df.columns]
    keys = [F.col(c) for c in ("key", "sha256") if c in df.columns] + [F.xxhash64("url").cast("string")]
    return df.withColumn("caption", F.coalesce(*text)).withColumn("row_key", F.coalesce(*keys))


def read_list_file(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank; a comment starts with # in the first column."""
    raw = spark.read.text(path)
    return raw.where(~F.col("value").startswith("#")).select(strip(F.col("value")).alias("path")).where("path <> ''")


def discover_files(spark: SparkSession, root: str, exts=MEDIA, limit: int | None = None) -> DataFrame:
    """(path, length) under ``root``, sorted; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*exts)).orderBy("path")
    return found.limit(limit) if limit else found


def check_signature(files: DataFrame, head_hex: str = "FFD8", tail_hex: str = "FFD9") -> DataFrame:
    head = F.hex(F.substring("content", 1, len(head_hex) // 2)) == head_hex
    size = len(tail_hex) // 2
    tail = F.hex(F.expr(f"substring(content, -{size}, {size})")) == tail_hex
    return files.withColumn("valid", head & tail)


def write_caption_tsv(df: DataFrame, path: str) -> int:
    """(caption, url): tabs and line ends become blanks, rows with an empty field go; fields stand as they are, without quotes.
    The number of rows written."""
    clean_tsv(df).write.option("quote", "").csv(path, sep="\t")
    return read_caption_tsv(df.sparkSession, path).count()


def read_caption_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("caption string, url string").option("quote", "").csv(path, sep="\t")


def clean_tsv(df: DataFrame) -> DataFrame:
    tidy = [strip(F.translate(c, "\t\n\r", "   ")).alias(c) for c in ("caption", "url")]
    return df.select(*tidy).where("caption <> '' and url <> ''")
