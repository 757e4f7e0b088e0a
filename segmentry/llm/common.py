"""What the operators of this subpackage share: patterns, stored intermediate tables, row keys."""

from __future__ import annotations

import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.sources.files import shared_root

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts; Spark's own bound is 64 MB, of which executor and worker hold some copies a task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now gives Python its rows in Arrow batches of ``BATCH_BYTES``, and a row beyond that by itself. The
    setting stays, as ``df`` is computed later; a session that names a size of its own keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there, lost executors reread it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, scan_only: bool = False) -> DataFrame:
    """``docs`` as (row: struct of all columns, key_file, key_row): the place of each row in its file.

    Unlike doc_id this is unique even with null or repeated ids, and the same in every pass and retry. ``scan_only`` says
    that ``docs`` has the rows of files as they are (a scan, or columns computed from one) if it comes from files; all else
    is stored first."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    if scan_only:
        try:
            meta = docs.metadataColumn("_metadata")
            keyed = docs.select(row, F.xxhash64(meta.getField("file_path")).alias("key_file"), meta.getField("row_index").alias("key_row"))
            keyed.schema  # noqa: B018  (resolved here)
            return keyed
        except AnalysisException:  # rows that are not of files have no such column
            pass
    return with_row_key(stored(docs, "rows"), True)


def text_or_empty(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def words(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]
