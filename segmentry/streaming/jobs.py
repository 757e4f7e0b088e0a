"""Incremental jobs as Structured Streaming. Files arrive in a folder; each job reads what is new and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from segmentry.sources.files import shared_folder


def source(df: DataFrame, name: str, batches: int = 3) -> DataFrame:
    """A stream over ``df``, written as files of a folder; one file a trigger."""
    path = shared_folder(df.sparkSession, name)
    df.repartitionByRange(batches, df.columns[0]).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_batches(stream: DataFrame, each, name: str) -> None:
    """Runs ``each(batch, batch_id)`` until the input is used up; the checkpoint makes finished input be skipped."""
    place = shared_folder(stream.sparkSession, f"{name}-checkpoint")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def append_once(stream: DataFrame, path: str, name: str) -> DataFrame:
    """Each batch goes to a folder of its own number, so a batch that runs again replaces itself."""
    run_batches(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), name)
    return stream.sparkSession.read.schema(stream.schema).parquet(path).drop("batch")


def totals(aggregated: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The result of a streaming aggregation after all input. A batch writes only the groups that it changed, in a folder of
    its own number; of a group the row of its last batch counts."""
    path = shared_folder(aggregated.sparkSession, name)
    place = shared_folder(aggregated.sparkSession, f"{name}-checkpoint")
    writer = aggregated.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    writer.option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    fields = StructType([*aggregated.schema.fields, StructField("batch", LongType())])
    rows = aggregated.sparkSession.read.schema(fields).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in aggregated.columns if c not in keys]), "batch").alias("last"))
    return last.select(*keys, "last.*")


def first_arrivals(stream: DataFrame, keys: list[str], at: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key to arrive, as the state store knows them. With a time column a key is forgotten ``delay``
    after it, so the state is bounded; without one all keys are kept."""
    if at is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def span(df: DataFrame, at: str = "ts") -> str:
    """The time between the first and the last row, as a delay with which no row of a finite table is late."""
    low, high = df.agg(F.min(F.unix_seconds(at)), F.max(F.unix_seconds(at))).first()
    return f"{(high or 0) - (low or 0) + 1} seconds"


def sessions(stream: DataFrame, pad: int, gap: int, delay: str = "30 days") -> DataFrame:
    """Regions (video_id, start_s, end_s) merged as sessions; append mode needs the watermark it sets."""
    timed = stream.withColumn("at", F.timestamp_seconds(F.greatest(F.col("start_s") - pad, F.lit(0)))).withWatermark("at", delay)
    length = F.concat((F.col("end_s") - F.col("start_s") + 2 * pad + gap).cast("string"), F.lit(" seconds"))
    return timed.groupBy("video_id", F.session_window("at", length).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def all_sessions(rows: DataFrame, folder: str, pad: int, gap: int) -> DataFrame:
    """The sessions of all files in ``folder``, which hold ``rows`` (start_s, video_id, end_s), in whatever order they arrive.

    The watermark waits for the whole span of ``rows``, so none is late. A closing row that moves it past all of them is
    written once they are used up, and read by a second run from the same checkpoint."""
    spark = rows.sparkSession
    first, last, video = rows.agg(F.min("start_s"), F.max("end_s"), F.max("video_id")).first()
    delay = (last or 0) - (first or 0) + 2 * pad + gap + 86400
    path, place = shared_folder(spark, "sessions"), shared_folder(spark, "sessions-checkpoint")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        merged = sessions(stream, pad, gap, f"{delay} seconds")
        merged.writeStream.format("parquet").option("path", path).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
        return merged.schema

    run()
    at = (last or 0) + 2 * delay
    spark.createDataFrame([(at, video, at)], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(run()).parquet(path)


def sliding(stream: DataFrame, size: str, stride: str, delay: str) -> DataFrame:
    """Windows over ts; their state is freed, and rows are late, once the newest ts is ``delay`` past them."""
    windows = stream.withWatermark("ts", delay).groupBy(F.window("ts", size, stride).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("value"))


def counters(stream: DataFrame, size: str, delay: str) -> DataFrame:
    """Tumbling windows, with the same rule for late rows."""
    windows = stream.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 20).alias("low"))


def live_top_k(spark: SparkSession, questions: DataFrame, search, path: str) -> DataFrame:
    """A stream of queries against a static corpus: ``search(batch)`` ranks inside each batch."""
    schema: dict = {}

    def each(batch, n):
        found = search(batch)
        schema["s"] = found.schema
        found.write.mode("overwrite").parquet(f"{path}/batch={n}")

    run_batches(questions, each, "live")
    return spark.read.schema(schema["s"]).parquet(path).drop("batch")
