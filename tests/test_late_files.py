import os

from pyspark.sql import functions as F

from segmentry.sources.files import shared_folder
from segmentry.streaming import jobs

DAY = 86400
SCHEMA = "start_s long, video_id string, end_s long"


def test_sessions_of_files_in_reverse_order(spark, tmp_path):
    """Three files over 200 days, the latest range first."""
    rows = [(at, v, at + 10) for v in "ab" for day in range(0, 200, 5) for at in (DAY * day, DAY * day + 20, DAY * day + 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "regions")
    for i, low in enumerate((140, 70, 0)):
        df.where(F.col("start_s").between(DAY * low, DAY * (low + 70) - 1)).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 1.5e9:
                os.utime(f"{folder}/{name}", (1e9 + i, 1e9 + i))
    found = jobs.all_sessions(df, folder, 0, 31).select("video_id", F.unix_seconds("w.start"), F.unix_seconds("w.end") - 31)
    want = [(v, DAY * day + a, DAY * day + b) for v in "ab" for day in range(0, 200, 5) for a, b in ((0, 30), (500, 510))]
    assert sorted(map(tuple, found.collect())) == sorted(want)

    # the same files (and the closing row) with the fixed delay of 30 days: those of the earlier ranges are dropped
    fixed = jobs.sessions(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), 0, 31)
    out, place = shared_folder(spark, "fixed"), shared_folder(spark, "fixed-checkpoint")
    fixed.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(fixed.schema).parquet(out).count()
    print("fixed delay:", kept, "of", len(want))
    assert kept < len(want)


def _in_turn(spark, folder, batches, schema):
    """A stream that reads one batch of rows a trigger, in their order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 1.5e9:
                os.utime(f"{folder}/{name}", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


EVENTS = "s long, value double, key string"
BATCHES = [[(10, 1.0, "a"), (20, 50.0, "b")], [(30, 2.0, "a"), (4 * DAY, 1.0, "c")], [(4 * DAY + 1, 1.0, "c")], [(40, 9.0, "a")]]


def test_counters_add_up_over_batches_and_drop_late_rows(spark, tmp_path):
    stream = _in_turn(spark, str(tmp_path / "events"), BATCHES, EVENTS).withColumn("ts", F.timestamp_seconds("s"))
    told = lambda delay, name: {r["at"]: (r["n"], r["low"]) for r in jobs.totals(jobs.counters(stream, "1 day", delay), ["w"], name).select(F.unix_seconds("w.start").alias("at"), "n", "low").collect()}
    assert told("10 days", "all") == {0: (4, 3), 4 * DAY: (2, 2)}
    # the row at 40 comes two batches after one four days ahead of it (a watermark holds from the batch after the next)
    assert told("1 day", "late") == {0: (3, 2), 4 * DAY: (2, 2)}


def test_first_arrivals(spark, tmp_path):
    stream = _in_turn(spark, str(tmp_path / "events"), BATCHES, EVENTS).withColumn("ts", F.timestamp_seconds("s"))
    kept = lambda df, name: sorted((r["key"], r["s"]) for r in jobs.append_once(df, shared_folder(spark, name), name).collect())
    want = [("a", 10), ("b", 20), ("c", 4 * DAY)]
    assert kept(jobs.first_arrivals(stream, ["key"]), "ever") == want
    assert kept(jobs.first_arrivals(stream, ["key"], "ts", "10 days"), "within") == want
