"""Store, scoring and vector segmentation on literal rows."""

from pyspark.sql import functions as F

from segmentry.operators import scoring, store, streams

STORE = "segment_id long, video_id string, start_frame int, end_frame int, midpoint_frame int, asr_text string"


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_store(spark):
    s = spark.createDataFrame([(1, "a", 0, 300, 150, None), (2, "a", 300, 900, 600, "x"), (3, "b", 0, 10, 5, None)], STORE)
    new = spark.createDataFrame([("b", 10), ("a", 900)], "video_id string, start_frame int")
    assert rows(store.insert(s, new, "video_id", "start_frame"), "segment_id", "video_id") == [(4, "a"), (5, "b")]
    assert rows(store.insert(s.where("false"), new, "video_id"), "segment_id") == [(1,), (2,)]
    # id 9 was given and deleted
    assert rows(store.insert(s, new, "video_id", "start_frame", high_water=9), "segment_id") == [(10,), (11,)]
    changed, unknown = store.update_text(s, spark.createDataFrame([(1, "n"), (1, "m"), (2, None), (9, "z")], "segment_id long, text string"))
    assert rows(changed, "segment_id", "asr_text") == [(1, "n"), (2, "x"), (3, None)] and rows(unknown, "segment_id") == [(9,)]
    spoken = spark.createDataFrame([("a", 290, 310, 1, "one"), ("a", 299, 1000, 2, "two"), ("a", 900, 901, 3, "no"), ("b", 10, 11, 4, "no")], "video_id string, sf int, ef int, k int, text string")
    for size in (1, 7, 250, 10_000):
        assert rows(store.overlapping(s, spoken, size), "segment_id", "k") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(store.spoken_text(s, spoken, "k"), "segment_id", "n", "text") == [(1, 2, "one two"), (2, 2, "one two")]
    assert {tuple(r) for r in store.last_spoken(s, spoken, "k").select("segment_id", "text").collect()} == {(1, None), (2, "two"), (3, None)}


def test_scoring(spark):
    truth = spark.createDataFrame([(1, "a", 10, 20, "Red  car"), (1, "a", 50, 60, "Red  car"), (2, "b", 0, 5, "x")], "query_id long, video_id string, s int, e int, answer string")
    given = spark.createDataFrame([(1, 1, "a", 9, "red car"), (1, 2, "a", 20, " RED car "), (1, 7, "a", 55, "blue"), (2, 1, "a", 3, None)], "query_id long, rank int, video_id string, frame int, answer string")
    scored = scoring.judged(given, truth)
    assert rows(scored, "query_id", "rank", "kis", "qa") == [(1, 1, 0, 0), (1, 2, 1, 1), (1, 7, 1, 0), (2, 1, 0, 0)]
    assert rows(scoring.final_score(scored, "kis"), "query_id", "final_score") == [(1, 0.8), (2, 0.0)]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    deep = scored.withColumn("rank", F.col("rank") + 98)
    assert rows(scoring.final_score(deep, "kis", queries=asked), "query_id", "final_score") == [(1, 0.2), (2, 0.0), (3, 0.0)]
    chain = spark.createDataFrame([(5, "trake", 1, "v", 30, 2, None), (5, "trake", 1, "v", 10, 1, None), (6, "qa", 1, "w", 4, 1, " yes "), (7, "kis", 1, "w", 4, 1, "no"), (7, "kis", 101, "w", 4, 1, None)], "query_id long, task string, rank int, video_id string, frame int, event_index int, answer string")
    assert rows(scoring.submission_lines(chain), "query_id", "line") == [(5, "v,10,30"), (6, "w,4,yes"), (7, "w,4")]


def test_submission_fields_are_quoted(spark, tmp_path):
    import csv
    import glob

    said = ['yes, no', 'say "hi"', "two\nlines", "plain"]
    given = spark.createDataFrame([(6, "qa", i + 1, "v,1", 4, 1, f" {a} ") for i, a in enumerate(said)] + [(7, "kis", 1, "w", 5, 1, None)], "query_id long, task string, rank int, video_id string, frame int, event_index int, answer string")
    lines = scoring.submission_lines(given)
    scoring.write_submission(lines, str(tmp_path / "official"))
    read = {q: [row for f in glob.glob(f"{tmp_path}/official/query_id={q}/*.txt") for row in csv.reader(open(f, newline=""))] for q in (6, 7)}
    assert read == {6: [["v,1", "4", a] for a in said], 7: [["w", "5"]]} and len(glob.glob(f"{tmp_path}/official/query_id=6/*.txt")) == 1
    scoring.write_unified(given, str(tmp_path / "unified"))
    back = sorted(row for f in glob.glob(f"{tmp_path}/unified/*.csv") for row in csv.reader(open(f, newline="")) if row[0] != "query_id")
    assert back == [["6", str(i + 1), "v,1", "4", "1", a] for i, a in enumerate(said)] + [["7", "1", "w", "5", "1", ""]]


def test_segment_videos_with_a_poisoned_one(spark):
    def video(name, n, f):
        return [(name, i, f(i)) for i in range(n)]

    step = lambda i: [0.0, 0.0] if i < 40 else [100.0, 0.0]
    frames = video("two", 80, step) + video("short", 3, step) + video("nan", 20, lambda i: [float("nan") if i == 5 else 0.0, 1.0]) + video("sizes", 20, lambda i: [1.0] * (1 + (i == 3)))
    frames += [("gap", 0, [1.0]), ("gap", 2, [1.0]), ("none", 0, None)]
    cut, status = streams.segment_videos(spark.createDataFrame(frames, "video_id string, frame_idx int, vec array<double>"), 8, 4, 1, 15.0)
    errors = {r["video_id"]: r["error"] for r in status.collect()}
    assert errors == {"two": None, "short": None, "nan": "missing or infinite values", "sizes": "vectors of unequal size", "gap": "gaps or repeats in frames", "none": "missing or infinite values"}
    found = rows(cut, "video_id", "start_frame", "end_frame", "midpoint_frame")
    # the window at 36 holds four frames of each kind, so its mean is apart from both
    assert found == [("short", 0, 3, 1), ("two", 0, 36, 18), ("two", 36, 40, 38), ("two", 40, 80, 60)]
    first = cut.where("video_id = 'two' and start_frame = 40").select(F.col("embedding")[0].alias("x")).first()
    assert first["x"] == 100.0
