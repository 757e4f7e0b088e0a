import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.functions import text, vectors
from segmentry.operators import chains, dataprep, scoring, search, streams
from segmentry.sources import files


@pytest.mark.parametrize("total, window, stride, want", [(100, 20, 7, [*range(0, 78, 7), 80]), (10, 64, 8, [0]), (64, 64, 8, [0])])
def test_window_starts(spark, total, window, stride, want):
    df = spark.createDataFrame([(total,)], "num_frames int")
    assert [r["window_start"] for r in streams.window_starts(df, window, stride).collect()] == want


def test_short_video_repeats_last_frame(spark):
    df = spark.createDataFrame([("v", i, float(i)) for i in range(10)], "video_id string, frame_idx int, value double")
    assert streams.pool_windows(df, 64, 8).collect()[0]["value"] == pytest.approx((45 + 54 * 9) / 64)


def test_ward():
    two = np.repeat([[0.0], [1000.0]], 10, axis=0) * np.ones((1, 16))
    assert streams.ward_labels(two, 10).tolist() == [0] * 10 + [1] * 10
    aba = np.repeat([[0.0], [500.0], [0.0]], 8, axis=0) * np.ones((1, 16))
    assert streams.ward_labels(aba, 10).tolist() == [0] * 8 + [1] * 8 + [2] * 8
    assert streams.ward_labels(np.zeros((1, 16)), 10).tolist() == [0]
    assert set(streams.ward_labels(np.ones((30, 4)), 10).tolist()) == {0}


def test_label_runs(spark):
    rows = [("v", i, s, x, 18) for i, (s, x) in enumerate([(0, 0), (5, 0), (10, 1)])]
    df = spark.createDataFrame(rows, "video_id string, window_idx int, window_start int, label int, num_frames int")
    got = streams.runs_from_labels(df).orderBy("start_frame").select("start_frame", "end_frame", "first_window", "last_window").collect()
    assert [tuple(r) for r in got] == [(0, 10, 0, 1), (10, 18, 2, 2)]


def test_intervals(spark):
    df = spark.createDataFrame([("v", 0, 5), ("v", 5, 6), ("v", 1, 2), ("v", 20, 45)], "video_id string, start_s int, end_s int")
    merged = streams.merge_intervals(df, 0, 0)
    assert [tuple(r)[2:] for r in merged.orderBy("start_s").collect()] == [(0, 6), (20, 45)]
    pieces = streams.split_intervals(merged.where("start_s = 20"), 10).orderBy("piece").collect()
    assert len(pieces) == 3 and pieces[-1]["end_s"] == 45


def test_trake_orders_frames(spark):
    segments = spark.createDataFrame([("v", f, [a, b]) for f, a, b in [(10, 0.9, 0.0), (30, 1.0, 0.0), (20, 0.0, 0.8), (5, 0.0, 0.99)]], "video_id string, frame int, vec array<double>")
    events = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "query_id long, event_index int, vec array<double>")
    got = chains.align(segments, events).orderBy("event_index").collect()
    assert [r["frame"] for r in got] == [10, 20] and got[0]["overall_score"] == pytest.approx(0.85)


def test_search_properties(spark):
    x = np.random.default_rng(0).normal(size=(200, 8))
    df = spark.createDataFrame([((500000 + i) * 7, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.limit(10).withColumn("vec", F.transform("vec", lambda v: v * 37)).withColumnRenamed("id", "query_id")
    assert all(r["id"] == r["query_id"] for r in search.knn_exact(df, q, 1).collect())
    assert search.knn_exact(df, q, 500).count() == 2000
    assert search.knn_exact(df, q.limit(0), 5).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.l2_normalize("a"), vectors.l2_normalize("b"), vectors.sq_l2("a", "b"), vectors.cosine("a", "b")).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0.0, 0.0] and r[2] == 25 and r[3] is None


def test_text(spark):
    df = spark.createDataFrame([(3661.9999, "a/b_c_d.mp4", "a/bc.mp4", "Video: h264, 30000/1001 fps", "Video: x, 30/0 fps")], "s double, p string, q string, f string, g string")
    r = df.select(text.timecode(F.col("s")), text.group_key(F.col("p")), text.group_key(F.col("q")), F.round(text.parse_fps(F.col("f")), 2), text.parse_fps(F.col("g"))).first()
    assert tuple(r) == ("01:01:01,999", "b", "a/bc.mp4", 29.97, None)


def test_split_has_no_leak(spark):
    df = spark.createDataFrame([(f"g{i % 20}", i) for i in range(200)], "g string, i int")
    split = dataprep.grouped_split(df, "g", 0.1)
    assert split.where("split = 'val'").select("g").distinct().count() == 2
    assert split.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_validation_rejects(spark):
    good = ("v", 0, 10, 5, [0.0] * 4, "coarse")
    rows = [good, ("v", 10, 10, 10, [0.0] * 4, "coarse"), ("v", 0, 10, 10, [0.0] * 4, "coarse"), ("v", 0, 10, 5, [0.0] * 3, "coarse"), ("v", 0, 10, 5, [0.0] * 4, "odd"), (None, 0, 10, 5, [0.0] * 4, "fine")]
    ok, bad = files.validate_segments(spark.createDataFrame(rows, files.SEGMENT), 4)
    assert (ok.count(), bad.count()) == (1, 5)


def test_no_frames_is_an_error(spark):
    with pytest.raises(Exception, match="no frames"):
        streams.window_starts(spark.createDataFrame([(0,)], "num_frames int"), 64, 8).collect()


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("k", [None, 3])
def test_scores_do_not_depend_on_blocks(spark, metric, k):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "id long, vec array<double>").repartition(1)
    few = rows.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    one, two, other = (sorted(map(tuple, search.scores(rows, few, k, metric=metric, block=n).collect())) for n in (1, 7, 10**6))
    assert one == two == other and len(one) == 10 * (k or 30)
    over = {r["query_id"]: r["n"] for r in search.counts_over(rows, few, 0.2, block=4).collect()}
    cosines = search.scores(rows, few).where("score > 0.2").groupBy("query_id").count().collect()
    assert {q: n for q, n in over.items() if n} == {r["query_id"]: r["count"] for r in cosines}


def test_clip_tasks_read_literals(spark):
    rows = [
        ("a", "[['0:00:01', '0:00:02'], ['0:00:03', '0:00:04']]", """["it's here", 'say "hi"']"""), ("b", "[['1', '2']]", "[' x ', 'y']"),
        ("c", "[broken", "['x']"), ("d", "[['1', '2', '3']]", "['x']"), ("e", None, "['x']"), ("f", "[['1', '2']]", "['tab\\t\\u00e9']"),
    ]
    df = spark.createDataFrame([(v, "u", t, c) for v, t, c in rows], "video_id string, url string, timestamps string, captions string")
    tasks, rejects = dataprep.expand_clip_tasks(df)
    got = {r["clip_id"]: (r["start"], r["caption"]) for r in tasks.collect()}
    assert got == {"a_000": ("0:00:01", "it's here"), "a_001": ("0:00:03", 'say "hi"'), "b_000": ("1", "x"), "f_000": ("1", "tab\té")}
    assert sorted(r["video_id"] for r in rejects.collect()) == ["c", "d", "e"]


def test_query_pack(spark, tmp_path):
    files_ = {
        "query-p1-1-kis.txt": "\n \ta man\n", "query-p1-2-kis.txt": "\n\n", "query-p1-3-QA.txt": "Scene Hỏi one Hỏi what colour?\n", "query-p1-4-qa.txt": "Scene Hỏi  \n",
        "query-p1-5-trake.txt": "E1: run\r\nnote\r\n e2:  jump \r\nE3:", "query-p1-6-odd.txt": "x", "short-kis.txt": "x", "query-p1-7-qa.txt": "no separator",
    }
    for name, text_ in files_.items():
        (tmp_path / name).write_bytes(text_.encode())
    got = {r["file_name"]: r for r in dataprep.read_query_pack(spark, str(tmp_path)).collect()}
    assert got["query-p1-1-kis.txt"]["query"] == "a man" and got["query-p1-1-kis.txt"]["query_id"] == "p1-1"
    assert got["query-p1-3-QA.txt"]["scene"] == "Scene Hỏi one" and got["query-p1-3-QA.txt"]["question"] == "what colour?"
    assert got["query-p1-5-trake.txt"]["events"] == ["run", "jump"]
    errors = {"query-p1-2-kis.txt": "empty query", "query-p1-4-qa.txt": "no question", "query-p1-7-qa.txt": "no question", "query-p1-6-odd.txt": "unknown task", "short-kis.txt": "bad file name"}
    assert {n: r["error"] for n, r in got.items() if r["error"]} == errors
    named = spark.createDataFrame([("pack-x/query-p1-2-kis.txt", "q"), ("a\\query-p2-3-kis.txt", "q")], "file_name string, content string")
    assert [r["query_id"] for r in dataprep.parse_query_pack(named).collect()] == ["p1-2", "p2-3"]


def test_numbered(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(rng.integers(0, 50, 500))], "x int, i int")
    got = dataprep.numbered(df, "x", "i", start=10).collect()
    assert [(r["x"], r["i"]) for r in sorted(got, key=lambda r: r["number"])] == sorted((r["x"], r["i"]) for r in got)
    assert sorted(r["number"] for r in got) == list(range(10, 510)) and dataprep.numbered(df.limit(0), "x").count() == 0


def test_next_valid_wraps(spark):
    rows = [("a", i, i == 2) for i in range(50)] + [("b", i, False) for i in range(3)] + [("c", 0, True), ("c", 1, False)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, fine boolean")
    got = {(r["video_id"], r["frame_idx"]): r["use_idx"] for r in streams.next_valid(df, F.col("fine")).collect()}
    assert len(got) == 55 and got["a", 0] == got["a", 2] == got["a", 49] == got["a", 21] == 2 and got["a", 20] is None and got["a", 3] is None
    assert got["b", 1] is None and got["c", 1] == 0


def test_word_f1(spark):
    answers = spark.createDataFrame([(1, 1, "The red  red car"), (1, 2, ""), (2, 1, " "), (3, 1, "x")], "query_id long, rank int, answer string")
    truth = spark.createDataFrame([(1, "red car red blue"), (2, "")], "query_id long, answer string")
    got = {(r["query_id"], r["rank"]): (r["exact"], r["f1"]) for r in scoring.word_f1(answers, truth).collect()}
    assert got == {(1, 1): (0, 0.75), (1, 2): (0, 0.0), (2, 1): (1, 1.0)}


def test_repair_keeps_a_null_key(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": null, "a": 1}\n{"a": 2}\n{"id": 3}\n{"id": 4, "b\n\n')
    assert files.repair_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")) == (2, 2)


def test_list_file_strips_white_space(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\ta.mp4 \n# note\n \t\n  # kept\u00a0\n")
    assert sorted(r["path"] for r in files.read_list_file(spark, str(tmp_path / "list.txt")).collect()) == ["# kept", "a.mp4"]
