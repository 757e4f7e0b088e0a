"""Values over slices against windows over whole keys; transcripts written and read back."""

import glob
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segmentry.operators import manifest, running, streams, transcripts


def hot(spark, n=400, seed=1):
    """Two thirds of all rows have one key; a null key; values and places that repeat."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.randrange(60), i, rng.choice([None, *range(9)])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, tie int, v int").repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("how", ["sum", "max"])
def test_before_like_a_window(spark, parts, how):
    df = hot(spark)
    got = running.before(running.sliced(df, ["k"], ["t", "tie"], parts), ["k"], ["t", "tie"], how, F.col("v"), "x")
    w = Window.partitionBy("k").orderBy("t", "tie").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("x", getattr(F, how)("v").over(w))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert parts == 1 or got.where("k = 'hot'").select("_slice").distinct().count() > 1


def plain_merge(rows, pad, gap):
    out = []
    for s, e in sorted((max(s - pad, 0), e + pad) for s, e in rows):
        if out and s - max(x[1] for x in out) <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("parts", [1, 9, 50])
def test_intervals_and_runs_over_slices(spark, parts):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "v", s := rng.randrange(3000), s + rng.choice((1, 5, 40))) for i in range(300)] + [("hot", 0, 1500), ("hot", 7, 7), ("hot", 7, 7)]
    df = spark.createDataFrame(rows, "video_id string, start_s int, end_s int")
    for pad, gap in ((0, 0), (2, 3)):
        got = streams.merge_intervals(df, pad, gap, parts).orderBy("video_id", "run").collect()
        for v in ("hot", "v"):
            assert [(r["start_s"], r["end_s"]) for r in got if r["video_id"] == v] == plain_merge([r[1:] for r in rows if r[0] == v], pad, gap)
            assert [r["run"] for r in got if r["video_id"] == v] == list(range(1, 1 + sum(r["video_id"] == v for r in got)))
    labels = [("hot", i, 4 * i, rng.choice((0, 0, 1)), 900) for i in range(200)] + [("v", 0, 0, 5, 3)]
    runs = streams.runs_from_labels(spark.createDataFrame(labels, "video_id string, window_idx int, window_start int, label int, num_frames int"), parts).where("video_id = 'hot'").orderBy("run").collect()
    want = [i for i, x in enumerate(labels[:200]) if i == 0 or labels[i - 1][3] != x[3]]
    assert [r["first_window"] for r in runs] == want and [r["label"] for r in runs] == [labels[i][3] for i in want]
    assert [r["end_frame"] for r in runs] == [4 * i for i in want[1:]] + [900] and [r["run"] for r in runs] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("parts", [1, 12])
def test_stop_rules(spark, parts):
    df = hot(spark).where("k is not null")
    rows = sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[2]))
    for most, budget in ((5, None), (None, 40), (30, 40)):
        got = manifest.capped(df, "k", "tie", most, parts, F.col("v") if budget else None, budget).collect()
        want = set()
        for k in ("a", "b", "hot"):
            n = spent = 0
            for r in (r for r in rows if r[0] == k):
                n, spent = n + 1, spent + (r[3] or 0)
                if (most is None or n <= most) and (budget is None or spent <= budget):
                    want.add((k, r[2], n))
        assert {(r["k"], r["tie"], r["n_new"]) for r in got} == want and len(got) == len(want)


def test_transcripts(spark, tmp_path):
    speech = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.2, 2.0), ("a", 10.0, 75.0), ("b", 0.05, 0.1)], "video_id string, start_s double, end_s double")
    cut = [tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in transcripts.regions(speech).orderBy("video_id", "start_s").collect()]
    assert cut == [("a", 0.3, 2.2), ("a", 9.8, 31.6), ("a", 31.6, 53.4), ("a", 53.4, 75.2), ("b", 0.0, 0.3)]
    said = spark.createDataFrame([("a", 3661.2509, 3662.0, " two\nlines "), ("a", 0.1, 0.9, "one"), ("a", 1.0, 2.0, "  \t"), ("a", 2.0, 3.0, None), ("b", 0.02, 0.06, "ö")], "video_id string, start_s double, end_s double, text string")
    kept = transcripts.kept(said)
    transcripts.write_srt(kept, str(tmp_path / "srt"))
    lines = {v: "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/srt/video_id={v}/*.txt"))) for v in "ab"}
    assert lines["a"] == "1\n00:00:00,100 --> 00:00:00,900\none\n\n2\n01:01:01,251 --> 01:01:02,000\ntwo\nlines\n\n" and lines["b"] == "1\n00:00:00,020 --> 00:00:00,060\nö\n\n"
    back = sorted(tuple(r) for r in transcripts.read_srt(spark, str(tmp_path / "srt")).select("video_id", "cue", "start_s", "end_s", "text").collect())
    assert back == [("a", 1, 0.1, 0.9, "one"), ("a", 2, 3661.251, 3662.0, "two\nlines"), ("b", 1, 0.02, 0.06, "ö")]
    fps = spark.createDataFrame([("a", 30.0), ("b", 25.0), ("c", 25.0)], "video_id string, video_fps double")
    transcripts.write_json(kept, fps, str(tmp_path / "json"))
    assert sorted(tuple(r) for r in transcripts.read_json(spark, str(tmp_path / "json")).collect()) == [("a", 30.0, 3, 27, "one"), ("a", 30.0, 109838, 109860, "two\nlines"), ("b", 25.0, 0, 2, "ö")]
    assert len(glob.glob(f"{tmp_path}/json/video=*/*.json")) == 3
    many = spark.createDataFrame([("v", float(i), i + 0.5, f"t{i}") for i in range(300)], "video_id string, start_s double, end_s double, text string")
    for parts in (1, 11):
        assert [r["cue"] for r in transcripts.cues(many, parts).orderBy("start_s").collect()] == list(range(1, 301))
