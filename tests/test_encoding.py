"""A caller's model: loads, batches, pooling and projection against plain numpy."""

import glob
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.operators import encoding, streams


def loader(folder, how="states"):
    """A model whose loading leaves a file, and whose batches leave their lengths."""

    def make_encoder():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(values):
            with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write(" ".join(str(len(v)) for v in values))
            n = max(map(len, values))
            states, mask = np.zeros((len(values), n, 3)), np.zeros((len(values), n))
            for i, v in enumerate(values):
                for j, x in enumerate(v):
                    states[i, j], mask[i, j] = [float(x), j, 1], 1
            return (states, mask) if how == "states" else states.sum(axis=1)

        return model

    return make_encoder


@pytest.mark.parametrize("pooling", ["first", "mean", None])
def test_texts_like_numpy(spark, tmp_path, pooling):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(map(str, rng.integers(0, 9, rng.integers(1, 12))))) for i in range(200)] + [(200, None)]
    w, b = rng.normal(size=(3, 2)), rng.normal(size=2)
    df = spark.createDataFrame(texts, "id long, text string").repartition(2).withColumn("in", encoding.text_inputs(F.col("text"), 8))
    got = {r["id"]: r["vec"] for r in encoding.encoded(df, "in", loader(tmp_path, "states" if pooling else "vectors"), pooling or "first", w, b, batch=16).collect()}
    for i, t in texts[:-1]:
        x = np.array([[float(t), j, 1] for j, t in enumerate(t.split()[:8])])
        want = (x[0] if pooling == "first" else x.mean(axis=0) if pooling else x.sum(axis=0)) @ w + b
        assert got[i] == pytest.approx(want)
    assert got[200] is None and len(got) == 201
    loads, batches = glob.glob(f"{tmp_path}/load-*"), [list(map(int, open(f).read().split())) for f in glob.glob(f"{tmp_path}/batch-*")]
    assert len(loads) == len({os.path.basename(f).split("-")[1] for f in loads}), "a worker loads once"
    assert all(b == sorted(b) and len(b) <= 16 for b in batches) and sum(map(len, batches)) == 200
    assert sum(b[-1] * len(b) - sum(b) for b in batches) < 200, "little is padded"


def test_windows_like_pooling(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(v, i, float(rng.normal())) for v, n in (("a", 30), ("short", 3), ("one", 1)) for i in range(n)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, value double")
    got = encoding.encoded_windows(frames, loader(tmp_path), 8, 4, pooling="mean").select("video_id", "window_start", "num_frames", F.col("vec")[0].alias("m")).collect()
    want = streams.pool_vectors(frames.select("video_id", "frame_idx", F.array("value").alias("vec")), 8, 4).select("video_id", "window_start", "num_frames", F.col("vec")[0].alias("m")).collect()
    key = lambda r: (r["video_id"], r["window_start"])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (*key(g), g["num_frames"]) == (*key(w), w["num_frames"]) and g["m"] == pytest.approx(w["m"])


def test_unknown_pooling():
    with pytest.raises(ValueError):
        encoding.pooled(np.zeros((1, 1, 1)), np.ones((1, 1)), "max")
