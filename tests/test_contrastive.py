"""Losses by tiles against plain numpy over whole batches."""

import numpy as np
import pytest

from segmentry.operators import contrastive


def plain(x, y, scale):
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    z = scale * x @ y.T
    own = np.diag(z)
    out = []
    for m in (z, z.T):
        out.append((np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1)) + m.max(axis=1) - own, own >= m.max(axis=1)))
    return out


def plain_uniformity(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)[np.triu_indices(len(x), 1)]
    return np.exp(-2 * d)


def table(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows, batches = [], []
    for b, n in enumerate(sizes):
        x = rng.normal(size=(n, 6))
        y = x + rng.normal(size=(n, 6))
        batches.append((x, y))
        rows += [(f"{b}-{i}", b, x[i].tolist(), y[i].tolist(), 1) for i in range(n)]
    return spark.createDataFrame(rows, "id string, step int, x array<double>, y array<double>, tile int").repartition(3), batches


@pytest.mark.parametrize("rows", [1, 7, 1000])
@pytest.mark.parametrize("batch", [None, "step"])
def test_infonce_like_numpy(spark, rows, batch):
    """A third of all rows in one batch, batches of one row."""
    df, batches = table(spark, [25, 1, 13, 2, 9])
    if batch is None:
        batches = [tuple(np.vstack([b[i] for b in batches]) for i in range(2))]
    for scale in (10.0, 600.0):
        (lx, ax), (ly, ay) = ([np.concatenate([plain(x, y, scale)[side][i] for x, y in batches]) for i in range(2)] for side in range(2))
        got = contrastive.infonce(df, scale, batch, rows).first()
        want = (50, lx.mean(), ly.mean(), lx.mean() + ly.mean(), ax.mean(), ay.mean())
        assert tuple(got) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("rows", [4, 1000])
@pytest.mark.parametrize("batch", [None, "step"])
def test_uniformity_like_numpy(spark, rows, batch):
    df, batches = table(spark, [11, 1, 6])
    if batch is None:
        batches = [tuple(np.vstack([b[i] for b in batches]) for i in range(2))]
    want = [np.log(np.concatenate([plain_uniformity(b[i]) for b in batches]).mean()) for i in range(2)]
    got = contrastive.uniformity(df, batch=batch, rows=rows).first()
    assert tuple(got) == pytest.approx((*want, sum(want) / 2), rel=1e-9)


def test_few_or_no_rows(spark):
    df, _ = table(spark, [1])
    assert contrastive.uniformity(df).first()["uniformity"] == 0 and contrastive.infonce(df, 5.0).first()["loss"] == pytest.approx(0)
    none = contrastive.infonce(df.where("false"), 5.0).first()
    assert none["n"] == 0 and none["loss"] is None
