"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines of fixed random directions, which approximates a
Gaussian kernel. Every task sums z z' and z y over its labelled rows; Spark adds these sums by cell, and the driver solves
one small system. Raw scores of held-back training rows are counted in bins, and pooling adjacent violators over the
bins gives the calibrated score.

Only numbers travel: statistics and labels are joined, texts are never shuffled.

Defined cases: null and empty texts have all statistics zero and are scored like any other; very long texts are counted
whole, piece by piece (a task holds their distinct words and lines); null or repeated ids are scored each and null ids
never train; several labels of one id are averaged; rows of equal statistics get equal scores; without labels all scores
are 0.5; columns other than doc_id and text, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from segmentry.llm.common import crc_mod, read, stored

DIRECTIONS, WIDTH, RIDGE, BINS, SEED = 128, 4.0, 1.0, 400, 7
PIECE_BYTES = 1 << 20
_SPACE, _LINE = re.compile(rb"[ \t-\r]"), re.compile(rb"\n")
N_STATS = 13
_KINDS = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&|<>", b"!", b".,;:?", b"\n", bytes(range(128, 256)), b"|"]
_CLASS = np.stack([np.isin(np.arange(256), list(kind)) for kind in _KINDS]).astype(np.float64)


def _pieces(text: bytes, cut: re.Pattern, size: int) -> Iterator[bytes]:
    """Stretches of ``text`` that end before a match of ``cut``."""
    at = 0
    while at < len(text):
        found = cut.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def statistics(text: bytes, piece: int = PIECE_BYTES) -> np.ndarray:
    """Statistics of a whole text; it is read in pieces that end between words or lines, which does not change them."""
    if not text:
        return np.zeros(N_STATS)
    n_words = doubled = lines = 0
    seen, seen_lines, last = set(), set(), None
    for part in _pieces(text, _SPACE, piece):
        words = part.split()
        if words:
            n_words += len(words)
            doubled += (words[0] == last) + sum(map(bytes.__eq__, words, words[1:]))
            seen.update(words)
            last = words[-1]
    for part in _pieces(text, _LINE, piece):
        rows = [x for x in part.split(b"\n") if x]
        lines += len(rows)
        seen_lines.update(rows)
    distinct, repeated = len(seen), lines - len(seen_lines)
    upper, lower, digit, symbol, shout, stop, line, wide, bar = _CLASS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, w = len(text), max(n_words, 1)
    return np.array([
        np.log1p(n), np.log1p(n_words), min(n / w, 50), upper / max(upper + lower, 1), digit / n, symbol / w, shout / w,
        stop / w, line / w, wide / n, bar / w, distinct / w + repeated / max(lines, 1), doubled / w,
    ])


@F.arrow_udf(ArrayType(DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid and t.as_py() else b"") for t in texts.cast(pa.binary())]
    flat = np.concatenate([*rows, np.zeros(0)])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS, dtype=np.int32)), pa.array(flat))


class Model:
    def __init__(self, mean, spread, weights=None, knots=((0.0,), (0.5,))):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = np.array(mean), np.array(spread)
        self.axes, self.shift = rng.normal(size=(N_STATS, DIRECTIONS)) / WIDTH, rng.uniform(0, 2 * np.pi, DIRECTIONS)
        self.weights, self.knots = weights, knots

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / DIRECTIONS) * np.cos(x @ self.axes + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots) if self.weights is not None else np.full(len(x), 0.5)


def pooled(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for p, n in zip(positives, counts):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks])


def fit(labelled: DataFrame) -> Model | None:
    """``labelled``: stats, y, part (0: calibrates, else fits)."""
    of = [F.col("stats")[i] for i in range(N_STATS)]
    row = labelled.agg(*[F.avg(c) for c in of], *[F.stddev_pop(c) for c in of], F.count(F.lit(1))).first()
    if not row[-1]:
        return None
    model = Model(row[:N_STATS], [s if s > 1e-9 else 1.0 for s in row[N_STATS:-1]])

    def sums(batches):
        total = np.zeros((DIRECTIONS + 1, DIRECTIONS + 2))
        for batch in batches:
            if len(batch):
                z = model.features(np.stack(batch["stats"]))
                total += z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        i, j = np.nonzero(np.triu(np.ones_like(total)))
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    fitted = labelled.where("part <> 0").select("stats", "y").mapInPandas(sums, "i int, j int, v double")
    cells = fitted.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((DIRECTIONS + 1, DIRECTIONS + 2))
    whole[cells["i"], cells["j"]] = cells["v"]
    gram = np.triu(whole[:, :-1]) + np.triu(whole[:, :-1], 1).T
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(DIRECTIONS + 1), whole[:, -1])

    def binned(batches):
        for batch in batches:
            if len(batch):
                raw = model.raw(np.stack(batch["stats"]))
                yield pd.DataFrame({"bin": np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1), "y": batch["y"]})

    held = labelled.where("part = 0").select("stats", "y").mapInPandas(binned, "bin int, y double")
    bins = held.groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    if len(bins):
        model.knots = ((bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, pooled(bins["y"].to_numpy(), bins["n"].to_numpy()))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    known = stored(docs.select("doc_id", crc_mod("doc_id", 5).alias("fold"), _statistics("text").alias("stats")), "statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    train = known.where("fold <> 0").join(marks, "doc_id").select("stats", "y", (F.col("fold") - 1).alias("part"))
    model = fit(stored(train, "labelled"))

    @F.arrow_udf(DoubleType())
    def score(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
        return pa.array(model.score(x) if model else np.full(len(x), 0.5))

    out = known.select("doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_model(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
