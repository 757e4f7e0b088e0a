"""Contrastive losses over whole tables or given batches: log-sum-exp merged tile by tile, so scores are never rows.

The rows of a batch are cut into tiles; every tile of one side meets every tile of the other of the same batch, and gives each
of its rows, in both directions, the greatest score, the sum of exponentials under it, and whether a negative comes first.
These are merged by a second pass over a few numbers a row. Without a batch column the whole table is one batch: its work is
then quadratic, in tiles that are dealt over all tasks; ``tiles`` tiles a batch bound what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.operators import tiles


def _sides(pairs: DataFrame, batch: str | None, names: list[str], rows: int) -> tuple[list[DataFrame], int, int]:
    """Each of the vector columns ``names`` of ``pairs`` (id) as unit vectors in tiles (batch, tile, ids, vecs)."""
    of = F.lit(0) if batch is None else F.col(batch)
    whole = pairs.select(of.alias("batch"), "id", *names)
    most = whole.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    dim = tiles.size_of(whole, names[0])[1]
    parts = max(1, -(-most // rows))
    for name in names:
        whole = tiles.whole(whole, dim, name)
    return [tiles.by_key(whole.select("batch", "id", F.col(name).alias("vec")), "batch", parts) for name in names], parts, dim


def _grid(a: DataFrame, b: DataFrame, parts: int) -> DataFrame:
    """All pairs of tiles of one batch: (batch, a_tile, a_ids, a, b_tile, b_ids, b)."""
    named = lambda df, side: df.select("batch", F.col("tile").alias(f"{side}_tile"), F.col("ids").alias(f"{side}_ids"), F.col("vecs").alias(side))
    left = named(a, "a").withColumn("b_tile", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(named(b, "b"), ["batch", "b_tile"])


def _unit(flat, n: int) -> np.ndarray:
    m = tiles.matrix(flat, n)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _log_sum(parts: str) -> Column:
    """Of a list of (top, mass): the log of the sum of all exponentials."""
    top = F.array_max(F.transform(parts, lambda p: p["top"]))
    return top + F.log(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["mass"] * F.exp(p["top"] - top)))


def infonce(pairs: DataFrame, scale: float, batch: str | None = None, rows: int = tiles.TILE, digits: int | None = None) -> DataFrame:
    """One row: n, loss_row, loss_col, loss (their sum), acc_row, acc_col, of ``pairs`` (id, x, y and ``batch``): cross-entropies
    of ``scale`` times the cosines of each x with all y of its batch, and of each y with all x. A pair is right if no other
    score of its batch is greater. ``digits`` rounds cosines. Ids are unique within a batch; null and NaN without rows."""
    (left, right), parts, _ = _sides(pairs, batch, ["x", "y"], rows)
    kind = pairs.schema["id"].dataType.simpleString()
    of = left.schema["batch"].dataType.simpleString()

    def both_ways(row: pd.Series) -> Iterator[pd.DataFrame]:
        a, b = np.asarray(row["a_ids"]), np.asarray(row["b_ids"])
        x, y = _unit(row["a"], len(a)), _unit(row["b"], len(b))
        own = np.full((2, max(len(a), len(b))), np.nan)
        at, place = np.full(len(a), -1), np.intersect1d(a, b, return_indices=True)[1:]
        at[place[0]] = place[1]
        tops, masses = np.full(len(b), -np.inf), np.zeros(len(b))
        for some in tiles.steps(len(a), len(b)):
            z = x[some] @ y.T
            z = scale * (z if digits is None else np.round(z, digits))
            i = np.flatnonzero(at[some] >= 0)
            j = at[some][i]
            own[0, i + some.start] = own[1, j] = z[i, j]
            top = z.max(axis=1)
            yield pd.DataFrame({"batch": row["batch"], "side": 0, "id": a[some], "top": top, "mass": np.exp(z - top[:, None]).sum(axis=1), "own": own[0, : len(a)][some]})
            top = np.maximum(tops, z.max(axis=0))
            tops, masses = top, masses * np.exp(tops - top) + np.exp(z - top).sum(axis=0)
        yield pd.DataFrame({"batch": row["batch"], "side": 1, "id": b, "top": tops, "mass": masses, "own": own[1, : len(b)]})

    found = tiles.each_pair(_grid(left, right, parts), both_ways, f"batch {of}, side int, id {kind}, top double, mass double, own double")
    each = found.groupBy("batch", "side", "id").agg(F.collect_list(F.struct("top", "mass")).alias("parts"), F.max(F.nanvl("own", F.lit(None))).alias("own"))  # a part a tile
    each = each.select("side", (_log_sum("parts") - F.col("own")).alias("loss"), (F.col("own") >= F.array_max(F.transform("parts", lambda p: p["top"]))).alias("ok"))
    of_side = lambda c, side: F.avg(F.when(F.col("side") == side, c))
    return each.agg(
        F.count_if(F.col("side") == 0).alias("n"), *[of_side(F.col("loss"), i).alias(f"loss_{s}") for i, s in enumerate(("row", "col"))],
        (of_side(F.col("loss"), 0) + of_side(F.col("loss"), 1)).alias("loss"), *[of_side(F.col("ok").cast("double"), i).alias(f"acc_{s}") for i, s in enumerate(("row", "col"))],
    )


def uniformity(pairs: DataFrame, sides=("x", "y"), batch: str | None = None, rows: int = tiles.TILE, digits: int | None = None) -> DataFrame:
    """One row with a column a side and their mean, uniformity: log of the mean of exp(-2 d^2) over all pairs of different rows of a
    batch, on unit vectors; 0 where no batch has two rows."""
    own, parts, _ = _sides(pairs, batch, list(sides), rows)

    def total(row: pd.Series) -> Iterator[pd.DataFrame]:
        a, b = _unit(row["a"], len(row["a_ids"])), _unit(row["b"], len(row["b_ids"]))
        n, e = 0, 0.0
        for own in tiles.steps(len(a), len(b)):
            x = a[own] @ b.T
            if digits is not None:
                x *= 10.0**digits
                np.rint(x, out=x)
                x *= 10.0**-digits
            x *= 4  # -2 d^2 is 4 x - 4
            x -= 4
            np.exp(x, out=x)
            if row["a_tile"] == row["b_tile"]:
                x = x[np.arange(len(b))[None] > np.arange(len(a))[own, None]]
            n, e = n + x.size, e + x.sum()
        yield pd.DataFrame({"n": [n], "e": [e]})

    def one(side: DataFrame, name: str) -> DataFrame:
        found = tiles.each_pair(_grid(side, side, parts).where("a_tile <= b_tile"), total, "n long, e double")
        return found.agg(F.coalesce(F.log(F.try_divide(F.sum("e"), F.sum("n"))), F.lit(0.0)).alias(name))

    out = one(own[0], sides[0])
    for side, name in zip(own[1:], sides[1:]):
        out = out.join(one(side, name))  # tables of one row
    return out.withColumn("uniformity", sum(F.col(s) for s in sides) / len(sides))
