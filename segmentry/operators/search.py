"""Exact and approximate nearest neighbours, fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions.vectors import inner_product, l2_normalize, rounded, sq_l2  # noqa: F401
from segmentry.operators import tiles
from segmentry.sources.files import stored

#: Query vectors in a block.
BLOCK = 4096


def top_k(scored: DataFrame, k, score: str = "score", ascending: bool = False) -> DataFrame:
    """The first ``k`` rows of each query_id; ties go to the smaller id. Adds rank."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)


def _scaled(m: np.ndarray, unit: bool) -> np.ndarray:
    """Rows of unit length if ``unit``, else as they are; a zero row stays zero."""
    if not unit:
        return m
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _by_blocks(corpus: DataFrame, queries: DataFrame, metric: str, normalize: bool, block: int, each, fields: str, *keep: str) -> DataFrame:
    """``each(query ids, corpus ids, scores, columns keep of queries)`` for every tile of ``corpus`` (id, vec) and block of ``queries``.

    Blocks of about ``block`` queries, cut by a hash of query_id, meet every tile: by broadcast, the corpus staying where it lies,
    while all of them are small, else both sides are dealt out and every part meets every part. No vector goes through the driver's Python. Null vectors, and
    vectors with a null, are left out; sizes that differ, and an empty corpus, are errors."""
    unit = normalize and metric == "ip"
    n, dim = tiles.size_of(queries)
    kinds = ", ".join(f"{c} {df.schema[k].dataType.simpleString()}" for c, df, k in (("query_id", queries, "query_id"), ("id", corpus, "id")) if c in fields.split(", "))
    schema = ", ".join(x for x in (kinds, *(f for f in fields.split(", ") if " " in f)) if x)
    if not n:
        return corpus.sparkSession.createDataFrame([], schema)
    if corpus.isEmpty():
        raise ValueError("the corpus is empty")
    blocks = -(-n // block)

    def scored(row: pd.Series) -> Iterator[pd.DataFrame]:
        c, every = _scaled(tiles.matrix(row["ids_vecs"], len(row["ids"])), unit), _scaled(tiles.matrix(row["vecs"], len(row["query_ids"])), unit)
        for own in tiles.steps(len(every), len(c)):
            q = every[own]
            score = q @ c.T
            if metric != "ip":
                score = (q**2).sum(1)[:, None] - 2 * score + (c**2).sum(1)[None]
            score *= 1e6  # np.round, without its copies
            np.rint(score, out=score)
            score /= 1e6
            score += 0.0
            yield each(row["query_ids"][own], row["ids"], score, *(row[c][own] for c in keep))

    asked = tiles.whole(queries.select(F.col("query_id").alias("id"), "vec", *keep), dim).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = tiles.by_key(asked, "part", 1, *keep).select("part", F.col("ids").alias("query_ids"), "vecs", *keep)
    lying = tiles.where_they_lie(tiles.whole(corpus.select("id", "vec"), dim), dim).withColumnRenamed("vecs", "ids_vecs")
    if 8 * n * dim > tiles.BROADCAST_BYTES:
        return tiles.each_pair(tiles.crossed(lying, asked, corpus.count(), n), scored, schema)
    lying = lying.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return tiles.each_pair(lying.join(F.broadcast(asked), "part"), scored, schema)


def _best(names, ids, score: np.ndarray, k: int | None, falling: bool = True) -> pd.DataFrame:
    """(query_id, id, score): all, or the best ``k`` a query; ties go to the smaller id."""
    if k is None:
        return pd.DataFrame({"query_id": np.repeat(names, len(ids)), "id": np.tile(ids, len(names)), "score": score.ravel()})
    key, place = -score if falling else score, pd.factorize(np.asarray(ids), sort=True)[0]
    edge = np.partition(key, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1, None] if len(ids) else key
    row, at = np.nonzero(~(key > edge))  # with ties at the edge, and NaN
    order = np.lexsort((place[at], key[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[first], at[first]
    return pd.DataFrame({"query_id": np.asarray(names)[row], "id": np.asarray(ids)[at], "score": score[row, at]})


def scores(corpus: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "ip", normalize: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score): ``corpus`` (id, vec), ``queries`` (query_id, vec), a batch; all rows, or the best ``k`` a
    query of each tile of the corpus."""
    return _by_blocks(corpus, queries, metric, normalize, block, lambda names, ids, score: _best(names, ids, score, k, metric == "ip"), "query_id, id, score double")


def counts_over(corpus: DataFrame, queries: DataFrame, floor: float, normalize: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, n): rows of ``corpus`` whose inner product with the query is over ``floor``; counted in the tasks, then added."""

    def count(names, ids, score):
        return pd.DataFrame({"query_id": names, "n": (score > floor).sum(axis=1)})

    local = _by_blocks(corpus, queries, "ip", normalize, block, count, "query_id, n long")
    return local.groupBy("query_id").agg(F.sum("n").alias("n"))


def own_places(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, place): ``pairs`` (id, x, y); by inner product with x, 1 and how many y of all pairs come before the best of its own
    id; ties go to the smaller id. All pairs are asked; tasks count, and only a number a query and task is shuffled. A null product
    comes before nothing, and nothing before it."""
    same = pairs.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("p"))  # one, unless an id is repeated
    best = F.array_max(F.flatten(F.transform("p", lambda a: F.transform("p", lambda b: rounded(inner_product(a["x"], b["y"]), 6)))))
    asked = same.select(F.col("id").alias("query_id"), best.alias("own"), F.explode("p.x").alias("vec"))

    def ahead(names, ids, score, own):
        own, ids, names = own[:, None], np.asarray(ids), np.asarray(names)
        n = np.array([np.count_nonzero(more) for more in score > own])  # rows one by one are faster than an axis
        row, at = np.divmod(np.flatnonzero(score == own), len(ids))
        n += np.bincount(row[ids[at] < names[row]], minlength=len(n))
        here = np.flatnonzero(np.isin(names, ids))
        row, at = np.nonzero(names[here, None] == ids[None])  # its own is not before itself, whatever the last bit of a product
        n -= np.bincount(here[row[score[here[row], at] > own[here[row], 0]]], minlength=len(n))
        return pd.DataFrame({"query_id": names, "n": n})

    counted = _by_blocks(pairs.select("id", F.col("y").alias("vec")), asked, "ip", False, block, ahead, "query_id, n long", "own")
    before = counted.groupBy("query_id").agg(F.sum("n").alias("n"))
    ids = pairs.select("id").distinct()
    return ids.join(before.withColumnRenamed("query_id", "id"), "id", "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("place"))


def knn_exact(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "ip", normalize: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of ``corpus`` (id, vec) for each of ``queries`` (query_id, vec), a batch.

    Tasks keep k a query and block, so only those are shuffled."""
    return top_k(scores(corpus, queries, k, metric, normalize), k, ascending=metric != "ip")


def train_cells(corpus: DataFrame, cells: int = 16, sample: int = 100_000, seed: int = 0, rounds: int = 10) -> tuple[list[list[float]], float]:
    """Centroids of ``corpus`` (id, vec) by k-means, and the mean squared distance to the nearest one.

    Fitted on about ``sample`` rows, taken by a hash threshold; each round every task sums its rows by cell, and Spark adds the
    sums, so no task sees more than its share. An empty cell keeps its centroid."""
    n = corpus.count()
    chosen = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30)
    points = stored(corpus.where(chosen).select("id", "vec"), "points")
    starts = points.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(cells).collect()
    centers, spread = np.array([r["vec"] for r in starts], np.float64), 0.0

    def sums(batches, centers):
        total, inertia = np.zeros((len(centers), centers.shape[1] + 1)), 0.0
        for rows in batches:
            for at in range(0, len(rows), tiles.TILE):
                x = np.stack(rows["vec"][at : at + tiles.TILE]).astype(np.float64)
                near = _nearest(x, centers, 1)[:, 0]
                np.add.at(total, near, np.hstack([x, np.ones((len(x), 1))]))
                inertia += ((x - centers[near]) ** 2).sum()
        used = np.flatnonzero(total[:, -1])
        if len(used):  # else the task has no rows
            yield pd.DataFrame({"cell": used, "total": list(total[used]), "inertia": np.where(np.arange(len(used)) == 0, inertia, 0.0)})

    for _ in range(rounds):
        found = points.mapInPandas(lambda batches, c=centers: sums(batches, c), "cell int, total array<double>, inertia double")
        places = found.select("cell", "inertia", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"), F.sum(F.when(F.col("at") == 0, F.col("inertia"))).alias("inertia"))
        cell_at = places.toPandas()  # cells x dimensions, whatever the number of rows
        total = np.zeros((len(centers), centers.shape[1] + 1))
        total[cell_at["cell"], cell_at["at"]] = cell_at["x"]
        own = total[:, -1] > 0
        centers = centers.copy()
        centers[own] = total[own, :-1] / total[own, -1:]
        spread = float(cell_at["inertia"].sum() / max(total[:, -1].sum(), 1))
    return centers.tolist(), spread


def spread(rows: DataFrame, centroids: list[list[float]]) -> float | None:
    """Mean squared distance of ``rows`` (vec) to the nearest centroid; null without rows."""
    centers = np.asarray(centroids, np.float64)

    def local(batches):
        for own in batches:
            if not own.empty:
                x = np.stack(own["vec"]).astype(np.float64)
                yield pd.DataFrame({"n": [len(x)], "d": [((x - centers[_nearest(x, centers, 1)[:, 0]]) ** 2).sum()]})

    found = rows.select("vec").mapInPandas(local, "n long, d double").agg(F.sum("d") / F.sum("n")).first()
    return found[0]


def with_cells(df: DataFrame, centroids: list[list[float]], n: int, unit: bool = False) -> DataFrame:
    """Adds cells, the numbers of the ``n`` centroids nearest to vec, or with ``unit`` to vec at unit length, nearest first (a
    bounded number of them is broadcast)."""
    given = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))

    def local(batches):
        c = given.value
        for rows in batches:
            for own in tiles.steps(len(rows), len(c)):
                some = rows.iloc[own]
                yield some.assign(cells=list(_nearest(_scaled(np.stack(some["vec"]).astype(np.float64), unit), c, n)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(local, f"{fields}, cells array<int>")


def nearest_cells(df: DataFrame, centroids: list[list[float]], n: int, unit: bool = False) -> DataFrame:
    """Adds cell_id: one row for each of the ``n`` nearest centroids."""
    return with_cells(df, centroids, n, unit).select(*df.columns, F.explode("cells").alias("cell_id"))


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first; ties go to the smaller number."""
    near = np.empty((len(x), min(n, len(centroids))), np.int32)
    size = (centroids**2).sum(1)[None]
    for own in tiles.steps(len(x), len(centroids)):
        d = size - 2 * x[own] @ centroids.T
        near[own] = d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return near


def probes(index: DataFrame, centroids, k: int = 5, least: float = 0.9, sample: int = 1000) -> int:
    """The fewest cells whose search finds ``least`` of the true ``k`` nearest, measured against exact search.

    The queries are a bounded sample of the rows of ``index`` (id, vec, cell_id), each without itself as a neighbour."""
    asked = index.orderBy(F.xxhash64("id")).limit(sample).select(F.col("id").alias("query_id"), "vec")
    true = knn_exact(index, asked, k + 1).where("id != query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    ranked = with_cells(asked, centroids, len(centroids), unit=True).select("query_id", "cells")
    place = (F.array_position("cells", F.col("cell_id")) - 1).alias("place")
    found = true.join(index.select("id", "cell_id"), "id").join(ranked, "query_id").groupBy(place).count()
    hits = {r["place"]: r["count"] for r in found.collect()}  # at most a row a cell
    reached = np.cumsum([hits.get(i, 0) for i in range(len(centroids))])
    return int(np.searchsorted(reached, least * reached[-1])) + 1 if reached[-1] else len(centroids)


def knn_ivf(index: DataFrame, queries: DataFrame, centroids, k: int, nprobe: int, block: int = BLOCK, normalize: bool = True) -> DataFrame:
    """``index`` (id, vec, cell_id): a query is compared with the rows of its ``nprobe`` nearest cells, by cosine, or without
    ``normalize`` by the inner product of the vectors as they are. Cells are nearest to the query at unit length.

    Rows lie by cell, and tiles of them meet the blocks of queries that probe their cell: by broadcast while these are small,
    else by a shuffle of both on the cell. Tasks keep k a query and tile. Where all cells are probed, no query is repeated for
    each of them: blocks of queries meet all tiles."""
    n, dim = tiles.size_of(queries)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"
    if not n:
        return top_k(index.sparkSession.createDataFrame([], kinds), k)
    if nprobe >= len(centroids):
        return top_k(scores(index, queries, k, normalize=normalize, block=block), k)
    near = stored(with_cells(tiles.whole(queries.select(F.col("query_id").alias("id"), "vec"), dim), centroids, nprobe, unit=True), "probed")
    probed = near.select("id", "vec", F.explode("cells").alias("cell_id"))
    asked = tiles.by_key(probed, "cell_id", -(-n // block)).select("cell_id", F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"))
    cells = [r["cell_id"] for r in probed.select("cell_id").distinct().collect()]  # MOST_CELLS of the index at most
    rows = index.where(F.col("cell_id").isin(cells)) if len(cells) < len(centroids) else index

    def scored(row: pd.Series) -> Iterator[pd.DataFrame]:
        every, c = _scaled(tiles.matrix(row["query_vecs"], len(row["query_ids"])), normalize), _scaled(tiles.matrix(row["vecs"], len(row["ids"])), normalize)
        for own in tiles.steps(len(every), len(c)):
            yield _best(row["query_ids"][own], row["ids"], np.round(every[own] @ c.T, 6) + 0.0, k)

    pairs = tiles.met(tiles.where_they_lie(rows, dim, "cell_id"), asked, ["cell_id"], 8 * n * nprobe * dim)
    return top_k(tiles.each_pair(pairs, scored, kinds), k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, hits, truth) of two tables (query_id, id)."""
    hits = exact.join(approx.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("truth"))


def rrf(a: DataFrame, b: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, rank)."""
    score = F.coalesce(1 / (c + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (c + F.col("rb")), F.lit(0.0))
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full")
    return top_k(both.select("query_id", "id", F.round(score, 6).alias("score")), k)
