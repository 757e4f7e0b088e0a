"""A stored vector index: rows as Parquet by batch and cell, centroids and parameters as tables beside them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.vectors import l2_normalize
from segmentry.operators import search as find

#: Cells grow with the square root of the rows up to this many; the centroids are held by the driver and by each task.
MOST_CELLS = 4096


@dataclass
class Index:
    #: ``centroids`` were fitted on rows whose mean squared distance to them was ``spread``.
    path: str
    dim: int
    nprobe: int
    centroids: list = field(repr=False)
    spread: float = 0.0

    def rows(self, spark: SparkSession, unit: bool = True) -> DataFrame:
        """(id, vec, batch, cell_id): vectors of unit length, or as they were given, which is how they are stored."""
        given = spark.read.schema("id long, vec array<double>, batch int, cell_id int").parquet(f"{self.path}/rows")
        return given.withColumn("vec", l2_normalize("vec")) if unit else given


def build(rows: DataFrame, path: str, cells: int | None = None, k: int = 5, least: float = 0.9, measure: bool = True) -> Index:
    """An index of ``rows`` (id, vec) under ``path``; all of them are in it.

    Centroids are fitted on a bounded sample; about sqrt(rows) of them unless ``cells`` says how many. nprobe, the number of
    cells a search looks at, is the least that finds ``least`` of the ``k`` nearest of sampled rows by exact search; without
    ``measure`` it is all of them."""
    spark = rows.sparkSession
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        raise ValueError("no rows to build an index from")
    cells = min(cells or max(int(n**0.5), 1), MOST_CELLS, n)
    index = Index(path, dim, 0, *find.train_cells(rows.withColumn("vec", l2_normalize("vec")), cells))
    add(index, rows, 0)
    index.nprobe = find.probes(index.rows(spark, unit=False), index.centroids, k, least) if measure else len(index.centroids)
    spark.createDataFrame(list(enumerate(index.centroids)), "cell_id int, center array<double>").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(dim, index.nprobe, index.spread)], "dim int, nprobe int, spread double").coalesce(1).write.parquet(f"{path}/params")
    return index


def load(spark: SparkSession, path: str) -> Index:
    params = spark.read.parquet(f"{path}/params").first()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell_id").collect()  # at most MOST_CELLS
    return Index(path, params["dim"], params["nprobe"], [c["center"] for c in cells], params["spread"])


def add(index: Index, rows: DataFrame, batch: int) -> None:
    """Rows (id, vec) go into the cells of the index as batch number ``batch``; a batch that runs again replaces itself.
    A vector of another size is an error."""
    size = F.size("vec")
    fits = F.when(size == index.dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("size of a vector: "), size.cast("string"))).cast(rows.schema["vec"].dataType))
    given = rows.select(F.col("id").cast("long").alias("id"), fits.cast("array<double>").alias("vec"))
    placed = find.nearest_cells(given, index.centroids, 1, unit=True)
    # by ranges, so a large cell is spread over tasks and a task writes few files
    placed.repartitionByRange("cell_id", "id").sortWithinPartitions("cell_id").write.partitionBy("cell_id").mode("overwrite").parquet(f"{index.path}/rows/batch={batch}")


def drift(index: Index, spark: SparkSession, batch: int) -> float | None:
    """How far the rows of a batch lie from their centroids, against the rows that these were fitted on: 1 is as near."""
    own = find.spread(index.rows(spark).where(F.col("batch") == batch), index.centroids)
    return None if own is None else own / max(index.spread, 1e-12)


def trained_again(index: Index, spark: SparkSession, path: str, most: float = 1.5, **how) -> Index:
    """``index`` itself while no batch's drift is over ``most``; else a new one under ``path``, fitted on all rows."""
    batches = [r["batch"] for r in index.rows(spark).select("batch").distinct().collect()]
    if all((drift(index, spark, b) or 0) <= most for b in batches if b):
        return index
    return build(index.rows(spark, unit=False).select("id", "vec"), path, **how)


def search(index: Index, queries: DataFrame, k: int = 5, nprobe: int | None = None, normalize: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best in the ``nprobe`` nearest cells of each query (query_id, vec), by cosine, or
    without ``normalize`` by the inner product of the vectors as they were given."""
    return find.knn_ivf(index.rows(queries.sparkSession, unit=False), queries, index.centroids, k, nprobe or index.nprobe, normalize=normalize)
