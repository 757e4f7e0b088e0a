"""The segment store on disk: batches, texts and deletes as files of their own, and a table of parameters.

Every append, text change and delete is a numbered folder, so one that runs again replaces itself. The parameters hold each
batch's first id and size: the high-water mark is the greatest id ever given, and a delete never frees one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.operators.dataprep import numbered

TEXTS = ("asr_text", "ocr_text")
_PARAMS = "first_id long, n long, batch int"
_CHANGES = "segment_id long, field string, text string, change int"
_DELETES = "segment_id long, change int"


@dataclass
class SegmentTable:
    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _schema(self) -> str:
        return self.spark.read.parquet(f"{self.path}/fields").first()["fields"]

    def params(self) -> DataFrame:
        return self._read("params", _PARAMS)

    def high_water(self) -> int:
        """The greatest id ever given, 0 before the first."""
        return self.params().agg(F.max(F.col("first_id") + F.col("n") - 1)).first()[0] or 0

    def append(self, rows: DataFrame, batch: int, *order: str) -> tuple[int, int]:
        """``rows`` get ids in ``order`` and go in as ``batch``; (first id, rows). The same batch again replaces its rows: it keeps
        its ids if it was the last, or is no larger than before; else it gets new ones, and the old ones stay unused."""
        before, top, n = self.params().where(F.col("batch") == batch).first(), self.high_water(), rows.count()
        again = before is not None and (n <= before["n"] or before["first_id"] + before["n"] - 1 == top)
        first = before["first_id"] if again else top + 1
        ids = numbered(rows, *order, start=first, name="segment_id")
        ids.select(*[f.strip().split(" ")[0] for f in self._schema().split(",")]).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        size = max(n, before["n"]) if again else n  # ids that were once given stay given
        self.spark.createDataFrame([(first, size)], "first_id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/params/batch={batch}")
        return first, n

    def set_text(self, updates: DataFrame, field: str, change: int) -> None:
        """``updates`` (segment_id, text) of one of ``TEXTS`` as ``change``: later changes win, a null text changes nothing, and of
        several texts for one id in a change the greatest is taken."""
        if field not in TEXTS:
            raise ValueError(f"not a text of a segment: {field}")
        one = updates.where("text is not null").groupBy("segment_id").agg(F.max("text").alias("text"))
        one.withColumn("field", F.lit(field)).write.mode("overwrite").parquet(f"{self.path}/texts/change={change}")

    def delete(self, ids: DataFrame, change: int) -> None:
        ids.select("segment_id").distinct().write.mode("overwrite").parquet(f"{self.path}/deleted/change={change}")

    def rows(self) -> DataFrame:
        """The store as it is now: segment_id, its fields, and both texts."""
        found = self._read("rows", f"{self._schema()}, batch int").join(self._read("deleted", _DELETES), "segment_id", "left_anti")
        last = self._read("texts", _CHANGES).groupBy("segment_id", "field").agg(F.max_by("text", "change").alias("text"))
        wide = last.groupBy("segment_id").agg(*[F.max(F.when(F.col("field") == t, F.col("text"))).alias(f"_{t}") for t in TEXTS])
        joined = found.join(wide, "segment_id", "left")
        for t in TEXTS:
            joined = joined.withColumn(t, F.coalesce(f"_{t}", *([t] if t in found.columns else []))).drop(f"_{t}")
        return joined.drop("batch")

    def unknown(self, updates: DataFrame) -> DataFrame:
        """Ids of ``updates`` that the store does not have."""
        return updates.select("segment_id").distinct().join(self.rows().select("segment_id"), "segment_id", "left_anti")

    def missing_text(self, field: str) -> DataFrame:
        return self.rows().where(F.col(field).isNull())

    def versions(self) -> DataFrame:
        """(batch, first_id, n), and the high-water mark after each."""
        upto = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, 0)  # a row a batch
        return self.params().withColumn("high_water", F.max(F.col("first_id") + F.col("n") - 1).over(upto))


def create(spark: SparkSession, path: str, fields: str) -> SegmentTable:
    """An empty store under ``path`` whose rows have ``fields`` (name type, ...) besides segment_id."""
    spark.createDataFrame([(f"segment_id long, {fields}",)], "fields string").coalesce(1).write.parquet(f"{path}/fields")
    for name, schema in (("rows", f"segment_id long, {fields}"), ("params", _PARAMS.rsplit(",", 1)[0]), ("texts", _CHANGES.rsplit(",", 1)[0]), ("deleted", _DELETES.rsplit(",", 1)[0])):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}/{'batch' if name in ('rows', 'params') else 'change'}=-1")
    return SegmentTable(spark, path)
