"""Texts go to Python in small Arrow batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmentry.llm import bpe, common, langid, near_dedup, similar_dedup

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
STEPS = {
    "language_id": lambda docs: langid.predicted(docs, "text", [(["en"], np.full((langid.pieces(langid.default_vocabulary()).n, 1), 0.5))]),
    "fingerprints": lambda docs: near_dedup.fingerprints(common.with_row_key(docs)),
    "near_dedup": lambda docs: similar_dedup.similar_groups(common.with_row_key(docs)),
    "bpe": bpe.round_trips,
}


@pytest.mark.parametrize("step", STEPS)
def test_a_worker_holds_few_texts_at_once(spark, make, step):
    docs = make([(i, f"{i} " + "word " * 20_000, "en", "a") for i in range(150)]).coalesce(1)
    size = F.arrow_udf(lambda texts: pa.array([texts.nbytes] * len(texts)), "long")
    try:
        spark.conf.unset(SETTING)
        STEPS[step](docs)
        assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 3 * common.BATCH_BYTES
        sizes = docs.select(size("text").alias("n")).distinct().collect()
        assert max(r["n"] for r in sizes) < common.BATCH_BYTES + 200_000
        spark.conf.set(SETTING, "8m")
        STEPS[step](docs)
        assert spark.conf.get(SETTING) == "8m"
    finally:
        spark.conf.unset(SETTING)
