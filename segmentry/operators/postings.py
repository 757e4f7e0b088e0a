"""A stored inverted index, and Okapi search in it.

Documents are taken in blocks as they lie; a row of the index is a term in a block: the ids, counts and lengths of the
block's documents that have it, and beside them the greatest count and smallest length (no document of the block can weigh
more) and the heaviest document. A term of every document is thus as many rows as there are blocks, in as many tasks. Rows
lie by batch and hash of the term, sorted, so a search reads the terms that are asked for and little else.

Search reads the small columns first. They give each term's weight, a score that the k best of a query surely reach, and the
most that a document of each block can score; the lists are read only of blocks that can reach that score. They are scored
block by block, and k rows a query and block are merged. No document is lost by it: the bound holds for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions.text import tokens
from segmentry.operators.search import top_k
from segmentry.sources.files import stored

K1, B = 1.2, 0.75
BLOCK_DOCS, BUCKETS = 1024, 64
#: Rows of (term, weight) or (block) that are broadcast; more are joined by shuffle.
SMALL = 500_000


@dataclass
class Postings:
    path: str

    def rows(self, spark: SparkSession) -> DataFrame:
        kind = spark.read.parquet(f"{self.path}/lengths").first()["id_kind"]
        return spark.read.schema(f"{_schema(kind)}, batch int, bucket int").parquet(f"{self.path}/postings")

    def size(self, spark: SparkSession) -> tuple[int, float]:
        """Documents, and their mean length."""
        row = spark.read.parquet(f"{self.path}/lengths").agg(F.sum("n"), F.sum("words")).first()
        return row[0] or 0, (row[1] or 0) / max(row[0] or 0, 1)


def _schema(kind: str) -> str:
    return f"term string, block long, n long, max_tf int, min_words int, top_tf int, top_words int, ids array<{kind}>, tf array<int>, words array<int>"


def weight(tf: Column, words: Column, mean: float, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / F.lit(mean or 1.0)))


def _inverted(block: list[tuple[pa.Array, pa.Array]], number: int) -> pa.RecordBatch:
    """The rows of one block of documents: ids and lists of words."""
    ids, lists = (pa.concat_arrays([part[i] for part in block]) for i in range(2))
    words = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), words)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + doc, return_counts=True)
    term, doc = key // max(len(ids), 1), key % max(len(ids), 1)
    length = words[doc].astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(starts, len(term)).astype(np.int32))
    share = tf / (tf + K1 * (1 - B + B * length / max(words.mean(), 1))) if len(tf) else np.zeros(0)
    order = np.lexsort((share, term))  # the heaviest document of a term comes last
    top = order[np.append(starts[1:], len(term)) - 1] if len(starts) else starts
    lists_of = lambda x: pa.ListArray.from_arrays(offsets, x)
    edge = lambda f, x: f.reduceat(x, starts).astype(np.int32) if len(starts) else x[:0].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), number)), pa.array(np.diff(np.append(starts, len(term)))),
            pa.array(edge(np.maximum, tf)), pa.array(edge(np.minimum, length)), pa.array(tf[top].astype(np.int32)), pa.array(length[top]),
            lists_of(ids.take(pa.array(doc))), lists_of(pa.array(tf.astype(np.int32))), lists_of(pa.array(length)),
        ],
        ["term", "block", "n", "max_tf", "min_words", "top_tf", "top_words", "ids", "tf", "words"],
    )


def invert(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of the index for ``docs`` (id, w: words); nothing is shuffled."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, block_docs - n)
                held.append((part.column("id"), part.column("w")))
                n, at = n + len(part), at + len(part)
                if n == block_docs:
                    yield _inverted(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield _inverted(held, number)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "w").mapInArrow(blocks, _schema(kind))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def add(index: Postings, docs: DataFrame, batch: int, block_docs: int = BLOCK_DOCS) -> None:
    """``docs`` (id, text) go into the index as batch number ``batch``; a batch that runs again replaces itself. A null text
    has no words, and counts as a document."""
    split = stored(docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w")), "words")
    rows = invert(split, block_docs).withColumn("bucket", _bucket(F.col("term")))
    # a bucket's rows go to one task for each 64 blocks, so the blocks of a frequent term are spread over tasks
    spread = F.pmod(F.xxhash64("block"), F.lit(split.count() // (64 * block_docs) + 1))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").mode("overwrite").parquet(f"{index.path}/postings/batch={batch}")
    sizes = split.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words"))
    sizes = sizes.withColumn("id_kind", F.lit(docs.schema["id"].dataType.simpleString()))
    sizes.write.mode("overwrite").parquet(f"{index.path}/lengths/batch={batch}")


def build(docs: DataFrame, path: str, block_docs: int = BLOCK_DOCS) -> Postings:
    index = Postings(path)
    add(index, docs, 0, block_docs)
    return index


def _held_to(rows: DataFrame, small: DataFrame, n: int, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(small) if n <= SMALL else small, on, how)


def search(index: Postings, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, queries_at_once: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of each of ``queries`` (query_id, text); ties go to the smaller id."""
    spark = queries.sparkSession
    n_docs, mean = index.size(spark)
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "asked")
    terms = stored(asked.select("term").distinct().withColumn("bucket", _bucket(F.col("term"))), "terms")
    n_terms, n_queries = terms.count(), asked.select("query_id").distinct().count()
    buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # BUCKETS at most
    all_rows = index.rows(spark)
    rows = all_rows.where(F.col("bucket").isin(buckets))
    place = ["batch", "block"]
    heads = stored(_held_to(rows.select("term", "bucket", *place, "n", "max_tf", "min_words", "top_tf", "top_words"), terms, n_terms, ["term", "bucket"]), "heads")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = stored(df.select("term", idf.alias("idf")), "weighed")
    heads = _held_to(heads, weighed, n_terms, ["term"]).select(
        "term", *place, "idf", (F.col("idf") * weight(F.col("max_tf"), F.col("min_words"), mean, k1, b)).alias("most"),
        (F.col("idf") * weight(F.col("top_tf"), F.col("top_words"), mean, k1, b)).alias("reached"),
    )
    # k documents, of k blocks, reach this by one term alone
    nth = heads.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("reached")))).where(F.col("nth") == k)
    floors = asked.join(nth.select("term", "reached"), "term").groupBy("query_id").agg(F.max("reached").alias("floor"))
    blocks = max(1, -(-n_queries // queries_at_once))
    each = asked.join(heads.drop("reached"), "term").withColumn("of_block", F.sum("most").over(Window.partitionBy("query_id", *place)))
    each = each.join(floors, "query_id", "left").where(F.col("of_block") >= F.coalesce(F.col("floor") - 2e-6, F.lit(0.0)))  # scores are rounded to 1e-6
    asks = stored(each.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("part"), *place, "query_id", "term", "idf"), "asks")
    wanted = asks.select("part", *place, "term").distinct()
    lists = rows.select("term", "bucket", *place, "ids", "tf", "words")
    lists = _held_to(lists, terms, n_terms, ["term", "bucket"])
    lists = _held_to(lists, stored(wanted, "wanted"), wanted.count(), [*place, "term"])

    def score(key, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The best ``k`` of one block for the queries of one part."""
        if own.empty or asks.empty:
            return pd.DataFrame({"query_id": asks["query_id"][:0], "id": [], "score": []})
        doc, ids = pd.factorize(np.concatenate(own["ids"].to_list()))
        who, names = pd.factorize(asks["query_id"])
        total, cuts = np.zeros((len(names), len(ids))), np.cumsum(own["ids"].str.len().to_numpy())[:-1]
        tf, words = (np.concatenate(own[c].to_list()).astype(float) for c in ("tf", "words"))
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / (mean or 1.0)))
        by_term = {t: (d, x) for t, d, x in zip(own["term"], np.split(doc, cuts), np.split(w, cuts))}
        for term, at in asks.groupby("term").indices.items():
            d, x = by_term[term]
            total[np.ix_(who[at], d)] += asks["idf"].to_numpy()[at, None] * x
        total = np.round(total, 6)
        best = np.lexsort((np.broadcast_to(ids, total.shape), -total), axis=1)[:, :k]
        row = np.repeat(np.arange(len(names)), best.shape[1])
        found = pd.DataFrame({"query_id": names[row], "id": ids[best.ravel()], "score": total[row, best.ravel()]})
        return found[found["score"] > 0]

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {all_rows.schema['ids'].dataType.elementType.simpleString()}, score double"
    key = ["part", *place]
    return top_k(lists.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(score, kinds), k)
