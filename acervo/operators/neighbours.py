"""Nearest neighbours of a stated query set, exactly, in blocks.

A block of queries of bounded size is broadcast; every partition of the rows keeps its own
best ``k`` for each query by one matrix product per batch; the best of those are taken
per query. Nothing but the query block is ever broadcast, and rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one broadcast block holds at most.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _query_blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select(key, vector).where(F.col(vector).isNotNull()).orderBy(key).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids), _unit(np.array(rows, dtype=np.float64))
            ids, rows = [], []
    if ids:
        yield np.array(ids), _unit(np.array(rows, dtype=np.float64))


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", floor: float = -1.0
) -> DataFrame:
    """``query, neighbour, similarity, rank``: the ``k`` most similar rows of every query, itself left out.

    Cosine similarity; ties go to the lower id; rows without a vector are left out.
    """
    spark = rows.sparkSession
    found = None
    for ids, block in _query_blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                sims = q @ _unit(_matrix(batch.column(1))).T
                sims[q_ids[:, None] == own[None, :]] = -np.inf
                sims[sims < floor - 1e-12] = -np.inf
                order = np.lexsort((np.broadcast_to(own, sims.shape), -np.round(sims, 12)), axis=1)[:, :k]
                at = np.repeat(np.arange(len(q_ids)), order.shape[1])
                value = sims[at, order.ravel()]
                good = np.isfinite(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at][good]), pa.array(own[order.ravel()][good]), pa.array(value[good])],
                    names=["query", "neighbour", "similarity"],
                )

        part = rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(
            run, "query bigint, neighbour bigint, similarity double"
        )
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query bigint, neighbour bigint, similarity double, rank int")
    best = Window.partitionBy("query").orderBy(F.round("similarity", 12).desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mutual(queries: DataFrame, rows: DataFrame, k: int, floor: float, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query, neighbour, similarity`` where each is among the ``k`` nearest of the other."""
    ahead = nearest(queries, rows, k, key=key, vector=vector, floor=floor)
    asked = rows.join(ahead.select(F.col("neighbour").alias(key)).distinct(), key, "left_semi")
    back = nearest(asked, rows, k, key=key, vector=vector, floor=floor)
    return ahead.join(
        back.select(F.col("query").alias("neighbour"), F.col("neighbour").alias("query")), ["query", "neighbour"], "left_semi"
    ).select("query", "neighbour", "similarity")


def silhouettes(queries: DataFrame, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``query, silhouette`` by cosine distance of a stated query set to all rows."""
    spark = rows.sparkSession
    sums = None
    for ids, block in _query_blocks(queries, key, vector):
        shared = spark.sparkContext.broadcast((ids, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                far = 1 - q @ _unit(_matrix(batch.column(1))).T
                far[q_ids[:, None] == own[None, :]] = 0.0
                labels = batch.column(2).to_numpy(zero_copy_only=False)
                for lab in np.unique(labels):
                    mine = labels == lab
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(q_ids),
                            pa.array(np.full(len(q_ids), lab, dtype=np.int64)),
                            pa.array(far[:, mine].sum(axis=1)),
                            pa.array((q_ids[:, None] != own[mine][None, :]).sum(axis=1).astype(np.int64)),
                        ],
                        names=["query", "other", "total", "n"],
                    )

        part = rows.select(key, vector, label).where(F.col(vector).isNotNull()).mapInArrow(
            run, "query bigint, other bigint, total double, n bigint"
        )
        sums = part if sums is None else sums.unionAll(part)
    if sums is None:
        return spark.createDataFrame([], "query bigint, silhouette double")
    means = sums.groupBy("query", "other").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("far"))
    own = queries.select(F.col(key).alias("query"), F.col(label).cast("bigint").alias("mine"))
    told = means.join(own, "query").groupBy("query").agg(
        F.max(F.when(F.col("other") == F.col("mine"), F.col("far"))).alias("a"),
        F.min(F.when(F.col("other") != F.col("mine"), F.col("far"))).alias("b"),
    )
    return told.select("query", F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))
