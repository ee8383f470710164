"""What both vector searches share: checked vectors, blocks of rows and queries, and the merge of partial answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part; rows alike in both count once."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if nonzero:
        kept = kept.where(F.exists("v", lambda x: x != 0.0))
    return kept.dropDuplicates(["vec_id", "v"])


def blocks_of(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def block(count: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")


def in_every(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = rows.column("v").combine_chunks()
    n = rows.num_rows
    return rows.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def answer(query: list, ids: list, scores: list) -> pa.Table:
    counts = [len(x) for x in ids]
    return pa.table({
        "query_id": pa.array(np.repeat(np.array(query, np.int64), counts), pa.int64()),
        "vec_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()),
        "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})


class Best:
    """The k best of what was offered: highest score first, ties to the smaller id."""

    def __init__(self, k: int, at_least: float = -np.inf):
        self.k, self.floor = k, at_least
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, scores[order[-1]])


def per_block(rows: DataFrame, queries: DataFrame, search: Callable) -> DataFrame:
    """search(row ids, row vectors, queries as a table) for every pair of a shard and a block of queries."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return answer([], [], [])
        return search(*matrix(left), right)

    keys = ["dim", "shard", "part"]
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # else both sides name the same columns
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, FOUND)


def ranked(found: DataFrame, k: int, kind: str) -> DataFrame:
    """The best k of each query over all shards; a query has at most k rows from each."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("score").cast(kind).alias("score")))
