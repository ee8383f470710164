"""Exact top-k search by integer inner product: a KD-tree in every shard, searched best box first.

Method.  Rows fall into shards by a hash.  A shard's tree halves its rows at the median of the widest dimension and
keeps a tight bounding box for each node.  A query takes boxes in order of their bound, the largest inner product any
point of the box can have, and stops when the bound falls below its k-th score.  Every query first searches the shard
it lies in; that k-th score goes with it to all shards, which then give only rows that can still be among the k.
Queries meet rows in blocks of bounded size on both sides, so no task holds more than one shard and one block.

Vectors that are null, empty, or hold null or non-finite components take no part.  Rows with one vec_id are one item:
they are no candidates for each other, and equal ones count once.  Vectors of different lengths never meet.  Ties go
to the smaller vec_id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable
from ledgerloom.llm.vectors import Best, answer, block, blocks_of, in_every, matrix, per_block, ranked, usable


def _tree(points: np.ndarray, leaf_rows: int):
    """Row order, and for each node its box, its children (-1: a leaf) and its slice of the order."""
    order = np.arange(len(points))
    low, high, child, span = [], [], [], []

    def grow(a: int, b: int) -> int:
        own = points[order[a:b]]
        low.append(own.min(0))
        high.append(own.max(0))
        child.append((-1, -1))
        span.append((a, b))
        me = len(span) - 1
        if b - a > leaf_rows:
            middle = (b - a) // 2
            wide = int(np.argmax(high[me] - low[me]))
            order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
            child[me] = (grow(a, a + middle), grow(a + middle, b))
        return me

    grow(0, len(points))
    return order, np.array(low), np.array(high), child, span


def _search(k: int, leaf_rows: int):
    def search(ids: np.ndarray, points: np.ndarray, queries: pa.Table) -> pa.Table:
        order, low, high, child, span = _tree(points, leaf_rows)
        ids, points = ids[order], points[order]
        query_ids, vectors = matrix(queries)
        floors = queries.column("floor").to_numpy()
        out = []
        for q, x, floor in zip(query_ids, vectors, floors, strict=True):
            best = Best(k, floor)
            bound = np.maximum(x * low, x * high).sum(1)
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= best.floor:
                _, node = heapq.heappop(heap)
                if child[node][0] >= 0:
                    for c in child[node]:
                        if bound[c] >= best.floor:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                a, b = span[node]
                other = ids[a:b] != q
                best.offer(ids[a:b][other], (points[a:b] @ x)[other])
            out.append(best)
        return answer(list(query_ids), [b.ids for b in out], [b.scores for b in out])
    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = 32_768,
          query_rows: int = 2048, leaf_rows: int = 512) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k highest inner products of floor(scale * x) for each query."""
    rows = usable(vectors, nonzero=False).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    rows = durable(rows.withColumn("dim", F.size("v")))
    queries = rows.where(is_query)
    shards, parts = blocks_of(rows.count(), shard_rows), blocks_of(queries.count(), query_rows)
    rows = rows.withColumn("shard", block(shards, 1))
    queries = queries.withColumn("part", block(parts, 2))
    search = _search(k, leaf_rows)
    at_home = queries.withColumn("shard", block(shards, 1)).withColumn("floor", F.lit(float("-inf")))
    home = per_block(rows.withColumn("part", in_every(parts)), at_home, search)
    floors = home.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(f"n >= {k}")
    reached = queries.join(floors, queries.vec_id == floors.query_id, "left").select(
        "vec_id", "v", "dim", "part", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    found = per_block(rows.withColumn("part", in_every(parts)), reached.withColumn("shard", in_every(shards)), search)
    return ranked(found, k, "long")
