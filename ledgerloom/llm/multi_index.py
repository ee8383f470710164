"""Approximate nearest neighbours by an inverted multi-index.

Method.  Each vector is cut in two halves, and each half is quantised by its own codebook, so a row's cell is a pair of
centroids.  A query orders the centroids of either half by distance (the negated inner product, as nearness here is the
largest inner product) and takes pairs in order of summed distance from a heap until the entries of the pairs taken
reach `visited` of the shard.  All entries taken are reranked by their exact inner product on the original vectors.  A
crowded cell counts as at most four average ones towards that share, so a group of copies does not use it up.

The codebooks are fitted on a bounded sample (`sample_rows` rows, those of smallest hash); every row is indexed.  Rows
fall into shards by a hash, every query meets every shard in blocks of bounded size, and the codebooks are the only
thing sent to all tasks.  Recall against brute force is held by a test.

Vectors that are null, empty, zero, or hold null or non-finite components take no part.  Rows with one vec_id are one
item: they are no candidates for each other, and equal ones count once.  Vectors of different lengths never meet; for
each length there are codebooks of its own.  Ties go to the smaller vec_id.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable
from ledgerloom.llm.vectors import Best, answer, block, blocks_of, in_every, matrix, per_block, ranked, usable


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly spaced starting rows; as many as there are distinct rows at most."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(size, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, 1)


def _pairs(first: np.ndarray, second: np.ndarray):
    """Pairs of places in two ascending lists in order of their sum."""
    heap = [(first[0] + second[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield i, j
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))


def _search(books: dict, k: int, visited: float):
    def search(ids: np.ndarray, points: np.ndarray, queries: pa.Table) -> pa.Table:
        one, two = books[points.shape[1]]
        half = one.shape[1]
        cell = nearest(points[:, :half], one) * len(two) + nearest(points[:, half:], two)
        order = np.argsort(cell, kind="stable")
        ids, points = ids[order], points[order]
        held = np.bincount(cell, minlength=len(one) * len(two))
        counts = np.minimum(held, 4 * (len(ids) // len(held) + 1)).tolist()
        wanted = visited * sum(counts)
        query_ids, vectors = matrix(queries)
        out = []
        for q, x in zip(query_ids, vectors, strict=True):
            far1, far2 = -(one @ x[:half]), -(two @ x[half:])
            by1, by2 = np.argsort(far1, kind="stable"), np.argsort(far2, kind="stable")
            taken, cells = 0, []
            names1, names2 = (by1 * len(two)).tolist(), by2.tolist()
            for i, j in _pairs(far1[by1].tolist(), far2[by2].tolist()):
                c = names1[i] + names2[j]
                if counts[c]:
                    cells.append(c)
                    taken += counts[c]
                    if taken >= wanted and taken > k:
                        break
            open_cells = np.zeros(len(held), bool)
            open_cells[cells] = True
            entries = np.flatnonzero(np.repeat(open_cells, held))
            entries = entries[ids[entries] != q]
            best = Best(k)
            best.offer(ids[entries], np.einsum("ij,j->i", points[entries], x))
            out.append(best)
        return answer(list(query_ids), [b.ids for b in out], [b.scores for b in out])
    return search


def fit(rows: DataFrame, n: int, centroids: int, sample_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks by vector length, from the rows of smallest hash: about sample_rows, whatever the table's size."""
    share = min(1.0, sample_rows / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    by_length: dict[int, list] = {}
    for v in sample.select("vec_id", "v").orderBy("vec_id").toArrow().column("v").to_pylist():
        by_length.setdefault(len(v), []).append(v)
    lengths = {r[0] for r in rows.select("dim").distinct().collect()}
    books = {}
    for d in lengths:
        points = np.array(by_length.get(d) or [[0.0] * d])
        books[d] = tuple(codebook(x, centroids) for x in (points[:, :d // 2], points[:, d // 2:]))
    return books


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, centroids: int = 64, visited: float = 0.6,
               sample_rows: int = 16_384, shard_rows: int = 65_536, query_rows: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k nearest found for each query."""
    rows = usable(vectors, nonzero=True)
    rows = durable(rows.withColumn("dim", F.size("v")))
    n = rows.count()
    queries = rows.where(is_query)
    shards, parts = blocks_of(n, shard_rows), blocks_of(queries.count(), query_rows)
    books = fit(rows, n, centroids, sample_rows)
    spread = rows.withColumn("shard", block(shards, 1)).withColumn("part", in_every(parts))
    asked = queries.withColumn("part", block(parts, 2)).withColumn("shard", in_every(shards))
    return ranked(per_block(spread, asked, _search(books, k, visited)), k, "double")
