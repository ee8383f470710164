"""Documents in blocks, so that what a distributed table knows of words reaches each text once per block.

A text's words meet a large table of words without a row per word: documents are packed into blocks of bounded size by
a hash, a block lists its distinct words, the list is joined to the table, and the answers come back to the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "block int, packed binary"


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about so many bytes of text the documents fill."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def pack(docs: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """(block, packed): rows of docs, which has doc_id and text, in compressed Arrow batches by block.

    The block depends on id and text alone, so copies and rows without id spread out and reruns agree.
    """
    placed = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    columns = docs.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield _by_block(held, columns)
                held, size = [], 0
        if held:
            yield _by_block(held, columns)

    return placed.mapInArrow(packed, PACKED)


def _by_block(batches: list[pa.RecordBatch], columns: list[str]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    block = rows.column("_block").to_numpy()
    order = np.argsort(block, kind="stable")
    rows = rows.select(columns).take(pa.array(order)).combine_chunks()
    names, start = np.unique(block[order], return_index=True)
    end = np.r_[start[1:], len(block)]
    packed = []
    for a, b in zip(start, end, strict=True):
        sink = pa.BufferOutputStream()
        part = rows.slice(a, b - a)
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(part.to_batches()))
        packed.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])


def unpack(rows: pa.Table) -> Iterator[pa.Table]:
    for packed in rows.column("packed"):
        yield pa.ipc.open_stream(packed.as_buffer()).read_all()


def per_block(packed: DataFrame, listed: Callable[[int, Iterator[pa.Table]], pa.Table], schema: str) -> DataFrame:
    """What `listed` gives for each block from its documents."""

    def run(key, rows):
        return listed(key[0].as_py(), unpack(rows))

    return packed.groupBy("block").applyInArrow(run, schema)


def with_answers(packed: DataFrame, answers: DataFrame,
                 finished: Callable[[Iterator[pa.Table], pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `finished` gives for each block from its documents and the answers, which have a column block."""

    def run(key, rows, known):
        return finished(unpack(rows), known)

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def texts(docs: pa.Table) -> list[str]:
    return pc.fill_null(docs.column("text"), "").to_pylist()
