"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir

#: A word: a longest run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in the shared checkpoint folder, so that a lost executor costs no result."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def word_count(text: Column) -> Column:
    """Words in the text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(*parts: Column, seed: int) -> Column:
    """Sixty bits that depend on the values and the seed alone, so every rerun agrees."""
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def _before(frame: DataFrame, group: list[str], place: str, sums: list[str]) -> DataFrame:
    """group, place and, as _before_<n>, each sum over the earlier places of the group; one window over its places."""
    earlier = W.partitionBy(*group).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return frame.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate([*group, place])],
                        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{n}") for n, s in enumerate(sums)])


def running_before(frame: DataFrame, group: list[str], key: str, order: list[str], measures: dict[str, str],
                   level_bits: tuple[int, ...] = (7, 7)) -> DataFrame:
    """For each row, the sum of each measure over the rows before it in its group, ordered by `key`, then `order`.

    `key` holds 60 uniform random bits.  Each level's bits cut the ranges of the level before into 2**bits smaller ones.
    The sums of the ranges are added up level by level, then those of the rows within one smallest range, so no task
    ever holds a whole group, nor more than 2**bits ranges of it.  measures: name of the new column -> column summed
    (a row count comes from a column of ones).
    """
    ends = [sum(level_bits[:i + 1]) for i in range(len(level_bits))]
    levels = [f"_range{i}" for i in range(len(ends))]
    ranged = frame.withColumns({r: F.shiftright(key, 60 - e) for r, e in zip(levels, ends, strict=True)})
    sums = [f"_sum{n}" for n in range(len(measures))]
    finest = ranged.groupBy(*group, *levels).agg(*[F.sum(c).alias(s) for s, c in zip(sums, measures.values(), strict=True)])
    starts = finest.select(*group, *levels, *[F.lit(0).cast("long").alias(f"_start{n}") for n in range(len(sums))])
    for i, level in enumerate(levels):
        own = [*group, *levels[:i]]
        at_level = finest.groupBy(*own, level).agg(*[F.sum(s).alias(s) for s in sums])
        before = _before(at_level, own, level, sums)
        same = [F.col(g).eqNullSafe(F.col(f"_k{k}")) for k, g in enumerate([*own, level])]
        starts = starts.join(before, same).select(
            *group, *levels, *[(F.col(f"_start{n}") + F.col(f"_before_{n}")).alias(f"_start{n}") for n in range(len(sums))])
    last = levels[-1]
    starts = starts.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col(last).alias("_last"),
                           *[f"_start{n}" for n in range(len(sums))])
    same = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    joined = ranged.join(starts, [*same, F.col(last) == F.col("_last")])
    within = W.partitionBy(*group, last).orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)
    added = joined.withColumns({name: F.col(f"_start{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))
                                for n, (name, c) in enumerate(measures.items())})
    return added.select(*frame.columns, *measures)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from a partition sorted by `key`; holds one batch and the group open at its end."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in key]

        def at(i, columns=columns):
            return tuple(c[i].as_py() for c in columns)

        end = at(batch.num_rows - 1)
        if last is not None and at(0) != last:
            yield pa.Table.from_batches(held)
            held = []
        # The group at the end of the batch may go on; everything before it is whole.
        low, high = 0, batch.num_rows - 1
        while low < high:
            middle = (low + high) // 2
            if at(middle) == end:
                high = middle
            else:
                low = middle + 1
        if low:
            yield pa.Table.from_batches([*held, batch.slice(0, low)])
            held = []
        held.append(batch.slice(low))
        last = end
    if held:
        yield pa.Table.from_batches(held)
