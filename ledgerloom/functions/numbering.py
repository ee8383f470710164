"""One running number over a whole table in an order of its columns, with no window over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import ensure_checkpoint_dir


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """frame with its place (from 1) in the order of the columns, nulls first.

    Spark samples the bounds of sorted ranges of about equal size; a row's number is its place in its range and the rows
    of the ranges before.  The only window runs over one row for each range.  The ranges are kept in the checkpoint
    folder, since another run may draw other bounds.  Rows alike in all the columns are numbered in any order.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("_range").alias("_of"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(starts, F.col("_range") == F.col("_of")).select(
        *frame.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
