"""Exact median per key without gathering a group in one task.

Spark's ``median`` keeps every distinct value of a group in one aggregation
buffer.  With two currencies and billions of resource-days that is one task
holding half the table.  This one fixes the middle value six decimal digits at
a time: count values per bucket, find the bucket holding the wanted rank,
descend into it.  Below the leading digits no window partition exceeds 10^6
rows, nothing is rounded, and the answer is exact for decimal(38,18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.joins import lookup_join

BASE = 1_000_000
#: Leading digits (all above 10^6), six before the point, three times six after it.
DIGITS = 5


def _digits(value: str) -> list:
    """The value as longs of six decimal digits each; the first keeps the sign, the rest count up from it."""
    v, one, base = F.col(value).cast("decimal(38,18)"), F.lit(1).cast("decimal(1,0)"), F.lit(BASE).cast("decimal(7,0)")
    whole = F.floor(v)
    low = F.pmod(whole, base)
    out = [F.floor((whole - low) / base).cast("long"), low.cast("long")]
    rest = F.pmod(v, one).cast("decimal(18,18)")
    for _ in range(3):
        scaled = rest * base
        out.append(F.floor(scaled).cast("long"))
        rest = F.pmod(scaled, one).cast("decimal(18,18)")
    return out


def exact_median(values: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """One row per key with the median of a decimal column (as a double); exact up to 19 digits before the point."""
    names = [f"_d{digit}" for digit in range(DIGITS)]
    histogram = (
        values.where(F.col(value).isNotNull())
        .select(*keys, *[part.alias(name) for part, name in zip(_digits(value), names, strict=True)])
        .groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    )

    picked = None
    for digit in range(DIGITS):
        prefix = [f"_d{d}" for d in range(digit)]
        if picked is None:
            group = keys
            buckets = histogram.groupBy(*keys, "_d0").agg(F.sum("_n").alias("_n"))
        else:
            group = [*keys, *prefix, "_side", "_rank"]
            buckets = (
                lookup_join(histogram, picked, [*keys, *prefix], [f"_d{DIGITS - 1}"])
                .groupBy(*group, f"_d{digit}").agg(F.sum("_n").alias("_n"))
            )
        running = W.partitionBy(*group).orderBy(f"_d{digit}").rowsBetween(W.unboundedPreceding, 0)
        buckets = buckets.withColumn("_upto", F.sum("_n").over(running))
        if picked is None:
            size = F.sum("_n").over(W.partitionBy(*keys))
            middle = F.array(
                F.struct(F.lit(0).alias("side"), F.floor((F.col("_size") - 1) / 2).alias("rank")),
                F.struct(F.lit(1).alias("side"), F.floor(F.col("_size") / 2).alias("rank")))
            buckets = (
                buckets.withColumn("_size", size).withColumn("_m", F.explode(middle))
                .withColumn("_side", F.col("_m.side")).withColumn("_rank", F.col("_m.rank"))
            )
        before = F.col("_upto") - F.col("_n")
        picked = (
            buckets.where((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto")))
            .select(*keys, *prefix, f"_d{digit}", "_side", (F.col("_rank") - before).alias("_rank"))
        )

    whole = (F.col("_d0").cast("decimal(19,0)") * F.lit(BASE).cast("decimal(7,0)") + F.col("_d1")).cast("decimal(19,0)")
    after = F.concat(F.lit("0."), *[F.lpad(F.col(f"_d{digit}").cast("string"), 6, "0") for digit in range(2, DIGITS)])
    amount = (whole + after.cast("decimal(18,18)")).cast("double")
    low = F.max(F.when(F.col("_side") == 0, F.col("_amount")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_amount")))
    return (
        picked.withColumn("_amount", amount).groupBy(*keys)
        .agg((low + (high - low) * 0.5).alias(alias))
    )
