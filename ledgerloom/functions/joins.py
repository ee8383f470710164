"""Join shapes that stay whole under skew.

No helper here forces a broadcast of data that grows.  Spark's own size check
decides (statically, then again from real shuffle sizes at run time); when the
lookup is too big to broadcast the salted key keeps a hot value spread over
many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def lookup_join(fact: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join whose key may be one hot value (a currency, an invoice, a day).

    The salt is a hash of fact columns, not a random number, so a retried task
    reproduces the same rows.  Each lookup row is repeated once per salt.
    """
    renamed = lookup.select(
        *[F.col(c).alias(f"_key_{c}") for c in on],
        *[c for c in lookup.columns if c not in on],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_of_lookup"),
    )
    salted = fact.withColumn("_salt_of_fact", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    match = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on]
    match.append(F.col("_salt_of_fact") == F.col("_salt_of_lookup"))
    joined = salted.join(renamed, reduce(lambda a, b: a & b, match), how)
    return joined.drop("_salt_of_fact", "_salt_of_lookup", *[f"_key_{c}" for c in on])


def with_one_row(facts: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the result of an ungrouped aggregate: exactly one row by construction."""
    return facts.crossJoin(F.broadcast(one_row))


def by_civil_day(intervals: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Half-open date intervals as one row per day they contain.

    Turns ``d >= start AND d < end`` into an equi-join on the day.  The result
    is bounded by calendar length times interval overlap, not by the facts.
    """
    return (
        intervals.where(F.col(start) < F.col(end))
        .withColumn(day, F.explode(F.sequence(F.col(start), F.date_sub(F.col(end), 1))))
    )
