"""Many per-column counts in one scan, turned into rows afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by_column(frame: DataFrame, counted: dict[str, Column], label: str, count: str,
                     keep: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Aggregate one expression per label, then unpivot the single result row.

    ``keep`` holds extra aggregates repeated on every output row; ``by`` adds
    grouping keys.  The scan and the aggregate run once however many labels.
    """
    keep, by = keep or {}, by or []
    aggregates = [expression.alias(f"_{n}") for n, expression in enumerate(counted.values())]
    aggregates += [expression.alias(name) for name, expression in keep.items()]
    grouped = frame.groupBy(*by) if by else frame.groupBy()
    entries = F.array(*[
        F.struct(F.lit(name).alias(label), F.col(f"_{n}").alias(count))
        for n, name in enumerate(counted)])
    return (
        grouped.agg(*aggregates)
        .select(*by, *keep, F.explode(entries).alias("_entry"))
        .select(*by, "_entry.*", *keep)
    )


def string_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if f.dataType.simpleString() == "string"]
