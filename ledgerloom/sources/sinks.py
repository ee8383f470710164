"""Writing results: the unified table, a gated sanitised layer, CSVs and logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import sanitise as Z
from ledgerloom.sources.readers import stored


class LeakFound(RuntimeError):
    """The output still holds identifiers of the input; nothing was published."""


def billing_month() -> Column:
    return F.date_format("BillingPeriodStart", "yyyy-MM")


def write_unified(frame: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """The unified bill as snappy parquet, one folder per billing month.

    Spark sizes the tasks from what it has shuffled: small months share a task, a month that holds most of the bill is
    split over as many as its size asks for.  No file holds more than rows_per_file rows.
    """
    (
        frame.withColumn("billing_month", billing_month()).hint("rebalance", "billing_month")
        .write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("billing_month").parquet(path)
    )


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/_commits"


def published_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(sequence, version, rows) of every publication, or None before the first.  One row each, however large the layer."""
    return stored(spark.read.schema("sequence bigint, version string, rows bigint").json, _commits(path))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The layer last published under the path; what was staged and not committed is never seen."""
    known = published_versions(spark, path)
    newest = None if known is None else known.orderBy(F.desc("sequence"), F.desc("version")).first()
    if newest is None:
        raise FileNotFoundError(f"nothing has been published under {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{newest['version']}")


def write_sanitised(original: DataFrame, path: str, metadata: DataFrame | None = None,
                    salt: str = Z.DEFAULT_SALT, spare: tuple[str, ...] = ()) -> str:
    """Sanitise into a version folder, prove it on what was written, and only then commit it; gives the version.

    Every row is written once.  The commit is one small file written last, so a run that fails or finds a leak anywhere
    before it leaves the layer published earlier as it was.  The rows of a version that leaks are overwritten by none.
    """
    spark = original.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    Z.sanitise(original, salt, spare).write.parquet(folder)
    written = spark.read.parquet(folder)
    if not Z.leak_scan(original, written).isEmpty():
        spark.createDataFrame([], written.schema).write.mode("overwrite").parquet(folder)
        raise LeakFound("the sanitised layer still holds original identifiers")
    if metadata is not None:
        kinds = {f.name: f.dataType for f in metadata.schema.fields}
        metadata.withColumns({n: Z.sanitise_nested(F.col(n), k, salt) for n, k in kinds.items()}).write.json(f"{folder}_manifest")
    known = published_versions(spark, path)
    last = 0 if known is None else known.agg(F.max("sequence")).first()[0] or 0
    entry = written.agg(F.count("*").alias("rows")).select(
        F.lit(last + 1).cast("long").alias("sequence"), F.lit(version).alias("version"), "rows")
    entry.coalesce(1).write.mode("append").json(_commits(path))
    return version


def write_results(spark: SparkSession, sf_dir: str, jobs: dict[str, Callable], folder: str) -> None:
    """Every named query result as CSV, one folder per query."""
    for name, job in jobs.items():
        job(spark, sf_dir).write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def literal_z(column: str) -> Column:
    """A civil timestamp as text ending in Z, with no zone arithmetic."""
    return F.date_format(F.col(column).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_companion(frame: DataFrame, path: str, stamps: list[str]) -> None:
    frame.withColumns({c: literal_z(c) for c in stamps}).write.mode("overwrite").csv(
        path, header=True, escape='"')


def append_usage(entries: DataFrame, log: DataFrame, path: str) -> None:
    """Append usage rows under the log's own columns; unknown ones stay empty."""
    have = set(entries.columns)
    row = [F.col(c).cast(log.schema[c].dataType).alias(c) if c in have
           else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]
    entries.select(*row).write.mode("append").csv(path, header=True)
