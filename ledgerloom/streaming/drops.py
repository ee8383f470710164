"""Continuous delivery: drops that supersede, first sightings, daily windows.

Batch and streaming callers share the transformations; only the sources and
sinks differ.  Checkpoints and tables live in folders the caller names, which
on a cluster are shared ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.columns import rows, total
from ledgerloom.functions.joins import with_one_row
from ledgerloom.sources.readers import stored


def read_drops(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Every parquet drop landing under a folder, labelled with the file it came from."""
    return (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
        .withColumn("drop_file", F.col("_metadata.file_path"))
        .withColumn("landed_at", F.col("_metadata.file_modification_time"))
    )


def latest_delivery(drops: DataFrame, month: str, version: list[str]) -> DataFrame:
    """Rows of each month's newest delivery; an earlier delivery is superseded whole."""
    newest = (
        drops.select(month, F.struct(*version).alias("_version")).groupBy(month)
        .agg(F.max("_version").alias("_newest"))
    )
    # One row per calendar month: small by nature, and Spark checks before broadcasting.
    return (
        drops.withColumn("_version", F.struct(*version))
        .join(newest.withColumnRenamed(month, "_month"), F.col(month).eqNullSafe(F.col("_month")))
        .where(F.col("_version").eqNullSafe(F.col("_newest"))).drop("_version", "_newest", "_month")
    )


def _index(target: str) -> str:
    return f"{target.rstrip('/')}__versions"


def held_versions(spark: SparkSession, target: str, months: DataFrame, month: str) -> DataFrame | None:
    """(_month, _held): the newest version the index has of each of these months, or None before the first delivery.

    The index is a row for each month, written beside the target; no batch reads the target itself.
    """
    index = stored(spark.read.parquet, _index(target))
    if index is None:
        return None
    wanted = months.select(F.col(month).cast("string").alias("_wanted")).distinct()
    return index.join(wanted, F.col("_month").eqNullSafe(F.col("_wanted")), "left_semi").groupBy("_month").agg(F.max("_held").alias("_held"))


def write_month_replacements(drops: DataFrame, target: str, checkpoint: str, month: str,
                             version: list[str]) -> StreamingQuery:
    """Replace whole months as they are re-delivered; never append to one.

    Dynamic partition overwrite replaces exactly the months a batch brings, and
    an old delivery arriving after a newer one is left out.  The index of
    versions is written after the months, so a batch that fails in between is
    repeated: it finds no newer version than its own and writes the same months
    again, as a replayed batch does.
    """
    def replace(batch: DataFrame, _: int) -> None:
        newest = latest_delivery(batch, month, version)
        held = held_versions(batch.sparkSession, target, newest, month)
        if held is not None:
            stale = newest[month].cast("string").eqNullSafe(held["_month"]) & (F.struct(*[newest[v] for v in version])
                                                                         < held["_held"])
            newest = newest.join(held, stale, "left_anti")
        (newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(month).parquet(target))
        index = newest.groupBy(F.col(month).cast("string").alias("_month")).agg(F.max(F.struct(*version)).alias("_held"))
        (index.withColumn("_of", F.col("_month")).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_of").parquet(_index(target)))

    return (
        drops.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def first_seen(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """When each resource or meter first appeared (batch form)."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen"), rows().alias("row_count"))


def first_seen_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """First sightings as they arrive, each key once for ever.

    No watermark: the state keeps every key that was ever seen and nothing else, so a key that returns after any time is
    not announced again.  It is as large as the keys; use the RocksDB state store, which holds it on disk.
    """
    return events.dropDuplicates(keys)


#: Folders that the keys seen are kept in; a batch reads those of its own keys only.
LEDGER_PARTS = 256


def _ledger_part(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(LEDGER_PARTS)).cast("int")


def write_first_seen(events: DataFrame, keys: list[str], at: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """First sightings with their times in an insert-only ledger: a row for each key, from the batch that saw it first.

    Keys that an earlier batch has are left out by an anti join with the ledger's parts of this batch's keys.  A batch
    writes under its own number, so a replayed one overwrites what it wrote and changes nothing.  Later sightings never
    change a row; within the first batch the earliest time counts, rows without a time last.  Batch numbers are those of
    one checkpoint, so a ledger belongs to one.
    """
    def insert(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy(*keys).agg(F.min(at).alias("first_seen"), rows().alias("row_count")).withColumn("part", _ledger_part(keys))
        known = stored(batch.sparkSession.read.parquet, ledger)
        if known is not None:
            same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys] + [F.col("part") == F.col("_known_part")]
            earlier = known.where(F.col("batch_id") < batch_id).select(
                F.col("part").alias("_known_part"), *[F.col(k).alias(f"_known_{k}") for k in keys])
            seen = seen.join(earlier, same, "left_anti")
        seen.write.mode("overwrite").partitionBy("part").parquet(f"{ledger.rstrip('/')}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_first_seen(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(ledger).drop("part")


def _day(at: str) -> Column:
    return F.window(F.col(at), "1 day")


def daily_window(events: DataFrame, keys: list[str], at: str, amount: str,
                 lateness: str | None = None) -> DataFrame:
    """Tumbling one-day totals; give a lateness bound when the input is a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark(at, lateness)
    return (
        timed.groupBy(_day(at).alias("w"), *keys)
        .agg(rows().alias("row_count"), total(amount).alias("amount"))
        .select(F.to_date("w.start").alias("day"), *keys, "row_count", "amount")
    )


def write_with_late_rows(events: DataFrame, keys: list[str], at: str, amount: str, lateness_days: int,
                         totals: str, late: str, checkpoint: str) -> StreamingQuery:
    """Daily totals kept up to date, with rows beyond the bound set aside, not lost.

    A row is late when its day lies further behind the newest day seen so far,
    in this batch or an earlier one, than the bound; a row without a time belongs
    to no day and is set aside with them.  Both outputs are kept per
    batch, so a retried batch overwrites what it wrote.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(F.to_date(at)).alias("_newest"))
        written = stored(batch.sparkSession.read.parquet, totals)
        if written is not None:
            earlier = written.where(F.col("batch_id") < batch_id)
            newest = newest.unionByName(earlier.agg(F.max("day").alias("_newest"))).agg(
                F.max("_newest").alias("_newest"))
        judged = with_one_row(batch, newest).withColumn(
            "_late", F.coalesce(F.datediff("_newest", F.to_date(at)) > lateness_days, F.lit(True)))
        on_time = judged.where(~F.col("_late")).drop("_late", "_newest")
        (daily_window(on_time, keys, at, amount)
         .write.mode("overwrite").parquet(f"{totals}/batch_id={batch_id}"))
        (judged.where("_late").drop("_late", "_newest")
         .write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}"))

    return (
        events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_daily_totals(spark: SparkSession, totals: str, keys: list[str]) -> DataFrame:
    """Per-batch partial totals added up: late-but-accepted rows refresh earlier days."""
    return (
        spark.read.parquet(totals).groupBy("day", *keys)
        .agg(F.sum("row_count").alias("row_count"), F.sum("amount").alias("amount"))
    )


def row_count_drift(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Each day's row count against the day before, per key (one row per day and key)."""
    before = F.lag("row_count").over(W.partitionBy(*keys).orderBy("day"))
    return daily.withColumn("previous", before).select(
        "day", *keys, "row_count", "previous", (F.col("row_count") - F.col("previous")).alias("change"))
