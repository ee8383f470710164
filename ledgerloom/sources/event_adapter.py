"""Metered usage, its log, and export ticks, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.bill_adapter import table

# Column rules as SQL text both engines read.
USAGE = {
    "tokens": "CAST(floor(value * 10) AS BIGINT)",
    "x_SkuMeterName": "CASE WHEN event_type IN ('view', 'click') THEN concat(event_type, ' Inp') ELSE concat(event_type, ' Outp') END",
    "ServiceName": "CASE WHEN user_id % 3 = 0 THEN 'AI service' ELSE 'Compute service' END",
    "ChargeDescription": "concat('meter ', event_type)",
}
PRICED = {
    "PricingQuantity": """CAST(CASE WHEN event_type = 'error' THEN ceil(tokens / 1000.0)
        ELSE tokens * CAST(0.001 AS DECIMAL(4,3)) END AS DECIMAL(20,6))""",
}
BILLED = {
    "BilledCost": """CAST(CASE WHEN event_type = 'signup' THEN 0 WHEN event_type IN ('view', 'click')
        THEN PricingQuantity * CAST(0.05 AS DECIMAL(4,2)) ELSE PricingQuantity * CAST(0.20 AS DECIMAL(4,2)) END AS DECIMAL(24,6))""",
}


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    for step in (USAGE, PRICED, BILLED):
        frame = frame.selectExpr("*", *[f"{rule} AS {name}" for name, rule in step.items()])
    return frame.select(
        "event_id", "user_id", "event_type", F.col("ts").alias("ChargePeriodStart"), F.col("ts").alias("used_at"),
        "tokens", F.col("tokens").cast("decimal(20,3)").alias("ConsumedQuantity"), "PricingQuantity", "BilledCost",
        "x_SkuMeterName", "ServiceName", "ChargeDescription")


def by_batch(frame: DataFrame) -> DataFrame:
    """Usage as (day, batch, tokens, cost), a batch being a tenth of the users."""
    return frame.select(F.to_date("used_at").alias("day"), (F.col("user_id") % 10).alias("batch"),
                        F.col("tokens").cast("decimal(20,0)").alias("tokens"), F.col("BilledCost").alias("cost"))


def batch_log(frame: DataFrame) -> DataFrame:
    """The log's own figures: some batches missing, some off by one token a row."""
    logged = by_batch(frame).where(~((F.col("batch") == 3) & (F.dayofmonth("day") % 9 == 0)))
    extra = F.when((F.col("batch") == 4) & (F.dayofmonth("day") % 7 == 0), 1).otherwise(0)
    return logged.withColumn("tokens", (F.col("tokens") + extra).cast("decimal(20,0)"))


def batch_ledger(frame: DataFrame) -> DataFrame:
    return by_batch(frame).where(~((F.col("batch") == 5) & (F.dayofmonth("day") % 11 == 0)))


def export_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export per day, on most days, at the day's first sign-up."""
    return (
        table(spark, sf_dir, "events").where("event_type = 'signup'")
        .groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("tick"))
        .where(F.dayofmonth("day") % 5 != 0).select("tick")
    )


USAGE_SQL = f"""
metered AS (
  SELECT *, ts AS ChargePeriodStart, CAST(ts AS DATE) AS day, {", ".join(f"{r} AS {n}" for n, r in BILLED.items())} FROM (
    SELECT *, {", ".join(f"{r} AS {n}" for n, r in PRICED.items())} FROM (
      SELECT *, {", ".join(f"{r} AS {n}" for n, r in USAGE.items())} FROM events)))"""
