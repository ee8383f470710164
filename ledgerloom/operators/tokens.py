"""Token ledgers, unit economics, scheduling and latency.

All inputs are bill-shaped usage rows (a day, a meter, consumed and priced
quantities, a billed cost) or the logs they are tied to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import Span, charge_day, display, ratio, reads, rows, total

# --- fixed values: interactive list rates per million tokens --------------------
INPUT_RATE, OUTPUT_RATE = "0.10", "0.40"
# --- fixed values: batch rates per million tokens (half the interactive ones) ---
BATCH_INPUT_RATE, BATCH_OUTPUT_RATE = "0.05", "0.20"


@reads("ChargePeriodStart", "x_SkuMeterName", "ConsumedQuantity", "PricingQuantity", "BilledCost")
def token_ledger(usage: DataFrame, span: Span) -> DataFrame:
    """Billed tokens per day and meter; one job whatever files the span crosses."""
    return (
        usage.where(span.on("ChargePeriodStart"))
        .groupBy(charge_day().alias("charge_date"), F.col("x_SkuMeterName").alias("meter"))
        .agg(display(total("ConsumedQuantity"), 3).alias("tokens"),
             display(total("PricingQuantity"), 6).alias("pricing_qty_1k"),
             display(total("BilledCost"), 6).alias("billed_usd"))
        .orderBy("charge_date", "meter")
    )


def token_tie_out(ledger: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The bill's tokens and cost against the usage log's, with exact variances."""
    billed = ledger.groupBy(*keys).agg(total("tokens").alias("billed_tokens"), total("cost").alias("billed_usd"))
    logged = log.groupBy(*keys).agg(total("tokens").alias("logged_tokens"), total("cost").alias("logged_usd"))
    token_gap = F.col("billed_tokens") - F.col("logged_tokens")
    cost_gap = F.col("billed_usd") - F.col("logged_usd")
    return (
        billed.join(logged, keys, "full_outer")
        .withColumn("token_variance", token_gap).withColumn("usd_variance", cost_gap)
        .withColumn("verdict",
                    F.when(F.col("billed_tokens").isNull(), "NOT BILLED")
                    .when(F.col("logged_tokens").isNull(), "NOT LOGGED")
                    .when((token_gap == 0) & (cost_gap == 0), "EXACT TIE").otherwise("VARIANCE"))
    )


def _per_thousand(top: Column, bottom: Column, scale: int) -> Column:
    return ratio(top, bottom, 6, scale)


@reads("ChargePeriodStart", "x_SkuMeterName", "ConsumedQuantity", "PricingQuantity", "BilledCost")
def unit_economics(usage: DataFrame, span: Span) -> DataFrame:
    """Finance's rate (priced) beside engineering's (consumed), per meter and in total.

    The total comes from raw sums through grouping sets, never from the rates.
    """
    rate = F.when(F.col("x_SkuMeterName").ilike("%Inp%"), F.lit(INPUT_RATE)).otherwise(F.lit(OUTPUT_RATE)).cast(
        "decimal(4,2)")
    tokens, qty, billed = F.col("tokens"), F.col("qty"), F.col("billed")
    per_meter = (
        usage.where(span.on("ChargePeriodStart")).groupBy("x_SkuMeterName")
        .agg(total("ConsumedQuantity").alias("tokens"), total("PricingQuantity").alias("qty"),
             total("BilledCost").alias("billed"))
        .withColumn("interactive", (tokens * rate).cast("decimal(38,6)"))
    )
    return (
        per_meter.groupingSets([["x_SkuMeterName"], []], "x_SkuMeterName")
        .agg(F.grouping("x_SkuMeterName").alias("is_total"), F.sum("tokens").alias("tokens"),
             F.sum("qty").alias("qty"), F.sum("billed").alias("billed"),
             F.sum("interactive").alias("interactive"))
        .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("x_SkuMeterName")).alias("meter"),
                display(tokens, 3).alias("tokens"), display(billed, 6).alias("billed_usd"),
                _per_thousand(billed, qty, 1).alias("finance_usd_per_1k"),
                _per_thousand(billed, tokens, 1000).alias("engineering_usd_per_1k"),
                F.when(F.col("is_total") == 1, "blended")
                .when(qty * 1000 == tokens, "coincide (no block rounding)")
                .otherwise("DIVERGE - pricing structure").alias("views"),
                ratio(F.col("interactive"), F.lit(1000000), 6, 1).alias("interactive_counterfactual_usd"))
        .orderBy("meter")
    )


@reads("ChargePeriodStart", "BilledCost")
def per_day_baseline(usage: DataFrame, spans: dict[str, Span]) -> DataFrame:
    """Average per day *present* in each named span: missing days are not zero days."""
    entries = F.array_compact(F.array(*[
        F.when(span.on("ChargePeriodStart"), F.lit(name)) for name, span in spans.items()]))
    per_day = (
        usage.select(F.explode(entries).alias("period"), charge_day().alias("day"), "BilledCost")
        .groupBy("period", "day").agg(total("BilledCost").alias("cost"))
    )
    return per_day.groupBy("period").agg(
        rows().alias("days_in_data"), display(F.sum("cost"), 4).alias("total_usd"),
        ratio(F.sum("cost"), rows(), 4, 1).alias("per_day"))


@reads("ChargePeriodStart", "BilledCost")
def weekend_detail(usage: DataFrame, span: Span) -> DataFrame:
    """Civil days labelled weekend or weekday (Spark counts Sunday as 1)."""
    weekend = F.dayofweek("ChargePeriodStart").isin(1, 7)
    return (
        usage.where(span.on("ChargePeriodStart"))
        .groupBy(charge_day().alias("d"),
                 F.when(weekend, "weekend (VM off all day)").otherwise("weekday").alias("day_type"))
        .agg(rows().alias("rows_emitted"), display(total("BilledCost"), 4).alias("billed_usd")).orderBy("d")
    )


@reads("ChargePeriodStart", "ServiceName", "ChargeDescription", "BilledCost")
def meter_anatomy(usage: DataFrame, spans: dict[str, Span]) -> DataFrame:
    """Every meter of each named span, the ones that bill nothing included."""
    entries = F.array_compact(F.array(*[
        F.when(span.on("ChargePeriodStart"), F.lit(name)) for name, span in spans.items()]))
    return (
        usage.select(F.explode(entries).alias("period"), "ServiceName", "ChargeDescription", "BilledCost")
        .groupBy("period", "ServiceName", "ChargeDescription")
        .agg(rows().alias("rows_"), display(total("BilledCost"), 4).alias("billed_usd"))
        .orderBy("period", F.desc("billed_usd"), "ServiceName", "ChargeDescription")
    )


USAGE_SCHEMA = ("struct<response:struct<body:struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint,"
                "total_tokens:bigint>>>>")


def batch_usage_cost(lines: DataFrame, by: list[str], usage: Column) -> DataFrame:
    """Batch output lines rolled up; a line without usage counts as zero tokens."""
    tokens = lines.select(*by, F.coalesce(usage["prompt_tokens"], F.lit(0)).alias("prompt"),
                          F.coalesce(usage["completion_tokens"], F.lit(0)).alias("completion"))
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    cost = (prompt * F.lit(BATCH_INPUT_RATE).cast("decimal(4,2)")
            + completion * F.lit(BATCH_OUTPUT_RATE).cast("decimal(4,2)"))
    return (
        tokens.groupBy(*by).agg(rows().alias("responses"), F.sum("prompt").alias("prompt_tokens"),
                                F.sum("completion").alias("completion_tokens"))
        .withColumn("total_tokens", prompt + completion)
        .withColumn("est_cost_usd", ratio(cost, F.lit(1000000), 6, 1))
    )


def job_variance(runs: DataFrame) -> DataFrame:
    """Each run of a job against its previous run.

    Rows are reduced to one per (job, run day) first, so a job's window holds at
    most one row per calendar day.
    """
    per_run = runs.groupBy("job", "run_day").agg(total("tokens").alias("tokens"))
    before = F.lag("tokens").over(W.partitionBy("job").orderBy("run_day"))
    return (
        per_run.withColumn("previous", before).where("previous IS NOT NULL")
        .select("job", "run_day", "tokens", "previous", (F.col("tokens") - F.col("previous")).alias("change"),
                ratio(F.col("tokens") - F.col("previous"), F.col("previous"), 1).alias("change_pct"))
    )


def next_at_or_after(instants: DataFrame, at: str, marks: DataFrame, mark: str) -> DataFrame:
    """instants with, as `mark`, the first mark at or after each: an as-of merge of two time lines.

    Both are put in one line and cut by the hour.  Within an hour a window carries each mark back to the instants before
    it; where none is left in the hour, the first mark of the next hour that has one is taken.  A window over hours finds
    that, so it grows with the calendar and not with the rows.
    """
    hour = F.date_trunc("hour", at)
    line = (
        instants.withColumn("_mark", F.lit(None).cast(marks.schema[mark].dataType))
        .unionByName(marks.select(F.col(mark).alias(at), F.col(mark).alias("_mark")).distinct(), allowMissingColumns=True)
        .withColumn("_is_mark", F.col("_mark").isNotNull()).withColumn("_hour", hour)
    )
    hours = line.groupBy("_hour").agg(F.min("_mark").alias("_first"))
    later = W.orderBy("_hour").rowsBetween(1, W.unboundedFollowing)
    hours = hours.select(F.col("_hour").alias("_of"), F.first("_first", ignorenulls=True).over(later).alias("_later"))
    # Later rows first, and at one time the mark first, so that it counts as at or after.
    back = W.partitionBy("_hour").orderBy(F.col(at).desc(), F.col("_is_mark").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = line.withColumn("_near", F.last("_mark", ignorenulls=True).over(back)).where("NOT _is_mark")
    return found.join(hours, F.col("_hour").eqNullSafe(F.col("_of")), "left").select(
        *instants.columns, F.coalesce("_near", F.when(F.col(at).isNotNull(), F.col("_later"))).alias(mark))


def billing_latency(charges: DataFrame, ticks: DataFrame) -> DataFrame:
    """Time from a charge to the first export tick at or after it, by day of usage.

    Charges of one instant are counted first and searched once.  Charges after
    the last tick are reported as unlogged, not as zero.
    """
    instants = charges.groupBy("used_at").agg(rows().alias("n"))
    met = next_at_or_after(instants, "used_at", ticks, "tick")
    delivered = F.sum(F.when(F.col("tick").isNotNull(), F.col("n")).otherwise(0))
    wait = F.timestamp_diff("SECOND", F.col("used_at"), F.col("tick"))
    return met.withColumn("wait", wait).groupBy(F.to_date("used_at").alias("day")).agg(
        F.sum("n").alias("charges"), delivered.alias("delivered"), (F.sum("n") - delivered).alias("unlogged"),
        F.max(F.datediff(F.to_date("tick"), F.to_date("used_at"))).cast("long").alias("max_days"),
        ratio(F.max("wait"), F.lit(3600), 1, 1).alias("max_hours"))


def weekly_hours(spark, start: str, stop: str, days: tuple[int, ...]) -> DataFrame:
    """The 168 hours of a week, marked off where the schedule stops the machine."""
    hours = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"),
                                    (F.col("id") % 24).cast("int").alias("hour"))
    on = F.col("weekday").isin(*days) & (F.col("hour") >= int(start)) & (F.col("hour") < int(stop))
    return hours.withColumn("off", ~on)


def hours_off_share(usage: DataFrame, schedule: DataFrame) -> DataFrame:
    """Scheduled-off share of the week, and the usage that falls in those hours.

    Usage is counted per meter and hour of week before it meets the schedule.
    """
    per_hour = usage.groupBy("meter", F.weekday("used_at").alias("weekday"), F.hour("used_at").alias("hour")).agg(
        rows().alias("n"))
    off_rows = F.sum(F.when(F.col("off"), F.col("n")).otherwise(0))
    share = schedule.agg(F.count_if("off").alias("hours_off"), rows().alias("hours"))
    return (
        per_hour.join(schedule, ["weekday", "hour"]).groupBy("meter")
        .agg(F.sum("n").alias("row_count"), off_rows.alias("rows_in_off_hours"),
             ratio(off_rows, F.sum("n")).alias("usage_off_pct"))
        .crossJoin(F.broadcast(share))
        .withColumn("hours_off_pct", ratio(F.col("hours_off"), F.col("hours")))
    )


def absent_dates(usage: DataFrame, by: str) -> DataFrame:
    """Gaps between consecutive days present: absent, which is not the same as zero."""
    days = usage.select(by, F.to_date("used_at").alias("day")).distinct()
    following = F.lead("day").over(W.partitionBy(by).orderBy("day"))
    return (
        days.withColumn("next_day", following).where(F.datediff("next_day", "day") > 1)
        .select(by, F.date_add("day", 1).alias("absent_from"), F.date_sub("next_day", 1).alias("absent_to"),
                (F.datediff("next_day", "day") - 1).cast("long").alias("absent_days"))
    )
