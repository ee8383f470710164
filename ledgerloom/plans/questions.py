"""The recurring finance questions over a bill.

Scope is always a parameter.  Consumption questions filter the charge start,
bill questions the billing-period start; currencies are never added together
and nothing is inferred from an amount's sign.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom import labels
from ledgerloom.functions.columns import (
    Span, charge_day, display, not_correction, ratio, reads, resource_key, rows, team, total, usage)
from ledgerloom.functions.joins import lookup_join
from ledgerloom.functions.median import exact_median


# ---- showback ---------------------------------------------------------------

@reads("Tags", "BillingCurrency", "ChargeCategory", "ChargePeriodStart", "EffectiveCost")
def showback_by_team(bill: DataFrame, span: Span) -> DataFrame:
    """What each team's consumption in the window cost."""
    return (
        bill.where(usage() & span.on("ChargePeriodStart"))
        .groupBy(team().alias("team"), "BillingCurrency")
        .agg(rows().alias("row_count"),
             display(total("EffectiveCost")).alias("effective_cost_consumption"))
        .orderBy("BillingCurrency", F.desc("effective_cost_consumption"))
    )


@reads("ChargeCategory", "BillingCurrency", "BillingPeriodStart", "BilledCost")
def reconciling_items(bill: DataFrame, span: Span) -> DataFrame:
    """What sits on the bill besides consumption."""
    return (
        bill.where(~usage() & span.on_date("BillingPeriodStart"))
        .groupBy("ChargeCategory", "BillingCurrency")
        .agg(rows().alias("row_count"), display(total("BilledCost")).alias("billed_cost_cash"))
        .orderBy("BillingCurrency", F.desc("billed_cost_cash"))
    )


@reads("ChargeCategory", "BillingCurrency", "BillingPeriodStart", "BilledCost")
def completeness_tie_out(bill: DataFrame, span: Span) -> DataFrame:
    """Usage side, reconciling side and their total from one scan."""
    sides = (
        bill.where(span.on_date("BillingPeriodStart"))
        .groupBy(usage().alias("is_usage"), "BillingCurrency")
        .agg(rows().alias("n"), total("BilledCost").alias("cash"))
    )
    panel = (F.when(F.grouping("is_usage") == 1, "GRAND TOTAL (= sum of the two above)")
             .when(F.col("is_usage"), "usage side").otherwise("reconciling side"))
    return (
        sides.groupingSets([["is_usage", "BillingCurrency"], ["BillingCurrency"]],
                           "is_usage", "BillingCurrency")
        .agg(panel.alias("panel"), F.grouping("is_usage").alias("is_total"),
             F.sum("n").alias("row_count"), display(F.sum("cash")).alias("billed_cost_cash"))
        # A row without a category counts in the total and on neither side.
        .where((F.col("is_total") == 1) | F.col("is_usage").isNotNull())
        .select("panel", "BillingCurrency", "row_count", "billed_cost_cash")
        .orderBy("BillingCurrency", "panel")
    )


@reads("ChargeCategory", "ChargeClass", "ResourceName", "ChargePeriodStart", "BillingPeriodStart", "BilledCost")
def scope_bridge(bill: DataFrame, span: Span) -> DataFrame:
    """Usage rows in exactly one of the two scopes: the bill's or consumption's."""
    on_bill, consumed = span.on_date("BillingPeriodStart"), span.on("ChargePeriodStart")
    return (
        bill.where(usage() & (on_bill | consumed) & (on_bill != consumed))
        .select(
            F.when(on_bill, "on the bill").otherwise("not on the bill").alias("bill_scope"),
            F.when(consumed, "consumed in window").otherwise("consumed outside window")
            .alias("consumption_scope"),
            "ChargeCategory", "ChargeClass", "ResourceName",
            charge_day().alias("charge_period_start"),
            display(F.col("BilledCost")).alias("billed_cost_cash"))
    )


# ---- budget -----------------------------------------------------------------

def _budget_subject(bill: DataFrame, span: Span, currency: str) -> DataFrame:
    return bill.where(~F.col("x_Synthetic") & usage() & (F.col("BillingCurrency") == currency)
                      & span.on("ChargePeriodStart"))


BUDGET_COLUMNS = ("x_Synthetic", "ChargeCategory", "BillingCurrency", "ChargePeriodStart", "EffectiveCost")


@reads(*BUDGET_COLUMNS)
def budget_vs_actual(bill: DataFrame, span: Span, budget: Decimal, currency: str = "USD") -> DataFrame:
    """A budget is compared only with its own subject."""
    limit = F.lit(budget).cast("decimal(18,2)")
    spent = F.col("effective_cost_consumption")
    return (
        _budget_subject(bill, span, currency)
        .agg(display(total("EffectiveCost")).alias("effective_cost_consumption"))
        .select(limit.alias("monthly_budget"), spent, display(limit - spent).alias("remaining"),
                ratio(spent, limit).alias("pct_of_budget_consumed"))
    )


@reads(*BUDGET_COLUMNS)
def daily_burn_down(bill: DataFrame, span: Span, budget: Decimal, days_in_period: int,
                    currency: str = "USD") -> DataFrame:
    """Cumulative spend by day beside a straight-line pace.

    The running total is over daily totals of one currency, so its single
    partition holds at most one row per calendar day.
    """
    limit = F.lit(budget).cast("decimal(18,2)")
    so_far = F.sum("spent").over(W.partitionBy("BillingCurrency").orderBy("day"))
    return (
        _budget_subject(bill, span, currency)
        .groupBy("BillingCurrency", charge_day().alias("day")).agg(total("EffectiveCost").alias("spent"))
        .withColumn("so_far", so_far)
        .select("day", display(F.col("spent")).alias("effective_cost_day"),
                display(F.col("so_far")).alias("cumulative_consumption"),
                ratio(limit * F.dayofmonth("day"), F.lit(days_in_period), 2, 1).alias("straight_line_pace"),
                ratio(F.col("so_far"), limit).alias("cumulative_pct_of_budget"))
        .orderBy("day")
    )


@reads("x_Synthetic", "ChargeCategory", "BillingCurrency", "ChargePeriodStart", "BillingPeriodStart",
       "EffectiveCost", "BilledCost")
def out_of_scope_panel(bill: DataFrame, span: Span) -> DataFrame:
    """Everything the budget leaves out, with the metric named per row; one scan."""
    consumption = usage() & span.on("ChargePeriodStart")
    events = ~usage() & span.on_date("BillingPeriodStart")
    return (
        bill.where(F.col("x_Synthetic") & (consumption | events))
        .groupBy(usage().alias("is_usage"), "BillingCurrency")
        .agg(rows().alias("row_count"), total("EffectiveCost").alias("effective"),
             total("BilledCost").alias("billed"))
        .select(
            F.when(F.col("is_usage"), "synthetic consumption (not the budget's subject)")
            .otherwise("synthetic billing events (reconciling panel)").alias("excluded_because"),
            "BillingCurrency", "row_count",
            F.when(F.col("is_usage"), "EffectiveCost").otherwise("BilledCost").alias("metric"),
            display(F.when(F.col("is_usage"), F.col("effective")).otherwise(F.col("billed"))).alias("amount"))
        .orderBy("excluded_because", "BillingCurrency")
    )


# ---- anomalies --------------------------------------------------------------

def resource_days(bill: DataFrame, span: Span) -> DataFrame:
    """Cost per resource, currency and day; ids group, names only display."""
    return (
        bill.where(usage() & not_correction() & span.on("ChargePeriodStart"))
        .groupBy(resource_key().alias("resource_key"), "BillingCurrency", charge_day().alias("day"))
        .agg(F.min("ResourceName").alias("resource_name"), total("EffectiveCost").alias("cost"))
    )


def _against_typical(days: DataFrame) -> DataFrame:
    """Resource-days beside their currency's median non-zero resource-day."""
    typical = exact_median(days.where(F.col("cost") != 0), ["BillingCurrency"], "cost", "typical")
    return lookup_join(days, typical, ["BillingCurrency"], ["resource_key", "day"])


ANOMALY_COLUMNS = ("ChargeCategory", "ChargeClass", "ChargePeriodStart", "ResourceId", "ResourceName",
                   "BillingCurrency", "EffectiveCost")


@reads(*ANOMALY_COLUMNS)
def anomaly_detection(bill: DataFrame, span: Span, times: int = 10, top: int = 10) -> DataFrame:
    """The resource-days furthest above typical; ``top`` is the report's own size."""
    cost = F.col("cost").cast("double")
    return (
        _against_typical(resource_days(bill, span))
        .withColumn("multiple", cost / F.nullif(F.col("typical"), F.lit(0.0)))
        .orderBy(F.desc_nulls_last("multiple"), "resource_key", "day", "BillingCurrency").limit(top)
        .select("resource_name", "BillingCurrency", "day",
                display(F.col("cost")).alias("effective_cost_day"),
                F.round(F.col("typical").cast("decimal(28,6)"), 2).alias("median_nonzero_resource_day"),
                F.round(F.col("multiple").cast("decimal(28,6)"), 1).alias("multiple_of_median"),
                F.when(cost >= times * F.col("typical"), "ANOMALY").otherwise("").alias("flag"))
    )


@reads(*ANOMALY_COLUMNS, "ServiceCategory", "ServiceName", "ChargeDescription", "Tags", "BilledCost")
def anomaly_incident(bill: DataFrame, span: Span, times: int = 10) -> DataFrame:
    """The evidence row of every flagged resource, over its whole life.

    The bill is reduced to one row per resource and currency *before* the join,
    so a resource holding a third of all rows is still one row there.
    """
    flagged = (
        _against_typical(resource_days(bill, span))
        .where(F.col("cost").cast("double") >= times * F.col("typical"))
        .select("resource_key").distinct()
    )
    day = charge_day()
    history = (
        bill.where(usage())
        .withColumn("resource_key", resource_key()).withColumn("team_tag", F.get_json_object("Tags", "$.team"))
        .groupBy("resource_key", "BillingCurrency")
        .agg(F.min("ResourceName").alias("resource_name"),
             F.min("ServiceCategory").alias("service_category"),
             F.min("ServiceName").alias("service_name"),
             F.min("ChargeDescription").alias("charge_description"),
             F.coalesce(F.min("team_tag"), F.lit("UNTAGGED")).alias("team"),
             F.min(day).alias("first_seen"), F.max(day).alias("last_seen"),
             F.count_distinct(day).alias("days_active"),
             display(total("EffectiveCost")).alias("effective_cost_total"),
             display(total("BilledCost")).alias("billed_cost_cash_total"))
    )
    return history.join(flagged, "resource_key", "left_semi").drop("resource_key")


# ---- savings ----------------------------------------------------------------

@reads("ChargeCategory", "ChargePeriodStart", "BillingCurrency", "ListCost", "ContractedCost", "EffectiveCost")
def savings_ladder(bill: DataFrame, span: Span) -> DataFrame:
    """Three rungs, each naming what it was saved against; the third is the sum of the others."""
    lst, con, eff = F.col("lst"), F.col("con"), F.col("eff")
    nothing = F.lit(None).cast("decimal(38,4)")

    def rung(name, against, list_cost, contracted, effective, saving):
        wide = [c.cast("decimal(38,4)") for c in (list_cost, contracted, effective, saving)]
        return F.struct(F.lit(name).alias("rung"), F.lit(against).alias("saved_compared_to"),
                        *[c.alias(n) for c, n in zip(wide, ("list_raw", "contracted_raw",
                                                            "effective_raw", "saving_raw"))])

    rungs = F.array(
        rung("1. negotiation", "vs paying the public list price", lst, con, nothing, lst - con),
        rung("2. commitment", "vs paying our negotiated rate on demand", nothing, con, eff, con - eff),
        rung("3. HEADLINE (= rung 1 + rung 2)", "vs paying the public list price with no commitments",
             lst, nothing, eff, lst - eff))
    return (
        bill.where(usage() & span.on("ChargePeriodStart")).groupBy("BillingCurrency")
        .agg(total("ListCost").alias("lst"), total("ContractedCost").alias("con"),
             total("EffectiveCost").alias("eff"))
        .where(lst != 0)
        .select("BillingCurrency", "lst", F.explode(rungs).alias("r")).select("BillingCurrency", "lst", "r.*")
        .select("rung", "saved_compared_to", "BillingCurrency",
                display(F.col("list_raw")).alias("list_cost"),
                display(F.col("contracted_raw")).alias("contracted_cost"),
                display(F.col("effective_raw")).alias("effective_cost"),
                display(F.col("saving_raw")).alias("saving"),
                ratio(F.col("saving_raw"), lst).alias("pct_of_list"))
        .orderBy("BillingCurrency", "rung")
    )


@reads("ChargeCategory", "ChargePeriodStart", "BillingCurrency", "CommitmentDiscountId",
       "ListCost", "ContractedCost", "EffectiveCost")
def savings_by_coverage(bill: DataFrame, span: Span) -> DataFrame:
    covered = F.when(F.col("CommitmentDiscountId").isNotNull(), labels.COVERED).otherwise(labels.ON_DEMAND)
    lst, con, eff = total("ListCost"), total("ContractedCost"), total("EffectiveCost")
    return (
        bill.where(usage() & span.on("ChargePeriodStart"))
        .groupBy(covered.alias("coverage"), "BillingCurrency")
        .agg(rows().alias("row_count"), display(lst).alias("list_cost"),
             display(con).alias("contracted_cost"), display(eff).alias("effective_cost"),
             display(lst - con).alias("negotiation_saving"), display(con - eff).alias("commitment_saving"))
        .orderBy("BillingCurrency", "coverage")
    )


# ---- blocks -----------------------------------------------------------------

@reads("ChargeCategory", "ChargeClass", "ChargePeriodStart", "ResourceName", "ChargeDescription",
       "BillingCurrency", "PricingUnit", "ConsumedUnit", "x_PricingBlockSize", "ConsumedQuantity",
       "PricingQuantity", "EffectiveCost")
def block_pricing_waste(bill: DataFrame, span: Span, tolerance: float = 0.0001) -> DataFrame:
    """Priced against consumed in the same unit; not assessable without a block size."""
    consumed, priced, cost = F.col("consumed"), F.col("priced"), F.col("cost")
    in_blocks = F.when(F.col("x_PricingBlockSize") != 0,
                       consumed.cast("double") / F.col("x_PricingBlockSize").cast("double"))
    waste = priced.cast("double") - F.col("in_blocks")
    waste_cost = waste * cost.cast("double") / F.nullif(priced.cast("double"), F.lit(0.0))

    def shown(value, digits):
        return F.round(value.cast("decimal(28,6)"), digits)

    return (
        bill.where(usage() & not_correction() & span.on("ChargePeriodStart")
                   & (F.col("PricingQuantity") != F.col("ConsumedQuantity")))
        .groupBy("ResourceName", "ChargeDescription", "BillingCurrency", "PricingUnit", "ConsumedUnit",
                 "x_PricingBlockSize")
        .agg(total("ConsumedQuantity").alias("consumed"), total("PricingQuantity").alias("priced"),
             total("EffectiveCost").alias("cost"))
        .withColumn("in_blocks", in_blocks).withColumn("waste", waste).withColumn("waste_cost", waste_cost)
        .orderBy(F.desc_nulls_last("waste_cost"))
        .select("ResourceName", "ChargeDescription", "BillingCurrency",
                display(consumed, 4).alias("consumed_quantity"), F.col("ConsumedUnit").alias("consumed_unit"),
                display(priced, 4).alias("pricing_quantity"), F.col("PricingUnit").alias("pricing_unit"),
                shown(F.col("in_blocks"), 4).alias("consumed_in_pricing_units"),
                display(cost).alias("effective_cost_consumption"),
                F.when(F.col("in_blocks").isNull(),
                       "unit conversion — block size not recorded; waste not assessable")
                .when(F.col("waste") < tolerance,
                      "unit rescaling only — exact division, no rounding waste")
                .otherwise("BLOCK ROUNDING WASTE").alias("verdict"),
                shown(F.col("waste"), 4).alias("waste_blocks"),
                shown(F.col("waste_cost"), 2).alias("waste_cost_effective"),
                ratio(F.col("in_blocks"), priced).alias("block_utilisation_pct"))
    )


# ---- commitments ------------------------------------------------------------

@reads("CommitmentDiscountId", "BillingCurrency", "ChargeCategory", "CommitmentDiscountStatus",
       "EffectiveCost", "ChargePeriodStart")
def commitment_utilisation(bill: DataFrame, contracts: DataFrame) -> DataFrame:
    """Utilisation over a term, refused where the term is unknown or not fully observed."""
    status = F.col("CommitmentDiscountStatus")
    day = charge_day()
    observed = (
        bill.where(F.col("CommitmentDiscountId").isNotNull() & usage())
        .groupBy("CommitmentDiscountId", "BillingCurrency")
        .agg(total("EffectiveCost", status == "Used").alias("used"),
             total("EffectiveCost", status == "Unused").alias("unused"),
             F.min(day).alias("first_observed"), F.max(day).alias("last_observed"),
             F.count_distinct(day).alias("days_observed"))
    )
    terms = contracts.select(
        F.col("ContractCommitmentId").alias("CommitmentDiscountId"), "BillingCurrency",
        F.col("ContractCommitmentDescription").alias("description"),
        F.col("ContractCommitmentCost").alias("contract_cost"),
        F.col("ContractCommitmentPeriodStart").cast("date").alias("term_start"),
        F.col("ContractCommitmentPeriodEnd").cast("date").alias("term_end"))
    both = F.col("used") + F.coalesce("unused", F.lit(0))
    pct = ratio(F.col("used"), both)
    short = F.replace(F.lit(labels.USE_SHORT), F.lit("{observed}"), F.col("days_observed").cast("string"))
    short = F.replace(short, F.lit("{term}"), F.col("term_days").cast("string"))
    return (
        observed.join(terms, ["CommitmentDiscountId", "BillingCurrency"], "left")
        .withColumn("term_days", F.datediff("term_end", "term_start"))
        .orderBy(F.asc_nulls_last("term_start"))
        .select(F.regexp_extract("CommitmentDiscountId", "[^/]+$", 0).alias("commitment"), "description",
                "BillingCurrency", "term_start", "term_end", F.col("term_days").cast("long").alias("term_days"),
                "days_observed", "first_observed", "last_observed",
                display(F.col("used")).alias("used_effective"),
                display(F.col("unused")).alias("unused_effective"),
                display(both).alias("used_plus_unused"),
                display(F.col("contract_cost")).alias("contract_commitment_cost"),
                F.when(F.col("term_days").isNull(), labels.USE_UNKNOWN)
                .when(F.col("days_observed") < F.col("term_days"), short)
                .otherwise(F.replace(F.lit(labels.USE_RATE), F.lit("{rate}"), pct.cast("string"))).alias("verdict"))
    )
