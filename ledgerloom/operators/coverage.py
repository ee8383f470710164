"""Commitment coverage measured against what a commitment could cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import labels
from ledgerloom.functions.columns import charge_day, display, ratio, reads, rows, total, usage
from ledgerloom.operators.reconcile import CENT_TOLERANCE, civil

UNUSED = "coalesce(CommitmentDiscountStatus, '') = 'Unused'"


@reads("ChargeCategory", "BillingCurrency", "x_CommitmentEligible", "PricingCategory",
       "CommitmentDiscountStatus", "EffectiveCost")
def coverage_of_coverable(bill: DataFrame) -> DataFrame:
    """Covered over eligible demand, beside the naive figure over all usage."""
    eligible = F.col("x_CommitmentEligible")
    covered, demand, everything = F.col("covered"), F.col("demand"), F.col("everything")
    return (
        bill.where(usage()).groupBy("BillingCurrency")
        .agg(total("EffectiveCost", eligible & (F.col("PricingCategory") == "Committed")).alias("covered"),
             total("EffectiveCost", eligible).alias("demand"),
             total("EffectiveCost", ~F.expr(UNUSED)).alias("everything"))
        .where(demand.isNotNull())
        .withColumn("covered", F.coalesce("covered", F.lit(0).cast("decimal(28,4)")))
        .select("BillingCurrency", display(covered).alias("covered_eligible"),
                display(demand).alias("total_eligible"),
                ratio(covered, demand).alias("coverage_of_coverable_pct"),
                ratio(covered, everything).alias("naive_coverage_of_all_usage_pct"))
        .orderBy("BillingCurrency")
    )


@reads("ChargeCategory", "x_CommitmentEligible", "PricingCategory", "BillingCurrency", "ResourceId",
       "ResourceName", "EffectiveCost")
def uncovered_action_list(bill: DataFrame) -> DataFrame:
    """Eligible demand still at standard price: what a purchase would address."""
    return (
        bill.where(usage() & F.col("x_CommitmentEligible") & (F.col("PricingCategory") == "Standard"))
        .groupBy("BillingCurrency", "ResourceId")
        .agg(F.min("ResourceName").alias("resource"), rows().alias("rows_"),
             display(total("EffectiveCost")).alias("uncovered_eligible_effective"))
        .drop("ResourceId")
        .orderBy("BillingCurrency", F.desc("uncovered_eligible_effective"))
    )


@reads("x_CommitmentEligible", "ChargeCategory", "CommitmentDiscountStatus", "x_SchemaEra",
       "BillingCurrency", "EffectiveCost")
def eligibility_universe(bill: DataFrame) -> DataFrame:
    """Every row in exactly one bucket; a null flag is never read as ineligible."""
    flag, category = F.col("x_CommitmentEligible"), F.col("ChargeCategory")
    bucket = (
        F.when(flag, labels.BUCKET_ELIGIBLE)
        .when(~flag, labels.BUCKET_INELIGIBLE)
        .when((category == "Usage") & F.expr(UNUSED), labels.BUCKET_UNUSED)
        .when(category != "Usage", labels.BUCKET_NON_USAGE)
        .when(F.col("x_SchemaEra") != "1.2",
              F.replace(F.lit(labels.BUCKET_ERA), F.lit("{era}"), F.col("x_SchemaEra")))
        .otherwise(labels.BUCKET_UNEXPLAINED))
    return (
        bill.groupBy(bucket.alias("eligibility_bucket"), "BillingCurrency")
        .agg(rows().alias("rows_"), display(total("EffectiveCost")).alias("effective_cost"))
        .orderBy("eligibility_bucket", "BillingCurrency")
    )


@reads("CommitmentDiscountId", "BillingCurrency", "ChargeCategory", "EffectiveCost", "BilledCost",
       "ChargePeriodStart")
def term_closure(bill: DataFrame, contracts: DataFrame) -> DataFrame:
    """Amortised, purchased and contracted amounts of a currency; the first matching verdict stands."""
    category, day = F.col("ChargeCategory"), charge_day()
    spent = (
        bill.where(F.col("CommitmentDiscountId").isNotNull()).groupBy("CommitmentDiscountId", "BillingCurrency")
        .agg(total("BilledCost", category == "Purchase").alias("purchased"),
             total("EffectiveCost", category == "Usage").alias("amortised"), F.max(day).alias("last_seen"))
    )
    terms = contracts.select(
        F.col("ContractCommitmentId").alias("CommitmentDiscountId"), "BillingCurrency", F.lit(True).alias("known"),
        F.col("ContractCommitmentCost").cast("decimal(28,4)").alias("contracted"),
        civil("ContractCommitmentPeriodStart").alias("term_start"),
        civil("ContractCommitmentPeriodEnd").alias("term_end"))
    zero, tolerance = F.lit(0), F.lit(CENT_TOLERANCE).cast("decimal(4,3)")
    amortised_gap = F.abs(F.coalesce("amortised", zero) - F.col("contracted"))
    purchased_gap = F.abs(F.coalesce("purchased", zero) - F.col("contracted"))
    return (
        spent.join(terms, ["CommitmentDiscountId", "BillingCurrency"], "left")
        .select("CommitmentDiscountId", "BillingCurrency", display(F.col("purchased")).alias("purchase_billed"),
                display(F.col("amortised")).alias("amortised_effective"),
                display(F.col("contracted")).alias("contract_cost"), "term_start", "term_end",
                F.when(F.col("known").isNull(), labels.TERM_ORPHAN)
                .when((F.col("last_seen") < F.col("term_end")) & (amortised_gap >= tolerance),
                      labels.TERM_IN_PROGRESS)
                .when((amortised_gap < tolerance) & (purchased_gap < tolerance), labels.TERM_CLOSES)
                .otherwise(labels.TERM_REVIEW).alias("verdict"))
        .orderBy("CommitmentDiscountId")
    )


@reads("ChargeCategory", "CommitmentDiscountStatus", "CommitmentDiscountId", "BillingCurrency", "EffectiveCost")
def unused_commitment(bill: DataFrame) -> DataFrame:
    status = F.col("CommitmentDiscountStatus")
    used, unused, both = F.col("used"), F.col("unused"), F.col("both")
    return (
        bill.where(usage() & status.isNotNull()).groupBy("CommitmentDiscountId", "BillingCurrency")
        .agg(total("EffectiveCost", status == "Used").alias("used"),
             total("EffectiveCost", status == "Unused").alias("unused"),
             total("EffectiveCost", status.isin("Used", "Unused")).alias("both"))
        .select("CommitmentDiscountId", "BillingCurrency", display(used).alias("used_effective"),
                display(unused).alias("unused_effective"), ratio(used, both).alias("utilisation_pct"))
        .orderBy("CommitmentDiscountId")
    )
