"""Bill, invoices and billing periods against each other.

Every side is aggregated to its key before it is joined, so a key carrying a
third of the bill meets the join as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import labels
from ledgerloom.functions.columns import charge_day, display, reads, rows, total
from ledgerloom.functions.joins import by_civil_day, lookup_join

CENT_TOLERANCE = "0.005"


def civil(name: str) -> Column:
    """A period bound as the civil date written, whatever its storage type."""
    return F.to_date(F.substring(F.col(name).cast("string"), 1, 10))


def _per_invoice(frame: DataFrame, amount: str, count: str) -> DataFrame:
    return (
        frame.where(F.col("InvoiceId").isNotNull()).groupBy("InvoiceId", "BillingCurrency")
        .agg(total("BilledCost").alias(amount), rows().alias(count))
    )


@reads("InvoiceId", "BillingCurrency", "BilledCost")
def invoice_tie_out(bill: DataFrame, invoices: DataFrame) -> DataFrame:
    cost = _per_invoice(bill, "cost_total", "cost_rows")
    lines = _per_invoice(invoices, "line_total", "line_count")
    gap = F.abs(F.col("cost_total") - F.col("line_total"))
    return (
        cost.join(lines, ["InvoiceId", "BillingCurrency"], "full_outer")
        .select(
            "InvoiceId", F.col("BillingCurrency").alias("Currency"),
            display(F.col("line_total")).alias("InvoiceTotal"),
            display(F.col("cost_total")).alias("CostUsageBilled"),
            F.col("cost_rows").alias("CU_Rows"), F.col("line_count").alias("InvoiceLines"),
            display(F.coalesce("cost_total", F.lit(0)) - F.coalesce("line_total", F.lit(0))).alias("Difference"),
            F.when(F.col("cost_rows").isNull(), "FAIL — invoice has no Cost & Usage rows")
            .when(F.col("line_count").isNull(), "FAIL — InvoiceId absent from invoice_detail")
            .when(gap < F.lit(CENT_TOLERANCE).cast("decimal(4,3)"), "TIES TO THE CENT")
            .otherwise("FAIL — does not tie").alias("Verdict"))
        .orderBy("InvoiceId", "Currency")
    )


@reads("InvoiceId", "x_InvoiceId", "ChargeCategory", "BillingCurrency", "BillingPeriodStart", "BilledCost")
def reconciling_panels(bill: DataFrame) -> DataFrame:
    """Every row in one of five panels, in order of precedence."""
    category = F.col("ChargeCategory")
    panel = (
        F.when(F.col("InvoiceId").isNotNull(), labels.PANEL_INVOICED)
        .when(F.col("x_InvoiceId").isNotNull(), labels.PANEL_LEGACY)
        .when(category.isin(labels.ACCOUNT_LEVEL), labels.PANEL_ACCOUNT)
        .when(category == "Purchase", labels.PANEL_PURCHASE)
        .otherwise(labels.PANEL_OPEN))
    return (
        bill.groupBy(panel.alias("ReconcilingPanel"), "BillingCurrency",
                     F.date_format("BillingPeriodStart", "yyyy-MM").alias("BillingPeriod"))
        .agg(rows().alias("Rows"), display(total("BilledCost")).alias("BilledCost"))
        .orderBy("ReconcilingPanel", "BillingCurrency", "BillingPeriod")
    )


@reads("InvoiceId", "BillingCurrency", "BilledCost")
def reconciliation_proof(bill: DataFrame) -> DataFrame:
    """Invoiced plus not invoiced equals everything, per currency, from one scan."""
    panel = (F.when(F.grouping("invoiced") == 1, "3 · = Dataset total")
             .when(F.col("invoiced"), "1 · Invoiced total").otherwise("2 · Reconciling items total"))
    sides = bill.groupBy(F.col("InvoiceId").isNotNull().alias("invoiced"), "BillingCurrency").agg(
        rows().alias("n"), total("BilledCost").alias("cash"))
    return (
        sides.groupingSets([["invoiced", "BillingCurrency"], ["BillingCurrency"]], "invoiced", "BillingCurrency")
        .agg(panel.alias("Panel"), display(F.sum("cash")).alias("BilledCost"), F.sum("n").alias("Rows"))
        .select("Panel", "BillingCurrency", "BilledCost", "Rows").orderBy("BillingCurrency", "Panel")
    )


@reads("InvoiceId")
def invoice_orphans(bill: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice ids known to one side only; on the invoice side, issued ones."""
    cited = bill.where(F.col("InvoiceId").isNotNull()).groupBy("InvoiceId").agg(rows().alias("Rows"))
    issued = (
        invoices.where((F.col("InvoiceIssueStatus") == "Issued") & F.col("InvoiceId").isNotNull())
        .groupBy("InvoiceId").agg(rows().alias("Rows"))
    )
    known = invoices.select("InvoiceId").where(F.col("InvoiceId").isNotNull()).distinct()
    return (
        cited.join(known, "InvoiceId", "left_anti")
        .select(F.lit("CU InvoiceId missing from invoice_detail").alias("Direction"), "InvoiceId", "Rows")
        .unionByName(
            issued.join(cited, "InvoiceId", "left_anti")
            .select(F.lit("Issued invoice with no CU rows").alias("Direction"), "InvoiceId", "Rows"))
    )


@reads("InvoiceId")
def invoice_shared_keys(bill: DataFrame, invoices: DataFrame) -> DataFrame:
    """How many invoice ids both sides know, or only one does."""
    cost = bill.where(F.col("InvoiceId").isNotNull()).select("InvoiceId").distinct().withColumn("on_bill", F.lit(True))
    lines = invoices.where(F.col("InvoiceId").isNotNull()).select("InvoiceId").distinct().withColumn("on_invoice", F.lit(True))
    where = (F.when(F.col("on_bill") & F.col("on_invoice"), "shared")
             .when(F.col("on_bill"), "bill only").otherwise("invoice only"))
    return (
        cost.join(lines, "InvoiceId", "full_outer").groupBy(where.alias("known_to")).agg(rows().alias("invoices"))
    )


@reads("BillingPeriodStart", "BillingPeriodEnd")
def period_match(bill: DataFrame, periods: DataFrame) -> DataFrame:
    """Every period pair on the bill against the declared ones, at civil-date grain."""
    pairs = (
        # Counted on the raw values first: the text step then sees a few pairs, not the bill.
        bill.groupBy("BillingPeriodStart", "BillingPeriodEnd").agg(rows().alias("n"))
        .groupBy(civil("BillingPeriodStart").alias("PeriodStart"), civil("BillingPeriodEnd").alias("PeriodEnd"))
        .agg(F.sum("n").alias("n"))
    )
    # Duplicate declarations multiply the row count, as a join on the rows would.
    declared = (
        periods.groupBy(civil("BillingPeriodStart").alias("PeriodStart"), civil("BillingPeriodEnd").alias("PeriodEnd"))
        .agg(F.max("BillingPeriodStatus").alias("PeriodStatus"), rows().alias("copies"))
    )
    return (
        pairs.join(declared, ["PeriodStart", "PeriodEnd"], "left")
        .select(F.date_format("PeriodStart", "yyyy-MM-dd").alias("PeriodStart"),
                F.date_format("PeriodEnd", "yyyy-MM-dd").alias("PeriodEnd"),
                (F.col("n") * F.coalesce("copies", F.lit(1))).alias("CU_Rows"), "PeriodStatus",
                F.when(F.col("copies").isNull(), "FAIL — period pair not in billing_period")
                .otherwise("MATCHED").alias("Verdict"))
        .orderBy("PeriodStart")
    )


@reads("ChargeClass", "InvoiceId", "ResourceName", "ChargePeriodStart", "BillingPeriodStart", "BilledCost")
def correction_discipline(bill: DataFrame, invoices: DataFrame, periods: DataFrame) -> DataFrame:
    """Corrections whose invoice refers to another invoice: is the restated period closed?

    The period lookup is an equi-join on the civil day rather than a range
    comparison, and both lookups are salted since one invoice or one day may
    hold most corrections.
    """
    corrections = (
        bill.where((F.col("ChargeClass") == "Correction") & F.col("InvoiceId").isNotNull())
        .withColumn("day", charge_day())
    )
    references = (
        invoices.where(F.col("ReferenceInvoiceId") != F.col("InvoiceId"))
        .select("InvoiceId", "ReferenceInvoiceId")
    )
    days = by_civil_day(
        periods.select(civil("BillingPeriodStart").alias("opens"), civil("BillingPeriodEnd").alias("closes"),
                       "BillingPeriodStatus"), "opens", "closes").select("day", "BillingPeriodStatus")
    spread = ["ResourceName", "ChargePeriodStart", "BilledCost"]
    restated = lookup_join(corrections, references, ["InvoiceId"], spread)
    return (
        lookup_join(restated, days, ["day"], spread, "left")
        .select("ResourceName", F.date_format("day", "yyyy-MM-dd").alias("ConsumptionDate"),
                F.date_format("BillingPeriodStart", "yyyy-MM").alias("BilledInPeriod"),
                display(F.col("BilledCost")).alias("BilledCost"), "ReferenceInvoiceId",
                F.col("BillingPeriodStatus").alias("ReferencedPeriodStatus"),
                F.when(F.col("BillingPeriodStatus") == "Closed", "PASS — restates a closed period")
                .otherwise("FAIL").alias("Verdict"))
    )
