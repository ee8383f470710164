"""Bill rows and their companion datasets as DataFrames over the driver tables.

Join shapes: every join here is a many-to-one key lookup.  Nothing is hinted
as broadcast; Spark compares the real size with its own threshold (statically
and again at run time) and otherwise sort-merges, which is the right plan for
orders and customer at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import Span, apart
from ledgerloom.sources import bill_columns as rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A pass of more columns than this is a step of its own, compiled apart from the joins and the other passes.
PASS_WIDTH = 12


def bill(spark: SparkSession, sf_dir: str, *columns: str, billed_in: Span | None = None) -> DataFrame:
    """The bill, holding only the requested columns (all of them by default).

    billed_in bounds the scan for a question about that window: rows billed in it were charged in it or, as corrections
    are billed a month late, in the month before.  It keeps every row of the window by either date, and others.
    """
    columns = columns or tuple(rules.FULL_BILL)
    needed = rules.closure(columns)
    joined_tables = rules.tables_for(columns)

    def raw(name: str) -> DataFrame:
        keep = [c for c in rules.RAW[name]
                if c in needed or any(c in rules.JOIN_KEYS[t] for t in joined_tables)]
        return table(spark, sf_dir, name).select(*keep)

    rows = raw("lineitem")
    if billed_in is not None:
        rows = rows.where((F.col("l_shipdate") >= F.add_months(F.lit(billed_in.start).cast("date"), -1).cast("timestamp_ntz"))
                          & (F.col("l_shipdate") < F.lit(billed_in.end).cast("timestamp_ntz")))
    if "customer" in joined_tables:
        # Resolve the small geography first so the fact side is joined once to orders.
        buyer = raw("customer")
        for dimension in ("nation", "region"):
            if dimension in joined_tables:
                left, right = rules.JOIN_KEYS[dimension]
                buyer = buyer.join(raw(dimension), F.col(left) == F.col(right))
        order = raw("orders").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    elif "orders" in joined_tables:
        rows = rows.join(raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in joined_tables:
        rows = rows.join(raw("part"), F.col("l_partkey") == F.col("p_partkey"))
    steps = rules.late_levels(columns)
    for n, step in enumerate(steps):
        made = {c: F.expr(rules.COLUMNS[c]) for c in step}
        if n == len(steps) - 1:
            # The last pass holds nothing that another column is made of.
            made = {c: made.get(c, F.col(c)) for c in columns}
        else:
            made = {c: F.col(c) for c in rows.columns} | made
        rows = apart(rows, made, step) if len(step) > PASS_WIDTH else rows.select(*[v.alias(c) for c, v in made.items()])
    return rows.select(*columns)


INVOICE_KEYS = ["InvoiceId", "ReferenceInvoiceId", "BillingCurrency", "ChargeCategory",
                "ChargeClass", "BillingPeriodStart", "BillingPeriodEnd"]


def invoice_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: one per invoice, currency, category and class.

    The fault plan (a missing month, a month off by a cent, an invoice nothing
    cites) exists so every reconciliation verdict has rows.
    """
    lines = (
        bill(spark, sf_dir, "InvoiceId", "reference_invoice", "BillingCurrency", "ChargeCategory",
             "ChargeClass", "BillingPeriodStart", "BillingPeriodEnd", "BilledCost")
        .where("InvoiceId IS NOT NULL AND BillingPeriodStart <> DATE'1999-05-01'")
        .groupBy("InvoiceId", F.col("reference_invoice").alias("ReferenceInvoiceId"),
                 "BillingCurrency", "ChargeCategory", "ChargeClass",
                 "BillingPeriodStart", "BillingPeriodEnd")
        .agg(F.sum("BilledCost").alias("BilledCost"))
    )
    off_by_a_cent = F.col("BillingPeriodStart") == F.lit("2000-01-01").cast("date")
    cents = F.when(off_by_a_cent, F.lit("0.01").cast("decimal(4,2)")).otherwise(F.lit("0.00").cast("decimal(4,2)"))
    amount = (F.col("BilledCost") + cents).cast("decimal(28,4)")
    real = F.struct(*INVOICE_KEYS, amount.alias("BilledCost"))
    # One invoice id nothing on the bill cites, priced from the real lines of its month.
    ghost_id = F.concat(F.lit("GHOST-"), "BillingCurrency")
    ghost = F.struct(
        ghost_id.alias("InvoiceId"), ghost_id.alias("ReferenceInvoiceId"), "BillingCurrency", F.lit("Usage").alias("ChargeCategory"),
        F.lit(None).cast("string").alias("ChargeClass"), F.lit("2000-02-01").cast("date").alias("BillingPeriodStart"),
        F.lit("2000-03-01").cast("date").alias("BillingPeriodEnd"), amount.alias("BilledCost"))
    both = F.array(real, F.when(F.col("BillingPeriodStart") == F.lit("2000-02-01").cast("date"), ghost))
    return (
        lines.select(F.explode(F.filter(both, lambda line: line.isNotNull())).alias("line")).select("line.*")
        .groupBy(*INVOICE_KEYS).agg(F.sum("BilledCost").cast("decimal(28,4)").alias("BilledCost"))
        .select(*INVOICE_KEYS, "BilledCost", F.lit("Issued").alias("InvoiceIssueStatus"))
    )


def billing_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared periods: every period pair on the bill bar one, one of them too long."""
    start = F.col("BillingPeriodStart")
    return (
        bill(spark, sf_dir, "BillingPeriodStart", "BillingPeriodEnd", "InvoiceIssuerName")
        .distinct()
        .where(start != F.lit("1996-03-01").cast("date"))
        .select(
            "BillingPeriodStart",
            F.when(start == F.lit("1998-02-01").cast("date"), F.date_add("BillingPeriodEnd", 5))
            .otherwise(F.col("BillingPeriodEnd")).alias("BillingPeriodEnd"),
            F.when((start >= F.lit("2001-10-01").cast("date"))
                   | (start == F.lit("1999-09-01").cast("date")), "Open")
            .otherwise("Closed").alias("BillingPeriodStatus"),
            "InvoiceIssuerName",
        )
    )


def contract_commitment(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """A contract for half of the commitments, so that some have none, or for all: cost as purchased, by currency."""
    return (
        bill(spark, sf_dir, "CommitmentDiscountId", "BillingCurrency", "ChargeCategory", "BilledCost")
        .where("CommitmentDiscountId IS NOT NULL" if every else "CommitmentDiscountId LIKE '%0'")
        .groupBy(F.col("CommitmentDiscountId").alias("ContractCommitmentId"), "BillingCurrency")
        .agg(F.sum(F.when(F.col("ChargeCategory") == "Purchase", F.col("BilledCost")))
             .alias("ContractCommitmentCost"))
        .select(
            "ContractCommitmentId",
            F.concat(F.lit("term of "), "ContractCommitmentId").alias("ContractCommitmentDescription"),
            F.coalesce("ContractCommitmentCost", F.lit(0)).cast("decimal(28,4)")
            .alias("ContractCommitmentCost"),
            "BillingCurrency",
            # Longer terms for every third commitment, so no verdict is unpopulated.
            F.when(F.col("ContractCommitmentId").rlike("[369]0$"), F.lit("1994-01-01"))
            .otherwise(F.lit("1999-01-01")).cast("date").alias("ContractCommitmentPeriodStart"),
            F.when(F.col("ContractCommitmentId").rlike("[369]0$"), F.lit("2003-01-01"))
            .when(F.col("ContractCommitmentId").rlike("[5]0$"), F.lit("1999-01-08"))
            .otherwise(F.lit("2000-01-01")).cast("date").alias("ContractCommitmentPeriodEnd"),
        )
    )
