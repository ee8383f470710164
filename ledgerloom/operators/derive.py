"""Datasets and figures derived from a bill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import count_where, display, kept_apart, reads, rows, total, usage
from ledgerloom.functions.numbering import numbered
from ledgerloom.functions.profile import counts_by_column


def third_party() -> Column:
    return ~F.col("PublisherName").eqNullSafe(F.col("ProviderName"))


# ---- invoice lines ----------------------------------------------------------

ISSUE_DELAY_DAYS = 8
PAYMENT_DAYS = 30


@reads("InvoiceId", "ChargeCategory", "ChargeClass", "ChargePeriodStart", "BillingPeriodStart", "BillingPeriodEnd",
       "BillingCurrency", "BilledCost", "InvoiceIssuerName", "BillingAccountId")
def derive_invoice_detail(bill: DataFrame) -> DataFrame:
    """Invoice lines from cost rows of every currency, numbered once across the whole file.

    Periods are those of the rows, whatever an invoice id looks like.  A correction refers to the invoice of the month it
    corrects where its own id spells its period; from another id that invoice cannot be told, and the reference is null.
    Issuer and account are named where all rows of a line agree on them.
    """
    def agreed(name: str) -> Column:
        return F.when(F.min(name) == F.max(name), F.min(name)).alias(name)

    grain = ["InvoiceId", "BillingCurrency", "BillingPeriodStart", "ChargeCategory", "ChargeClass", "charge_month"]
    lines = (
        bill.where(F.col("InvoiceId") != "")
        .withColumn("charge_month", F.to_date(F.trunc("ChargePeriodStart", "MM")))
        .withColumns({c: F.to_date(c) for c in ("BillingPeriodStart", "BillingPeriodEnd")})
        .groupBy(*grain).agg(total("BilledCost").alias("amount"), F.max("BillingPeriodEnd").alias("closes"),
                             agreed("InvoiceIssuerName"), agreed("BillingAccountId"))
        .withColumn("class_order", F.coalesce("ChargeClass", F.lit("")))
    )
    order = ["InvoiceId", "BillingCurrency", "BillingPeriodStart", "ChargeCategory", "class_order", "charge_month"]
    correction = F.col("ChargeClass").eqNullSafe("Correction")
    own, month = (F.date_format(c, "yyyy-MM") for c in ("BillingPeriodStart", "charge_month"))
    renamed = F.when(F.contains("InvoiceId", own), F.replace("InvoiceId", own, month))
    reference = F.when(correction, renamed).otherwise(F.col("InvoiceId"))
    issued = F.date_add("closes", ISSUE_DELAY_DAYS)
    # The line number is padded to three digits and never cut beyond them.
    digits = F.col("number").cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    described = F.concat(F.col("ChargeCategory"), F.lit(" correction to "), F.coalesce(reference, F.lit("an invoice not named")))
    return numbered(lines, order, "number").select(
        F.concat("InvoiceId", F.lit("-"), padded).alias("InvoiceDetailId"), "InvoiceId",
        reference.alias("ReferenceInvoiceId"), "InvoiceIssuerName", "BillingAccountId", "BillingCurrency",
        display(F.col("amount")).alias("BilledCost"), "ChargeCategory", "BillingPeriodStart", F.col("closes").alias("BillingPeriodEnd"),
        issued.alias("InvoiceIssueDate"), F.lit("Issued").alias("InvoiceIssueStatus"),
        F.date_add(issued, PAYMENT_DAYS).alias("PaymentDueDate"), F.lit(f"Net {PAYMENT_DAYS}").alias("PaymentTerms"),
        F.when(correction, described).otherwise(F.concat("ChargeCategory", F.lit(" charges"))).alias("InvoiceDetailDescription"),
        F.concat(F.lit('{"ChargeCategory":"'), "ChargeCategory", F.lit('","ChargeClass":"'),
                 F.coalesce("ChargeClass", F.lit("None")), F.lit('"}')).alias("InvoiceDetailGrain"),
        issued.alias("InvoiceDetailCreated"), issued.alias("InvoiceDetailLastUpdated"))


# ---- reservation amortisation -----------------------------------------------

def amortise_commitment(contracts: DataFrame, hours_per_day: int = 24, full_days: int = 10,
                        partial_hours: int = 18, committed_rate: str = "0.10",
                        on_demand_rate: str = "0.15") -> DataFrame:
    """A commitment in a currency as one purchase plus a Used (and Unused) row per day of its term."""
    committed = F.lit(committed_rate).cast("decimal(9,4)")
    on_demand = F.lit(on_demand_rate).cast("decimal(9,4)")
    term = contracts.select(
        F.col("ContractCommitmentId").alias("CommitmentDiscountId"), "BillingCurrency",
        F.col("ContractCommitmentPeriodStart").cast("date").alias("opens"),
        F.col("ContractCommitmentPeriodEnd").cast("date").alias("closes"))
    daily = (
        term.select("CommitmentDiscountId", "BillingCurrency",
                    F.posexplode(F.sequence("opens", F.date_sub("closes", 1))).alias("n", "day"))
        .withColumn("used", F.when(F.col("n") < full_days, hours_per_day).otherwise(partial_hours))
        .select("CommitmentDiscountId", "BillingCurrency", "day", F.explode(F.array(
            F.struct(F.lit("Used").alias("status"), F.col("used").alias("hours")),
            F.struct(F.lit("Unused").alias("status"), (F.lit(hours_per_day) - F.col("used")).alias("hours"))))
            .alias("s"))
        .select("CommitmentDiscountId", "BillingCurrency", "day", "s.*").where("hours > 0")
        .select("CommitmentDiscountId", "BillingCurrency", F.col("day").alias("ChargeDay"), F.lit("Usage").alias("ChargeCategory"),
                F.col("status").alias("CommitmentDiscountStatus"), F.col("hours").cast("long").alias("hours"),
                (F.col("hours") * F.when(F.col("status") == "Used", on_demand).otherwise(committed))
                .cast("decimal(28,4)").alias("ListCost"),
                (F.col("hours") * committed).cast("decimal(28,4)").alias("EffectiveCost"),
                F.lit(0).cast("decimal(28,4)").alias("BilledCost"))
    )
    hours = (F.datediff("closes", "opens") * hours_per_day).cast("long")
    paid = (hours * committed).cast("decimal(28,4)")
    purchase = term.select(
        "CommitmentDiscountId", "BillingCurrency", F.col("opens").alias("ChargeDay"), F.lit("Purchase").alias("ChargeCategory"),
        F.lit(None).cast("string").alias("CommitmentDiscountStatus"), hours.alias("hours"),
        paid.alias("ListCost"), F.lit(0).cast("decimal(28,4)").alias("EffectiveCost"),
        paid.alias("BilledCost"))
    return purchase.unionByName(daily)


# ---- reading a bill's totals ------------------------------------------------

@reads("BillingCurrency", "EffectiveCost", "BilledCost", "PublisherName", "ProviderName",
       "ChargeCategory", "CommitmentDiscountId")
def gap_explained(bill: DataFrame) -> DataFrame:
    """Effective less billed, against the causes that explain it."""
    committed = usage() & F.col("CommitmentDiscountId").isNotNull()
    zero = F.lit(0)
    parts = bill.groupBy("BillingCurrency").agg(
        total("BilledCost").alias("billed"), total("EffectiveCost").alias("effective"),
        F.coalesce(total("EffectiveCost", third_party()), zero).alias("third"),
        F.coalesce(total("EffectiveCost", committed), zero).alias("amortised"),
        F.coalesce(total("BilledCost", F.col("ChargeCategory") == "Purchase"), zero).alias("purchased"),
        F.coalesce(total("EffectiveCost", third_party() & committed), zero).alias("overlap"))
    explained = F.expr("third + amortised - purchased - overlap")
    gap = F.expr("effective - billed")
    return parts.select(
        "BillingCurrency", display(gap).alias("gap"), display(F.col("third")).alias("third_party"),
        display(F.expr("amortised - purchased")).alias("commitment_timing"),
        display(F.col("overlap")).alias("overlap"), display(explained).alias("explained"),
        display(gap - explained).alias("unexplained"),
        F.when(gap == explained, "PASS").otherwise("FAIL").alias("verdict"))


@reads("BillingCurrency", "ResourceId", "EffectiveCost")
def allocatable_split(bill: DataFrame) -> DataFrame:
    split = F.when(F.col("ResourceId").isNotNull(), "allocatable").otherwise("unallocatable")
    return bill.groupBy("BillingCurrency", split.alias("allocation")).agg(
        rows().alias("row_count"), display(total("EffectiveCost")).alias("effective_cost"))


@reads("BillingCurrency", "BilledCost", "EffectiveCost", "PublisherName", "ProviderName", "CommitmentDiscountId")
def zero_billed(bill: DataFrame) -> DataFrame:
    """Billed nothing yet cost something: why.  A row may have both causes."""
    covered = F.col("CommitmentDiscountId").isNotNull()
    return (
        bill.where((F.col("BilledCost") == 0) & (F.col("EffectiveCost") > 0)).groupBy("BillingCurrency")
        .agg(rows().alias("row_count"), count_where(covered).alias("commitment_covered"),
             count_where(third_party()).alias("third_party"),
             display(total("EffectiveCost")).alias("effective_cost"))
    )


@reads("ChargePeriodStart", "ChargePeriodEnd", "BillingPeriodEnd")
def month_boundary(bill: DataFrame) -> DataFrame:
    """Charges whose exclusive end is their bill's end: kept by half-open filters only."""
    ends = F.to_date("ChargePeriodEnd")
    return (
        bill.where((ends == F.col("BillingPeriodEnd").cast("date"))
                   & (F.col("ChargePeriodStart") < F.col("ChargePeriodEnd")))
        .groupBy(ends.alias("boundary")).agg(rows().alias("row_count"))
    )


@reads("ChargeCategory", "ChargeClass", "EffectiveCost", "BillingCurrency")
def corrections(bill: DataFrame) -> DataFrame:
    """Corrections that say so, and negative usage that does not."""
    kind = (F.when(F.col("ChargeClass") == "Correction", "flagged")
            .when(F.col("ChargeClass").isNull() & usage() & (F.col("EffectiveCost") < 0), "unflagged"))
    return (
        bill.withColumn("kind", kind).where(F.col("kind").isNotNull()).groupBy("kind", "BillingCurrency")
        .agg(rows().alias("row_count"), display(total("EffectiveCost")).alias("effective_cost"))
    )


@reads("x_SchemaEra", "ChargePeriodStart", "ChargePeriodEnd")
def granularity(bill: DataFrame) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.col("ChargePeriodStart"), F.col("ChargePeriodEnd"))
    return bill.groupBy("x_SchemaEra", hours.alias("hours")).agg(rows().alias("row_count"))


def currency_totals(bill: DataFrame) -> DataFrame:
    """Per-currency totals; there is deliberately no row adding currencies up."""
    return bill.groupBy("BillingCurrency").agg(display(total("EffectiveCost")).alias("effective_cost"))


def era_gap(bill: DataFrame, era: str = "pre-1.2") -> DataFrame:
    """Standard columns an era could not carry, with what rows of it hold anyway."""
    missing = [c for c in schema.STANDARD_COLUMNS if not schema.era_supports(era, c) and c in bill.columns]
    counted = {c: F.count(F.col(c)) for c in missing}
    introduced = F.create_map(*[F.lit(x) for c in missing for x in (c, schema.INTRODUCED[c])])
    return (
        counts_by_column(bill.where(F.col("x_SchemaEra") == era), counted, "column_name", "populated",
                         {"era_rows": rows()})
        .withColumn("introduced", introduced[F.col("column_name")])
    )


@reads("SkuPriceDetails", "x_SkuDetails")
def sku_key_coverage(bill: DataFrame) -> DataFrame:
    """Rows using each standard property, and each key that is not one.

    Distinct documents are counted before their keys are exploded.
    """
    text = F.coalesce("SkuPriceDetails", "x_SkuDetails")
    documents = bill.where(text.isNotNull()).groupBy(text.alias("document")).agg(rows().alias("n"))
    used = (
        documents.select("n", F.explode(F.json_object_keys("document")).alias("sku_key"))
        .groupBy("sku_key").agg(F.sum("n").alias("row_count"))
    )
    key, zero = F.col("sku_key"), F.lit(0).cast("long")
    standard = counts_by_column(
        used, {k: F.coalesce(F.sum(F.when(key == k, F.col("row_count"))), zero) for k in schema.SKU_PROPERTIES},
        "sku_key", "row_count").withColumn("kind", F.lit("standard"))
    other = used.where(~key.isin(*schema.SKU_PROPERTIES)).withColumn(
        "kind", F.when(key.startswith("x_"), "provider").otherwise("unknown"))
    return standard.unionByName(other)


#: Where a digest of 64 hexadecimal digits is cut, so that each piece fits a long: (first digit, digits).
DIGEST_PIECES = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))


def content_fingerprint(frame: DataFrame, by: list[str]) -> DataFrame:
    """A fingerprint of the values that row order, files and partitions cannot change.

    All 256 bits of every row's digest enter, as exclusive or and as sum.  Values carry their length, so neither a null
    nor a separator inside a value can be taken for something else.
    """
    def told(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    parts = [told(c) for c in sorted(frame.columns)]
    digest = F.sha2(F.concat_ws(",", *[kept_apart(part) for part in parts[:1]], *parts[1:]), 256)
    pieces = [F.conv(F.substring("_digest", at, size), 16, 10).cast("long").alias(f"_h{at}") for at, size in DIGEST_PIECES]
    return (
        frame.select(*by, digest.alias("_digest")).select(*by, *pieces).groupBy(*by).agg(
            rows().alias("row_count"),
            F.concat_ws("-", *[F.bit_xor(f"_h{at}") for at, _ in DIGEST_PIECES]).alias("xor_of_rows"),
            F.concat_ws("-", *[F.sum(F.col(f"_h{at}").cast("decimal(20,0)")) for at, _ in DIGEST_PIECES]).alias("sum_of_rows"))
    )
