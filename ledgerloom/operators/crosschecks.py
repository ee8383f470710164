"""Checks that need more than one dataset at once.

Each side is aggregated to its key first, then joined; findings share one
shape.  Where the authority dataset is missing or empty nothing is emitted:
not evaluable is not a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import charge_day, count_where, ratio, reads, rows, total, usage
from ledgerloom.functions.joins import by_civil_day
from ledgerloom.operators.reconcile import civil
from ledgerloom.operators.rulebook import FAIL, INFO, PRODUCT_TOLERANCE, WARN



def _tolerance() -> Column:
    return F.lit(PRODUCT_TOLERANCE).cast("decimal(7,6)")


def _found(check: str, severity, subject: Column, text, count=None, left=None, right=None) -> Column:
    """The common shape: what, how strong, about whom, and the figures behind it."""
    def column(value, kind):
        if value is None:
            return F.lit(None).cast(kind)
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        F.lit(check).alias("check_id"), column(severity, "string").alias("severity"),
        subject.cast("string").alias("subject"), column(text, "string").alias("finding"),
        column(count, "bigint").alias("row_count"), column(left, "decimal(28,4)").alias("left_amount"),
        column(right, "decimal(28,4)").alias("right_amount"))


def finding(frame: DataFrame, *shape, **figures) -> DataFrame:
    return frame.select(_found(*shape, **figures).alias("found")).select("found.*")


def _each(frame: DataFrame, *entries: Column) -> DataFrame:
    """A row for every entry that is not null; entries are structs of one type."""
    made = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return frame.select(F.explode(made).alias("found")).select("found.*")


def _all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _only_if_any(found: DataFrame, authority: DataFrame) -> DataFrame:
    """Keep findings only where the authority has rows (one probe row at most)."""
    probe = authority.select(F.lit(1).alias("_probe")).limit(1)
    return found.crossJoin(F.broadcast(probe)).drop("_probe")


def _keyed(keys: list[str], *sides: DataFrame) -> DataFrame:
    """Sides of one row a key put together: a key's columns of every side, null where that side lacks it; one shuffle."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


# ---- invoices ---------------------------------------------------------------

INVOICE_CHECK = "XDS-invoice-reconciliation"


@reads("InvoiceId", "BillingCurrency", "BilledCost")
def invoice_reconciliation(bill: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per invoice and currency, where both sides know it; the rest is reported apart."""
    keys = ["InvoiceId", "BillingCurrency"]
    named = F.col("InvoiceId") != ""
    both = _keyed(
        keys,
        bill.groupBy(*keys).agg(rows().alias("cost_rows"), F.coalesce(total("BilledCost"), F.lit(0)).alias("cost_total")),
        invoices.groupBy(*keys).agg(rows().alias("lines"), total("BilledCost").alias("line_total")))
    # A currency that is not known meets no other.
    seen = F.coalesce((F.col("cost_rows") > 0) & F.col("BillingCurrency").isNotNull(), F.lit(False))
    apart = F.abs(F.col("cost_total") - F.col("line_total")) > _tolerance()
    stated = F.coalesce(named, F.lit(False)) & F.col("line_total").isNotNull()
    nothing = F.lit(0).cast("bigint")
    # A key's own verdict, and what it adds to the sums over all keys; the sums melt into one row before the shuffle.
    own = F.struct(
        F.concat("InvoiceId", F.lit(" ["), "BillingCurrency", F.lit("]")).alias("subject"), F.when(seen, "apart").otherwise("unseen").alias("part"),
        F.when(seen, F.col("cost_total")).alias("cost_total"), F.col("line_total"), F.lit(1).cast("bigint").alias("n"),
        nothing.alias("of"), nothing.alias("lines"), nothing.alias("shared"))
    sums = F.struct(
        F.lit(None).cast("string").alias("subject"), F.lit("all").alias("part"),
        *[F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("cost_total", "line_total")],
        F.when(F.coalesce("InvoiceId", F.lit("")) == "", F.coalesce("cost_rows", nothing)).otherwise(nothing).alias("n"),
        F.coalesce("cost_rows", nothing).alias("of"), F.coalesce("lines", nothing).alias("lines"), (stated & seen).cast("bigint").alias("shared"))
    melted = _each(both, F.when(stated & (~seen | apart), own), sums).groupBy("part", "subject", "cost_total", "line_total").agg(
        *[F.sum(c).alias(c) for c in ("n", "of", "lines", "shared")])
    unseen, whole = F.col("part") == "unseen", F.col("part") == "all"
    per_key = _found(
        INVOICE_CHECK, F.when(unseen, WARN).otherwise(FAIL), F.col("subject"),
        F.when(unseen, "no cost row carries this invoice; not evaluable").otherwise("cost rows and invoice lines differ"),
        None, F.col("cost_total"), F.col("line_total"))
    unattributed = _found(
        INVOICE_CHECK, INFO, F.lit("cost rows without an invoice"),
        F.concat(ratio(F.col("n"), F.col("of"), 0).cast("long").cast("string"), F.lit("% of rows are outside reconciliation")), F.col("n"))
    shared = _found(INVOICE_CHECK, INFO, F.lit("invoices reconciled"), "reconciled on the named key", F.col("shared"))
    # Two invoices of unknown currency may be alike in subject and sum: as many findings as there are keys.
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(whole, F.lit(1).cast("bigint")).otherwise(F.col("n"))))
    return _each(melted.select("*", times.alias("_time")), F.when(~whole, per_key),
                 F.when(whole & (F.col("lines") > 0) & (F.col("n") > 0), unattributed),
                 F.when(whole & (F.col("shared") > 0), shared))


ORPHAN_CHECK = "XDS-invoice-orphan-cost-side"


@reads("InvoiceId")
def invoice_orphan(bill: DataFrame, invoices: DataFrame) -> DataFrame:
    known = invoices.where(F.col("InvoiceId").isNotNull()).select("InvoiceId").distinct()
    orphans = (
        bill.where(F.col("InvoiceId") != "").groupBy("InvoiceId").agg(rows().alias("n"))
        .join(known, "InvoiceId", "left_anti")
    )
    each = finding(orphans, ORPHAN_CHECK, FAIL, F.col("InvoiceId"), "invoice does not exist in invoice_detail",
                   F.col("n"))
    clean = finding(orphans.agg(rows().alias("n")).where("n = 0"), ORPHAN_CHECK, INFO, F.lit("all invoices"),
                    "every invoice on a cost row exists", None)
    return _only_if_any(_all(each, clean), known)


# ---- commitments ------------------------------------------------------------

CLOSURE_CHECK = "XDS-commitment-closure"


@reads("CommitmentDiscountId", "BillingCurrency", "ChargeCategory", "EffectiveCost", "BilledCost",
       "ChargePeriodStart", "ChargePeriodEnd")
def commitment_term_closure(bill: DataFrame, contracts: DataFrame) -> DataFrame:
    """Closure of a commitment in a currency, asserted only where the bill spans the contract's whole term."""
    zero = F.lit(0)
    keys = ["CommitmentDiscountId", "BillingCurrency"]
    spent = bill.where(F.col("CommitmentDiscountId") != "").groupBy(*keys).agg(
        F.coalesce(total("EffectiveCost", usage()), zero).alias("used"),
        F.coalesce(total("BilledCost", F.col("ChargeCategory") == "Purchase"), zero).alias("bought"),
        F.min(F.when(usage(), F.col("ChargePeriodStart"))).alias("seen_from"),
        F.max(F.when(usage(), F.col("ChargePeriodEnd"))).alias("seen_to"))
    terms = contracts.select(
        F.col("ContractCommitmentId").alias("CommitmentDiscountId"), "BillingCurrency", F.lit(True).alias("known"),
        F.col("ContractCommitmentCost").cast("decimal(28,4)").alias("contracted"),
        civil("ContractCommitmentPeriodStart").cast("timestamp_ntz").alias("opens"),
        civil("ContractCommitmentPeriodEnd").cast("timestamp_ntz").alias("closes"))
    joined = spent.join(terms, keys, "left")
    seconds = F.timestamp_diff("SECOND", F.greatest("seen_from", "opens"), F.least("seen_to", "closes"))
    # greatest/least skip nulls, so an unobserved commitment is removed first.
    observed = F.coalesce(F.col("known"), F.lit(False)) & F.col("seen_from").isNotNull() & F.col("seen_to").isNotNull()
    full = (F.col("seen_from") <= F.col("opens")) & (F.col("seen_to") >= F.col("closes"))
    closes = F.abs(F.col("used") - F.col("bought")) <= _tolerance()
    state = (
        F.when(full & ~closes, "FAIL|term fully covered; closure must hold and does not")
        .when(full, "INFO|term fully covered and closure holds")
        .when(seconds <= 0, "WARN|every usage row falls outside the term")
        .otherwise("INFO|dataset covers part of the term; closure not evaluable"))
    parts = F.split("state", r"\|")
    named = F.col("CommitmentDiscountId")

    def told(message: str | Column) -> Column:
        said = F.lit(message) if isinstance(message, str) else message
        return F.concat(said, F.lit(" ["), F.coalesce("BillingCurrency", F.lit("unknown")), F.lit("]"))

    judged = _found(CLOSURE_CHECK, parts[0], named, told(parts[1]), F.when(~full & (seconds > 0), F.floor(seconds / 86400)),
                    F.col("used"), F.col("bought"))
    unknown = _found(CLOSURE_CHECK, INFO, named, told("no contract record; term unknown"), None, F.col("used"))
    dear = F.abs(F.col("bought") - F.col("contracted")) > _tolerance()
    disagree = _found(CLOSURE_CHECK, FAIL, named, told("purchases disagree with the contract cost"), None, F.col("bought"), F.col("contracted"))
    found = _each(joined.withColumn("state", state), F.when(observed, judged), F.when(F.col("known").isNull(), unknown),
                  F.when(observed & full & (F.col("bought") != 0) & dear, disagree))
    return _only_if_any(found, contracts)


# ---- periods ----------------------------------------------------------------

PERIOD_CHECK = "XDS-billing-period"


def period_overlap(periods: DataFrame) -> DataFrame:
    """Neighbouring declared periods of one issuer that overlap."""
    ordered = W.partitionBy("InvoiceIssuerName").orderBy("opens", "closes", "BillingPeriodStatus")
    bounds = periods.select("InvoiceIssuerName", civil("BillingPeriodStart").alias("opens"),
                            civil("BillingPeriodEnd").alias("closes"), "BillingPeriodStatus")
    return (
        bounds.where("opens IS NOT NULL AND closes IS NOT NULL")
        .withColumn("previous_start", F.lag("opens").over(ordered))
        .withColumn("previous_end", F.lag("closes").over(ordered))
        .where(F.col("opens") < F.col("previous_end"))
        .select("InvoiceIssuerName", "previous_start", "previous_end", F.col("opens").alias("next_start"),
                F.col("closes").alias("next_end"))
    )


@reads("ChargePeriodStart")
def billing_periods(bill: DataFrame, periods: DataFrame) -> DataFrame:
    """Overlaps, several open periods, and bill rows no period contains.

    The bill is counted per civil day before it meets the periods.
    """
    overlap = period_overlap(periods)
    overlaps = finding(
        overlap, PERIOD_CHECK, FAIL,
        F.concat_ws("..", F.col("previous_start").cast("string"), F.col("previous_end").cast("string")),
        F.concat(F.lit("overlaps "), F.concat_ws("..", F.col("next_start").cast("string"),
                                                 F.col("next_end").cast("string"))))
    several = finding(
        periods.agg(count_where(F.lower("BillingPeriodStatus") == "open").alias("n")).where("n > 1"),
        PERIOD_CHECK, WARN, F.lit("open periods"), "more than one period is open", F.col("n"))
    days = by_civil_day(periods.select(civil("BillingPeriodStart").alias("opens"),
                                       civil("BillingPeriodEnd").alias("closes")), "opens", "closes")
    per_day = bill.where(F.col("ChargePeriodStart").isNotNull()).groupBy(charge_day().alias("day")).agg(
        rows().alias("n"))
    uncovered = per_day.join(days.select("day").distinct(), "day", "left_anti").agg(F.sum("n").alias("n"))
    outside = finding(uncovered.where("n > 0"), PERIOD_CHECK, INFO, F.lit("cost rows outside every period"),
                      "the periods do not describe the whole bill", F.col("n"))
    return _only_if_any(_all(overlaps, several, outside), periods)


PAIR_CHECK = "XDS-period-pair-match"


@reads("BillingPeriodStart", "BillingPeriodEnd")
def period_pairs(bill: DataFrame, periods: DataFrame) -> DataFrame:
    def pairs(frame):
        # Raw values are counted first, so the text step sees a few pairs only.
        return (
            frame.groupBy("BillingPeriodStart", "BillingPeriodEnd").agg(rows().alias("n"))
            .groupBy(civil("BillingPeriodStart").alias("opens"), civil("BillingPeriodEnd").alias("closes"))
            .agg(F.sum("n").alias("n")).where("opens IS NOT NULL AND closes IS NOT NULL")
        )

    declared = pairs(periods).drop("n")
    missing = pairs(bill).join(declared, ["opens", "closes"], "left_anti")
    each = finding(missing, PAIR_CHECK, FAIL,
                   F.concat_ws("..", F.col("opens").cast("string"), F.col("closes").cast("string")),
                   "period has no row in billing_period", F.col("n"))
    clean = finding(missing.agg(rows().alias("n")).where("n = 0"), PAIR_CHECK, INFO, F.lit("all periods"),
                    "every period pair exists", None)
    return _only_if_any(_all(each, clean), declared)


CORRECTION_CHECK = "XDS-correction-discipline"


@reads("ChargeClass", "InvoiceId", "ChargePeriodStart")
def correction_rules(bill: DataFrame, invoices: DataFrame | None, periods: DataFrame | None) -> DataFrame:
    """Corrections restate a closed period and their invoice names what it corrects.

    Corrections are counted per invoice and civil day before any join, so a hot
    invoice or day is one row.
    """
    made = (
        bill.where(F.col("ChargeClass") == "Correction")
        .groupBy("InvoiceId", charge_day().alias("day")).agg(rows().alias("n"))
    )

    def entry(part: str, key: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), F.col("n")))

    blank = F.coalesce("InvoiceId", F.lit("")) == ""
    entries = [entry("none", F.lit(""), blank)]
    sides, flags = [], {}
    if invoices is not None:
        entries.append(entry("invoice", F.col("InvoiceId"), ~blank))
        flags["has_invoices"] = invoices
        sides.append(invoices.where(F.col("ReferenceInvoiceId") != F.col("InvoiceId")).select(
            F.lit("invoice").alias("part"), F.col("InvoiceId").alias("key"), F.lit("named").alias("status")).distinct())
    if periods is not None:
        entries.append(entry("day", F.col("day"), ~blank))
        days = (
            by_civil_day(periods.select(civil("BillingPeriodStart").alias("opens"),
                                        civil("BillingPeriodEnd").alias("closes"), "BillingPeriodStatus"),
                         "opens", "closes")
            .groupBy("day").agg(F.min_by("BillingPeriodStatus", F.struct("opens", "closes")).alias("status"))
        )
        flags["has_periods"] = periods
        sides.append(days.select(F.lit("day").alias("part"), F.col("day").cast("string").alias("key"), "status"))
    counted = _each(made, *entries).groupBy("part", "key").agg(F.sum("n").alias("n"))
    if not sides:
        counted = counted.withColumn("status", F.lit(None).cast("string"))
    met = _keyed(["part", "key"], counted, *sides).where("n IS NOT NULL")
    for name, authority in flags.items():
        met = met.crossJoin(F.broadcast(authority.limit(1).agg((rows() > 0).alias(name))))
    part, closed = F.col("part"), F.coalesce(F.lower("status") == "closed", F.lit(False))
    unnamed = _found(CORRECTION_CHECK, WARN, F.lit("corrections without an invoice"), "cut-off discipline is not evaluable", F.col("n"))
    silent = _found(CORRECTION_CHECK, FAIL, F.col("key"), "no line on this invoice names what is corrected", F.col("n"))
    judged = _found(
        CORRECTION_CHECK, F.when(closed, INFO).otherwise(FAIL), F.col("key"),
        F.when(F.col("status").isNull(), "date falls in no declared period").when(closed, "restates a closed period")
        .otherwise(F.concat(F.lit("restates a period that is "), "status")), F.col("n"))
    found = [F.when(part == "none", unnamed)]
    if invoices is not None:
        found.append(F.when((part == "invoice") & F.col("has_invoices") & F.col("status").isNull(), silent))
    if periods is not None:
        found.append(F.when((part == "day") & F.col("has_periods"), judged))
    return _each(met, *found)


# ---- eligibility ------------------------------------------------------------

ELIGIBILITY_CHECK = "XDS-eligibility-universe"


@reads("ChargeCategory", "BillingCurrency", "x_CommitmentEligible", "CommitmentDiscountStatus",
       "PricingCategory", "x_SchemaEra", "EffectiveCost")
def eligibility(bill: DataFrame) -> DataFrame:
    """Current-era demand without a verdict is a failure; both coverage figures are reported."""
    flag = F.col("x_CommitmentEligible")
    unused = F.coalesce(F.col("CommitmentDiscountStatus") == "Unused", F.lit(False))
    sums = bill.where(usage()).groupBy("BillingCurrency").agg(
        total("EffectiveCost", flag & (F.col("PricingCategory") == "Committed")).alias("covered"),
        total("EffectiveCost", flag).alias("eligible"), total("EffectiveCost", ~unused).alias("demand"),
        count_where(flag.isNull() & (F.col("x_SchemaEra") == "1.2") & ~unused).alias("unexplained"))
    gap = finding(sums.agg(F.sum("unexplained").alias("n")).where("n > 0"), ELIGIBILITY_CHECK, FAIL,
                  F.lit("rows without a verdict"), "the eligibility universe is not fully explained", F.col("n"))
    covered = F.coalesce("covered", F.lit(0))
    figures = finding(
        sums.where("BillingCurrency IS NOT NULL AND eligible > 0 AND demand > 0"), ELIGIBILITY_CHECK, INFO,
        F.col("BillingCurrency"),
        F.concat(F.lit("coverage of coverable "), ratio(covered, F.col("eligible")).cast("string"),
                 F.lit("% vs naive "), ratio(covered, F.col("demand")).cast("string"), F.lit("%")),
        None, F.col("eligible"), F.col("demand"))
    return gap.unionByName(figures)
