"""What a drop contains: nulls, categories, currencies, placeholders, defects.

Each profile is one aggregate over one scan with every count inside it, then an
unpivot of the single result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import count_where, display, ratio, reads, rows, total
from ledgerloom.functions.profile import counts_by_column, string_columns

CATEGORY_COLUMNS = """ChargeCategory PricingCategory ServiceCategory
    CommitmentDiscountCategory""".split()


def null_profile(frame: DataFrame) -> DataFrame:
    """Null count and share of every column that has any."""
    counted = {c: count_where(F.col(c).isNull()) for c in frame.columns}
    return (
        counts_by_column(frame, counted, "column_name", "nulls", {"total_rows": rows()})
        .where(F.col("nulls") > 0)
        .withColumn("pct", ratio(F.col("nulls"), F.col("total_rows")))
    )


@reads(*CATEGORY_COLUMNS)
def category_inventory(frame: DataFrame) -> DataFrame:
    """Distinct values of every *Category column with counts.

    The combinations are counted first, so the unpivot multiplies a handful of
    distinct combinations rather than the bill.
    """
    names = [c for c in frame.columns if c.endswith("Category")]
    combined = frame.groupBy(*names).agg(rows().alias("n"))
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names])
    return (
        combined.select("n", F.explode(entries).alias("e"))
        .groupBy("e.column_name", "e.value").agg(F.sum("n").alias("row_count"))
    )


@reads("BillingCurrency", "PricingCurrency")
def currency_inventory(frame: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("currency"))
                        for c in ("BillingCurrency", "PricingCurrency") if c in frame.columns])
    pairs = frame.select("BillingCurrency", "PricingCurrency").distinct()
    return pairs.select(F.explode(entries).alias("e")).select("e.*").distinct()


@reads("BillingCurrency", "PricingCurrency")
def currency_pairs(frame: DataFrame) -> DataFrame:
    """Billed against priced currency; different ones are marked, not merged."""
    return (
        frame.groupBy("BillingCurrency", "PricingCurrency").agg(rows().alias("row_count"))
        .withColumn("differs", ~F.col("BillingCurrency").eqNullSafe(F.col("PricingCurrency")))
    )


def semantic_nulls(frame: DataFrame) -> DataFrame:
    """Nulls that state a fact, with the fact."""
    present = {c: m for c, m in schema.NULL_MEANING.items() if c in frame.columns}
    counts = counts_by_column(
        frame, {c: count_where(F.col(c).isNull()) for c in present}, "column_name", "nulls")
    meaning = F.create_map(*[F.lit(x) for pair in present.items() for x in pair])
    return counts.withColumn("meaning", meaning[F.col("column_name")])


def cascade_defects(frame: DataFrame) -> DataFrame:
    """Satellites filled on rows whose anchor is null."""
    pairs = {(a, s): count_where(F.col(a).isNull() & F.col(s).isNotNull())
             for a, satellites in schema.ANCHORS.items() for s in satellites
             if a in frame.columns and s in frame.columns}
    named = counts_by_column(frame, {f"{a}>{s}": c for (a, s), c in pairs.items()}, "pair", "row_count")
    parts = F.split("pair", ">")
    return named.select(parts[0].alias("anchor"), parts[1].alias("satellite"), "row_count").where("row_count > 0")


def placeholder_scan(frame: DataFrame) -> DataFrame:
    """Text standing in for a missing value."""
    counted = {c: count_where(F.col(c).isin(*schema.PLACEHOLDERS)) for c in string_columns(frame)}
    return counts_by_column(frame, counted, "column_name", "placeholders").where("placeholders > 0")


def drop_audit(frame: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows and eras found per drop against the row count its manifest states."""
    found = (
        frame.groupBy(F.col("x_FixtureId").alias("drop_id"), "x_SchemaEra").agg(rows().alias("n"))
        .groupBy("drop_id")
        .agg(F.sum("n").alias("rows_found"),
             F.array_join(F.sort_array(F.collect_set("x_SchemaEra")), ", ").alias("eras"))
    )
    return (
        found.join(manifest, "drop_id", "full_outer")
        .select("drop_id", "rows_found", "eras", "rows_stated",
                F.when(F.col("rows_found").isNull(), "MISSING")
                .when(F.col("rows_found") == F.col("rows_stated"), "MATCH")
                .otherwise("MISMATCH").alias("verdict"))
    )


@reads("BillingCurrency", "x_SchemaEra")
def era_labels(frame: DataFrame) -> DataFrame:
    """The eras present per currency as one label (the eras are a short fixed list)."""
    return (
        frame.select("BillingCurrency", "x_SchemaEra").distinct().groupBy("BillingCurrency")
        .agg(F.array_join(F.sort_array(F.collect_set("x_SchemaEra")), ", ").alias("eras"))
    )


@reads("BillingCurrency", "InvoiceId")
def unattributed_share(frame: DataFrame) -> DataFrame:
    """Rows that name no invoice, with their share."""
    missing = count_where(F.coalesce("InvoiceId", F.lit("")) == "")
    return frame.groupBy("BillingCurrency").agg(
        missing.alias("unattributed"), rows().alias("total_rows"), ratio(missing, rows()).alias("pct"))


@reads("ResourceId", "ResourceName")
def renamed_resources(frame: DataFrame) -> DataFrame:
    """Ids seen under more than one name, one row per id and name.

    Kept long: a list per id would gather an unbounded set in one row.
    """
    named = (
        frame.where(F.col("ResourceId").isNotNull() & F.col("ResourceName").isNotNull())
        .groupBy("ResourceId", "ResourceName").agg(rows().alias("row_count"))
    )
    several = (
        named.groupBy("ResourceId").agg(rows().alias("names")).where("names > 1")
    )
    return named.join(several, "ResourceId")


@reads("x_ResourceGroupName", "BillingCurrency", "EffectiveCost")
def resource_group_fold(frame: DataFrame) -> DataFrame:
    """Cost per resource group once the spellings are folded together."""
    return (
        frame.groupBy(F.lower("x_ResourceGroupName").alias("resource_group"), "BillingCurrency",
                      "x_ResourceGroupName")
        .agg(rows().alias("n"), total("EffectiveCost").alias("cost"))
        .groupBy("resource_group", "BillingCurrency")
        .agg(F.sum("n").alias("row_count"), rows().alias("spellings"),
             display(F.sum("cost")).alias("effective_cost"))
    )
