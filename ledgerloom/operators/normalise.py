"""Bringing schema eras together: canonical names, nulls, provenance, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import count_where
from ledgerloom.functions.profile import counts_by_column, string_columns


def canonical_columns(export: DataFrame) -> DataFrame:
    """Resolve the version-dependent columns from what this export has.

    Decided from the schema alone, so it adds expressions and no work.
    """
    present = set(export.columns)
    resolved = []
    for name, fallback in schema.FALLBACK_COLUMNS.items():
        sources = [F.col(c) for c in (name, fallback) if c in present]
        value = F.coalesce(*sources) if sources else F.lit(None).cast("string")
        resolved.append(value.alias(name))
    return export.select(*[c for c in export.columns if c not in schema.FALLBACK_COLUMNS], *resolved)


def empty_to_null(frame: DataFrame) -> DataFrame:
    """'' becomes NULL on every string column; done once, where layers merge."""
    texts = set(string_columns(frame))
    return frame.select(*[
        F.nullif(F.col(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in frame.columns])


def empty_string_report(frame: DataFrame) -> DataFrame:
    """How many '' each string column holds, counted before they are normalised."""
    counted = {c: count_where(F.col(c) == "") for c in string_columns(frame)}
    return counts_by_column(frame, counted, "column_name", "empty_strings")


def with_provenance(frame: DataFrame, synthetic: bool, era: str, fixture: str) -> DataFrame:
    return frame.withColumns({
        "x_Synthetic": F.lit(synthetic), "x_SchemaEra": F.lit(era), "x_FixtureId": F.lit(fixture)})


def pricing_currency_default(bill: DataFrame) -> DataFrame:
    """Rows of the current era fall back to billing-currency figures; older rows stay null."""
    current = F.col("x_SchemaEra") == schema.TARGET_VERSION

    def filled(name: str, source: str) -> Column:
        return F.when(current, F.coalesce(name, source)).otherwise(F.col(name))

    return bill.withColumns({
        "PricingCurrency": filled("PricingCurrency", "BillingCurrency"),
        "PricingCurrencyEffectiveCost": filled("PricingCurrencyEffectiveCost", "EffectiveCost"),
        "PricingCurrencyListUnitPrice": filled("PricingCurrencyListUnitPrice", "ListUnitPrice"),
        "PricingCurrencyContractedUnitPrice": filled(
            "PricingCurrencyContractedUnitPrice", "ContractedUnitPrice"),
    })


def align_types(frame: DataFrame) -> DataFrame:
    """Cast standard columns to their declared type so a by-name union agrees."""
    declared = {c: schema.column_type(c) for c in frame.columns
                if c in schema.INTRODUCED or c in schema.CARRIED_COLUMNS + schema.FIXTURE_COLUMNS}
    return frame.withColumns({c: F.col(c).cast(t) for c, t in declared.items()}) if declared else frame


def unify(layers: list[DataFrame]) -> DataFrame:
    """Merge layers by column name; a column a layer lacks is NULL there."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(align_types, layers))
    return empty_to_null(merged)


def fold_resource_group(column: str = "x_ResourceGroupName") -> Column:
    return F.lower(F.col(column))


def id_contains(fragment: str) -> Column:
    """Case-insensitive match on the resource id; NULL for a null id, so such a
    row belongs neither to the scope nor to its complement."""
    return F.col("ResourceId").ilike(f"%{fragment}%")


def ai_rows(bill: DataFrame, fragment: str, currency: str = "USD") -> DataFrame:
    """Named scope: usage of the resource the fragment names."""
    return bill.where(id_contains(fragment) & (F.col("ChargeCategory") == "Usage")
                      & (F.col("BillingCurrency") == currency))


def compute_rows(bill: DataFrame, fragment: str, currency: str = "USD") -> DataFrame:
    """Named scope: usage of every other identified resource."""
    return bill.where(~id_contains(fragment) & (F.col("ChargeCategory") == "Usage")
                      & (F.col("BillingCurrency") == currency))


# --- fixed values: white space as the requirement sentences count it -----------
SPACE = (r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}]+")


def normalise_requirement(text: Column) -> Column:
    """A requirement sentence without link markup, asterisks, odd spacing or final dots."""
    unlinked = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    spaced = F.trim(F.regexp_replace(F.replace(unlinked, F.lit("*"), F.lit("")), SPACE, " "))
    return F.regexp_replace(spaced, r"\.+$", "")
