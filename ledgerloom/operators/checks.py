"""Row conformance checks.

Every row rule compiles to a boolean ``broken`` column (and, for null rules, a
``suppressed`` one).  ``summary`` counts all of them in one aggregate over one
scan with no explode; ``violations`` emits one row per broken rule by filtering
an array of structs before exploding it, so clean rows cost no output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import count_where, display, reads, rows, total, usage
from ledgerloom.functions.profile import counts_by_column, string_columns
from ledgerloom.operators import rulebook
from ledgerloom.operators.conditions import compile_condition, is_blank
from ledgerloom.operators.normalise import SPACE
from ledgerloom.operators.rulebook import FAIL, INFO, WARN


@dataclass(frozen=True)
class RowCheck:
    """One check compiled for one table."""

    check_id: str
    severity: str
    columns: tuple[str, ...]
    broken: Column
    message: Column
    suppressed: Column | None = None
    era_gated: bool = False


def _false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def in_era(columns) -> Column:
    """Rows whose era supports every column read; a row with no era is in scope."""
    eras = schema.supported_eras(columns)
    era = F.col("x_SchemaEra")
    return era.isNull() | (era.isin(*eras) if eras else F.lit(False))


def _text(value: Column) -> Column:
    return F.concat(F.lit("'"), value.cast("string"), F.lit("'"))


# ---- compiling families -----------------------------------------------------

def nullability_checks(frame: DataFrame, rules=None) -> list[RowCheck]:
    """Null rules.  '' counts as null for a condition; where only the literal
    reading fires, the hit is suppressed and counted, since the empty-string
    check owns that defect."""
    rules = rulebook.NULL_RULES if rules is None else rules
    texts = set(string_columns(frame))
    compiled = []
    for rule, check_id in zip(rules, rulebook.null_check_ids(rules)):
        if not set(rule.columns) <= set(frame.columns):
            continue
        blank = is_blank(rule.column, True, rule.column in texts)
        empty = _false(F.col(rule.column) == "") if rule.column in texts else F.lit(False)
        applies, literal_only = F.lit(True), F.lit(False)
        if rule.condition:
            applies = compile_condition(rule.condition, True, texts)
            literal_only = ~applies & compile_condition(rule.condition, False, texts)
        if rule.must_be_null:
            broken, placeholder = applies & ~_false(blank), F.lit(False)
        else:
            broken, placeholder = applies & F.col(rule.column).isNull(), applies & empty
        scope = in_era(rule.columns) if rule.dataset == "cost_and_usage" else F.lit(True)
        compiled.append(RowCheck(
            check_id, rule.severity, rule.columns, scope & broken, F.lit(rule.sentence),
            scope & (literal_only | placeholder), rule.dataset == "cost_and_usage"))
    return compiled


def allowed_value_checks(frame: DataFrame, allowed=None) -> list[RowCheck]:
    allowed = schema.ALLOWED_VALUES if allowed is None else allowed
    return [
        RowCheck(f"AV-{c}", FAIL, (c,), _false((F.col(c) != "") & ~F.col(c).isin(*values)),
                 F.concat(F.lit(f"{c} = "), _text(F.col(c)),
                          F.lit(f" is not one of the {len(values)} allowed values")))
        for c, values in allowed.items() if c in frame.columns]


def service_parent_checks(frame: DataFrame) -> list[RowCheck]:
    """A subcategory belongs to its category; with an unknown category, to any.

    The pairs are a fixed list, so membership is a hash-set test and no join.
    """
    pair = F.concat_ws("|", "ServiceCategory", "ServiceSubcategory")
    pairs = [f"{c}|{s}" for c, subs in schema.SERVICE_PAIRS.items() for s in subs]
    every = sorted({s for subs in schema.SERVICE_PAIRS.values() for s in subs})
    known = _false(F.col("ServiceCategory").isin(*schema.SERVICE_PAIRS))
    named = F.col("ServiceSubcategory") != ""
    wrong_parent = known & ~pair.isin(*pairs)
    unknown_name = ~known & ~F.col("ServiceSubcategory").isin(*every)
    sub, parent = _text(F.col("ServiceSubcategory")), _text(F.coalesce("ServiceCategory", F.lit("null")))
    message = F.when(known, F.concat(sub, F.lit(" is not permitted under "), parent)).otherwise(
        F.concat(sub, F.lit(" is not a recognised subcategory")))
    return [RowCheck("SVC-parent-map", FAIL, ("ServiceCategory", "ServiceSubcategory"),
                     _false(named & (wrong_parent | unknown_name)), message)]


def non_negative_checks(frame: DataFrame) -> list[RowCheck]:
    return [
        RowCheck(f"METRIC-nonneg-{c}", FAIL, (c,), _false(F.col(c) < 0),
                 F.lit(f"{c} is negative; MUST be non-negative"))
        for c in rulebook.NON_NEGATIVE if c in frame.columns]


def product_checks(frame: DataFrame) -> list[RowCheck]:
    """price x quantity = cost, corrections exempt.

    The product is exact: at full width Spark's own would keep only six decimal
    places, which is the tolerance itself.
    """
    found = []
    for price, quantity, cost in rulebook.PRODUCTS:
        if not {price, quantity, cost, "ChargeClass"} <= set(frame.columns):
            continue
        off = _product_is_off(price, quantity, cost)
        scope = compile_condition(("ne", "ChargeClass", "Correction"), True, set())
        found.append(RowCheck(
            f"METRIC-product-{cost}", FAIL, (price, quantity, cost, "ChargeClass"), _false(scope & off),
            F.lit(f"{price} x {quantity} does not match {cost}")))
    return found


def _product_is_off(price: str, quantity: str, cost: str) -> Column:
    """Whether price x quantity is further from cost than the tolerance, with no operand rounded.

    Whole and fractional parts multiply within 38 digits; the whole parts of the difference are added apart from the
    fractions, so nothing is cut on the way.
    """
    one = F.lit(1).cast("decimal(1,0)")

    def parts(name: str) -> tuple[Column, Column]:
        value = F.col(name).cast("decimal(38,18)")
        return F.floor(value).cast("decimal(19,0)"), F.pmod(value, one).cast("decimal(18,18)")

    (p, p_rest), (q, q_rest), (c, c_rest) = parts(price), parts(quantity), parts(cost)
    mixed = [p * q_rest, q * p_rest]
    whole = (p * q).cast("decimal(38,0)") + sum(F.floor(m).cast("decimal(38,0)") for m in mixed) - c
    fraction = sum(F.pmod(m, one).cast("decimal(20,18)") for m in mixed) + (p_rest * q_rest).cast("decimal(20,18)") - c_rest
    near = F.when(F.abs(whole) <= 4, whole).cast("decimal(2,0)") + fraction
    exact = F.coalesce(F.abs(near) > F.lit(rulebook.PRODUCT_TOLERANCE).cast("decimal(7,6)"),
                       F.when(F.col(price).isNotNull() & F.col(quantity).isNotNull() & F.col(cost).isNotNull(), True))
    # Doubles decide wherever their own error, bounded generously, cannot; nulls and what is near the tolerance stay exact.
    p_near, q_near, c_near = (F.col(name).cast("double") for name in (price, quantity, cost))
    gap = F.abs(p_near * q_near - c_near)
    error = ((F.abs(p_near * q_near) + F.abs(c_near)) * F.lit(1e-14)
             + (F.abs(p_near) + F.abs(q_near) + F.lit(1.0)) * F.lit(1e-17))
    limit = F.lit(float(rulebook.PRODUCT_TOLERANCE))
    return F.when(gap > limit + error, True).when(gap < limit - error, False).otherwise(exact)


def cross_column_checks(frame: DataFrame) -> list[RowCheck]:
    """Values legal on their own that another column's value forbids."""
    frequency = compile_condition(
        ("and", ("eq", "ChargeCategory", "Purchase"), ("eq", "ChargeFrequency", "Usage-Based")), True, set())
    return [
        RowCheck("XCOL-ChargeClass-Correction", FAIL, ("ChargeClass",),
                 _false(F.col("ChargeClass") != "Correction"),
                 F.concat(F.lit("ChargeClass = "), _text(F.col("ChargeClass")),
                          F.lit(" but MUST be 'Correction' when not null"))),
        RowCheck("XCOL-ChargeFrequency-Usage-Based", FAIL, ("ChargeFrequency", "ChargeCategory"), frequency,
                 F.lit("ChargeFrequency 'Usage-Based' is forbidden when ChargeCategory is Purchase")),
    ]


def currency_checks(frame: DataFrame) -> list[RowCheck]:
    """Billing currency has the ISO shape; pricing currencies may be virtual."""
    return [RowCheck("FMT-ISO4217-BillingCurrency", FAIL, ("BillingCurrency",),
                     _false((F.col("BillingCurrency") != "") & ~F.col("BillingCurrency").rlike("^[A-Z]{3}$")),
                     F.concat(F.lit("BillingCurrency = "), _text(F.col("BillingCurrency")),
                              F.lit(" is not three capital letters")))]


def period_checks(frame: DataFrame) -> list[RowCheck]:
    return [RowCheck("PERIOD-ordering", FAIL, ("ChargePeriodStart", "ChargePeriodEnd"),
                     _false(F.col("ChargePeriodEnd") <= F.col("ChargePeriodStart")),
                     F.lit("ChargePeriodEnd is not after ChargePeriodStart"))]


def duplicate_name_checks(frame: DataFrame) -> list[RowCheck]:
    same = (F.col("ResourceName") == F.col("ResourceId")) & (F.col("ResourceId") != "")
    return [RowCheck("WARN-ResourceName-duplicates-ResourceId", WARN, ("ResourceId", "ResourceName"),
                     _false(same), F.lit("ResourceName repeats ResourceId"))]


def blank(name: str) -> Column:
    """Present and nothing but white space."""
    return _false(F.col(name).rlike(f"^{SPACE[:-1]}*$"))


def empty_string_checks(frame: DataFrame) -> list[RowCheck]:
    """One check per string column: a MUST on standard columns, a SHOULD on others.

    Bound to raw layers: once '' has been normalised away this would report
    zero and read as a pass.
    """
    found = []
    for name in string_columns(frame):
        standard = name in schema.INTRODUCED
        if name in ("x_ExpectedViolation", "x_ViolationDetail"):
            continue
        found.append(RowCheck(
            f"EMPTY-STRING-{'standard' if standard else 'custom'}-{name}", FAIL if standard else WARN, (name,),
            blank(name), F.lit(f"{name} holds an empty string where the value is absent")))
    return found


_BAD_KEY = "exists(json_object_keys({0}), key -> NOT (key IN ({1}) OR startswith(key, 'x_')))"


def sku_key_checks(frame: DataFrame) -> list[RowCheck]:
    listed = ", ".join(f"'{k}'" for k in schema.SKU_PROPERTIES)
    return [RowCheck("SKU-key-prefix", FAIL, ("SkuPriceDetails",),
                     _false(F.expr(_BAD_KEY.format("SkuPriceDetails", listed))),
                     F.lit("SkuPriceDetails has a key that is neither standard nor x_ prefixed"))]


FAMILIES = {
    "allowed_values": (allowed_value_checks, ()),
    "nullability": (nullability_checks, ()),
    "service_parent": (service_parent_checks, ("ServiceCategory", "ServiceSubcategory")),
    "non_negative": (non_negative_checks, ()),
    "product": (product_checks, ()),
    "cross_column": (cross_column_checks, ("ChargeClass", "ChargeFrequency", "ChargeCategory")),
    "currency": (currency_checks, ("BillingCurrency",)),
    "period": (period_checks, ("ChargePeriodStart", "ChargePeriodEnd")),
    "duplicate_name": (duplicate_name_checks, ("ResourceId", "ResourceName")),
    "sku_keys": (sku_key_checks, ("SkuPriceDetails",)),
}


def row_checks(frame: DataFrame, raw_layer: bool = False) -> list[RowCheck]:
    """Every check the table has the columns for; the rest are skipped, not passed."""
    found = []
    for build, needed in FAMILIES.values():
        if set(needed) <= set(frame.columns):
            found += build(frame)
    return found + (empty_string_checks(frame) if raw_layer else [])


def skipped_checks(frame: DataFrame) -> list[str]:
    """Null and value checks that cannot run for want of a column."""
    ids = rulebook.null_check_ids(rulebook.NULL_RULES)
    missing = [i for r, i in zip(rulebook.NULL_RULES, ids) if not set(r.columns) <= set(frame.columns)]
    return missing + [f"AV-{c}" for c in schema.ALLOWED_VALUES if c not in frame.columns]


# ---- running them -----------------------------------------------------------

def summary(frame: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """Violations, suppressed hits and rows out of era per check, in one aggregate."""
    aggregates, entries = [], []
    for n, check in enumerate(checks):
        aggregates.append(count_where(check.broken).alias(f"_b{n}"))
        held = F.lit(0).cast("long")
        if check.suppressed is not None:
            aggregates.append(count_where(check.suppressed).alias(f"_s{n}"))
            held = F.col(f"_s{n}")
        skipped = F.lit(0).cast("long")
        if check.era_gated and len(schema.supported_eras(check.columns)) < len(schema.ERA_CEILING):
            aggregates.append(count_where(~in_era(check.columns)).alias(f"_e{n}"))
            skipped = F.col(f"_e{n}")
        entries.append(F.struct(F.lit(check.check_id).alias("check_id"), F.lit(check.severity).alias("severity"),
                                F.col(f"_b{n}").alias("violations"), held.alias("suppressed"),
                                skipped.alias("rows_out_of_era")))
    return frame.agg(*aggregates).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


# Structs per array; longer projections stop fitting one generated method.
FAMILY_WIDTH = 25


def violations(frame: DataFrame, checks: list[RowCheck], keep: list[str]) -> DataFrame:
    """One row per broken rule per row, carrying the given natural-key columns."""
    hits = [
        F.when(c.broken, F.struct(F.lit(c.check_id).alias("check_id"), F.lit(c.severity).alias("severity"),
                                  c.message.alias("message"))) for c in checks]
    groups = [F.array_compact(F.array(*hits[i:i + FAMILY_WIDTH])) for i in range(0, len(hits), FAMILY_WIDTH)]
    every = groups[0] if len(groups) == 1 else F.concat(*groups)
    return frame.select(*keep, F.explode(every).alias("v")).select(*keep, "v.*")


# ---- checks that are not one row's own --------------------------------------

def absent_mandatory(columns) -> dict[str, list[str]]:
    """For each era, the columns of feature level Mandatory that a table lacks though the era has them.

    Presence is a question of its own: a column that must be there may hold nulls, and one that must not be null may be
    left out where its level allows that.
    """
    absent = [c for c in schema.FEATURE_MANDATORY if c not in columns]
    return {era: [c for c in absent if schema.version_rank(schema.INTRODUCED[c]) <= schema.version_rank(ceiling)]
            for era, ceiling in schema.ERA_CEILING.items()}


def absence_message(column: str, era: str) -> str:
    return f"{column} is Mandatory and absent from a dataset containing {era} rows"


def presence(frame: DataFrame) -> DataFrame:
    """Mandatory columns the table lacks, per era it contains.

    The levels of other columns depend on conditions told in prose, so their absence is reported and not judged.
    """
    others = [c for c in schema.STANDARD_COLUMNS if c not in frame.columns and c not in schema.FEATURE_MANDATORY]
    entry = "array<struct<severity:string,message:string>>"
    told = F.array().cast(entry)
    for era, names in absent_mandatory(frame.columns).items():
        messages = [F.struct(F.lit(FAIL).alias("severity"), F.lit(absence_message(c, era)).alias("message")) for c in names]
        told = F.when(F.col("era") == era, F.array(*messages).cast(entry)).otherwise(told)
    eras = frame.select(F.col("x_SchemaEra").alias("era")).where("era IS NOT NULL").distinct()
    hard = eras.select(F.explode(told).alias("v")).select(F.lit("PRESENCE-mandatory").alias("check_id"), "v.severity", "v.message")
    soft = eras.agg(rows().alias("n")).where("n > 0").select(
        F.lit("PRESENCE-mandatory").alias("check_id"), F.lit(INFO).alias("severity"),
        F.lit(f"{len(others)} columns of other levels absent; not evaluable without their conditions").alias("message"))
    return hard.unionByName(soft) if others else hard


@reads("ResourceId", "ResourceName")
def name_duplicates_id(frame: DataFrame) -> DataFrame:
    """One warning with a count: provisioning method, which decides it, is not in the row."""
    check = duplicate_name_checks(frame)[0]
    return (
        frame.agg(count_where(check.broken).alias("row_count")).where("row_count > 0")
        .select(F.lit(check.check_id).alias("check_id"), F.lit(WARN).alias("severity"), "row_count")
    )


COMMITMENT_COLUMNS = ("CommitmentDiscountId", "BillingCurrency", "ChargeCategory", "EffectiveCost",
                      "BilledCost", "CommitmentDiscountStatus")


def _per_commitment(frame: DataFrame) -> DataFrame:
    known = F.col("CommitmentDiscountId") != ""
    settled = F.coalesce(F.col("CommitmentDiscountStatus").isin("Used", "Unused"), F.lit(False))
    bought = F.col("ChargeCategory") == "Purchase"
    zero = F.lit(0)
    return frame.where(known).groupBy("CommitmentDiscountId", "BillingCurrency").agg(
        count_where(usage()).alias("usage_rows"), count_where(bought).alias("purchase_rows"),
        F.coalesce(total("EffectiveCost", usage()), zero).alias("used_cost"),
        F.coalesce(total("BilledCost", bought), zero).alias("purchase_cost"),
        F.coalesce(total("EffectiveCost", usage() & settled), zero).alias("stated_cost"),
        count_where(usage() & ~settled).alias("unstated_rows"))


def _named() -> Column:
    return F.col("CommitmentDiscountId").alias("commitment")


@reads(*COMMITMENT_COLUMNS)
def commitment_closure(frame: DataFrame) -> DataFrame:
    """Usage against purchases per commitment; a missing purchase is its own finding."""
    gap = F.col("used_cost") - F.col("purchase_cost")
    off = F.abs(gap) > F.lit(rulebook.PRODUCT_TOLERANCE).cast("decimal(7,6)")
    unbought = F.col("purchase_rows") == 0
    return (
        _per_commitment(frame).where("usage_rows > 0 OR purchase_rows > 0").where(unbought | off)
        .select(_named(), "BillingCurrency", F.lit("COMMIT-closure").alias("check_id"), F.lit(WARN).alias("severity"),
                F.when(unbought, "no purchase row in this dataset; closure not evaluable")
                .otherwise("usage and purchase differ; the dataset may not span the term").alias("finding"),
                display(F.col("used_cost"), 4).alias("usage_effective"),
                F.when(~unbought, display(F.col("purchase_cost"), 4)).alias("purchase_billed"),
                F.when(~unbought, display(gap, 4)).alias("out_by"))
    )


@reads(*COMMITMENT_COLUMNS)
def commitment_split(frame: DataFrame) -> DataFrame:
    """Used plus unused is a partition of usage, whatever part of the term is present."""
    gap = F.col("used_cost") - F.col("stated_cost")
    return (
        _per_commitment(frame).where("usage_rows > 0")
        .where(F.abs(gap) > F.lit(rulebook.PRODUCT_TOLERANCE).cast("decimal(7,6)"))
        .select(_named(), "BillingCurrency", F.lit("COMMIT-split").alias("check_id"), F.lit(FAIL).alias("severity"),
                display(F.col("used_cost"), 4).alias("usage_effective"),
                display(F.col("stated_cost"), 4).alias("used_plus_unused"), display(gap, 4).alias("out_by"),
                "unstated_rows")
    )


def _documents(frame: DataFrame) -> DataFrame:
    """Distinct SKU documents with their row counts: one SKU repeats one document."""
    return (
        frame.where(F.col("SkuPriceDetails").isNotNull())
        .groupBy(F.col("SkuPriceDetails").alias("document")).agg(rows().alias("n"))
    )


HINT_PREFIX = 6


@reads("SkuPriceDetails")
def sku_key_findings(frame: DataFrame) -> DataFrame:
    """Keys neither standard nor x_ prefixed, with the standard key they resemble."""
    key = F.col("sku_key")
    standard = F.array(*[F.lit(k) for k in schema.SKU_PROPERTIES])
    alike = F.filter(standard, lambda s: F.lower(F.substring(s, 1, HINT_PREFIX))
                     == F.lower(F.substring(key, 1, HINT_PREFIX)))
    return (
        _documents(frame).select("n", F.explode(F.json_object_keys("document")).alias("sku_key"))
        .where(~key.isin(*schema.SKU_PROPERTIES) & ~key.startswith("x_"))
        .groupBy("sku_key").agg(F.sum("n").alias("row_count"))
        .withColumn("did_you_mean", F.array_min(alike))
    )


@reads("SkuPriceDetails")
def sku_type_findings(frame: DataFrame) -> DataFrame:
    """Standard keys whose value is not of the declared type; null values are skipped."""
    document = F.try_parse_json("document")

    def observed(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(document, f"$.{key}", "variant"))
        return (F.when(kind == "STRING", "String").when(kind == "BOOLEAN", "Boolean")
                .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "Numeric")
                .when(kind != "VOID", "Other"))

    entries = F.array(*[
        F.struct(F.lit(k).alias("sku_key"), F.lit("Numeric" if k in schema.SKU_NUMERIC else "String").alias("declared"),
                 observed(k).alias("observed")) for k in schema.SKU_PROPERTIES])
    return (
        _documents(frame).select("n", F.explode(entries).alias("e")).select("n", "e.*")
        .where("observed IS NOT NULL AND observed <> declared")
        .groupBy("sku_key", "declared", "observed").agg(F.sum("n").alias("row_count"))
    )


def declaration_drift(frame: DataFrame) -> DataFrame:
    """Columns populated ahead of the era a row declares: a floor, so only INFO."""
    lowest = min(schema.version_rank(v) for v in schema.ERA_CEILING.values())
    ahead = [c for c in frame.columns
             if c in schema.INTRODUCED and schema.version_rank(schema.INTRODUCED[c]) > lowest]
    counted = {c: F.count(F.col(c)) for c in ahead}
    rank = F.create_map(*[F.lit(x) for e, v in schema.ERA_CEILING.items() for x in (e, schema.version_rank(v))])
    introduced = F.create_map(*[F.lit(x) for c in ahead for x in (c, schema.INTRODUCED[c])])
    needs = F.create_map(*[F.lit(x) for c in ahead for x in (c, schema.version_rank(schema.INTRODUCED[c]))])
    return (
        counts_by_column(frame, counted, "column_name", "row_count", by=["x_SchemaEra"])
        .where((F.col("row_count") > 0)
               & (F.element_at(needs, F.col("column_name")) > F.element_at(rank, F.col("x_SchemaEra"))))
        .select("x_SchemaEra", "column_name", introduced[F.col("column_name")].alias("introduced"), "row_count")
    )


def provenance_gaps(frame: DataFrame) -> DataFrame:
    """Rows missing a provenance value."""
    counted = {c: count_where(F.col(c).isNull()) for c in schema.PROVENANCE_COLUMNS if c in frame.columns}
    return counts_by_column(frame, counted, "column_name", "missing", {"total_rows": rows()})


def check_scope(frame: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """Version window of every era-gated check with the rows in and out of its scope.

    Rows are counted per era once; the checks are then fanned out over that
    handful of rows.
    """
    eras = frame.groupBy(F.col("x_SchemaEra").alias("era")).agg(rows().alias("n"))
    entries = []
    for check in checks:
        known = [schema.INTRODUCED[c] for c in check.columns if c in schema.INTRODUCED]
        gone = [schema.REMOVED[c] for c in check.columns if c in schema.REMOVED]
        supported = schema.supported_eras(check.columns) if check.era_gated else list(schema.ERA_CEILING)
        entries.append(F.struct(
            F.lit(check.check_id).alias("check_id"),
            F.lit(max(known, key=schema.version_rank) if known else "0.5").alias("from_version"),
            F.lit(min(gone, key=schema.version_rank) if gone else None).cast("string").alias("until_version"),
            F.array(*[F.lit(e) for e in supported]).cast("array<string>").alias("eras")))
    scoped = F.col("era").isNull() | F.array_contains("c.eras", F.col("era"))
    return (
        eras.select("era", "n", F.explode(F.array(*entries)).alias("c"))
        .groupBy("c.check_id", "c.from_version", "c.until_version")
        .agg(F.sum(F.when(scoped, F.col("n")).otherwise(0)).alias("rows_in_scope"),
             F.sum(F.when(scoped, 0).otherwise(F.col("n"))).alias("rows_out_of_scope"))
    )


def companion_checks(frame: DataFrame, dataset: str) -> DataFrame:
    """Presence, allowed values and nullability of one companion dataset."""
    catalogue = rulebook.COMPANION_RULES[dataset]
    absent = [c for c in catalogue["required"] if c not in frame.columns]
    null_rules = [rulebook.NullRule(c, False, dataset=dataset) for c in catalogue["required"]]
    checks = nullability_checks(frame, null_rules) + allowed_value_checks(frame, catalogue["allowed"])
    found = summary(frame, checks).select("check_id", "severity", "violations")
    if absent:
        missing = frame.agg(rows().alias("n")).select(F.explode(F.array(*[
            F.struct(F.lit(f"PRESENCE-{c}").alias("check_id"), F.lit(FAIL).alias("severity"),
                     F.lit(1).cast("long").alias("violations")) for c in absent])).alias("e")).select("e.*")
        found = found.unionByName(missing)
    return found.withColumn("dataset", F.lit(dataset))


def verdict(summaries: DataFrame) -> DataFrame:
    """Checks and violations per severity, and how many checks found anything."""
    return summaries.groupBy("severity").agg(
        rows().alias("checks"), count_where(F.col("violations") > 0).alias("checks_with_findings"),
        F.sum("violations").alias("violations"), F.sum("suppressed").alias("suppressed"))


def proof(found: DataFrame, expectations: DataFrame) -> DataFrame:
    """Planted faults against the check that must name them.

    ``expectations`` maps a planted label to a check-id prefix.  Hits by other
    checks on the same row are incidental and counted apart.
    """
    named = F.col("check_id").startswith(F.col("check_prefix"))
    return (
        expectations.join(found, "x_ExpectedViolation", "left").groupBy("x_ExpectedViolation")
        .agg(F.max(F.coalesce(named, F.lit(False))).alias("caught"),
             count_where(~named).alias("incidental"))
    )
