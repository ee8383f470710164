"""Conformance checks wired to the driver tables, with comparison SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import rows
from ledgerloom.operators import checks as K
from ledgerloom.operators import crosschecks as X
from ledgerloom.plans.oracle_base import CONTRACTS, INVOICES, PERIODS, bill_cte, money, over_bill
from ledgerloom.sources import bill_adapter as A
from ledgerloom.sources.bill_columns import TEXT_COLUMNS

CHECKED = schema.STANDARD_COLUMNS + ["x_SchemaEra"]
TEXTS = TEXT_COLUMNS
WITHOUT = [c for c in schema.STANDARD_COLUMNS if c not in (
    "PricingUnit", "ServiceSubcategory", "ProviderName", "AvailabilityZone", "SkuMeter")]
DRIFTING = [c for c in schema.STANDARD_COLUMNS if c in schema.INTRODUCED]


def _family(name: str, *needed: str):
    """Row-level findings of one family."""
    def run(spark, sf_dir):
        frame = A.bill(spark, sf_dir, "x_ChargeId", *needed)
        return K.violations(frame, K.FAMILIES[name][0](frame), ["x_ChargeId"])
    return run


def _on(job, *names, **kwargs):
    def run(spark, sf_dir):
        return job(A.bill(spark, sf_dir, *(names or job.columns)), **kwargs)
    return run


def _cross(job, *companions):
    def run(spark, sf_dir):
        return job(A.bill(spark, sf_dir, *job.columns), *[c(spark, sf_dir) for c in companions])
    return run


def _nullability(spark, sf_dir):
    frame = A.bill(spark, sf_dir, *CHECKED)
    return K.summary(frame, K.nullability_checks(frame))


def _validate_all(spark, sf_dir):
    frame = A.bill(spark, sf_dir, *CHECKED)
    return K.summary(frame, K.row_checks(frame))


def _empty_strings(spark, sf_dir):
    frame = A.bill(spark, sf_dir, *TEXTS)
    return K.summary(frame, K.empty_string_checks(frame)).select("check_id", "severity", "violations")


def _horizons(spark, sf_dir):
    frame = A.bill(spark, sf_dir, *CHECKED)
    return K.check_scope(A.bill(spark, sf_dir, "x_SchemaEra"), K.row_checks(frame))


def _supplemental(spark, sf_dir):
    parts = [K.companion_checks(make(spark, sf_dir), name) for name, make in (
        ("billing_period", A.billing_period), ("invoice_detail", A.invoice_detail),
        ("contract_commitment", A.contract_commitment))]
    return reduce(DataFrame.unionByName, parts)


def _currency_format(spark, sf_dir):
    """The shape check on both currency columns' values: billing must match, pricing may not."""
    frame = A.bill(spark, sf_dir, "BillingCurrency", "PricingCurrency")
    check = K.currency_checks(frame)[0]
    return frame.groupBy("BillingCurrency", "PricingCurrency").agg(
        rows().alias("row_count"), F.count_if(check.broken).alias("violations"))


def _era_columns(spark, sf_dir):
    """Declaration drift over the current schema, by era and drop."""
    frame = A.bill(spark, sf_dir, "x_SchemaEra", *DRIFTING)
    return K.declaration_drift(frame).groupBy("introduced").agg(
        rows().alias("columns_ahead"), F.sum("row_count").alias("row_count"))


def _coverage_of_rules(spark, sf_dir):
    """Implemented rules that found something, by severity and direction."""
    found = _nullability(spark, sf_dir)
    direction = F.when(F.col("check_id").contains("-notnull"), "MUST NOT be null").otherwise("MUST be null")
    return found.groupBy("severity", direction.alias("direction")).agg(
        rows().alias("implemented"), F.count_if(F.col("violations") > 0).alias("with_findings"),
        F.count_if(F.col("rows_out_of_era") > 0).alias("partly_out_of_era"))


QUERIES = {
    "check_allowed_values": _family("allowed_values", *schema.ALLOWED_VALUES),
    "check_nullability": _nullability,
    "check_presence": _on(K.presence, *WITHOUT, "x_SchemaEra"),
    "check_service_parent": _family("service_parent", "ServiceCategory", "ServiceSubcategory"),
    "check_name_duplicates_id": _on(K.name_duplicates_id),
    "check_non_negative": _family("non_negative", "ListUnitPrice", "ContractedUnitPrice",
                                  "PricingCurrencyListUnitPrice", "PricingCurrencyContractedUnitPrice"),
    "check_price_quantity": _family("product", "ListUnitPrice", "ContractedUnitPrice", "PricingQuantity",
                                    "ListCost", "ContractedCost", "ChargeClass"),
    "check_commitment_closure": _on(K.commitment_closure),
    "check_commitment_split": _on(K.commitment_split),
    "check_cross_column": _family("cross_column", "ChargeClass", "ChargeFrequency", "ChargeCategory"),
    "check_currency_format": _currency_format,
    "check_period_order": _family("period", "ChargePeriodStart", "ChargePeriodEnd"),
    "check_sku_keys": _on(K.sku_key_findings),
    "check_sku_types": _on(K.sku_type_findings),
    "check_empty_strings": _empty_strings,
    "check_declaration_drift": _on(K.declaration_drift, "x_SchemaEra", *DRIFTING),
    "check_era_columns": _era_columns,
    "check_provenance": _on(K.provenance_gaps, *schema.PROVENANCE_COLUMNS),
    "check_supplemental": _supplemental,
    "check_horizons": _horizons,
    "validate_all": _validate_all,
    "report_verdict": lambda spark, sf: K.verdict(_validate_all(spark, sf)),
    "rule_coverage": _coverage_of_rules,
    "xds_invoice": _cross(X.invoice_reconciliation, A.invoice_detail),
    "xds_closure": _cross(X.commitment_term_closure, A.contract_commitment),
    "xds_billing_period": _cross(X.billing_periods, A.billing_period),
    "xds_orphan": _cross(X.invoice_orphan, A.invoice_detail),
    "xds_period_pair": _cross(X.period_pairs, A.billing_period),
    "xds_correction": _cross(X.correction_rules, A.invoice_detail, A.billing_period),
    "xds_eligibility": _cross(X.eligibility),
    "period_overlap": lambda spark, sf: X.period_overlap(A.billing_period(spark, sf)),
}

# ---- comparison SQL ---------------------------------------------------------
# Null rules restated by hand: (column, must be null, condition) in SQL text, where
# {Name?} reads "Name is null", leniently or literally as the caller chooses.

_PRICED = "ChargeCategory IN ('Usage', 'Purchase') AND ChargeClass IS DISTINCT FROM 'Correction'"
_COMMITTED = "(ChargeCategory IN ('Usage', 'Purchase') AND NOT {CommitmentDiscountId?})"
_NULLS = [(c, False, "true", "FAIL") for c in schema.MANDATORY + ["PricingCurrency", "PricingCurrencyEffectiveCost"]]
_NULLS += [(c, True, "{" + a + "?}", "FAIL") for a, c in [
    ("ResourceId", "ResourceName"), ("ResourceId", "ResourceType"),
    ("CommitmentDiscountId", "CommitmentDiscountStatus"), ("CommitmentDiscountId", "CommitmentDiscountCategory"),
    ("CommitmentDiscountId", "CommitmentDiscountType"), ("SubAccountId", "SubAccountName"),
    ("SubAccountId", "SubAccountType"), ("CapacityReservationId", "CapacityReservationStatus"),
    ("SkuPriceId", "SkuPriceDetails"), ("RegionId", "RegionName")]]
_NULLS += [(c, True, "ChargeCategory = 'Tax'", "FAIL") for c in (
    "PricingCategory", "SkuId", "SkuPriceId", "PricingQuantity", "ListUnitPrice", "ContractedUnitPrice")]
_NULLS += [
    ("ConsumedQuantity", True, "ChargeCategory IS DISTINCT FROM 'Usage'", "FAIL"),
    ("CommitmentDiscountCategory", False, "NOT {CommitmentDiscountId?}", "FAIL"),
    ("CommitmentDiscountType", False, "NOT {CommitmentDiscountId?}", "FAIL"),
    ("CommitmentDiscountStatus", False, "NOT {CommitmentDiscountId?} AND ChargeCategory = 'Usage'", "FAIL"),
    ("SkuPriceId", False, _PRICED, "FAIL"),
    ("PricingCurrencyListUnitPrice", False, _PRICED, "FAIL"),
    ("PricingCurrencyContractedUnitPrice", False, _PRICED, "FAIL"),
    ("CommitmentDiscountQuantity", False, _COMMITTED + " AND ChargeClass IS DISTINCT FROM 'Correction'", "FAIL"),
    ("CommitmentDiscountQuantity", True, "NOT " + _COMMITTED, "FAIL"),
    ("ChargeDescription", False, "true", "WARN"),
    ("SkuMeter", False, "NOT {SkuId?}", "WARN"),
]
# Columns newer than the older eras' ceiling: only current-era rows owe them.
_NEWER = """BillingAccountType CapacityReservationId CapacityReservationStatus CommitmentDiscountQuantity
    CommitmentDiscountUnit InvoiceId PricingCurrency PricingCurrencyContractedUnitPrice PricingCurrencyEffectiveCost
    PricingCurrencyListUnitPrice ServiceSubcategory SkuMeter SkuPriceDetails SubAccountType""".split()
_NUMERIC = {c for c in schema.STANDARD_COLUMNS if c.endswith(("Cost", "Quantity", "UnitPrice"))} | {
    "BillingPeriodStart", "BillingPeriodEnd", "ChargePeriodStart", "ChargePeriodEnd"}


def _read(text: str, lenient: bool) -> str:
    for name in schema.STANDARD_COLUMNS:
        blank = f"({name} IS NULL OR {name} = '')" if lenient and name not in _NUMERIC else f"({name} IS NULL)"
        text = text.replace("{" + name + "?}", blank)
    return f"coalesce(({text}), false)"


def _null_rows():
    place: dict[str, int] = {}
    for column, must_be, condition, severity in _NULLS:
        place[column] = place.get(column, 0) + 1
        kind = ("null" if must_be else "notnull") + ("" if severity == "FAIL" else "-should")
        reads = [column] + [c for c in schema.STANDARD_COLUMNS if f"{c}" in condition.replace("{", " ").replace("?", " ").split()
                            or f"{{{c}?}}" in condition]
        newer = [c for c in reads if c in _NEWER]
        scope = "(x_SchemaEra IS NULL OR x_SchemaEra = '1.2')" if newer else "true"
        empty = f"({column} = '')" if column not in _NUMERIC else "false"
        lenient, strict = _read(condition, True), _read(condition, False)
        if must_be:
            broken = f"{lenient} AND {column} IS NOT NULL AND NOT {empty}"
            held = f"NOT {lenient} AND {strict}"
        else:
            broken = f"{lenient} AND {column} IS NULL"
            held = f"(NOT {lenient} AND {strict}) OR ({lenient} AND coalesce({empty}, false))"
        yield (f"NULL-{column}-{kind}{place[column]}", severity, f"{scope} AND ({broken})",
               f"{scope} AND ({held})", f"NOT {scope}")


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_PAIRS = ", ".join(f"('{c}', '{s}')" for c, subs in schema.SERVICE_PAIRS.items() for s in subs)
_SUBS = _listed(sorted({s for subs in schema.SERVICE_PAIRS.values() for s in subs}))
_BAD_PARENT = (f"ServiceSubcategory <> '' AND CASE WHEN ServiceCategory IN ({_listed(schema.SERVICE_PAIRS)}) "
               f"THEN (ServiceCategory, ServiceSubcategory) NOT IN ({_PAIRS}) ELSE ServiceSubcategory NOT IN ({_SUBS}) END")
_PRODUCT = ("ChargeClass IS DISTINCT FROM 'Correction' AND abs(CAST({p} AS DECIMAL(19,9)) * CAST(PricingQuantity AS DECIMAL(18,6)) "
            "- {c}) > 0.000001")
_PROPERTIES = _listed(schema.SKU_PROPERTIES)
_BAD_SKU = (f"CASE WHEN json_valid(SkuPriceDetails) THEN len(list_filter(json_keys(SkuPriceDetails), "
            f"lambda key: key NOT IN ({_PROPERTIES}) AND NOT starts_with(key, 'x_'))) > 0 END")


def _other_rows():
    for column, values in schema.ALLOWED_VALUES.items():
        yield f"AV-{column}", "FAIL", f"{column} <> '' AND {column} NOT IN ({_listed(values)})"
    yield "SVC-parent-map", "FAIL", _BAD_PARENT
    for column in ("ListUnitPrice", "ContractedUnitPrice", "PricingCurrencyListUnitPrice",
                   "PricingCurrencyContractedUnitPrice"):
        yield f"METRIC-nonneg-{column}", "FAIL", f"{column} < 0"
    for price, cost in (("ListUnitPrice", "ListCost"), ("ContractedUnitPrice", "ContractedCost")):
        yield f"METRIC-product-{cost}", "FAIL", _PRODUCT.format(p=price, c=cost)
    yield "XCOL-ChargeClass-Correction", "FAIL", "ChargeClass <> 'Correction'"
    yield "XCOL-ChargeFrequency-Usage-Based", "FAIL", "ChargeCategory = 'Purchase' AND ChargeFrequency = 'Usage-Based'"
    yield "FMT-ISO4217-BillingCurrency", "FAIL", "NOT regexp_full_match(BillingCurrency, '[A-Z]{3}')"
    yield "PERIOD-ordering", "FAIL", "ChargePeriodEnd <= ChargePeriodStart"
    yield "WARN-ResourceName-duplicates-ResourceId", "WARN", "ResourceName = ResourceId AND ResourceId <> ''"
    yield "SKU-key-prefix", "FAIL", _BAD_SKU


def _summary_sql(everything: bool) -> str:
    checks = list(_null_rows())
    if everything:
        checks += [(i, s, f"coalesce({b}, false)", "false", "false") for i, s, b in _other_rows()]
    return " UNION ALL ".join(
        f"SELECT '{i}' AS check_id, '{s}' AS severity, count_if({b}) AS violations, count_if({h}) AS suppressed, "
        f"count_if({e}) AS rows_out_of_era FROM bill" for i, s, b, h, e in checks)


_MATERIAL = bill_cte().replace("bill AS (SELECT", "bill AS MATERIALIZED (SELECT")


def _summaries(body: str, everything: bool) -> str:
    return f"WITH {_MATERIAL},\nsummaries AS ({_summary_sql(everything)})\n{body}"


def _horizon_sql() -> str:
    """Each check's version window from the columns its SQL condition reads."""
    pairs = []
    gated = {i: (c, t) for (i, *_), (c, _, t, _) in zip(_null_rows(), _NULLS)}
    for check_id, (column, condition) in gated.items():
        words = set(re.findall(r"\w+", condition)) | {column}
        pairs += [(check_id, c, "true") for c in schema.STANDARD_COLUMNS if c in words]
    for check_id, _, condition in _other_rows():
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", condition)))
        pairs += [(check_id, c, "false") for c in schema.STANDARD_COLUMNS if c in words]
    reads = ", ".join(f"('{i}', '{c}', {g})" for i, c, g in pairs)
    life = ", ".join(f"('{c}', '{v}', {schema.version_rank(v)})" for c, v in schema.INTRODUCED.items())
    return over_bill(f"""
        SELECT check_id, arg_max(version, rank) AS from_version,
               max(CASE WHEN column_name IN ('ProviderName', 'PublisherName') THEN '1.4' END) AS until_version,
               CASE WHEN bool_or(gated AND rank > 2) THEN any_value(newest) ELSE any_value(every) END AS rows_in_scope,
               CASE WHEN bool_or(gated AND rank > 2) THEN any_value(every - newest) ELSE 0 END AS rows_out_of_scope
        FROM (VALUES {reads}) r(check_id, column_name, gated)
        JOIN (VALUES {life}) l(column_name, version, rank) USING (column_name),
             (SELECT count(*) AS every, count_if(x_SchemaEra = '1.2') AS newest FROM bill)
        GROUP BY check_id""")


def _rows_sql(*checks) -> str:
    """Row-level findings; each check is (id, severity, condition, message expression)."""
    return over_bill(" UNION ALL ".join(
        f"SELECT x_ChargeId, '{i}' AS check_id, '{s}' AS severity, {m} AS message FROM bill WHERE {w}"
        for i, s, w, m in checks))


_FOUND = "check_id, severity, subject, finding, row_count, left_amount, right_amount"


def _finding_sql(body: str, *companions: str) -> str:
    return over_bill(f"SELECT check_id, severity, subject, finding, CAST(row_count AS BIGINT) AS row_count, "
                     f"CAST(left_amount AS DOUBLE) AS left_amount, CAST(right_amount AS DOUBLE) AS right_amount "
                     f"FROM ({body}) f({_FOUND})", *companions)


_PER_COMMITMENT = """
commitment AS (
  SELECT CommitmentDiscountId, BillingCurrency, count_if(ChargeCategory = 'Usage') AS usage_rows,
         count_if(ChargeCategory = 'Purchase') AS purchase_rows,
         sum(CASE WHEN ChargeCategory = 'Usage' THEN EffectiveCost ELSE 0 END) AS used,
         sum(CASE WHEN ChargeCategory = 'Purchase' THEN BilledCost ELSE 0 END) AS bought,
         sum(CASE WHEN ChargeCategory = 'Usage' AND CommitmentDiscountStatus IN ('Used', 'Unused') THEN EffectiveCost ELSE 0 END) AS stated,
         count_if(ChargeCategory = 'Usage' AND coalesce(CommitmentDiscountStatus, '') NOT IN ('Used', 'Unused')) AS unstated_rows
  FROM bill WHERE CommitmentDiscountId <> '' GROUP BY ALL)"""
_MANDATORY_ABSENT = [("PricingUnit", "0.5"), ("ProviderName", "0.5")]
_INTRO = {c: schema.INTRODUCED[c] for c in DRIFTING}
_DRIFT = " UNION ALL ".join(
    f"SELECT x_SchemaEra, '{c}' AS column_name, '{v}' AS introduced, count({c}) AS row_count FROM bill "
    f"WHERE x_SchemaEra IN ('1.0r2', 'pre-1.2') GROUP BY ALL" for c, v in _INTRO.items() if v in ("1.1", "1.2"))


_COMPANION = {
    "billing_period": ("period", ["BillingPeriodStart", "BillingPeriodEnd", "BillingPeriodStatus", "InvoiceIssuerName"],
                       ["BillingPeriodCreated", "BillingPeriodLastUpdated"],
                       {"BillingPeriodStatus": ["Open", "Closed"]}),
    "invoice_detail": ("invoice", ["InvoiceId", "BillingCurrency", "BilledCost", "ChargeCategory", "BillingPeriodStart",
                                   "BillingPeriodEnd", "InvoiceIssueStatus"], ["InvoiceDetailId", "InvoiceIssuerName"],
                       {"ChargeCategory": ["Usage", "Purchase", "Tax", "Credit", "Adjustment"]}),
    "contract_commitment": ("contract", ["ContractCommitmentId", "ContractCommitmentCost", "BillingCurrency",
                                         "ContractCommitmentPeriodStart", "ContractCommitmentPeriodEnd"],
                            ["ContractId", "ServiceProviderName"], {}),
}


def _companion_sql() -> str:
    parts = []
    for dataset, (table, present, absent, allowed) in _COMPANION.items():
        for c in present:
            parts.append(f"SELECT '{dataset}' AS dataset, 'NULL-{c}-notnull1' AS check_id, 'FAIL' AS severity, "
                         f"count_if({c} IS NULL) AS violations FROM {table}")
        for c in absent:
            parts.append(f"SELECT '{dataset}', 'PRESENCE-{c}', 'FAIL', CAST(1 AS BIGINT)")
        for c, values in allowed.items():
            parts.append(f"SELECT '{dataset}', 'AV-{c}', 'FAIL', count_if({c} NOT IN ({_listed(values)})) FROM {table}")
    return " UNION ALL ".join(parts)


_TEXT_CHECKS = " UNION ALL ".join(
    f"SELECT 'EMPTY-STRING-{'custom' if c.startswith('x_') else 'standard'}-{c}' AS check_id, "
    f"'{'WARN' if c.startswith('x_') else 'FAIL'}' AS severity, count_if(trim({c}) = '') AS violations FROM bill"
    for c in TEXTS)
_SKU_TYPES = " UNION ALL ".join(
    f"SELECT '{k}' AS sku_key, '{'Numeric' if k in schema.SKU_NUMERIC else 'String'}' AS declared, "
    f"json_type(SkuPriceDetails, '$.{k}') AS kind FROM bill WHERE json_valid(SkuPriceDetails)" for k in schema.SKU_PROPERTIES)

ORACLE = {
    "check_allowed_values": _rows_sql(*[
        (f"AV-{c}", "FAIL", f"{c} <> '' AND {c} NOT IN ({_listed(v)})",
         f"'{c} = ''' || {c} || ''' is not one of the {len(v)} allowed values'") for c, v in schema.ALLOWED_VALUES.items()]),
    "check_nullability": _summaries("SELECT * FROM summaries", False),
    "check_presence": over_bill(" UNION ALL ".join(
        f"SELECT 'PRESENCE-mandatory' AS check_id, 'FAIL' AS severity, '{c} is Mandatory and absent from a dataset containing ' "
        f"|| x_SchemaEra || ' rows' AS message FROM (SELECT DISTINCT x_SchemaEra FROM bill)"
        + (" WHERE x_SchemaEra = '1.2'" if v in ("1.1", "1.2") else "") for c, v in _MANDATORY_ABSENT)
        + " UNION ALL SELECT 'PRESENCE-mandatory', 'INFO', '3 columns of other levels absent; not evaluable without their conditions' FROM bill HAVING count(*) > 0"),
    "check_service_parent": _rows_sql((
        "SVC-parent-map", "FAIL", _BAD_PARENT,
        f"CASE WHEN ServiceCategory IN ({_listed(schema.SERVICE_PAIRS)}) THEN '''' || ServiceSubcategory || ''' is not permitted under ''' "
        f"|| ServiceCategory || '''' ELSE '''' || ServiceSubcategory || ''' is not a recognised subcategory' END")),
    "check_name_duplicates_id": over_bill("""
        SELECT 'WARN-ResourceName-duplicates-ResourceId' AS check_id, 'WARN' AS severity, count(*) AS row_count
        FROM bill WHERE ResourceName = ResourceId AND ResourceId <> '' HAVING count(*) > 0"""),
    "check_non_negative": _rows_sql(*[
        (f"METRIC-nonneg-{c}", "FAIL", f"{c} < 0", f"'{c} is negative; MUST be non-negative'") for c in (
            "ListUnitPrice", "ContractedUnitPrice", "PricingCurrencyListUnitPrice", "PricingCurrencyContractedUnitPrice")]),
    "check_price_quantity": _rows_sql(*[
        (f"METRIC-product-{c}", "FAIL", _PRODUCT.format(p=p, c=c), f"'{p} x PricingQuantity does not match {c}'")
        for p, c in (("ListUnitPrice", "ListCost"), ("ContractedUnitPrice", "ContractedCost"))]),
    "check_commitment_closure": over_bill(f"""
        SELECT CommitmentDiscountId AS commitment, BillingCurrency, 'COMMIT-closure' AS check_id, 'WARN' AS severity,
               CASE WHEN purchase_rows = 0 THEN 'no purchase row in this dataset; closure not evaluable'
                    ELSE 'usage and purchase differ; the dataset may not span the term' END AS finding,
               {money('used', 4)} AS usage_effective, CASE WHEN purchase_rows > 0 THEN {money('bought', 4)} END AS purchase_billed,
               CASE WHEN purchase_rows > 0 THEN {money('used - bought', 4)} END AS out_by
        FROM commitment WHERE usage_rows + purchase_rows > 0 AND (purchase_rows = 0 OR abs(used - bought) > 0.000001)""",
        ctes=_PER_COMMITMENT),
    "check_commitment_split": over_bill(f"""
        SELECT CommitmentDiscountId AS commitment, BillingCurrency, 'COMMIT-split' AS check_id, 'FAIL' AS severity,
               {money('used', 4)} AS usage_effective, {money('stated', 4)} AS used_plus_unused, {money('used - stated', 4)} AS out_by,
               unstated_rows FROM commitment WHERE usage_rows > 0 AND abs(used - stated) > 0.000001""", ctes=_PER_COMMITMENT),
    "check_cross_column": _rows_sql(
        ("XCOL-ChargeClass-Correction", "FAIL", "ChargeClass <> 'Correction'",
         "'ChargeClass = ''' || ChargeClass || ''' but MUST be ''Correction'' when not null'"),
        ("XCOL-ChargeFrequency-Usage-Based", "FAIL", "ChargeCategory = 'Purchase' AND ChargeFrequency = 'Usage-Based'",
         "'ChargeFrequency ''Usage-Based'' is forbidden when ChargeCategory is Purchase'")),
    "check_currency_format": over_bill("""
        SELECT BillingCurrency, PricingCurrency, count(*) AS row_count,
               count_if(NOT regexp_full_match(BillingCurrency, '[A-Z]{3}')) AS violations FROM bill GROUP BY ALL"""),
    "check_period_order": _rows_sql(("PERIOD-ordering", "FAIL", "ChargePeriodEnd <= ChargePeriodStart",
                                     "'ChargePeriodEnd is not after ChargePeriodStart'")),
    "check_sku_keys": over_bill(f"""
        SELECT sku_key, count(*) AS row_count, (SELECT min(s) FROM (VALUES {", ".join(f"('{k}')" for k in schema.SKU_PROPERTIES)}) p(s)
               WHERE lower(s[:6]) = lower(sku_key[:6])) AS did_you_mean
        FROM (SELECT unnest(json_keys(SkuPriceDetails)) AS sku_key FROM bill WHERE json_valid(SkuPriceDetails))
        WHERE sku_key NOT IN ({_PROPERTIES}) AND NOT starts_with(sku_key, 'x_') GROUP BY ALL"""),
    "check_sku_types": over_bill(f"""
        SELECT sku_key, declared, observed, count(*) AS row_count FROM (
          SELECT sku_key, declared, CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'Numeric' WHEN kind = 'VARCHAR' THEN 'String'
                 WHEN kind = 'BOOLEAN' THEN 'Boolean' ELSE 'Other' END AS observed
          FROM ({_SKU_TYPES}) WHERE kind IS NOT NULL AND kind <> 'NULL') WHERE observed <> declared GROUP BY ALL"""),
    "check_empty_strings": over_bill(_TEXT_CHECKS),
    "check_declaration_drift": over_bill(
        f"SELECT * FROM ({_DRIFT}) WHERE row_count > 0 AND column_name IN ({_listed(DRIFTING)})"),
    "check_era_columns": over_bill(f"""
        SELECT introduced, count(*) AS columns_ahead, CAST(sum(row_count) AS BIGINT) AS row_count
        FROM ({_DRIFT}) WHERE row_count > 0 GROUP BY ALL"""),
    "check_provenance": over_bill(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing, count(*) AS total_rows FROM bill"
        for c in ("x_Synthetic", "x_SchemaEra", "x_FixtureId"))),
    "check_supplemental": over_bill(_companion_sql(), INVOICES, PERIODS, CONTRACTS),
    "check_horizons": _horizon_sql(),
    "validate_all": _summaries("SELECT * FROM summaries", True),
    "report_verdict": _summaries("""
        SELECT severity, count(*) AS checks, count_if(violations > 0) AS checks_with_findings,
               CAST(sum(violations) AS BIGINT) AS violations, CAST(sum(suppressed) AS BIGINT) AS suppressed
        FROM summaries GROUP BY ALL""", True),
    "rule_coverage": _summaries("""
        SELECT severity, CASE WHEN contains(check_id, '-notnull') THEN 'MUST NOT be null' ELSE 'MUST be null' END AS direction,
               count(*) AS implemented, count_if(violations > 0) AS with_findings,
               count_if(rows_out_of_era > 0) AS partly_out_of_era FROM summaries GROUP BY ALL""", False),
    "xds_invoice": _finding_sql(f"""
        SELECT 'XDS-invoice-reconciliation', CASE WHEN c.total IS NULL THEN 'WARN' ELSE 'FAIL' END,
               i.InvoiceId || ' [' || i.BillingCurrency || ']', CASE WHEN c.total IS NULL
               THEN 'no cost row carries this invoice; not evaluable' ELSE 'cost rows and invoice lines differ' END,
               NULL, c.total, i.total
        FROM (SELECT InvoiceId, BillingCurrency, sum(BilledCost) AS total FROM invoice GROUP BY ALL) i
        LEFT JOIN (SELECT InvoiceId, BillingCurrency, sum(BilledCost) AS total FROM bill GROUP BY ALL) c
          ON i.InvoiceId = c.InvoiceId AND i.BillingCurrency = c.BillingCurrency
        WHERE c.total IS NULL OR abs(c.total - i.total) > 0.000001
        UNION ALL
        SELECT 'XDS-invoice-reconciliation', 'INFO', 'cost rows without an invoice',
               CAST(round(100.0 * n / t, 0) AS BIGINT) || '% of rows are outside reconciliation', n, NULL, NULL
        FROM (SELECT count_if(InvoiceId IS NULL) AS n, count(*) AS t FROM bill) WHERE n > 0
        UNION ALL
        SELECT 'XDS-invoice-reconciliation', 'INFO', 'invoices reconciled', 'reconciled on the named key', count(*), NULL, NULL
        FROM (SELECT InvoiceId, BillingCurrency FROM invoice INTERSECT SELECT InvoiceId, BillingCurrency FROM bill)
        HAVING count(*) > 0""", INVOICES),
    "xds_closure": _finding_sql("""
        SELECT 'XDS-commitment-closure', severity, tail, finding || currency, days, used, bought FROM (
          SELECT *, CASE WHEN id IS NULL THEN 'INFO' WHEN whole THEN CASE WHEN abs(used - bought) > 0.000001 THEN 'FAIL' ELSE 'INFO' END
                    WHEN secs <= 0 THEN 'WARN' ELSE 'INFO' END AS severity,
                 CASE WHEN whole THEN CASE WHEN abs(used - bought) > 0.000001
                        THEN 'term fully covered; closure must hold and does not' ELSE 'term fully covered and closure holds' END
                      WHEN secs <= 0 THEN 'every usage row falls outside the term'
                      ELSE 'dataset covers part of the term; closure not evaluable' END AS finding,
                 CASE WHEN NOT whole AND secs > 0 THEN secs // 86400 END AS days
          FROM term WHERE id IS NOT NULL AND seen_from IS NOT NULL)
        UNION ALL
        SELECT 'XDS-commitment-closure', 'INFO', tail, 'no contract record; term unknown' || currency, NULL, used, NULL FROM term WHERE id IS NULL
        UNION ALL
        SELECT 'XDS-commitment-closure', 'FAIL', tail, 'purchases disagree with the contract cost' || currency, NULL, bought, contracted
        FROM term WHERE whole AND bought <> 0 AND abs(bought - contracted) > 0.000001""", CONTRACTS + """,
term AS (
  SELECT u.*, u.CommitmentDiscountId AS tail, ' [' || coalesce(u.BillingCurrency, 'unknown') || ']' AS currency, c.ContractCommitmentId AS id, c.ContractCommitmentCost AS contracted,
         seen_from <= c.ContractCommitmentPeriodStart AND seen_to >= c.ContractCommitmentPeriodEnd AS whole,
         date_diff('second', greatest(seen_from, CAST(c.ContractCommitmentPeriodStart AS TIMESTAMP)),
                   least(seen_to, CAST(c.ContractCommitmentPeriodEnd AS TIMESTAMP))) AS secs
  FROM (SELECT CommitmentDiscountId, BillingCurrency, sum(CASE WHEN ChargeCategory = 'Usage' THEN EffectiveCost ELSE 0 END) AS used,
               sum(CASE WHEN ChargeCategory = 'Purchase' THEN BilledCost ELSE 0 END) AS bought,
               min(ChargePeriodStart) FILTER (WHERE ChargeCategory = 'Usage') AS seen_from,
               max(ChargePeriodEnd) FILTER (WHERE ChargeCategory = 'Usage') AS seen_to
        FROM bill WHERE CommitmentDiscountId IS NOT NULL GROUP BY ALL) u
  LEFT JOIN contract c ON u.CommitmentDiscountId = c.ContractCommitmentId AND u.BillingCurrency = c.BillingCurrency)"""),
    "xds_billing_period": _finding_sql("""
        SELECT 'XDS-billing-period', 'FAIL', s || '..' || e, 'overlaps ' || s2 || '..' || e2, NULL, NULL, NULL FROM (
          SELECT lag(BillingPeriodStart) OVER w AS s, lag(BillingPeriodEnd) OVER w AS e, BillingPeriodStart AS s2, BillingPeriodEnd AS e2
          FROM period WINDOW w AS (PARTITION BY InvoiceIssuerName ORDER BY BillingPeriodStart, BillingPeriodEnd)) WHERE s2 < e
        UNION ALL
        SELECT 'XDS-billing-period', 'WARN', 'open periods', 'more than one period is open', count(*), NULL, NULL
        FROM period WHERE BillingPeriodStatus = 'Open' HAVING count(*) > 1
        UNION ALL
        SELECT 'XDS-billing-period', 'INFO', 'cost rows outside every period', 'the periods do not describe the whole bill', count(*), NULL, NULL
        FROM bill b WHERE NOT EXISTS (FROM period p WHERE CAST(b.ChargePeriodStart AS DATE) >= p.BillingPeriodStart
                                      AND CAST(b.ChargePeriodStart AS DATE) < p.BillingPeriodEnd) HAVING count(*) > 0""", PERIODS),
    "xds_orphan": _finding_sql("""
        SELECT 'XDS-invoice-orphan-cost-side', 'FAIL', InvoiceId, 'invoice does not exist in invoice_detail', count(*), NULL, NULL
        FROM bill WHERE InvoiceId IS NOT NULL AND InvoiceId NOT IN (SELECT InvoiceId FROM invoice) GROUP BY InvoiceId""", INVOICES),
    "xds_period_pair": _finding_sql("""
        SELECT 'XDS-period-pair-match', 'FAIL', BillingPeriodStart || '..' || BillingPeriodEnd, 'period has no row in billing_period',
               count(*), NULL, NULL FROM bill ANTI JOIN period USING (BillingPeriodStart, BillingPeriodEnd)
        GROUP BY BillingPeriodStart, BillingPeriodEnd""", PERIODS),
    "xds_correction": _finding_sql("""
        SELECT 'XDS-correction-discipline', 'WARN', 'corrections without an invoice', 'cut-off discipline is not evaluable', count(*), NULL, NULL
        FROM bill WHERE ChargeClass = 'Correction' AND InvoiceId IS NULL HAVING count(*) > 0
        UNION ALL
        SELECT 'XDS-correction-discipline', 'FAIL', InvoiceId, 'no line on this invoice names what is corrected', count(*), NULL, NULL
        FROM bill WHERE ChargeClass = 'Correction' AND InvoiceId IS NOT NULL
          AND InvoiceId NOT IN (SELECT InvoiceId FROM invoice WHERE ReferenceInvoiceId <> InvoiceId) GROUP BY InvoiceId
        UNION ALL
        SELECT 'XDS-correction-discipline', CASE WHEN status = 'Closed' THEN 'INFO' ELSE 'FAIL' END, CAST(day AS VARCHAR),
               CASE WHEN status IS NULL THEN 'date falls in no declared period' WHEN status = 'Closed' THEN 'restates a closed period'
                    ELSE 'restates a period that is ' || status END, count(*), NULL, NULL
        FROM (SELECT CAST(ChargePeriodStart AS DATE) AS day, (SELECT arg_min(BillingPeriodStatus, p.BillingPeriodStart) FROM period p
                WHERE CAST(b.ChargePeriodStart AS DATE) >= p.BillingPeriodStart AND CAST(b.ChargePeriodStart AS DATE) < p.BillingPeriodEnd) AS status
              FROM bill b WHERE ChargeClass = 'Correction' AND InvoiceId IS NOT NULL) GROUP BY day, status""", INVOICES, PERIODS),
    "xds_eligibility": _finding_sql("""
        SELECT 'XDS-eligibility-universe', 'FAIL', 'rows without a verdict', 'the eligibility universe is not fully explained', count(*), NULL, NULL
        FROM bill WHERE ChargeCategory = 'Usage' AND x_SchemaEra = '1.2' AND x_CommitmentEligible IS NULL
          AND CommitmentDiscountStatus IS DISTINCT FROM 'Unused' HAVING count(*) > 0
        UNION ALL
        SELECT 'XDS-eligibility-universe', 'INFO', BillingCurrency, 'coverage of coverable '
               || CAST(round(CAST(100 * CAST(covered AS DOUBLE) / CAST(eligible AS DOUBLE) AS DECIMAL(28,6)), 1) AS VARCHAR) || '% vs naive '
               || CAST(round(CAST(100 * CAST(covered AS DOUBLE) / CAST(demand AS DOUBLE) AS DECIMAL(28,6)), 1) AS VARCHAR) || '%',
               NULL, eligible, demand
        FROM (SELECT BillingCurrency, sum(EffectiveCost) FILTER (WHERE x_CommitmentEligible AND PricingCategory = 'Committed') AS covered,
                     sum(EffectiveCost) FILTER (WHERE x_CommitmentEligible) AS eligible,
                     sum(EffectiveCost) FILTER (WHERE CommitmentDiscountStatus IS DISTINCT FROM 'Unused') AS demand
              FROM bill WHERE ChargeCategory = 'Usage' GROUP BY ALL) WHERE eligible > 0 AND demand > 0"""),
    "period_overlap": over_bill("""
        SELECT a.InvoiceIssuerName, a.BillingPeriodStart AS previous_start, a.BillingPeriodEnd AS previous_end,
               b.BillingPeriodStart AS next_start, b.BillingPeriodEnd AS next_end
        FROM period a JOIN period b USING (InvoiceIssuerName)
        WHERE b.BillingPeriodStart < a.BillingPeriodEnd AND b.BillingPeriodStart > a.BillingPeriodStart
          AND NOT EXISTS (FROM period c WHERE c.InvoiceIssuerName = a.InvoiceIssuerName
                          AND c.BillingPeriodStart > a.BillingPeriodStart AND c.BillingPeriodStart < b.BillingPeriodStart)""", PERIODS),
}
