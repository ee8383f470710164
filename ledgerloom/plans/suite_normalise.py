"""Normalisation, inventory and derived figures, with comparison SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import display, rows, total
from ledgerloom.operators import derive as D
from ledgerloom.operators import file_audit
from ledgerloom.operators import inventory as I
from ledgerloom.operators import normalise as N
from ledgerloom.plans.oracle_base import EVERY_CONTRACT, money, over_bill, ratio
from ledgerloom.sources import bill_adapter as A
from ledgerloom.sources import bill_columns as rules

PROFILED = [c for c in rules.FULL_BILL if c != "x_ChargeId"]
TEXTS = rules.TEXT_COLUMNS
CANONICAL = "x_ChargeId x_SchemaEra SkuMeter SkuPriceDetails PricingCurrency InvoiceId".split()
PRICED = """x_ChargeId x_SchemaEra PricingCurrency PricingCurrencyEffectiveCost
    PricingCurrencyListUnitPrice PricingCurrencyContractedUnitPrice""".split()
SCANNED = rules.FULL_BILL
# Of the driver's tables, those that are one file at every size.
TABLES = "region nation customer supplier part orders lineitem events benchmark".split()
FRAGMENT = "/RES/1"
ERA_COLUMNS = [c for c in schema.STANDARD_COLUMNS if not schema.era_supports("pre-1.2", c)]


def _on(job, *names):
    def run(spark, sf_dir):
        return job(A.bill(spark, sf_dir, *(names or job.columns)))
    return run


def _canonical(spark, sf_dir):
    needed = CANONICAL + list(schema.FALLBACK_COLUMNS.values())
    return N.canonical_columns(A.bill(spark, sf_dir, *needed)).select(*CANONICAL)


def _priced(spark, sf_dir):
    needed = PRICED + ["BillingCurrency", "EffectiveCost", "ListUnitPrice", "ContractedUnitPrice"]
    return N.pricing_currency_default(A.bill(spark, sf_dir, *needed)).select(*PRICED)


def _resource_filter(spark, sf_dir):
    bill = A.bill(spark, sf_dir, "ResourceId", "BillingCurrency", "BilledCost")
    scope = F.when(N.id_contains(FRAGMENT), "matching").when(~N.id_contains(FRAGMENT), "not matching")
    return (
        bill.withColumn("scope", scope).where("scope IS NOT NULL").groupBy("scope", "BillingCurrency")
        .agg(rows().alias("row_count"), display(total("BilledCost")).alias("billed_cost")))


def _unified(spark, sf_dir):
    """Three era layers with their own columns, merged by name and summed per era."""
    bill = A.bill(spark, sf_dir, "x_SchemaEra", "ServiceSubcategory", "x_SkuMeterName", "EffectiveCost",
                  "CommitmentDiscountName", "x_FixtureId")
    current = bill.where("x_SchemaEra = '1.2'").drop("x_SkuMeterName")
    older = [bill.where(F.col("x_SchemaEra") == era).drop("ServiceSubcategory") for era in ("1.0r2", "pre-1.2")]
    merged = N.unify([current, *older])
    return merged.groupBy("x_SchemaEra", "x_FixtureId").agg(
        rows().alias("row_count"), F.count("ServiceSubcategory").alias("subcategories"),
        F.count("x_SkuMeterName").alias("fallback_meters"),
        F.count("CommitmentDiscountName").alias("named_commitments"),
        display(total("EffectiveCost"), 2).alias("effective_cost"))


def _requirements(spark, sf_dir):
    """Every line of every document, normalised as a requirement sentence."""
    text = A.table(spark, sf_dir, "documents")
    lines = text.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"),
                        N.normalise_requirement(F.col("line")).alias("requirement"))


def _drop_audit(spark, sf_dir):
    bill = A.bill(spark, sf_dir, "x_FixtureId", "x_SchemaEra")
    year = F.substring("x_FixtureId", 6, 4).cast("int")
    stated = bill.groupBy(F.col("x_FixtureId").alias("drop_id")).agg(
        (rows() + F.when(F.max(year) % 3 == 0, 1).otherwise(0)).cast("long").alias("rows_stated"))
    return I.drop_audit(bill.where("x_FixtureId <> 'drop-2001'"), stated)


STATED = {"orders": 1, "part": None}  # one file misstated, one not stated, and one stated that is not there


def _file_audit(spark, sf_dir):
    """Every file of the driver's folder against the counts of its own tables."""
    counts = [A.table(spark, sf_dir, name).agg(F.concat(F.lit(name), F.lit(".parquet")).alias("file_name"),
                                               (rows() + STATED.get(name, 0)).alias("rows_stated"))
              for name in TABLES if STATED.get(name, 0) is not None]
    counts.append(spark.createDataFrame([("absent.parquet", 5)], "file_name string, rows_stated bigint"))
    audit = file_audit.file_audit(file_audit.listed_files(spark, sf_dir), file_audit.rows_by_file(spark, sf_dir), reduce(DataFrame.unionByName, counts))
    return audit.where(F.col("file_name").isin(*[f"{t}.parquet" for t in (*TABLES, "absent")])).drop("bytes")


QUERIES = {
    "scan_bill": lambda spark, sf: A.bill(spark, sf, *SCANNED),
    "canonical_columns": _canonical,
    "empty_to_null": lambda spark, sf: N.empty_to_null(A.bill(spark, sf, *TEXTS)),
    "empty_string_report": _on(N.empty_string_report, *TEXTS),
    "pricing_currency_default": _priced,
    "unified_layers": _unified,
    "resource_filter": _resource_filter,
    "resource_group_fold": _on(I.resource_group_fold),
    "normalise_requirement": _requirements,
    "null_profile": _on(I.null_profile, *PROFILED),
    "category_inventory": _on(I.category_inventory),
    "currency_inventory": _on(I.currency_inventory),
    "currency_pairs": _on(I.currency_pairs),
    "semantic_nulls": _on(I.semantic_nulls, *schema.NULL_MEANING),
    "cascade_defects": _on(I.cascade_defects, *schema.ANCHORS,
                           *[s for group in schema.ANCHORS.values() for s in group]),
    "placeholder_scan": _on(I.placeholder_scan, *TEXTS),
    "drop_audit": _drop_audit,
    "file_audit": _file_audit,
    "era_labels": _on(I.era_labels),
    "unattributed_share": _on(I.unattributed_share),
    "renamed_resources": _on(I.renamed_resources),
    "derive_invoice_detail": _on(D.derive_invoice_detail),
    "amortise_commitment": lambda spark, sf: D.amortise_commitment(A.contract_commitment(spark, sf, every=True)),
    "gap_explained": _on(D.gap_explained),
    "allocatable_split": _on(D.allocatable_split),
    "zero_billed": _on(D.zero_billed),
    "month_boundary": _on(D.month_boundary),
    "corrections": _on(D.corrections),
    "granularity": _on(D.granularity),
    "currency_totals": _on(D.currency_totals, "BillingCurrency", "EffectiveCost"),
    "era_gap": _on(D.era_gap, "x_SchemaEra", *ERA_COLUMNS),
    "sku_key_coverage": _on(D.sku_key_coverage),
    "content_fingerprint": lambda spark, sf: D.content_fingerprint(A.bill(spark, sf), ["x_SchemaEra"]),
}


def _per_column(columns, condition: str, alias: str, having: str = "", extra: str = "") -> str:
    pieces = [f"SELECT '{c}' AS column_name, count_if({condition.format(c=c)}) AS {alias}{extra} FROM bill"
              for c in columns]
    body = " UNION ALL ".join(pieces)
    return over_bill(f"SELECT * FROM ({body}) {having}")


_PLACEHOLDERS = ", ".join(f"'{p}'" for p in schema.PLACEHOLDERS)
_CATEGORIES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM bill" for c in I.CATEGORY_COLUMNS)
_DECIMALS = [c for c in rules.NOT_TEXT if not c.endswith(("Start", "End")) and c not in ("x_Synthetic", "x_CommitmentEligible")]
_PIECES = [f"CAST('0x' || substr(d, {at}, {size}) AS BIGINT)" for at, size in D.DIGEST_PIECES]
_CASCADES = " UNION ALL ".join(
    f"SELECT '{a}' AS anchor, '{s}' AS satellite, count(*) AS row_count FROM bill "
    f"WHERE {a} IS NULL AND {s} IS NOT NULL" for a, group in schema.ANCHORS.items() for s in group)
_SKU = "(VALUES " + ", ".join(f"('{k}')" for k in schema.SKU_PROPERTIES) + ") s(sku_key)"

ORACLE = {
    "scan_bill": over_bill("SELECT " + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c in _DECIMALS else c for c in SCANNED) + " FROM bill"),
    "canonical_columns": over_bill("""
        SELECT x_ChargeId, x_SchemaEra, coalesce(SkuMeter, x_SkuMeterName) AS SkuMeter,
               coalesce(SkuPriceDetails, x_SkuDetails) AS SkuPriceDetails,
               coalesce(PricingCurrency, x_PricingCurrency) AS PricingCurrency,
               coalesce(InvoiceId, x_InvoiceId) AS InvoiceId FROM bill"""),
    "empty_to_null": over_bill("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in TEXTS) + " FROM bill"),
    "empty_string_report": _per_column(TEXTS, "{c} = ''", "empty_strings"),
    "pricing_currency_default": over_bill("""
        SELECT x_ChargeId, x_SchemaEra,
          CASE WHEN PricingCurrency IS NULL AND x_SchemaEra = '1.2' THEN BillingCurrency ELSE PricingCurrency END AS PricingCurrency,
          CAST(CASE WHEN x_SchemaEra = '1.2' THEN ifnull(PricingCurrencyEffectiveCost, EffectiveCost)
               ELSE PricingCurrencyEffectiveCost END AS DOUBLE) AS PricingCurrencyEffectiveCost,
          CAST(CASE WHEN x_SchemaEra = '1.2' THEN ifnull(PricingCurrencyListUnitPrice, ListUnitPrice)
               ELSE PricingCurrencyListUnitPrice END AS DOUBLE) AS PricingCurrencyListUnitPrice,
          CAST(CASE WHEN x_SchemaEra = '1.2' THEN ifnull(PricingCurrencyContractedUnitPrice, ContractedUnitPrice)
               ELSE PricingCurrencyContractedUnitPrice END AS DOUBLE) AS PricingCurrencyContractedUnitPrice
        FROM bill"""),
    "unified_layers": over_bill(f"""
        SELECT x_SchemaEra, x_FixtureId, count(*) AS row_count,
               count_if(x_SchemaEra = '1.2' AND ServiceSubcategory <> '') AS subcategories,
               count_if(x_SchemaEra <> '1.2' AND x_SkuMeterName <> '') AS fallback_meters,
               count_if(CommitmentDiscountName <> '') AS named_commitments,
               {money('sum(EffectiveCost)')} AS effective_cost FROM bill GROUP BY ALL"""),
    "resource_filter": over_bill(f"""
        SELECT CASE WHEN contains(lower(ResourceId), lower('{FRAGMENT}')) THEN 'matching' ELSE 'not matching' END AS scope,
               BillingCurrency, count(*) AS row_count, {money('sum(BilledCost)')} AS billed_cost
        FROM bill WHERE ResourceId IS NOT NULL GROUP BY ALL"""),
    "resource_group_fold": over_bill(f"""
        SELECT lower(x_ResourceGroupName) AS resource_group, BillingCurrency, count(*) AS row_count,
               count(DISTINCT x_ResourceGroupName) AS spellings, {money('sum(EffectiveCost)')} AS effective_cost
        FROM bill GROUP BY ALL"""),
    "normalise_requirement": f"""
        SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(replace(
                 regexp_replace(line, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '*', ''),
                 '{N.SPACE}', ' ', 'g')), '\\.+$', '') AS requirement
        FROM (SELECT doc_id, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""",
    "null_profile": over_bill("SELECT column_name, nulls, total_rows, "
                              + ratio("nulls", "total_rows") + " AS pct FROM ("
                              + " UNION ALL ".join(
                                  f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS total_rows FROM bill"
                                  for c in PROFILED) + ") WHERE nulls > 0"),
    "category_inventory": over_bill(
        f"SELECT column_name, value, count(*) AS row_count FROM ({_CATEGORIES}) GROUP BY ALL"),
    "currency_inventory": over_bill("""
        SELECT DISTINCT 'BillingCurrency' AS column_name, BillingCurrency AS currency FROM bill UNION ALL
        SELECT DISTINCT 'PricingCurrency', PricingCurrency FROM bill"""),
    "currency_pairs": over_bill("""
        SELECT BillingCurrency, PricingCurrency, count(*) AS row_count,
               BillingCurrency IS DISTINCT FROM PricingCurrency AS differs FROM bill GROUP BY ALL"""),
    "semantic_nulls": over_bill(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS nulls, '{m.replace(chr(39), chr(39) * 2)}' AS meaning FROM bill"
        for c, m in schema.NULL_MEANING.items())),
    "cascade_defects": over_bill(f"SELECT * FROM ({_CASCADES}) WHERE row_count > 0"),
    "placeholder_scan": _per_column(TEXTS, "{c} IN (" + _PLACEHOLDERS + ")", "placeholders", "WHERE placeholders > 0"),
    "drop_audit": over_bill("""
        SELECT drop_id, rows_found, eras, rows_stated, CASE WHEN rows_found IS NULL THEN 'MISSING'
               WHEN rows_found = rows_stated THEN 'MATCH' ELSE 'MISMATCH' END AS verdict
        FROM (SELECT x_FixtureId AS drop_id,
                     CASE WHEN x_FixtureId <> 'drop-2001' THEN count(*) END AS rows_found,
                     CASE WHEN x_FixtureId <> 'drop-2001' THEN string_agg(DISTINCT x_SchemaEra, ', ' ORDER BY x_SchemaEra) END AS eras,
                     CAST(count(*) + CASE WHEN CAST(right(x_FixtureId, 4) AS INT) % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rows_stated
              FROM bill GROUP BY x_FixtureId)"""),
    "file_audit": " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file_name, count(*) AS rows_found, "
        + ("NULL::BIGINT AS rows_stated, 'NOT STATED' AS verdict" if STATED.get(t, 0) is None else
           f"count(*) + {STATED.get(t, 0)} AS rows_stated, '{'MISMATCH' if STATED.get(t, 0) else 'MATCH'}' AS verdict")
        + f" FROM {t}" for t in TABLES) + " UNION ALL SELECT 'absent.parquet', NULL, 5, 'MISSING'",
    "era_labels": over_bill("""
        SELECT BillingCurrency, string_agg(DISTINCT x_SchemaEra, ', ' ORDER BY x_SchemaEra) AS eras FROM bill GROUP BY ALL"""),
    "unattributed_share": over_bill(f"""
        SELECT BillingCurrency, unattributed, total_rows, {ratio('unattributed', 'total_rows')} AS pct
        FROM (SELECT BillingCurrency, count(*) - count(nullif(InvoiceId, '')) AS unattributed, count(*) AS total_rows
              FROM bill GROUP BY ALL)"""),
    "renamed_resources": over_bill("""
        SELECT ResourceId, ResourceName, count(*) AS row_count, any_value(names) AS names
        FROM bill JOIN (SELECT ResourceId, count(DISTINCT ResourceName) AS names FROM bill GROUP BY ALL) USING (ResourceId)
        WHERE names > 1 AND ResourceName IS NOT NULL GROUP BY ResourceId, ResourceName"""),
    "derive_invoice_detail": over_bill(f"""
        SELECT InvoiceId || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS InvoiceDetailId,
               InvoiceId, ReferenceInvoiceId, InvoiceIssuerName, BillingAccountId, BillingCurrency, {money('amount')} AS BilledCost, ChargeCategory,
               BillingPeriodStart, closes AS BillingPeriodEnd, closes + 8 AS InvoiceIssueDate,
               'Issued' AS InvoiceIssueStatus, closes + 38 AS PaymentDueDate, 'Net 30' AS PaymentTerms,
               CASE WHEN ChargeClass = 'Correction' THEN ChargeCategory || ' correction to ' || coalesce(ReferenceInvoiceId, 'an invoice not named')
                    ELSE ChargeCategory || ' charges' END AS InvoiceDetailDescription,
               '{{"ChargeCategory":"' || ChargeCategory || '","ChargeClass":"' || coalesce(ChargeClass, 'None') || '"}}' AS InvoiceDetailGrain,
               closes + 8 AS InvoiceDetailCreated, closes + 8 AS InvoiceDetailLastUpdated
        FROM (SELECT *, row_number() OVER (ORDER BY InvoiceId, BillingCurrency, BillingPeriodStart, ChargeCategory, coalesce(ChargeClass, ''), charge_month) AS n,
                     CASE WHEN ChargeClass IS DISTINCT FROM 'Correction' THEN InvoiceId
                          WHEN contains(InvoiceId, strftime(BillingPeriodStart, '%Y-%m'))
                          THEN replace(InvoiceId, strftime(BillingPeriodStart, '%Y-%m'), strftime(charge_month, '%Y-%m')) END AS ReferenceInvoiceId
              FROM (SELECT InvoiceId, BillingCurrency, BillingPeriodStart, ChargeCategory, ChargeClass, charge_month, sum(BilledCost) AS amount,
                           max(BillingPeriodEnd) AS closes, CASE WHEN min(InvoiceIssuerName) = max(InvoiceIssuerName) THEN min(InvoiceIssuerName) END AS InvoiceIssuerName,
                           CASE WHEN min(BillingAccountId) = max(BillingAccountId) THEN min(BillingAccountId) END AS BillingAccountId
                    FROM bill WHERE InvoiceId <> '' GROUP BY ALL))"""),
    "amortise_commitment": over_bill("""
        SELECT ContractCommitmentId AS CommitmentDiscountId, BillingCurrency, ContractCommitmentPeriodStart AS ChargeDay,
               'Purchase' AS ChargeCategory, NULL AS CommitmentDiscountStatus,
               CAST(24 * date_diff('day', ContractCommitmentPeriodStart, ContractCommitmentPeriodEnd) AS BIGINT) AS hours,
               CAST(2.40 * date_diff('day', ContractCommitmentPeriodStart, ContractCommitmentPeriodEnd) AS DOUBLE) AS ListCost,
               CAST(0 AS DOUBLE) AS EffectiveCost,
               CAST(2.40 * date_diff('day', ContractCommitmentPeriodStart, ContractCommitmentPeriodEnd) AS DOUBLE) AS BilledCost
        FROM contract UNION ALL
        SELECT id, BillingCurrency, CAST(start + n * INTERVAL 1 DAY AS DATE), 'Usage', status, CAST(hours AS BIGINT),
               CAST(hours * CASE status WHEN 'Used' THEN 0.15 ELSE 0.10 END AS DOUBLE), CAST(hours * 0.10 AS DOUBLE), 0
        FROM (SELECT id, BillingCurrency, start, n, status, CASE WHEN status = 'Used' THEN CASE WHEN n < 10 THEN 24 ELSE 18 END
                     ELSE CASE WHEN n < 10 THEN 0 ELSE 6 END END AS hours
              FROM (SELECT ContractCommitmentId AS id, BillingCurrency, ContractCommitmentPeriodStart AS start,
                           unnest(range(date_diff('day', ContractCommitmentPeriodStart, ContractCommitmentPeriodEnd))) AS n
                    FROM contract), (VALUES ('Used'), ('Unused')) s(status)) WHERE hours > 0""", EVERY_CONTRACT),
    "gap_explained": over_bill(f"""
        SELECT BillingCurrency, {money('gap')} AS gap, {money('third')} AS third_party,
               {money('timing')} AS commitment_timing, {money('overlap')} AS overlap,
               {money('third + timing - overlap')} AS explained, {money('gap - (third + timing - overlap)')} AS unexplained,
               CASE WHEN gap = third + timing - overlap THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT BillingCurrency, sum(EffectiveCost - BilledCost) AS gap,
                sum(CASE WHEN PublisherName <> ProviderName THEN EffectiveCost ELSE 0 END) AS third,
                sum(CASE WHEN ChargeCategory = 'Usage' AND CommitmentDiscountId IS NOT NULL THEN EffectiveCost ELSE 0 END)
                  - sum(CASE WHEN ChargeCategory = 'Purchase' THEN BilledCost ELSE 0 END) AS timing,
                sum(CASE WHEN ChargeCategory = 'Usage' AND CommitmentDiscountId IS NOT NULL
                          AND PublisherName <> ProviderName THEN EffectiveCost ELSE 0 END) AS overlap
              FROM bill GROUP BY ALL)"""),
    "allocatable_split": over_bill(f"""
        SELECT BillingCurrency, CASE WHEN ResourceId IS NULL THEN 'unallocatable' ELSE 'allocatable' END AS allocation,
               count(*) AS row_count, {money('sum(EffectiveCost)')} AS effective_cost FROM bill GROUP BY ALL"""),
    "zero_billed": over_bill(f"""
        SELECT BillingCurrency, count(*) AS row_count, count(CommitmentDiscountId) AS commitment_covered,
               count_if(PublisherName <> ProviderName) AS third_party, {money('sum(EffectiveCost)')} AS effective_cost
        FROM bill WHERE BilledCost = 0 AND EffectiveCost > 0 GROUP BY ALL"""),
    "month_boundary": over_bill("""
        SELECT CAST(ChargePeriodEnd AS DATE) AS boundary, count(*) AS row_count FROM bill
        WHERE CAST(ChargePeriodEnd AS DATE) = BillingPeriodEnd AND ChargePeriodStart < ChargePeriodEnd GROUP BY ALL"""),
    "corrections": over_bill(f"""
        SELECT CASE WHEN ChargeClass = 'Correction' THEN 'flagged' ELSE 'unflagged' END AS kind, BillingCurrency,
               count(*) AS row_count, {money('sum(EffectiveCost)')} AS effective_cost FROM bill
        WHERE ChargeClass = 'Correction' OR (ChargeClass IS NULL AND ChargeCategory = 'Usage' AND EffectiveCost < 0)
        GROUP BY ALL"""),
    "granularity": over_bill("""
        SELECT x_SchemaEra, CAST(date_diff('hour', ChargePeriodStart, ChargePeriodEnd) AS BIGINT) AS hours,
               count(*) AS row_count FROM bill GROUP BY ALL"""),
    "currency_totals": over_bill(
        f"SELECT BillingCurrency, {money('sum(EffectiveCost)')} AS effective_cost FROM bill GROUP BY ALL"),
    "era_gap": over_bill(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS populated, count(*) AS era_rows, "
        f"'{schema.INTRODUCED[c]}' AS introduced FROM bill WHERE x_SchemaEra = 'pre-1.2'" for c in ERA_COLUMNS)),
    "sku_key_coverage": over_bill(f"""
        SELECT sku_key, coalesce(row_count, 0) AS row_count,
               CASE WHEN s.standard THEN 'standard' WHEN sku_key[:2] = 'x_' THEN 'provider' ELSE 'unknown' END AS kind
        FROM used FULL JOIN (SELECT sku_key, true AS standard FROM {_SKU}) s USING (sku_key)""",
        ctes="""used AS (SELECT sku_key, count(*) AS row_count FROM (
              SELECT unnest(json_keys(doc)) AS sku_key FROM (SELECT coalesce(SkuPriceDetails, x_SkuDetails) AS doc FROM bill)
              WHERE json_valid(doc)) GROUP BY ALL)"""),
    "content_fingerprint": over_bill(f"""
        SELECT x_SchemaEra, count(*) AS row_count, concat_ws('-', {", ".join(f"bit_xor({h})" for h in _PIECES)}) AS xor_of_rows,
               concat_ws('-', {", ".join(f"sum(CAST({h} AS HUGEINT))" for h in _PIECES)}) AS sum_of_rows
        FROM (SELECT x_SchemaEra, sha256(concat_ws(',', {", ".join(
            f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(SCANNED))})) AS d FROM bill)
        GROUP BY ALL"""),
}
