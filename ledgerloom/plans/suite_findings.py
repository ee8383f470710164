"""The table of findings and the proof over planted faults, with comparison SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import findings as V
from ledgerloom.operators import rulebook
from ledgerloom.plans import suite_checks as S
from ledgerloom.sources import bill_adapter as A

# Left out of the table, so that it has checks to skip and a mandatory column to miss.
UNSEEN = ("PricingUnit", "SkuMeter")
# Faults that the adapter's rules plant, by row number, with the check that must name each.
PLANTED = {
    "negative list price": ("k % 863 = 5", "METRIC-nonneg-ListUnitPrice"),
    "negative contracted price": ("k % 887 = 5", "METRIC-nonneg-ContractedUnitPrice"),
    "unknown frequency": ("k % 701 = 5", "AV-ChargeFrequency"),
    "unknown commitment category": ("k % 409 = 5", "AV-CommitmentDiscountCategory"),
    "period ends before it starts": ("k % 1009 = 3", "PERIOD-ordering"),
    "name repeats the id": ("k % 503 = 5 AND k % 8 <> 0", "WARN-ResourceName-duplicates-ResourceId"),
    "no service category": ("k % 607 = 5", "NULL-ServiceCategory-notnull"),
}
LABEL = "CASE " + " ".join(f"WHEN {condition} THEN '{name}'" for name, (condition, _) in PLANTED.items()) + " END"


def _violations(spark, sf_dir):
    return V.findings(A.bill(spark, sf_dir, "x_ChargeId", *[c for c in S.CHECKED if c not in UNSEEN]), "x_ChargeId")


def _proof(spark, sf_dir):
    frame = A.bill(spark, sf_dir, "k", *S.CHECKED).withColumn("planted_fault", F.expr(LABEL)).drop("k")
    expected = spark.createDataFrame([(name, check) for name, (_, check) in PLANTED.items()], "planted_fault string, check_prefix string")
    return V.planted_faults(frame, "planted_fault", expected)


QUERIES = {"violations": _violations, "planted_proof": _proof}

# ---- comparison SQL ---------------------------------------------------------


def _messages() -> dict[str, str]:
    """The message of each rule that is not a null rule."""
    quote, listed = "''''", S._listed
    told = {f"AV-{c}": f"'{c} = ' || {quote} || {c} || {quote} || ' is not one of the {len(v)} allowed values'"
            for c, v in schema.ALLOWED_VALUES.items()}
    sub, parent = f"{quote} || ServiceSubcategory || {quote}", f"{quote} || ServiceCategory || {quote}"
    told["SVC-parent-map"] = (f"CASE WHEN ServiceCategory IN ({listed(schema.SERVICE_PAIRS)}) THEN {sub} || ' is not permitted under ' || {parent} "
                              f"ELSE {sub} || ' is not a recognised subcategory' END")
    for c in ("ListUnitPrice", "ContractedUnitPrice", "PricingCurrencyListUnitPrice", "PricingCurrencyContractedUnitPrice"):
        told[f"METRIC-nonneg-{c}"] = f"'{c} is negative; MUST be non-negative'"
    for p, c in (("ListUnitPrice", "ListCost"), ("ContractedUnitPrice", "ContractedCost")):
        told[f"METRIC-product-{c}"] = f"'{p} x PricingQuantity does not match {c}'"
    return told | {
        "XCOL-ChargeClass-Correction": f"'ChargeClass = ' || {quote} || ChargeClass || {quote} || ' but MUST be ''Correction'' when not null'",
        "XCOL-ChargeFrequency-Usage-Based": "'ChargeFrequency ''Usage-Based'' is forbidden when ChargeCategory is Purchase'",
        "FMT-ISO4217-BillingCurrency": f"'BillingCurrency = ' || {quote} || BillingCurrency || {quote} || ' is not three capital letters'",
        "PERIOD-ordering": "'ChargePeriodEnd is not after ChargePeriodStart'",
        "WARN-ResourceName-duplicates-ResourceId": "'ResourceName repeats ResourceId'",
        "SKU-key-prefix": "'SkuPriceDetails has a key that is neither standard nor x_ prefixed'",
    }


_SAID = dict(zip(rulebook.null_check_ids(rulebook.NULL_RULES), (r.sentence for r in rulebook.NULL_RULES), strict=True))
_READS = {i: {column, *re.findall(r"\w+", condition)} for (i, *_), (column, _, condition, _) in zip(S._null_rows(), S._NULLS, strict=True)}
_UNREAD = [i for i, reads in _READS.items() if reads & set(UNSEEN)]


def _rules(without: list[str]) -> list[tuple[str, str, str, str]]:
    """(check, severity, condition, message) of every rule on rows."""
    nulls = [(i, s, b, "'" + _SAID[i].replace("'", "''") + "'") for i, s, b, _, _ in S._null_rows() if i not in without]
    return nulls + [(i, s, f"coalesce({b}, false)", _messages()[i]) for i, s, b in S._other_rows()]


def _findings_sql() -> str:
    parts = [f"SELECT 'violation' AS kind, '{i}' AS check_id, '{s}' AS severity, x_ChargeId AS subject, {m} AS message, 1 AS row_count "
             f"FROM bill WHERE {b}" for i, s, b, m in _rules(_UNREAD)]
    for i, s, _, held, out in S._null_rows():
        if i in _UNREAD:
            parts.append(f"SELECT 'note', '{i}', 'INFO', NULL, 'not run: a column it reads is absent', NULL")
        else:
            parts.append(f"SELECT 'suppressed', '{i}', '{s}', NULL, NULL, count(*) FROM bill WHERE {held} HAVING count(*) > 0")
            parts.append(f"SELECT 'note', '{i}', 'INFO', x_SchemaEra, 'rows out of the check''s eras', count(*) FROM bill WHERE {out} GROUP BY x_SchemaEra")
    parts.append("SELECT DISTINCT 'violation', 'PRESENCE-mandatory', 'FAIL', x_SchemaEra, "
                 "'PricingUnit is Mandatory and absent from a dataset containing ' || x_SchemaEra || ' rows', 1 FROM bill")
    subject = "CommitmentDiscountId || ' [' || BillingCurrency || ']'"
    parts.append(f"""SELECT 'violation', 'COMMIT-closure', 'WARN', {subject},
        CASE WHEN purchase_rows = 0 THEN 'no purchase row in this dataset; closure not evaluable'
             ELSE 'usage and purchase differ; the dataset may not span the term' END, 1
        FROM commitment WHERE usage_rows + purchase_rows > 0 AND (purchase_rows = 0 OR abs(used - bought) > 0.000001)""")
    parts.append(f"""SELECT 'violation', 'COMMIT-split', 'FAIL', {subject}, 'used and unused do not add up to usage', 1
        FROM commitment WHERE usage_rows > 0 AND abs(used - stated) > 0.000001""")
    return (f"WITH {S._MATERIAL},{S._PER_COMMITMENT}\nSELECT kind, check_id, severity, subject, message, CAST(row_count AS BIGINT) AS row_count FROM ("
            + " UNION ALL ".join(parts) + ")")


def _proof_sql() -> str:
    hits = " UNION ALL ".join(f"SELECT '{i}' AS check_id, planted_fault FROM bill WHERE planted_fault IS NOT NULL AND {b}"
                              for i, _, b, _ in _rules([]))
    expected = ", ".join(f"('{name}', '{check}')" for name, (_, check) in PLANTED.items())
    material = S._MATERIAL.replace("bill AS MATERIALIZED (SELECT", f"bill AS MATERIALIZED (SELECT {LABEL} AS planted_fault,")
    return f"""WITH {material}, hits AS MATERIALIZED ({hits}), expected(planted_fault, check_prefix) AS (VALUES {expected})
        SELECT *, CASE WHEN planted = 0 THEN 'NOT PLANTED' WHEN caught >= planted THEN 'CAUGHT' ELSE 'MISSED' END AS verdict FROM (
          SELECT planted_fault, check_prefix, (SELECT count(*) FROM bill l WHERE l.planted_fault = e.planted_fault) AS planted,
                 (SELECT count(*) FROM hits h WHERE h.planted_fault = e.planted_fault AND starts_with(check_id, check_prefix)) AS caught,
                 (SELECT count(*) FROM hits h WHERE h.planted_fault = e.planted_fault AND NOT starts_with(check_id, check_prefix)) AS incidental
          FROM expected e)"""


ORACLE = {"violations": _findings_sql(), "planted_proof": _proof_sql()}
