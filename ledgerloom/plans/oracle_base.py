"""Shared pieces of the comparison SQL: the bill and its companions as CTEs.

The strings are only ever run by the comparison engine over the same parquet
tables; no Spark job reads them.
"""

from __future__ import annotations

from ledgerloom.sources import bill_columns as rules


def bill_cte() -> str:
    """The whole bill as one CTE chain ending in ``bill``."""
    raw = ", ".join(c for columns in rules.RAW.values() for c in columns)
    joins = " ".join(f"JOIN {t} ON {a} = {b}" for t, (a, b) in rules.JOIN_KEYS.items())
    steps = [f"bill_0 AS (SELECT {raw} FROM lineitem {joins})"]
    passes = rules.levels(rules.COLUMNS)
    for n, step in enumerate(passes, start=1):
        derived = ", ".join(f"{rules.COLUMNS[c]} AS {c}" for c in step)
        steps.append(f"bill_{n} AS (SELECT *, {derived} FROM bill_{n - 1})")
    steps.append(f"bill AS (SELECT {', '.join(rules.COLUMNS)} FROM bill_{len(passes)})")
    return ",\n".join(steps)


INVOICES = """
invoice_lines AS (
  SELECT InvoiceId, reference_invoice AS ReferenceInvoiceId, BillingCurrency, ChargeCategory,
         ChargeClass, BillingPeriodStart, BillingPeriodEnd, sum(BilledCost) AS BilledCost
  FROM bill WHERE InvoiceId IS NOT NULL AND BillingPeriodStart <> DATE '1999-05-01'
  GROUP BY ALL),
invoice AS (
  SELECT * REPLACE (CAST(BilledCost + CASE WHEN BillingPeriodStart = DATE '2000-01-01'
                    THEN 0.01 ELSE 0 END AS DECIMAL(28,4)) AS BilledCost),
         'Issued' AS InvoiceIssueStatus FROM invoice_lines
  UNION ALL BY NAME
  SELECT 'GHOST-' || BillingCurrency AS InvoiceId, 'GHOST-' || BillingCurrency AS ReferenceInvoiceId,
         BillingCurrency, 'Usage' AS ChargeCategory, DATE '2000-02-01' AS BillingPeriodStart,
         DATE '2000-03-01' AS BillingPeriodEnd, CAST(sum(BilledCost) AS DECIMAL(28,4)) AS BilledCost,
         'Issued' AS InvoiceIssueStatus
  FROM invoice_lines WHERE BillingPeriodStart = DATE '2000-02-01' GROUP BY BillingCurrency)"""

PERIODS = """
period AS (
  SELECT DISTINCT BillingPeriodStart,
         CASE WHEN BillingPeriodStart = DATE '1998-02-01' THEN CAST(BillingPeriodEnd + INTERVAL 5 DAY AS DATE)
              ELSE BillingPeriodEnd END AS BillingPeriodEnd,
         CASE WHEN BillingPeriodStart >= DATE '2001-10-01' OR BillingPeriodStart = DATE '1999-09-01'
              THEN 'Open' ELSE 'Closed' END AS BillingPeriodStatus,
         InvoiceIssuerName
  FROM bill WHERE BillingPeriodStart <> DATE '1996-03-01')"""

CONTRACTS = """
contract AS (
  SELECT CommitmentDiscountId AS ContractCommitmentId,
         'term of ' || CommitmentDiscountId AS ContractCommitmentDescription,
         CAST(coalesce(sum(BilledCost) FILTER (WHERE ChargeCategory = 'Purchase'), 0) AS DECIMAL(28,4))
           AS ContractCommitmentCost,
         BillingCurrency,
         CASE WHEN regexp_matches(CommitmentDiscountId, '[369]0$') THEN DATE '1994-01-01'
              ELSE DATE '1999-01-01' END AS ContractCommitmentPeriodStart,
         CASE WHEN regexp_matches(CommitmentDiscountId, '[369]0$') THEN DATE '2003-01-01'
              WHEN regexp_matches(CommitmentDiscountId, '[5]0$') THEN DATE '1999-01-08'
              ELSE DATE '2000-01-01' END AS ContractCommitmentPeriodEnd
  FROM bill WHERE CommitmentDiscountId LIKE '%0' GROUP BY CommitmentDiscountId, BillingCurrency)"""


EVERY_CONTRACT = CONTRACTS.replace("LIKE '%0' GROUP", "IS NOT NULL GROUP")


def over_bill(body: str, *companions: str, ctes: str = "") -> str:
    """A query text over the bill and any companion datasets."""
    parts = [bill_cte(), *companions]
    if ctes:
        parts.append(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body


def money(expression: str, digits: int = 2) -> str:
    return f"CAST(round({expression}, {digits}) AS DOUBLE)"


def ratio(numerator: str, denominator: str, digits: int = 1, scale: str = "100") -> str:
    """A display ratio: divide as doubles, then round as a decimal."""
    return (f"CAST(round(CAST({scale} * CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0) "
            f"AS DECIMAL(28,6)), {digits}) AS DOUBLE)")
