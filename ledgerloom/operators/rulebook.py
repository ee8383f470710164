"""The rule catalogue: which sentence each check implements and how strong it is.

A rule cites a sentence; its severity is the strongest keyword of that sentence
unless the rule says why it is reported lower.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from ledgerloom import schema
from ledgerloom.operators.conditions import columns_in, describe

FAIL, WARN, INFO = "FAIL", "WARN", "INFO"


@dataclass(frozen=True)
class NullRule:
    """A column that must, or must not, be null, perhaps only under a condition."""

    column: str
    must_be_null: bool
    condition: tuple | None = None
    severity: str = FAIL
    dataset: str = "cost_and_usage"

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([self.column, *columns_in(self.condition)]))

    @property
    def sentence(self) -> str:
        verb = ("MUST" if self.severity == FAIL else "SHOULD") + ("" if self.must_be_null else " NOT")
        when = f" when {describe(self.condition)}" if self.condition else ""
        return f"{self.column} {verb} be null{when}"


PRICED = ("and", ("eq", "ChargeCategory", "Usage", "Purchase"), ("ne", "ChargeClass", "Correction"))
COMMITTED = ("and", ("eq", "ChargeCategory", "Usage", "Purchase"), ("not_null", "CommitmentDiscountId"))
TAX = ("eq", "ChargeCategory", "Tax")

FOLLOWS = {
    "ResourceId": ["ResourceName", "ResourceType"],
    "CommitmentDiscountId": ["CommitmentDiscountStatus", "CommitmentDiscountCategory", "CommitmentDiscountType"],
    "SubAccountId": ["SubAccountName", "SubAccountType"],
    "CapacityReservationId": ["CapacityReservationStatus"],
    "SkuPriceId": ["SkuPriceDetails"],
    "RegionId": ["RegionName"],
}
EMPTY_FOR_TAX = "PricingCategory SkuId SkuPriceId PricingQuantity ListUnitPrice ContractedUnitPrice".split()

NULL_RULES = (
    [NullRule(c, False) for c in schema.MANDATORY + ["PricingCurrency", "PricingCurrencyEffectiveCost"]]
    + [NullRule(c, True, ("null", anchor)) for anchor, followers in FOLLOWS.items() for c in followers]
    + [NullRule(c, True, TAX) for c in EMPTY_FOR_TAX]
    + [
        NullRule("ConsumedQuantity", True, ("ne", "ChargeCategory", "Usage")),
        NullRule("CommitmentDiscountCategory", False, ("not_null", "CommitmentDiscountId")),
        NullRule("CommitmentDiscountType", False, ("not_null", "CommitmentDiscountId")),
        NullRule("CommitmentDiscountStatus", False,
                 ("and", ("not_null", "CommitmentDiscountId"), ("eq", "ChargeCategory", "Usage"))),
        NullRule("SkuPriceId", False, PRICED),
        NullRule("PricingCurrencyListUnitPrice", False, PRICED),
        NullRule("PricingCurrencyContractedUnitPrice", False, PRICED),
        NullRule("CommitmentDiscountQuantity", False, ("and", COMMITTED, ("ne", "ChargeClass", "Correction"))),
        NullRule("CommitmentDiscountQuantity", True, ("not", COMMITTED)),
        NullRule("ChargeDescription", False, None, WARN),
        NullRule("SkuMeter", False, ("not_null", "SkuId"), WARN),
    ]
)


def null_check_ids(rules: list[NullRule]) -> list[str]:
    """Stable ids: column, direction, strength, and a place among the column's own rules."""
    seen: Counter = Counter()
    ids = []
    for rule in rules:
        seen[rule.column] += 1
        kind = ("null" if rule.must_be_null else "notnull") + ("" if rule.severity == FAIL else "-should")
        ids.append(f"NULL-{rule.column}-{kind}{seen[rule.column]}")
    return ids


@dataclass(frozen=True)
class Refused:
    """A stated rule no check can evaluate, because the row lacks the deciding fact."""

    column: str
    sentence: str
    reason: str


_UNKNOWN = "condition turns on a fact the row does not carry"
_MIXED = "condition joins a checkable term with a fact the row does not carry"
REFUSED = [Refused(c, s, r) for c, s, r in [
    ("AvailabilityZone", "MUST be null when a charge is not specific to an availability zone", _UNKNOWN),
    ("BillingAccountName", "MUST NOT be null when the provider supports assigning a display name", _UNKNOWN),
    ("CapacityReservationId", "MUST be null when a charge is not related to a capacity reservation", _UNKNOWN),
    ("CapacityReservationId", "MUST NOT be null when a charge is the unused part of a reservation", _UNKNOWN),
    ("CapacityReservationId", "SHOULD NOT be null when a charge is related to a capacity reservation", _UNKNOWN),
    ("ChargeClass", "MUST be null when the row does not represent a correction", _MIXED),
    ("ChargeClass", "MUST NOT be null when the row corrects a previously invoiced period", _UNKNOWN),
    ("CommitmentDiscountId", "MUST be null when a charge is not related to a commitment discount", _UNKNOWN),
    ("CommitmentDiscountId", "MUST NOT be null when a charge is related to a commitment discount", _UNKNOWN),
    ("CommitmentDiscountName", "MUST NOT be null when a display name can be assigned", _UNKNOWN),
    ("InvoiceId", "MUST be null when the charge is not associated with an invoice", _UNKNOWN),
    ("InvoiceId", "MUST NOT be null when the charge is associated with an invoice", _UNKNOWN),
    ("RegionId", "MUST NOT be null when operated in or managed from a distinct region", _UNKNOWN),
    ("ResourceId", "MUST be null when a charge is not related to a resource", _UNKNOWN),
    ("ResourceId", "MUST NOT be null when a charge is related to a resource", _UNKNOWN),
    ("ResourceName", "MUST NOT be null when the resource has an assigned display name", _MIXED),
    ("SubAccountId", "MUST be null when a charge is not related to a sub account", _UNKNOWN),
    ("SubAccountId", "MUST NOT be null when a charge is related to a sub account", _UNKNOWN),
]]

NON_NEGATIVE = """ListUnitPrice ContractedUnitPrice PricingCurrencyListUnitPrice
    PricingCurrencyContractedUnitPrice""".split()
PRODUCTS = [("ListUnitPrice", "PricingQuantity", "ListCost"),
            ("ContractedUnitPrice", "PricingQuantity", "ContractedCost")]
PRODUCT_TOLERANCE = "0.000001"

# Companion datasets: what each must carry and which values it may hold.
COMPANION_RULES = {
    "billing_period": {
        "required": """BillingPeriodStart BillingPeriodEnd BillingPeriodStatus InvoiceIssuerName
            BillingPeriodCreated BillingPeriodLastUpdated""".split(),
        "allowed": {"BillingPeriodStatus": ["Open", "Closed"]},
    },
    "invoice_detail": {
        "required": """InvoiceDetailId InvoiceId InvoiceIssuerName BillingCurrency BilledCost ChargeCategory
            BillingPeriodStart BillingPeriodEnd InvoiceIssueStatus""".split(),
        "allowed": {"ChargeCategory": schema.ALLOWED_VALUES["ChargeCategory"]},
    },
    "contract_commitment": {
        "required": """ContractId ContractCommitmentId ContractCommitmentCost BillingCurrency
            ServiceProviderName ContractCommitmentPeriodStart ContractCommitmentPeriodEnd""".split(),
        "allowed": {},
    },
}
