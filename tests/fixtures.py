"""Clean and broken bill rows with known answers, built with createDataFrame.

Fixed values: amounts, dates, ids and labels below restate the published
fixture set so the published results can be asserted.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from decimal import Decimal

from ledgerloom import schema

JULY = (datetime(2026, 7, 1), datetime(2026, 8, 1))
MARCH24 = (datetime(2024, 3, 1), datetime(2024, 4, 1))
TAGS = json.dumps({"team": "platform", "environment": "production"})
MONTHLY = "/commitments/res-basv2-1yr-001"
UPFRONT = "/commitments/res-basv2-3yr-upfront-001"
LEGACY = "/commitments/res-basv2-legacy-2023"
VM, STORE = "/res/vm-web-01", "/res/stp1sandbox"
MONEY = {f.name for f in schema.current_schema().fields if f.dataType == schema.MONEY}

ACCOUNT = dict(
    BillingAccountId="/billing/2", BillingAccountName="Sandbox", BillingAccountType="Billing Profile",
    SubAccountId="/sub/1", SubAccountName="Sub 1", SubAccountType="Subscription", BillingCurrency="USD",
    ProviderName="Cloud Provider", PublisherName="Cloud Provider", InvoiceIssuerName="Cloud Provider")
KIND = {
    "vm": ("Virtual Machines", "Compute", "Virtual Machines"),
    "storage": ("Storage Accounts", "Storage", "Object Storage"),
    "network": ("Virtual Network", "Networking", "Network Connectivity"),
    "web": ("App Service", "Web", "Application Platforms"),
    "ai": ("Inference Service", "AI and Machine Learning", "Generative AI"),
    "tax": ("Tax", "Other", "Other (Other)"),
    "market": ("Marketplace Security Appliance", "Security", "Threat Detection and Response"),
}
REGION = dict(RegionId="za-north", RegionName="South Africa North")


def row(kind, start, cost, *, end=None, hours=None, price=None, unit="Hours", consumed="same", contracted=None,
        listed=None, billed=None, category="Usage", frequency="Usage-Based", pricing="Standard", sku="SKU-1",
        resource=None, name=None, tags=TAGS, eligible=None, period=JULY, **extra):
    """One charge; prices and quantities may be left out for flat amounts."""
    service, family, sub = KIND[kind]
    cost = Decimal(str(cost))
    values = dict(
        ACCOUNT, ServiceName=service, ServiceCategory=family, ServiceSubcategory=sub, ChargeCategory=category,
        ChargeFrequency=frequency, ChargePeriodStart=start, ChargePeriodEnd=end or start + timedelta(days=1),
        BillingPeriodStart=period[0], BillingPeriodEnd=period[1], EffectiveCost=cost,
        BilledCost=cost if billed is None else billed, ContractedCost=cost if contracted is None else contracted,
        ListCost=cost if listed is None else listed, ChargeDescription=extra.pop("text", "charge"),
        ResourceId=resource, ResourceName=name, ResourceType="thing" if resource else None,
        Tags=tags, x_CommitmentEligible=eligible, x_Synthetic=True, x_SchemaEra="1.2", x_FixtureId="clean")
    if hours is not None:
        values.update(PricingCategory=pricing, SkuId=sku, SkuPriceId=sku + "/1", SkuMeter="meter",
                      ListUnitPrice=price, ContractedUnitPrice=extra.pop("contracted_price", price),
                      PricingQuantity=hours, PricingUnit=unit)
        if category == "Usage" and consumed is not None:
            values.update(ConsumedQuantity=hours if consumed == "same" else consumed,
                          ConsumedUnit=extra.pop("consumed_unit", unit))
    values.update(extra)
    values.setdefault("PricingCurrency", values["BillingCurrency"])
    values.setdefault("PricingCurrencyEffectiveCost", values["EffectiveCost"])
    values.setdefault("PricingCurrencyListUnitPrice", values.get("ListUnitPrice"))
    values.setdefault("PricingCurrencyContractedUnitPrice", values.get("ContractedUnitPrice"))
    return values


def day(n, month=7):
    return datetime(2026, month, n)


def _commitment(identity, status=None, quantity=None):
    return dict(CommitmentDiscountId=identity, CommitmentDiscountName="reserved", CommitmentDiscountCategory="Usage",
                CommitmentDiscountType="Reserved Instance", CommitmentDiscountStatus=status,
                CommitmentDiscountQuantity=quantity, CommitmentDiscountUnit="Hours")


def reservation():
    """744 h bought at 0.10; 31 Used days (24 h for ten, then 18 h) and 21 Unused of 6 h."""
    rows = [row("vm", day(1), 0, hours=744, price="0.10", billed="74.40", listed="74.40", contracted="74.40",
                category="Purchase", frequency="Recurring", text="purchase", **REGION, **_commitment(MONTHLY, None, 744))]
    for n in range(1, 32):
        used = 24 if n <= 10 else 18
        rate, list_rate = Decimal("0.10"), Decimal("0.15")
        rows.append(row("vm", day(n), rate * used, hours=used, price="0.15", billed=0, listed=list_rate * used,
                        contracted=list_rate * used, pricing="Committed", resource=VM, name="vm-web-01", eligible=True,
                        x_ResourceGroupName="rg-1", **REGION, **_commitment(MONTHLY, "Used", used)))
        if used < 24:
            spare = 24 - used
            rows.append(row("vm", day(n), rate * spare, hours=spare, price="0.10", billed=0, consumed=None,
                            pricing="Committed", **REGION, **_commitment(MONTHLY, "Unused", spare)))
    return rows


def charges():
    last = day(31)
    return [
        row("tax", last, "11.16", category="Tax", frequency="One-Time", tags=None),
        row("tax", last, "-25.00", category="Credit", frequency="One-Time", tags=None),
        row("vm", last, "-3.72", category="Adjustment", frequency="One-Time", resource=VM, name="vm-web-01", **REGION),
        row("storage", day(14, 6), "-1.85", ChargeClass="Correction", InvoiceId="INV-2026-07-0001", eligible=False,
            resource=STORE, name="stp1sandbox", **REGION),
        row("network", day(18), "-0.42", hours="-2.8", price="0.15", unit="GB", eligible=False, tags=None, **REGION),
    ]


def pricing():
    rows = []
    for n, used, blocks in ((20, 500, 1), (21, 1500, 2)):
        rows.append(row("storage", day(n), Decimal("0.05") * blocks, hours=blocks, price="0.05", unit="1K Operations",
                        consumed=used, consumed_unit="Operations", x_PricingBlockSize=1000, eligible=False,
                        resource=STORE, name="stp1sandbox", text="Storage write operations, billed per 1K block", **REGION))
    rows.append(row("ai", day(22), "3.00", hours="1.5", price="2", unit="1M Tokens", consumed=1500000,
                    consumed_unit="Tokens", eligible=False, PricingCurrency="AI Credits", PricingCurrencyEffectiveCost=300,
                    PricingCurrencyListUnitPrice=200, PricingCurrencyContractedUnitPrice=200, x_TokenCount=1500000,
                    resource="/res/aoai", name="aoai-p1-sandbox", text="Generative AI inference, 1M-token pricing", **REGION))
    for n in (23, 24):
        rows.append(row("vm", day(n), "3.312", hours=24, price="0.138", eligible=True, BillingCurrency="EUR",
                        PricingCurrency="USD", PricingCurrencyEffectiveCost="3.60", PricingCurrencyListUnitPrice="0.15",
                        PricingCurrencyContractedUnitPrice="0.15", x_BillingExchangeRate="0.92", resource="/res/eu",
                        name="vm-web-eu-01", **REGION))
    rows.append(row("vm", day(25), "1.08", hours=24, price="0.15", contracted_price="0.045", listed="3.60",
                    contracted="1.08", pricing="Dynamic", eligible=False, resource="/res/spot", name="vm-batch-spot-01", **REGION))
    rows.append(row("market", day(26), "18.00", hours=1, price="18", unit="Licences", billed=0, pricing="Other",
                    frequency="Recurring", eligible=False, PublisherName="Fortifex Security Ltd", resource="/res/fx",
                    name="fx-appliance-01", text="Third-party security appliance licence, monthly", **REGION))
    return rows


def resources():
    full = json.dumps({"CoreCount": 2, "DiskSpace": 32, "DiskType": "SSD", "GpuCount": 0, "InstanceSeries": "Basv2",
                       "InstanceType": "B2ats_v2", "MemorySize": 1, "NetworkMaxIops": 4000, "NetworkMaxThroughput": 6250,
                       "OperatingSystem": "Linux", "x_AcceleratedNetworking": False})
    disk = json.dumps({"DiskMaxIops": 120, "DiskSpace": 32, "DiskType": "SSD", "Redundancy": "Local", "StorageClass": "Premium"})
    vm = dict(hours=24, price="0.15", eligible=True, resource=VM, **REGION)
    rows = [
        row("vm", day(27), "3.60", name="vm-web-01", SkuPriceDetails=full, AvailabilityZone="az1", x_ResourceGroupName="rg-1", **vm),
        row("storage", day(27), "0.62", hours=31, price="0.02", unit="GiB", SkuPriceDetails=disk, eligible=False,
            resource="/res/disk", name="vm-web-01-osdisk", **REGION),
        row("network", day(28), "0.05", hours=1, price="0.05", unit="Units", eligible=False, resource="/res/nic",
            tags=None, **REGION),
        row("vm", day(29), "3.60", name="vm-web-01", x_ResourceGroupName="rg-1", **vm),
        row("vm", day(30), "3.60", name="vm-web-prod-01", x_ResourceGroupName="RG-1", SubAccountName="Production", **vm),
    ]
    for status, hours in (("Used", 20), ("Unused", 4)):
        used = status == "Used"
        cost = Decimal("0.10") * hours
        rows.append(row("vm", day(31), cost, hours=hours, price="0.15", contracted_price="0.10", billed=0,
                        listed=Decimal("0.15") * hours, contracted=cost, pricing="Committed",
                        consumed="same" if used else None, eligible=True if used else None,
                        resource=VM if used else None, name="vm-web-01" if used else None, tags=TAGS if used else None,
                        CapacityReservationId="/capacity/1", CapacityReservationStatus=status, **REGION,
                        **_commitment(UPFRONT, status, hours)))
    rows.append(row("vm", day(31), 0, hours=26280, price="0.10", billed="2628.00", listed="2628.00", contracted="2628.00",
                    category="Purchase", frequency="One-Time", tags=None, **REGION, **_commitment(UPFRONT, None, 26280)))
    rows.append(row("storage", day(31), "0.31", hours=31, price="0.01", unit="GiB", eligible=False, resource=STORE,
                    name="stp1sandbox", **REGION))
    for n, invoice in ((28, "INV-2026-07-0001"), (31, None)):
        rows.append(row("web", day(n), "0.24", hours=24, price="0.01", eligible=False, InvoiceId=invoice,
                        resource="/res/asp", name="asp-p1-sandbox", **REGION))
    return rows


def legacy():
    shared = dict(period=MARCH24, x_SchemaEra="pre-1.2", x_InvoiceId="INV-2024-03-0001", x_PricingCurrency="USD",
                  x_SkuMeterName="old meter", x_SkuDetails='{"CoreCount":2}', **REGION)
    at = datetime(2024, 3, 14)
    rows = [row("vm", at.replace(hour=h), "0.15", end=at.replace(hour=h + 1), hours=1, price="0.15", resource=VM,
                name="vm-web-01", **shared) for h in range(8, 16)]
    rows.append(row("storage", at, "0.24", hours=24, price="0.01", unit="GiB", resource=STORE, name="stp1sandbox", **shared))
    rows.append(row("vm", at.replace(hour=16), "0.10", end=at.replace(hour=17), hours=1, price="0.15",
                    contracted_price="0.10", billed=0, listed="0.15", contracted="0.10", pricing="Committed",
                    resource=VM, name="vm-web-01", **shared, **_commitment(LEGACY, "Used")))
    return rows


def _typed(values, fields):
    made = []
    for field in fields:
        value = values.get(field.name)
        made.append(Decimal(str(value)) if field.dataType == schema.MONEY and value is not None else value)
    return tuple(made)


def current_layer(spark):
    fields = schema.current_schema().fields
    rows = reservation() + charges() + pricing() + resources()
    return spark.createDataFrame([_typed(r, fields) for r in rows], schema.current_schema())


def legacy_layer(spark):
    fields = schema.legacy_schema().fields
    return spark.createDataFrame([_typed(r, fields) for r in legacy()], schema.legacy_schema())


def _valid(**changes):
    values = row("vm", day(15), "3.60", hours=24, price="0.15", resource=VM, name="vm-web-01", **REGION)
    values.update(changes)
    return values


BROKEN = {
    "NULL_IN_MANDATORY_COLUMN": dict(ServiceCategory=None),
    "EMPTY_STRING_PLACEHOLDER": dict(ServiceSubcategory=""),
    "INVALID_ENUM_VALUE": dict(ChargeCategory="Consumption", ConsumedQuantity=None, ConsumedUnit=None),
    "INVALID_CHARGECLASS_VALUE": dict(ChargeClass="Adjustment"),
    "SATELLITE_WITHOUT_ANCHOR": dict(ResourceId=None, ResourceType=None),
    "TAX_WITH_PRICING_CATEGORY": dict(
        ChargeCategory="Tax", ChargeFrequency="One-Time", ServiceName="Tax", ServiceCategory="Other",
        ServiceSubcategory="Other (Other)", ConsumedQuantity=None, ConsumedUnit=None, PricingQuantity=None,
        PricingUnit=None, ContractedUnitPrice=None, ListUnitPrice=None, PricingCurrencyContractedUnitPrice=None,
        PricingCurrencyListUnitPrice=None, SkuId=None, SkuPriceId=None, SkuMeter=None),
    "PURCHASE_WITH_USAGE_BASED_FREQUENCY": dict(
        ChargeCategory="Purchase", EffectiveCost=0, ConsumedQuantity=None, ConsumedUnit=None),
    "NEGATIVE_UNIT_PRICE": dict(ListUnitPrice="-0.15", ListCost="-3.60"),
    "UNIT_PRICE_COST_MISMATCH": dict(ContractedCost="9.99"),
    "ORPHAN_COMMITMENT_STATUS": dict(CommitmentDiscountStatus="Used"),
    "ORPHAN_CAPACITY_RESERVATION_STATUS": dict(CapacityReservationStatus="Used"),
    "SKU_PRICE_DETAILS_BAD_KEYS": dict(SkuPriceDetails='{"MemoryGB":1,"AcceleratedNetworking":false,"CoreCount":2}'),
    "CURRENCY_NOT_ISO_4217": dict(BillingCurrency="US Dollars", PricingCurrency="US Dollars"),
    "CHARGE_PERIOD_INVERTED": dict(ChargePeriodStart=day(16), ChargePeriodEnd=day(15)),
}
EXPECTED_CHECK = {
    "NULL_IN_MANDATORY_COLUMN": "NULL-ServiceCategory",
    "EMPTY_STRING_PLACEHOLDER": "EMPTY-STRING",
    "INVALID_ENUM_VALUE": "AV-ChargeCategory",
    "INVALID_CHARGECLASS_VALUE": "XCOL-ChargeClass",
    "SATELLITE_WITHOUT_ANCHOR": "NULL-ResourceName",
    "TAX_WITH_PRICING_CATEGORY": "NULL-PricingCategory",
    "PURCHASE_WITH_USAGE_BASED_FREQUENCY": "XCOL-ChargeFrequency",
    "NEGATIVE_UNIT_PRICE": "METRIC-nonneg-ListUnitPrice",
    "UNIT_PRICE_COST_MISMATCH": "METRIC-product-ContractedCost",
    "ORPHAN_COMMITMENT_STATUS": "NULL-CommitmentDiscountStatus",
    "ORPHAN_CAPACITY_RESERVATION_STATUS": "NULL-CapacityReservationStatus",
    "SKU_PRICE_DETAILS_BAD_KEYS": "SKU-key-prefix",
    "CURRENCY_NOT_ISO_4217": "FMT-ISO4217-BillingCurrency",
    "CHARGE_PERIOD_INVERTED": "PERIOD-ordering",
}


def negative_layer(spark):
    fields = schema.negative_schema().fields
    rows = [_typed(dict(_valid(**changes), x_ExpectedViolation=label, x_ViolationDetail=label), fields)
            for label, changes in BROKEN.items()]
    return spark.createDataFrame(rows, schema.negative_schema())


def periods(spark, without=(), reopened=()):
    known = [(date(2024, 3, 1), date(2024, 4, 1), "Closed"), (date(2026, 6, 1), date(2026, 7, 1), "Closed"),
             (date(2026, 7, 1), date(2026, 8, 1), "Open")]
    rows = [(s, e, "Open" if s in reopened else status, "Cloud Provider") for s, e, status in known if s not in without]
    return spark.createDataFrame(rows, "BillingPeriodStart date, BillingPeriodEnd date, BillingPeriodStatus string, "
                                       "InvoiceIssuerName string")


def invoices(spark):
    rows = [("INV-2026-07-0001", "INV-2026-07-0001", "USD", Decimal("0.24"), "Usage", "Issued"),
            ("INV-2026-07-0001", "INV-2026-06-0001", "USD", Decimal("-1.85"), "Usage", "Issued")]
    return spark.createDataFrame(rows, "InvoiceId string, ReferenceInvoiceId string, BillingCurrency string, "
                                       "BilledCost decimal(18,2), ChargeCategory string, InvoiceIssueStatus string")


def contracts(spark):
    rows = [(MONTHLY, "monthly", Decimal("74.40"), "USD", date(2026, 7, 1), date(2026, 8, 1)),
            (UPFRONT, "upfront", Decimal("2628.00"), "USD", date(2026, 7, 31), date(2029, 7, 31))]
    return spark.createDataFrame(
        rows, "ContractCommitmentId string, ContractCommitmentDescription string, ContractCommitmentCost decimal(18,2), "
              "BillingCurrency string, ContractCommitmentPeriodStart date, ContractCommitmentPeriodEnd date")
