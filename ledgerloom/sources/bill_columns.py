"""Rules that turn the TPC-H-shaped driver tables into bill rows.

Each bill column is one SQL expression valid in Spark and in the comparison
engine alike, over the raw tables or over earlier columns.  The adapter only
joins the tables that the requested columns reach, so a question that needs no
part attributes never touches ``part``.
"""

from __future__ import annotations

import re

RAW = {
    "lineitem": """l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount
        l_returnflag l_linestatus l_shipdate""".split(),
    "orders": "o_orderkey o_custkey o_orderpriority".split(),
    "customer": "c_custkey c_nationkey c_mktsegment".split(),
    "nation": "n_nationkey n_regionkey n_name".split(),
    "region": "r_regionkey r_name".split(),
    "part": "p_partkey p_name p_brand p_type p_size".split(),
}
TABLE_OF = {column: table for table, columns in RAW.items() for column in columns}
# A table is reached through the ones before it.
REACHED_THROUGH = {
    "lineitem": [], "orders": [], "part": [],
    "customer": ["orders"], "nation": ["orders", "customer"],
    "region": ["orders", "customer", "nation"],
}
JOIN_KEYS = {
    "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"),
    "nation": ("c_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
    "part": ("l_partkey", "p_partkey"),
}


def _guid(m: str) -> str:
    """Text shaped like a GUID, from a digest column."""
    return (f"concat(substr({m}, 1, 8), '-', substr({m}, 9, 4), '-', substr({m}, 13, 4), '-', "
            f"substr({m}, 17, 4), '-', substr({m}, 21, 12))")


def _code(m: str) -> str:
    return (f"concat(substr({m}, 1, 4), '-', substr({m}, 5, 4), '-', substr({m}, 9, 3), '-', "
            f"substr({m}, 12, 3))")


_MONTH_START = "make_date(year({0}), month({0}), 1)"
# One reference to the date: filters on it are copied down to the scan as written.
_NEXT_MONTH = "CAST({0} + INTERVAL '1' MONTH AS DATE)"
_YM = ("concat(CAST(year({0}) AS STRING), '-', "
       "lpad(CAST(month({0}) AS STRING), 2, '0'))")

COLUMNS = {
    "k": "l_orderkey * 7 + l_linenumber",
    "x_ChargeId": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "ChargePeriodStart": "l_shipdate",
    "ChargePeriodEnd": """CASE WHEN k % 1009 = 3 THEN l_shipdate - INTERVAL '1' DAY
        WHEN k % 31 = 2 THEN l_shipdate + INTERVAL '1' HOUR
        ELSE l_shipdate + INTERVAL '1' DAY END""",
    "charge_month": _MONTH_START.format("l_shipdate"),
    "ChargeCategory": """CASE k % 97 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'Tax' WHEN 2 THEN 'Credit'
        WHEN 3 THEN 'Adjustment' ELSE 'Usage' END""",
    "ChargeClass": """CASE WHEN ChargeCategory = 'Usage' AND l_returnflag = 'R' AND k % 50 = 7
        THEN 'Correction' END""",
    "x_SchemaEra": """CASE WHEN year(l_shipdate) < 1997 THEN 'pre-1.2'
        WHEN year(l_shipdate) < 1999 THEN '1.0r2' ELSE '1.2' END""",
    "x_Synthetic": "l_linestatus = 'O'",
    "x_FixtureId": "concat('drop-', CAST(year(l_shipdate) AS STRING))",
    "BillingCurrency": "CASE WHEN r_name = 'EUROPE' THEN 'EUR' ELSE 'USD' END",
    "next_month": _NEXT_MONTH.format("charge_month"),
    "BillingPeriodStart": "CASE WHEN ChargeClass = 'Correction' THEN next_month ELSE charge_month END",
    "BillingPeriodEnd": _NEXT_MONTH.format("BillingPeriodStart"),
    "ListCost": "CAST(l_extendedprice AS DECIMAL(15,2))",
    "ContractedCost": "CAST(ListCost * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))",
    "CommitmentDiscountId": """CASE WHEN ChargeCategory IN ('Usage', 'Purchase') AND l_suppkey % 5 = 0
        THEN concat('/commitments/res-', CAST(l_suppkey AS STRING)) END""",
    "CommitmentDiscountStatus": """CASE WHEN ChargeCategory = 'Usage' AND CommitmentDiscountId IS NOT NULL
        THEN CASE WHEN k % 4 = 0 THEN 'Unused' ELSE 'Used' END END""",
    "PricingCategory": """CASE WHEN ChargeCategory IN ('Tax', 'Credit', 'Adjustment') THEN NULL
        WHEN CommitmentDiscountId IS NOT NULL THEN 'Committed'
        WHEN k % 11 = 0 THEN 'Dynamic' ELSE 'Standard' END""",
    "EffectiveCost": """CAST(CASE WHEN ChargeCategory = 'Purchase' THEN 0
        WHEN ChargeCategory IN ('Credit', 'Adjustment') OR ChargeClass = 'Correction' THEN -ContractedCost
        WHEN CommitmentDiscountStatus IS NOT NULL THEN ContractedCost * CAST(0.70 AS DECIMAL(3,2))
        ELSE ContractedCost END AS DECIMAL(18,4))""",
    "third_party": "k % 13 = 0",
    "BilledCost": """CAST(CASE WHEN third_party OR CommitmentDiscountStatus IS NOT NULL THEN 0
        WHEN ChargeCategory = 'Purchase' THEN ListCost ELSE EffectiveCost END AS DECIMAL(18,4))""",
    "ProviderName": "'Cloud Provider'",
    "InvoiceIssuerName": "'Cloud Provider'",
    "PublisherName": "CASE WHEN third_party THEN 'Third Party' ELSE 'Cloud Provider' END",
    "x_CommitmentEligible": """CASE WHEN ChargeCategory <> 'Usage' OR x_SchemaEra <> '1.2'
          OR (CommitmentDiscountStatus IS NOT NULL AND CommitmentDiscountStatus = 'Unused') THEN NULL
        WHEN PricingCategory = 'Committed' THEN true WHEN PricingCategory = 'Dynamic' THEN false
        ELSE p_type IN ('STANDARD', 'ECONOMY') END""",
    "team": "lower(c_mktsegment)",
    "Tags": """CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN NULL
        WHEN k % 2 = 0 THEN concat('{"team":"', team, '","env":"prod"}')
        ELSE concat('{"env":"prod","team":"', team, '"}') END""",
    "ResourceId": "CASE WHEN k % 8 <> 0 THEN concat('/res/', CAST(l_partkey AS STRING)) END",
    "ResourceName": "CASE WHEN k % 503 = 5 AND ResourceId IS NOT NULL THEN ResourceId ELSE p_name END",
    "ResourceType": "CASE WHEN ResourceId IS NOT NULL THEN p_type END",
    "InvoiceId": f"""CASE WHEN x_SchemaEra = '1.2' AND k % 3 <> 0
        THEN concat('INV-', {_YM.format('BillingPeriodStart')}, '-', BillingCurrency) END""",
    "x_InvoiceId": f"""CASE WHEN x_SchemaEra = 'pre-1.2'
        THEN concat('OLD-', {_YM.format('BillingPeriodStart')}) END""",
    "reference_invoice": f"""CASE WHEN InvoiceId IS NULL THEN NULL WHEN ChargeClass = 'Correction'
        THEN concat('INV-', {_YM.format('charge_month')}, '-', BillingCurrency) ELSE InvoiceId END""",
    "x_PricingBlockSize": "CAST(CASE p_type WHEN 'STANDARD' THEN 1000 WHEN 'ECONOMY' THEN 100 END AS DECIMAL(9,2))",
    "ConsumedQuantity": """CAST(CASE WHEN ChargeCategory = 'Usage' OR k % 397 = 0
        THEN l_quantity * 100 END AS DECIMAL(18,4))""",
    "ConsumedUnit": "CASE WHEN ChargeCategory = 'Usage' THEN 'Units' END",
    "PricingQuantity": """CAST(CASE WHEN ChargeCategory = 'Tax' THEN NULL
        WHEN p_type = 'STANDARD' THEN ceil(l_quantity / 10) ELSE l_quantity END AS DECIMAL(18,4))""",
    "PricingUnit": """CASE WHEN ChargeCategory = 'Tax' THEN NULL WHEN p_type = 'STANDARD' THEN '1K Units'
        WHEN p_type = 'ECONOMY' THEN '100 Units' ELSE 'Each' END""",
    "ListUnitPrice": """CAST(CASE WHEN k % 863 = 5 THEN -1 WHEN PricingQuantity IS NULL THEN NULL
        ELSE CAST(ListCost AS DOUBLE) / CAST(PricingQuantity AS DOUBLE)
             + CASE WHEN k % 41 = 5 THEN 0.5 ELSE 0 END END AS DECIMAL(20,10))""",
    "ContractedUnitPrice": """CAST(CASE WHEN k % 887 = 5 THEN -1 WHEN PricingQuantity IS NULL THEN NULL
        ELSE CAST(ContractedCost AS DOUBLE) / CAST(PricingQuantity AS DOUBLE)
             + CASE WHEN k % 43 = 5 THEN 0.5 ELSE 0 END END AS DECIMAL(20,10))""",
    "x_PricingCurrency": "CASE WHEN x_SchemaEra <> '1.2' THEN BillingCurrency END",
    "PricingCurrency": """CASE WHEN x_SchemaEra = '1.2' AND k % 71 <> 0
        THEN CASE WHEN k % 73 = 0 THEN 'AI Credits' ELSE BillingCurrency END END""",
    "PricingCurrencyEffectiveCost": "CASE WHEN x_SchemaEra = '1.2' AND k % 71 <> 0 THEN EffectiveCost END",
    "PricingCurrencyListUnitPrice": "CASE WHEN x_SchemaEra = '1.2' AND k % 71 <> 0 THEN ListUnitPrice END",
    "PricingCurrencyContractedUnitPrice": "CASE WHEN x_SchemaEra = '1.2' AND k % 71 <> 0 THEN ContractedUnitPrice END",
    "ServiceCategory": """CASE WHEN k % 607 = 5 THEN NULL ELSE CASE p_type WHEN 'STANDARD' THEN 'Compute'
        WHEN 'ECONOMY' THEN 'Storage' WHEN 'PROMO' THEN 'Databases' WHEN 'SMALL' THEN 'Networking'
        WHEN 'MEDIUM' THEN 'Analytics' ELSE 'Security' END END""",
    "ServiceSubcategory": """CASE WHEN x_SchemaEra <> '1.2' THEN NULL WHEN k % 223 = 5 THEN 'Mystery Service'
        WHEN k % 227 = 5 THEN '' WHEN k % 211 = 5 THEN 'Virtual Machines'
        ELSE CASE p_type WHEN 'STANDARD' THEN 'Virtual Machines' WHEN 'ECONOMY' THEN 'Object Storage'
        WHEN 'PROMO' THEN 'Relational Databases' WHEN 'SMALL' THEN 'Network Connectivity'
        WHEN 'MEDIUM' THEN 'Data Processing' ELSE 'Secret Management' END END""",
    "ServiceName": "concat(lower(p_type), ' service')",
    "ChargeDescription": "CASE WHEN k % 401 = 5 THEN NULL ELSE concat(p_brand, ' usage') END",
    "ChargeFrequency": """CASE WHEN k % 701 = 5 THEN 'Monthly' WHEN ChargeCategory = 'Usage' THEN 'Usage-Based'
        WHEN ChargeCategory = 'Purchase' AND k % 3 = 0 THEN 'Usage-Based' ELSE 'One-Time' END""",
    "CommitmentDiscountCategory": """CASE WHEN k % 409 = 5 THEN 'Money'
        WHEN CommitmentDiscountId IS NOT NULL THEN 'Usage' END""",
    "CommitmentDiscountType": """CASE WHEN CommitmentDiscountId IS NOT NULL AND k % 419 <> 5
        THEN 'Reservation' END""",
    "CommitmentDiscountName": """CASE WHEN CommitmentDiscountId IS NOT NULL THEN 'Reserved capacity'
        WHEN x_SchemaEra = '1.0r2' THEN '' END""",
    "CommitmentDiscountQuantity": """CASE WHEN CommitmentDiscountId IS NOT NULL AND x_SchemaEra = '1.2'
        AND k % 149 <> 5 THEN CAST(l_quantity AS DECIMAL(18,4)) END""",
    "CommitmentDiscountUnit": """CASE WHEN CommitmentDiscountId IS NOT NULL AND x_SchemaEra = '1.2'
        THEN 'Hours' END""",
    "CapacityReservationId": """CASE WHEN x_SchemaEra = '1.2' AND k % 19 = 5
        THEN concat('/capacity/', CAST(l_suppkey AS STRING)) END""",
    "CapacityReservationStatus": """CASE WHEN CapacityReservationId IS NOT NULL
        THEN CASE WHEN k % 2 = 0 THEN 'Used' ELSE 'Unused' END
        WHEN x_SchemaEra = '1.2' AND k % 331 = 5 THEN 'Used' END""",
    "AvailabilityZone": "CASE WHEN k % 6 = 0 THEN 'zone-1' END",
    "RegionId": "CASE WHEN k % 17 <> 0 THEN lower(r_name) END",
    "RegionName": "r_name",
    "SkuId": "CASE WHEN ChargeCategory <> 'Tax' OR k % 9 = 0 THEN concat('SKU-', p_brand) END",
    "SkuPriceId": "CASE WHEN ChargeCategory <> 'Tax' AND k % 433 <> 5 THEN concat(SkuId, '-', CAST(k % 5 AS STRING)) END",
    "SkuMeter": "CASE WHEN x_SchemaEra = '1.2' AND k % 439 <> 5 THEN concat(lower(p_type), ' meter') END",
    "x_SkuMeterName": "CASE WHEN x_SchemaEra <> '1.2' THEN concat(lower(p_type), ' meter') END",
    "sku_json": """CASE k % 10 WHEN 0 THEN concat('{"CoreCount":', CAST(p_size AS STRING), ',"InstanceType":"', p_type, '"}')
        WHEN 1 THEN concat('{"MemoryGB":', CAST(p_size AS STRING), ',"CoreCount":2}')
        WHEN 2 THEN '{"CoreCount":"two","x_Tier":"gold"}'
        WHEN 3 THEN '{"DiskType":7,"MemorySize":true}'
        WHEN 4 THEN '{oops'
        WHEN 5 THEN '{"Redundancy":"LRS","StorageClass":null,"color":"red"}' END""",
    "SkuPriceDetails": "CASE WHEN x_SchemaEra = '1.2' THEN sku_json END",
    "x_SkuDetails": "CASE WHEN x_SchemaEra <> '1.2' THEN sku_json END",
    "account_digest": "md5(concat('account-', CAST(c_nationkey AS STRING)))",
    "account_guid": _guid("account_digest"),
    "BillingAccountId": "concat('/billing/accounts/', account_guid)",
    "BillingAccountName": "n_name",
    "BillingAccountType": """CASE WHEN k % 457 = 5 THEN NULL WHEN x_SchemaEra <> '1.0r2' OR k % 9 = 0
        THEN 'Billing Profile' END""",
    "sub_digest": "md5(concat('sub-', c_mktsegment))",
    "sub_guid": _guid("sub_digest"),
    "SubAccountId": "CASE WHEN k % 29 <> 0 THEN concat('/sub/', sub_guid) END",
    "SubAccountName": "c_mktsegment",
    "SubAccountType": "CASE WHEN x_SchemaEra = '1.2' THEN 'Subscription' END",
    "x_ResourceGroupName": "CASE WHEN k % 2 = 0 THEN concat('RG-', c_mktsegment) ELSE lower(concat('RG-', c_mktsegment)) END",
    "profile_digest": "upper(md5(concat('profile-', CAST(c_nationkey AS STRING))))",
    "x_BillingProfileCode": _code("profile_digest"),
    "x_InvoiceSectionId": """concat('section ', x_BillingProfileCode, ' of ', account_guid)""",
    "x_BillingAccountName": "n_name",
    "x_CustomerName": "CASE WHEN k % 3 = 0 THEN concat('Owner of ', c_mktsegment) END",
    "x_CostCenter": "CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 5 = 1 THEN 'N/A' ELSE '' END",
    "x_BillingExchangeRate": "CASE WHEN BillingCurrency = 'EUR' THEN CAST(0.92 AS DECIMAL(9,4)) END",
}

# The columns a full bill carries, in a fixed order (helpers left out).
HELPERS = """k charge_month next_month third_party team account_digest account_guid sub_digest sub_guid
    profile_digest sku_json reference_invoice""".split()
FULL_BILL = [c for c in COLUMNS if c not in HELPERS]

# Columns of a full bill that are not text.
NOT_TEXT = """ChargePeriodStart ChargePeriodEnd x_Synthetic BillingPeriodStart BillingPeriodEnd ListCost ContractedCost
    EffectiveCost BilledCost x_CommitmentEligible x_PricingBlockSize ConsumedQuantity PricingQuantity ListUnitPrice
    ContractedUnitPrice PricingCurrencyEffectiveCost PricingCurrencyListUnitPrice PricingCurrencyContractedUnitPrice
    CommitmentDiscountQuantity x_BillingExchangeRate""".split()
TEXT_COLUMNS = [c for c in FULL_BILL if c not in NOT_TEXT]

_WORD = re.compile(r"'[^']*'|[A-Za-z_]\w*")


def _names(expression: str) -> list[str]:
    found = []
    for word in _WORD.findall(expression):
        if (word in COLUMNS or word in TABLE_OF) and word not in found:
            found.append(word)
    return found


DEPENDS = {column: [n for n in _names(rule) if n != column] for column, rule in COLUMNS.items()}


def closure(columns) -> set[str]:
    """Every derived and raw column the requested ones are built from."""
    wanted, pending = set(), list(columns)
    while pending:
        name = pending.pop()
        if name not in wanted:
            wanted.add(name)
            pending.extend(DEPENDS.get(name, []))
    return wanted


def levels(columns) -> list[list[str]]:
    """The derived columns in passes, each pass needing only earlier ones."""
    wanted = [c for c in COLUMNS if c in closure(columns)]
    depth: dict[str, int] = {}
    for column in wanted:
        depth[column] = 1 + max([depth[d] for d in DEPENDS[column] if d in depth], default=-1)
    return [[c for c in wanted if depth[c] == n] for n in range(max(depth.values(), default=-1) + 1)]


def late_levels(columns) -> list[list[str]]:
    """The same passes with each column as late as its first use allows, so that few are carried from pass to pass."""
    wanted = [c for c in COLUMNS if c in closure(columns)]
    height: dict[str, int] = {}
    for column in reversed(wanted):
        height[column] = 1 + max([height[c] for c in wanted if column in DEPENDS[c]], default=-1)
    return [[c for c in wanted if height[c] == n] for n in range(max(height.values(), default=-1), -1, -1)]


def tables_for(columns) -> list[str]:
    reached = {TABLE_OF[c] for c in closure(columns) if c in TABLE_OF}
    for table in list(reached):
        reached.update(REACHED_THROUGH[table])
    return [t for t in JOIN_KEYS if t in reached]
