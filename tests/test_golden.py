"""Published answers on the clean fixture rows (the rows that can be rebuilt)."""

from decimal import Decimal

import fixtures as fx
import pytest

from ledgerloom.functions.columns import Span
from ledgerloom.operators import coverage, derive, inventory, reconcile
from ledgerloom.operators.normalise import unify
from ledgerloom.plans import questions as Q

JULY = Span("2026-07-01", "2026-08-01")


@pytest.fixture(scope="module")
def bill(spark):
    return unify([fx.current_layer(spark), fx.legacy_layer(spark)]).cache()


def found(frame, *key):
    return {tuple(r[k] for k in key): r for r in frame.collect()}


def close(value, expected):
    return value is not None and abs(Decimal(value) - Decimal(str(expected))) < Decimal("0.000001")


def test_layers_have_published_shape(spark, bill):
    assert fx.current_layer(spark).count() == 76 and fx.legacy_layer(spark).count() == 10
    assert bill.count() == 86


def test_showback(bill):
    rows = found(Q.showback_by_team(bill, JULY), "team", "BillingCurrency")
    assert rows["platform", "EUR"]["row_count"] == 2
    assert close(rows["platform", "EUR"]["effective_cost_consumption"], "6.62")


def test_reconciling_items(bill):
    rows = found(Q.reconciling_items(bill, JULY), "ChargeCategory")
    assert close(rows["Purchase",]["billed_cost_cash"], "2702.40") and rows["Purchase",]["row_count"] == 2
    for category, amount in (("Tax", "11.16"), ("Adjustment", "-3.72"), ("Credit", "-25.00")):
        assert close(rows[category,]["billed_cost_cash"], amount)


def test_completeness_ties_out(bill):
    rows = found(Q.completeness_tie_out(bill, JULY), "panel", "BillingCurrency")
    total = rows["GRAND TOTAL (= sum of the two above)", "USD"]
    parts = [rows["usage side", "USD"], rows["reconciling side", "USD"]]
    assert total["row_count"] == sum(p["row_count"] for p in parts)
    assert close(total["billed_cost_cash"], sum(p["billed_cost_cash"] for p in parts))
    assert close(rows["reconciling side", "USD"]["billed_cost_cash"], "2684.84")


def test_bridge_is_the_correction(bill):
    row, = Q.scope_bridge(bill, JULY).collect()
    assert str(row["charge_period_start"]) == "2026-06-14" and row["ResourceName"] == "stp1sandbox"
    assert row["ChargeClass"] == "Correction" and close(row["billed_cost_cash"], "-1.85")


def test_out_of_scope(bill):
    rows = found(Q.out_of_scope_panel(bill, JULY), "metric", "BillingCurrency")
    assert rows["EffectiveCost", "USD"]["row_count"] == 68
    assert close(rows["EffectiveCost", "USD"]["amount"], "110.87")
    assert close(rows["EffectiveCost", "EUR"]["amount"], "6.62")
    assert close(rows["BilledCost", "USD"]["amount"], "2684.84")


def test_incident(bill):
    rows = found(Q.anomaly_incident(bill, JULY, times=7), "resource_name")
    row = rows["fx-appliance-01",]
    assert str(row["first_seen"]) == str(row["last_seen"]) == "2026-07-26" and row["days_active"] == 1
    assert close(row["effective_cost_total"], 18) and close(row["billed_cost_cash_total"], 0)
    assert row["team"] == "platform" and row["service_category"] == "Security"


def test_top_anomaly(bill):
    top = Q.anomaly_detection(bill, JULY).collect()
    assert len(top) == 10 and top[0]["resource_name"] == "fx-appliance-01"


def test_savings(bill):
    ladder = found(Q.savings_ladder(bill, JULY), "rung", "BillingCurrency")
    one, two = ladder["1. negotiation", "USD"], ladder["2. commitment", "USD"]
    head = ladder["3. HEADLINE (= rung 1 + rung 2)", "USD"]
    assert close(one["saving"] + two["saving"], head["saving"])
    assert close(two["saving"], "30.90") and close(one["saving"], "3.72")
    covered = found(Q.savings_by_coverage(bill, JULY), "coverage", "BillingCurrency")["commitment-covered", "USD"]
    assert covered["row_count"] == 54 and close(covered["commitment_saving"], "30.90")


def test_block_waste(bill):
    rows = found(Q.block_pricing_waste(bill, JULY), "ChargeDescription")
    waste = rows["Storage write operations, billed per 1K block",]
    assert waste["verdict"] == "BLOCK ROUNDING WASTE"
    assert close(waste["waste_blocks"], 1) and close(waste["waste_cost_effective"], "0.05")
    assert close(waste["block_utilisation_pct"], "66.7")
    tokens = rows["Generative AI inference, 1M-token pricing",]
    assert tokens["consumed_in_pricing_units"] is None and "not assessable" in tokens["verdict"]


def test_utilisation(spark, bill):
    rows = found(Q.commitment_utilisation(bill, fx.contracts(spark)), "commitment")
    assert rows["res-basv2-1yr-001",]["verdict"].startswith("utilisation 83.1% of term")
    assert "1 of 1096 term days" in rows["res-basv2-3yr-upfront-001",]["verdict"]
    assert rows["res-basv2-legacy-2023",]["verdict"].startswith("TERM UNKNOWN")


def test_invoice_ties(spark, bill):
    row, = reconcile.invoice_tie_out(bill, fx.invoices(spark)).collect()
    assert row["Verdict"] == "TIES TO THE CENT" and row["CU_Rows"] == row["InvoiceLines"] == 2
    assert close(row["InvoiceTotal"], "-1.61") and close(row["CostUsageBilled"], "-1.61")


def test_orphans_empty_is_the_pass(spark, bill):
    assert reconcile.invoice_orphans(bill, fx.invoices(spark)).count() == 0


def test_panels(bill):
    rows = found(reconcile.reconciling_panels(bill), "ReconcilingPanel", "BillingCurrency")
    amounts = {k[0][0] + k[1]: (r["Rows"], r["BilledCost"]) for k, r in rows.items()}
    assert amounts["1USD"][0] == 2 and close(amounts["1USD"][1], "-1.61")
    assert amounts["2USD"][0] == 10 and close(amounts["2USD"][1], "1.44")
    assert amounts["3USD"][0] == 3 and close(amounts["3USD"][1], "-17.56")
    assert amounts["4USD"][0] == 2 and close(amounts["4USD"][1], "2702.40")


@pytest.mark.parametrize("zone", ["UTC", "Africa/Johannesburg", "Australia/Sydney", "America/New_York"])
def test_periods_do_not_depend_on_the_zone(spark, bill, zone):
    previous = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = found(reconcile.period_match(bill, fx.periods(spark)), "PeriodStart")
        assert rows["2024-03-01",]["Verdict"] == "MATCHED" and rows["2024-03-01",]["CU_Rows"] == 10
        assert rows["2026-07-01",]["PeriodStatus"] == "Open"
        row, = reconcile.correction_discipline(bill, fx.invoices(spark), fx.periods(spark)).collect()
        assert row["Verdict"].startswith("PASS") and row["ReferenceInvoiceId"] == "INV-2026-06-0001"
        assert row["ConsumptionDate"] == "2026-06-14" and row["BilledInPeriod"] == "2026-07"
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)


def test_coverage(bill):
    rows = found(coverage.coverage_of_coverable(bill), "BillingCurrency")
    assert close(rows["USD",]["covered_eligible"], "63.80") and close(rows["USD",]["total_eligible"], "74.60")
    assert close(rows["USD",]["coverage_of_coverable_pct"], "85.5")
    assert close(rows["EUR",]["coverage_of_coverable_pct"], 0)
    actions = found(coverage.uncovered_action_list(bill), "BillingCurrency")
    assert actions["EUR",]["rows_"] == 2 and actions["USD",]["rows_"] == 3
    assert close(actions["USD",]["uncovered_eligible_effective"], "10.80")


def test_eligibility_buckets(bill):
    rows = {(k[0][0], k[1]): (r["rows_"], r["effective_cost"]) for k, r in
            found(coverage.eligibility_universe(bill), "eligibility_bucket", "BillingCurrency").items()}
    expected = {("1", "EUR"): (2, "6.62"), ("1", "USD"): (35, "74.60"), ("2", "USD"): (12, "21.42"),
                ("3", "USD"): (22, "13.00"), ("4", "USD"): (5, "-17.56"), ("5", "USD"): (10, "1.54")}
    assert set(rows) == set(expected)
    for key, (count, amount) in expected.items():
        assert rows[key][0] == count and close(rows[key][1], amount), key


def test_term_closure_and_unused(spark, bill):
    rows = {k[0].rsplit("/", 1)[1]: r for k, r in found(
        coverage.term_closure(bill, fx.contracts(spark)), "CommitmentDiscountId").items()}
    assert rows["res-basv2-1yr-001"]["verdict"].startswith("CLOSES EXACTLY")
    assert rows["res-basv2-3yr-upfront-001"]["verdict"].startswith("IN PROGRESS")
    assert rows["res-basv2-legacy-2023"]["verdict"].startswith("ORPHAN")
    used = {r["CommitmentDiscountId"].rsplit("/", 1)[1]: r["utilisation_pct"]
            for r in coverage.unused_commitment(bill).collect()}
    assert [close(used[k], v) for k, v in (("res-basv2-1yr-001", "83.1"), ("res-basv2-3yr-upfront-001", "83.3"),
                                           ("res-basv2-legacy-2023", 100))] == [True] * 3


def test_gap_is_explained(bill):
    for row in derive.gap_explained(bill.where("x_SchemaEra = '1.2'")).collect():
        assert row["verdict"] == "PASS", row


def test_renames_and_sku_coverage(bill):
    names = {r["ResourceName"] for r in inventory.renamed_resources(bill).collect()}
    assert names == {"vm-web-01", "vm-web-prod-01"}
    used = {r["sku_key"]: r["row_count"] for r in derive.sku_key_coverage(
        bill.where("x_SchemaEra = '1.2'")).where("kind = 'standard'").collect()}
    assert len(used) == 13 and all(used.values())


def test_derived_invoice_lines(bill):
    lines = {r["InvoiceDetailId"]: r for r in derive.derive_invoice_detail(bill).collect()}
    first, second = lines["INV-2026-07-0001-001"], lines["INV-2026-07-0001-002"]
    assert close(first["BilledCost"], "0.24") and first["ReferenceInvoiceId"] == "INV-2026-07-0001"
    assert close(second["BilledCost"], "-1.85") and second["ReferenceInvoiceId"] == "INV-2026-06-0001"
    assert str(first["InvoiceIssueDate"]) == "2026-08-09" and str(first["PaymentDueDate"]) == "2026-09-08"
    assert second["InvoiceDetailDescription"] == "Usage correction to INV-2026-06-0001"
    assert first["InvoiceDetailGrain"] == '{"ChargeCategory":"Usage","ChargeClass":"None"}'


def test_amortised_commitment_closes(spark):
    rows = derive.amortise_commitment(fx.contracts(spark).where("ContractCommitmentCost < 100")).collect()
    assert len(rows) == 53
    assert sum(r["EffectiveCost"] for r in rows) == Decimal("74.40") == sum(r["BilledCost"] for r in rows)


def test_naive_total_mixes_currencies(bill):
    per_currency = {r["BillingCurrency"]: r["effective_cost"] for r in derive.currency_totals(bill).collect()}
    assert set(per_currency) == {"USD", "EUR"}
