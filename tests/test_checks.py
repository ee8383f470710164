"""Conformance: every planted fault is named by its own check, clean rows are silent."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import checks as K
from ledgerloom.operators import crosschecks as X
from ledgerloom.operators import report
from ledgerloom.operators.conditions import columns_in, compile_condition
from ledgerloom.operators.normalise import unify


@pytest.fixture(scope="module")
def bill(spark):
    return unify([fx.current_layer(spark), fx.legacy_layer(spark)]).cache()


def findings(frame):
    return [(r["severity"], r["subject"], r["finding"], r["row_count"]) for r in frame.collect()]


def test_each_fault_is_caught_by_its_own_check(spark):
    broken = fx.negative_layer(spark)
    hits = K.violations(broken, K.row_checks(broken, raw_layer=True), ["x_ExpectedViolation"])
    expected = spark.createDataFrame(list(fx.EXPECTED_CHECK.items()), "x_ExpectedViolation string, check_prefix string")
    proof = K.proof(hits, expected).collect()
    assert len(proof) == 14
    assert [r["x_ExpectedViolation"] for r in proof if not r["caught"]] == []
    assert [r["x_ExpectedViolation"] for r in proof if r["incidental"]] == [], hits.collect()


@pytest.mark.parametrize("layer", ["current_layer", "legacy_layer"])
def test_clean_layers_have_no_hard_failures(spark, layer):
    frame = getattr(fx, layer)(spark)
    failing = K.summary(frame, K.row_checks(frame, raw_layer=True)).where(
        "severity = 'FAIL' AND violations > 0").collect()
    assert failing == []


def test_missing_columns_skip_a_check_instead_of_passing_it(spark):
    frame = fx.current_layer(spark).drop("SkuMeter")
    skipped = K.skipped_checks(frame)
    assert [s for s in skipped if s.startswith("NULL-SkuMeter")]
    assert not [c for c in K.row_checks(frame) if c.check_id.startswith("NULL-SkuMeter")]


def test_two_valued_conditions(spark):
    frame = spark.createDataFrame([(None,), ("",), ("A",)], "c string")
    cases = {
        ("eq", "c", "A"): [False, False, True],
        ("ne", "c", "A"): [True, True, False],
        ("not", ("eq", "c", "A")): [True, True, False],
        ("or", ("null", "c"), ("eq", "c", "A")): [True, True, True],
        ("and", ("not_null", "c"), ("ne", "c", "B")): [False, False, True],
    }
    for condition, expected in cases.items():
        got = [r[0] for r in frame.select(compile_condition(condition, True, {"c"})).collect()]
        assert got == expected, condition
    strict = [r[0] for r in frame.select(compile_condition(("null", "c"), False, {"c"})).collect()]
    assert strict == [True, False, False]
    assert columns_in(("and", ("eq", "a", "x"), ("not", ("null", "b")))) == ["a", "b"]


def test_placeholder_hits_are_suppressed_and_counted(spark):
    frame = fx.current_layer(spark).withColumn("CommitmentDiscountId", F.coalesce("CommitmentDiscountId", F.lit("")))
    rows = {r["check_id"]: r for r in K.summary(frame, K.nullability_checks(frame)).collect()}
    category = next(r for i, r in rows.items() if i.startswith("NULL-CommitmentDiscountCategory-notnull"))
    assert category["violations"] == 0
    empties = K.summary(frame, K.empty_string_checks(frame)).where("check_id LIKE '%-CommitmentDiscountId'").first()
    assert empties["severity"] == "FAIL" and empties["violations"] == 76 - 53 - 3


def test_era_gate(spark):
    frame = fx.legacy_layer(spark).withColumn("InvoiceId", F.lit(None).cast("string")).withColumn(
        "PricingCurrency", F.lit(None).cast("string"))
    rows = {r["check_id"]: r for r in K.summary(frame, K.nullability_checks(frame)).collect()}
    gated = rows["NULL-PricingCurrency-notnull1"]
    assert gated["violations"] == 0 and gated["rows_out_of_era"] == 10
    unlabelled = frame.withColumn("x_SchemaEra", F.lit(None).cast("string"))
    rows = {r["check_id"]: r for r in K.summary(unlabelled, K.nullability_checks(unlabelled)).collect()}
    assert rows["NULL-PricingCurrency-notnull1"]["violations"] == 10
    unknown = frame.withColumn("x_SchemaEra", F.lit("9.9"))
    rows = {r["check_id"]: r for r in K.summary(unknown, K.nullability_checks(unknown)).collect()}
    assert rows["NULL-ServiceName-notnull1"]["violations"] == 0


def test_split_reports_unstated_rows(spark):
    frame = fx.current_layer(spark).withColumn(
        "CommitmentDiscountStatus", F.when(F.col("ChargePeriodStart") != "2026-07-03", F.col("CommitmentDiscountStatus")))
    row, = K.commitment_split(frame).collect()
    assert row["severity"] == "FAIL" and row["unstated_rows"] == 1
    assert K.commitment_split(fx.current_layer(spark)).count() == 0


def test_closure_distinguishes_missing_purchase(spark, bill):
    rows = {r["commitment"]: r for r in K.commitment_closure(bill).collect()}
    legacy = next(r for k, r in rows.items() if "legacy" in k)
    assert legacy["finding"].startswith("no purchase row") and legacy["out_by"] is None
    assert not [k for k in rows if k.endswith("res-basv2-1yr-001")]


def test_real_layer_stand_in(spark):
    """118 rows with '' in both commitment name columns: 236 hard findings."""
    frame = spark.range(118).select(
        F.lit("").alias("CommitmentDiscountId"), F.lit("").alias("CommitmentDiscountName"),
        F.lit("1.0r2").alias("x_SchemaEra"), F.lit(" ").alias("x_Custom"))
    rows = K.summary(frame, K.empty_string_checks(frame)).groupBy("severity").agg(F.sum("violations")).collect()
    assert dict(rows) == {"FAIL": 236, "WARN": 118}


def test_presence_per_era(spark, bill):
    rows = K.presence(bill.drop("ServiceSubcategory", "ServiceName")).where("severity = 'FAIL'").collect()
    text = sorted(r["message"] for r in rows)
    assert len(text) == 2 and all("ServiceName" in t for t in text)  # the level of ServiceSubcategory is not Mandatory
    assert K.presence(bill).where("severity = 'FAIL'").count() == 0


# ---- cross-dataset: the clean run, then one mutation per check ----------------

def test_clean_cross_run(spark, bill):
    assert [f for f in findings(X.invoice_reconciliation(bill, fx.invoices(spark))) if f[0] == "FAIL"] == []
    assert findings(X.invoice_orphan(bill, fx.invoices(spark)))[0][0] == "INFO"
    assert findings(X.period_pairs(bill, fx.periods(spark)))[0][0] == "INFO"
    assert {f[0] for f in findings(X.correction_rules(bill, fx.invoices(spark), fx.periods(spark)))} == {"INFO"}
    assert [f for f in findings(X.eligibility(bill)) if f[0] == "FAIL"] == []
    closure = findings(X.commitment_term_closure(bill, fx.contracts(spark)))
    assert sorted(f[0] for f in closure) == ["INFO", "INFO", "INFO"]
    assert "holds" in next(f[2] for f in closure if f[1].endswith("1yr-001"))


def test_closure_never_adds_currencies(spark, bill):
    """The same commitment once more in another currency, at ten times the cost and with a contract of its own."""
    tenfold = {c: (F.col(c) * 10).cast(bill.schema[c].dataType) for c in ("EffectiveCost", "BilledCost")}
    other = bill.where("CommitmentDiscountId LIKE '%1yr-001'").withColumns(tenfold | {"BillingCurrency": F.lit("GBP")})
    agreed = fx.contracts(spark)
    dear = agreed.where("ContractCommitmentId LIKE '%1yr-001'").withColumns({
        "BillingCurrency": F.lit("GBP"), "ContractCommitmentCost": (F.col("ContractCommitmentCost") * 10).cast("decimal(18,2)")})
    closure = [f for f in findings(X.commitment_term_closure(bill.unionByName(other), agreed.unionByName(dear))) if f[1].endswith("1yr-001")]
    assert sorted(f[2] for f in closure) == [f"term fully covered and closure holds [{c}]" for c in ("GBP", "USD")]
    # A contract in one currency says nothing of the other.
    alone = [f for f in findings(X.commitment_term_closure(bill.unionByName(other), agreed)) if f[1].endswith("1yr-001")]
    assert sorted(f[2] for f in alone) == ["no contract record; term unknown [GBP]", "term fully covered and closure holds [USD]"]


def test_ghost_invoice(spark, bill):
    ghost = bill.withColumn("InvoiceId", F.when(F.col("InvoiceId").isNotNull(), F.lit("INV-GHOST")))
    severity, subject, _, count = findings(X.invoice_orphan(ghost, fx.invoices(spark)))[0]
    assert (severity, subject, count) == ("FAIL", "INV-GHOST", 2)
    assert "WARN" in {f[0] for f in findings(X.invoice_reconciliation(ghost, fx.invoices(spark)))}


def test_deleted_period(spark, bill):
    from datetime import date
    rows = findings(X.period_pairs(bill, fx.periods(spark, without=(date(2024, 3, 1),))))
    assert rows == [("FAIL", "2024-03-01..2024-04-01", "period has no row in billing_period", 10)]


def test_reopened_period(spark, bill):
    from datetime import date
    rows = findings(X.correction_rules(bill, fx.invoices(spark), fx.periods(spark, reopened=(date(2026, 6, 1),))))
    assert [r for r in rows if r[0] == "FAIL"] == [("FAIL", "2026-06-14", "restates a period that is Open", 1)]
    assert "WARN" in {f[0] for f in findings(X.billing_periods(bill, fx.periods(spark, reopened=(date(2026, 6, 1),))))}


def test_wiped_flag(spark, bill):
    wiped = bill.withColumn("x_CommitmentEligible", F.lit(None).cast("boolean"))
    assert findings(X.eligibility(wiped))[0][3] == 49


def test_missing_authority_is_not_a_pass(spark, bill):
    nothing = fx.periods(spark).limit(0)
    assert findings(X.period_pairs(bill, nothing)) == []
    assert findings(X.billing_periods(bill, nothing)) == []
    assert findings(X.correction_rules(bill, None, nothing)) == []
    assert findings(X.invoice_orphan(bill, fx.invoices(spark).limit(0))) == []
    assert findings(X.invoice_reconciliation(bill, fx.invoices(spark).limit(0))) == []
    assert findings(X.commitment_term_closure(bill, fx.contracts(spark).limit(0))) == []
    assert findings(X.correction_rules(bill, fx.invoices(spark).limit(0), None)) == []


def test_overlapping_periods(spark):
    from datetime import date
    frame = spark.createDataFrame(
        [(date(2026, 1, 1), date(2026, 2, 3), "Closed", "A"), (date(2026, 2, 1), date(2026, 3, 1), "Open", "A"),
         (date(2026, 2, 1), date(2026, 3, 1), "Open", "B")],
        "BillingPeriodStart date, BillingPeriodEnd date, BillingPeriodStatus string, InvoiceIssuerName string")
    row, = X.period_overlap(frame).collect()
    assert row["InvoiceIssuerName"] == "A" and str(row["next_start"]) == "2026-02-01"


def test_report_tables(spark, bill, tmp_path):
    tables = report.report_tables(bill, [X.eligibility(bill)])
    assert tables["refused"].count() == 18
    report.write_report({"inventory": tables["inventory"], "verdict": tables["verdict"]}, str(tmp_path))
    text = report.render(spark.read.parquet(str(tmp_path / "verdict")), "Verdict")
    assert text.startswith("## Verdict") and "FAIL" in text


def test_declared_schema_nullability(spark):
    declared = {f.name: f.nullable for f in schema.current_schema().fields}
    frame = fx.current_layer(spark)
    nulls = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in frame.columns]).first().asDict()
    assert [c for c, n in nulls.items() if n and not declared[c]] == []


def test_unresolved_column_suggests_a_name(bill):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN.WITH_SUGGESTION"):
        bill.select("EffectivCost").collect()


def test_price_times_quantity_is_exact(spark):
    from decimal import Decimal

    from ledgerloom.operators.checks import _product_is_off

    rows = [("0.0000000123", "10000000", "0.123", False), ("0.0000000123", "10000000", "0.124", True),
            ("3", "1000000000000000000", "3000000000000000000", False), ("-1.5", "2.5", "-3.75", False),
            ("-1.5", "2.5", "-3.750002", True), ("0.1", "0.1", "0.0100009", False)]
    frame = spark.createDataFrame([(*map(Decimal, r[:3]), r[3]) for r in rows],
                                  "p decimal(38,18), q decimal(38,18), c decimal(38,18), off boolean")
    assert all(r.off == r.found for r in frame.withColumn("found", _product_is_off("p", "q", "c")).collect())


def test_rows_clear_of_the_tolerance_never_reach_the_wide_product(spark):
    """10^25 does not fit the exact form's 38 digits, so a row that reached it would end the job."""
    from decimal import Decimal

    rows = [("1" + "0" * 25, "2", "3", True), ("2", "3", "6.000001", False),
            ("2", "3", "6.0000010000000001", True), ("2", None, "6", None)]
    frame = spark.createDataFrame([(*(v and Decimal(v) for v in r[:3]), r[3]) for r in rows],
                                  "p decimal(38,10), q decimal(38,10), c decimal(38,16), off boolean")
    found = frame.withColumn("found", K._product_is_off("p", "q", "c")).collect()
    assert [r.found for r in found] == [r.off for r in found]
