"""The one-pass table of findings, the proof over planted faults, running numbers, and audits of files."""

import fixtures as fx
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.numbering import numbered
from ledgerloom.operators import checks as K
from ledgerloom.operators import derive, file_audit
from ledgerloom.operators import findings as V
from ledgerloom.operators.normalise import unify
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.bill_adapter import bill as adapted


def test_findings_agree_with_the_single_checks(spark):
    frame = fx.negative_layer(spark).withColumn("id", F.col("x_ExpectedViolation"))
    got = V.findings(frame.drop("x_ExpectedViolation", "x_ViolationDetail"), "id", raw_layer=True).cache()
    checks = K.row_checks(frame.drop("x_ExpectedViolation", "x_ViolationDetail", "id"), raw_layer=True)
    alone = K.violations(frame, checks, ["id"]).collect()
    on_rows = got.where("kind = 'violation' AND check_id NOT LIKE 'COMMIT%' AND check_id NOT LIKE 'PRESENCE%'").collect()
    assert sorted((r.check_id, r.subject, r.message) for r in on_rows) == sorted((r.check_id, r.id, r.message) for r in alone)
    held = {r.check_id: r.suppressed for r in K.summary(frame, checks).collect() if r.suppressed}
    assert {r.check_id: r.row_count for r in got.where("kind = 'suppressed'").collect()} == held


def test_repeated_keys_and_absent_columns(spark):
    bill = unify([fx.current_layer(spark), fx.legacy_layer(spark)])
    twice = bill.unionByName(bill).withColumn("id", F.lit("same")).drop("PricingUnit", "SkuMeter")
    checks = K.row_checks(twice)
    alone = sum(r.violations for r in K.summary(twice, checks).collect())
    got = V.findings(twice, "id")
    on_rows = got.where("kind = 'violation' AND subject = 'same'")
    assert on_rows.count() == alone
    absent = {r.subject for r in got.where("check_id = 'PRESENCE-mandatory'").collect()}
    assert absent == {r.x_SchemaEra for r in bill.select("x_SchemaEra").distinct().collect()}
    notes = {r.check_id for r in got.where("kind = 'note' AND row_count IS NULL").collect()}
    assert notes == set(K.skipped_checks(twice)) and notes
    split = {(r.check_id, r.subject) for r in got.where("check_id LIKE 'COMMIT%'").collect()}
    closure = {("COMMIT-closure", f"…{r.commitment} [{r.BillingCurrency}]") for r in K.commitment_closure(twice).collect()}
    assert {(c, s[-10:]) for c, s in split if c == "COMMIT-closure"} == {(c, s[-10:]) for c, s in closure}


def test_a_split_that_leaves_usage_unstated_is_found(spark):
    bill = unify([fx.current_layer(spark)])
    broken = bill.withColumn("CommitmentDiscountStatus", F.when(F.col("CommitmentDiscountStatus") != "Unused", F.col("CommitmentDiscountStatus")))
    assert bill.where("CommitmentDiscountStatus = 'Unused'").count() > 0
    broken = broken.withColumn("id", F.lit("r"))
    assert V.findings(broken, "id").where("check_id = 'COMMIT-split'").count() == K.commitment_split(broken).count() > 0


def test_the_table_is_scanned_once(spark):
    frame = adapted(spark, "/root/testdata/sf0.001", "x_ChargeId", *schema.STANDARD_COLUMNS, "x_SchemaEra")
    plan = V.findings(frame, "x_ChargeId")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 1


def test_planted_faults(spark):
    broken = fx.negative_layer(spark)
    expected = spark.createDataFrame([*fx.EXPECTED_CHECK.items(), ("never planted", "AV-")], "x_ExpectedViolation string, check_prefix string")
    got = {r.x_ExpectedViolation: r for r in V.planted_faults(broken, "x_ExpectedViolation", expected, raw_layer=True).collect()}
    assert len(got) == 15 and got["never planted"].verdict == "NOT PLANTED"
    assert all(r.verdict == "CAUGHT" and r.incidental == 0 for k, r in got.items() if k != "never planted")


def test_numbers_over_several_ranges(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(frame, ["b", "a"], "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(((r.b is not None, r.b or "", r.a) for r in frame.collect()))
    assert [(r.b is not None, r.b or "", r.a) for r in sorted(got, key=lambda r: r.n)] == want
    assert [r.n for r in sorted(got, key=lambda r: r.n)] == list(range(1, 5001))
    assert numbered(frame.where("a < 0"), ["a"], "n").collect() == []


def test_invoice_lines_of_any_id_and_currency_read_back(spark, tmp_path):
    bill = unify([fx.current_layer(spark)])
    named = bill.where("InvoiceId IS NOT NULL")
    odd = named.withColumn("InvoiceId", F.lit("facture no 7")).withColumn("BillingCurrency", F.lit("EUR"))
    lines = derive.derive_invoice_detail(named.unionByName(odd))
    rows = lines.collect()
    assert {r.BillingCurrency for r in rows} == {"USD", "EUR"} and lines.columns == [f.name for f in schema.INVOICE_DETAIL_SCHEMA.fields]
    corrections = {r.InvoiceId: r.ReferenceInvoiceId for r in rows if "correction" in r.InvoiceDetailDescription}
    assert corrections == {"INV-2026-07-0001": "INV-2026-06-0001", "facture no 7": None}
    stamps = "BillingPeriodStart BillingPeriodEnd InvoiceIssueDate PaymentDueDate InvoiceDetailCreated InvoiceDetailLastUpdated".split()
    sinks.write_companion(lines, str(tmp_path / "lines"), stamps)
    back = {r.InvoiceDetailId: r for r in readers.read_invoice_detail(spark, str(tmp_path / "lines")).collect()}
    assert len(back) == len(rows) and all(back[r.InvoiceDetailId].BilledCost == r.BilledCost for r in rows)
    assert {r.BillingPeriodStart for r in back.values()} == {"2026-07-01T00:00:00Z"}


def test_files_without_rows_are_audited(spark, tmp_path):
    full = spark.createDataFrame([("1.2", 1, None), ("1.0r2", 2, None)], "x_SchemaEra string, a int, b int").coalesce(1)
    other = spark.createDataFrame([(1.5,)], "z double").coalesce(1)
    for name, frame in (("one", full), ("none", full.where("a < 0")), ("other", other)):
        frame.write.parquet(str(tmp_path / "tables" / name))
    root = str(tmp_path / "tables")
    files, found = file_audit.listed_files(spark, root), file_audit.rows_by_file(spark, root)
    names = {r.file_path.split("/")[-2]: r.file_path.split("/")[-1] for r in files.collect()}
    assert set(names) == {"one", "none", "other"}
    stated = spark.createDataFrame([(names["one"], 2), (names["none"], 0), ("lost.parquet", 4)], "file_name string, rows_stated bigint")
    got = {r.file_name: (r.rows_found, r.verdict) for r in file_audit.file_audit(files, found, stated).collect()}
    assert got == {names["one"]: (2, "MATCH"), names["none"]: (0, "MATCH"), names["other"]: (1, "NOT STATED"), "lost.parquet": (None, "MISSING")}
    contents = file_audit.contents_by_file(spark.read.parquet(str(tmp_path / "tables" / "one"))).collect()
    assert [(r.eras, r.filled_columns) for r in contents] == [("1.0r2, 1.2", ["x_SchemaEra", "a"])]
