"""Snapshots of the specification as a rule table, and companion rows judged by its sentences."""

import json

import pytest

from ledgerloom.operators import snapshots as S
from ledgerloom.operators.companions import companion_findings
from ledgerloom.sources.snapshots import read_lifecycle, read_snapshots

LINK = "[{0}](#datasets.x.{0})"


def record(column, tag, sentences, **more):
    return {"column_id": column, "tag": tag, "dataset": "billing_period", "feature_level": "Mandatory", "allows_nulls": "False",
            "introduced": "", "introduced_note": "", "allowed_values": [],
            "requirements": [{"text": f"{column} {s}", "severity": "FAIL", "indent": 0} for s in sentences]} | more


TIMES = ["MUST be of type Date/Time.", "MUST conform to [DateTimeFormat](#attributes.date/timeformat) requirements.", "MUST NOT be null."]
NEWER = {
    "BillingPeriodCreated": record("BillingPeriodCreated", "v1.4", TIMES),
    "BillingPeriodLastUpdated": record("BillingPeriodLastUpdated", "v1.4", [
        *TIMES, "MUST be greater than or equal to [BillingPeriodCreated](#datasets.x.y).", "MUST represent the last change."]),
    "BillingPeriodStatus": record("BillingPeriodStatus", "v1.4", ["MUST be of type String.", "MUST be one of the allowed values."],
                                  allowed_values=["Open", "Closed"], introduced="1.4", introduced_note="In place of PeriodState"),
}
OLDER = {"PeriodState": record("PeriodState", "v1.3", ["MUST NOT be null."]),
         "BillingPeriodCreated": record("BillingPeriodCreated", "v1.3", TIMES[:1], feature_level="Conditional", allows_nulls="True")}
GOOD = ("2026-06-01T00:00:00Z", "2026-07-09T02:00:00Z", "Closed")


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("spec")
    for name, content in (("a", NEWER), ("b", OLDER)):
        (folder / f"{name}.json").write_text(json.dumps(content, indent=2))
    (folder / "c.json").write_text("not json")
    return read_snapshots(spark, str(folder)).cache()


def test_snapshots_are_a_rule_table(spark, rules):
    assert {(r.tag, r.column_id) for r in rules.collect()} == {("v1.4", c) for c in NEWER} | {("v1.3", c) for c in OLDER}
    assert [r.tag for r in rules.select("tag", "tag_order").distinct().orderBy("tag_order").collect()] == ["v1.3", "v1.4"]
    assert {r.column_id: r.removed for r in S.column_removed(rules).collect()} == {"PeriodState": "v1.4"}
    assert {(r.removed_column, r.successor) for r in S.column_successors(rules).collect()} == {("PeriodState", "BillingPeriodStatus")}
    changed = {r.column_id: r for r in S.snapshot_diff(rules, "v1.3", "v1.4").collect()}
    assert changed["BillingPeriodCreated"].feature_level == "Conditional -> Mandatory" and changed["BillingPeriodCreated"].rules_added == 2
    assert changed["PeriodState"].status == "removed" and changed["BillingPeriodStatus"].status == "added"
    assert {r.severity: r.sentences for r in S.severity_counts(rules).where("tag = 'v1.4'").collect()}["FAIL"] == 10


def judged(spark, rules, *rows):
    frame = spark.createDataFrame(list(rows), "BillingPeriodCreated string, BillingPeriodLastUpdated string, BillingPeriodStatus string")
    return {r.check_id.removeprefix("LC-billing_period-"): r for r in companion_findings(frame, rules, "billing_period", "v1.4").collect()}


def test_rows_pass_and_fail_by_the_sentences(spark, rules):
    good = judged(spark, rules, GOOD)
    assert {r.outcome for k, r in good.items() if not k.startswith("sentence")} == {"PASS"}
    assert [k for k, r in good.items() if r.outcome == "NOT IMPLEMENTED"] == ["sentence5-BillingPeriodLastUpdated"]
    bad = judged(spark, rules, GOOD, ("2026-06-31", "2026-06-01T00:00:00Z", "Ajar"), ("2026-06-02T00:00:00Z", "2026-06-01T00:00:00Z", None),
                 (None, "2026-13-01T00:00:00Z", "Open"))
    assert {k: r.violations for k, r in bad.items() if r.violations} == {
        "type-BillingPeriodCreated": 1, "format-BillingPeriodCreated": 1, "notnull-BillingPeriodCreated": 1, "type-BillingPeriodLastUpdated": 1,
        "format-BillingPeriodLastUpdated": 1, "order-BillingPeriodLastUpdated": 2, "values-BillingPeriodStatus": 1}
    assert {r.total_rows for r in bad.values() if r.violations is not None} == {4}


def test_no_rows_and_no_rules(spark, rules):
    assert {r.violations for r in judged(spark, rules).values()} <= {0, None}
    frame = spark.createDataFrame([("x",)], "Other string")
    assert {r.outcome for r in companion_findings(frame, rules, "billing_period", "v1.4").collect()} == {"NOT IMPLEMENTED"}
    assert companion_findings(frame, rules, "another", "v1.4").collect() == []


def test_lifecycle(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"introduced": {"A": "1.0", "B": "1.2"}, "removed": {"A": "1.4"}, "columns": {}}))
    assert {(r.column_id, r.introduced, r.removed) for r in read_lifecycle(spark, str(tmp_path / "l.json")).collect()} == {
        ("A", "1.0", "1.4"), ("B", "1.2", None)}


def test_checks_without_a_citation_and_rules_without_a_check(spark):
    checks = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("d", "y")], "check_id string, column_id string")
    cited = spark.createDataFrame([("a", "x", "x  MUST NOT be null."), ("b", "x", "  "), ("c", "x", None)],
                                  "check_id string, column_id string, text string")
    assert sorted(map(tuple, S.uncited_checks(checks, cited).collect())) == [("b", 1), ("c", 1), ("d", 1)]
    rules = spark.createDataFrame([
        ("v2", "x", ["x MUST NOT be null", "x MUST NOT be null.", "x SHOULD be null when [y](#y) is null", "x MAY be null"]),
        ("v2", "y", ["y MUST be text"]), ("v2", "z", None), ("v1", "y", ["y MUST be null"])],
        "tag string, column_id string, requirements array<string>")
    stated = S.stated_null_rules(rules, cited, "v2")
    assert sorted(map(tuple, stated.collect())) == [("x", "x MUST NOT be null", True), ("x", "x SHOULD be null when y is null", False)]
    assert [tuple(r) for r in S.rule_coverage(stated).collect()] == [("x", 2, 1, 1)]
    assert S.uncited_checks(checks, cited.limit(0)).count() == 4
