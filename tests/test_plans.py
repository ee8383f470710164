"""Plan shapes that must hold whatever the data size."""

import re

import pytest

from ledgerloom.plans import catalogue

SF = "/root/testdata/sf0.001"
JOBS = catalogue.queries()


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture()
def no_broadcast(spark):
    """What the planner does once nothing is small enough to broadcast."""
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_cross_products_and_no_python(no_broadcast, name):
    text = plan(JOBS[name](no_broadcast, SF))
    assert "CartesianProduct" not in text
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text)
    # Nested loops are left only for one-row sides: aggregates without keys and limit-one probes.
    for block in re.findall(r"\n\(\d+\) BroadcastNestedLoopJoin.*?\n\n", text, re.S):
        assert "Join condition: None" in block, block


def test_date_window_reaches_the_scan(spark):
    text = plan(JOBS["savings_ladder"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.parametrize("name", ["reconciling_items", "completeness_tie_out", "scope_bridge", "out_of_scope_panel"])
def test_billing_window_reaches_the_scan(spark, name):
    filters = re.findall(r"PushedFilters: (.*l_shipdate.*)", plan(JOBS[name](spark, SF)))
    assert filters and all("GreaterThanOrEqual(l_shipdate,1999-06-01" in f and "LessThan(l_shipdate,1999-08-01" in f for f in filters)


@pytest.mark.parametrize("name, scans", [("xds_invoice", 2), ("xds_closure", 3), ("xds_correction", 5)])
def test_cross_checks_read_the_bill_once(spark, name, scans):
    """One scan of the bill; the others are companions, which the adapter derives from the same table, and their probes."""
    text = plan(JOBS[name](spark, SF))
    assert len(re.findall(r"Location: .*lineitem", text)) == scans


def test_leak_scan_reads_the_bill_once(spark, monkeypatch):
    """The bill's distinct values are found in one pass; the sweep, the identifiers and the names are read off them."""
    from ledgerloom.operators import sanitise

    passes, found = [], sanitise.column_values
    monkeypatch.setattr(sanitise, "column_values", lambda frame: passes.append(plan(frame)) or found(frame))
    text = plan(JOBS["leak_scan"](spark, SF))
    assert [len(re.findall(r"Location: .*lineitem", p)) for p in passes] == [1] and "lineitem" not in text


def test_only_needed_tables_and_columns_are_read(spark):
    text = plan(JOBS["granularity"](spark, SF))
    assert text.count("ReadSchema:") == 1
    schema_line = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "l_extendedprice" not in schema_line and "l_shipdate" in schema_line
    text = plan(JOBS["allocatable_split"](spark, SF))
    assert "part.parquet" not in text


@pytest.mark.parametrize("name", ["scan_bill", "empty_to_null"])
def test_wide_projections_are_compiled(no_broadcast, name):
    """The JVM compiles no method of more than 8000 bytes; the passes of a wide bill in one method had 21381."""
    spark, adaptive = no_broadcast, no_broadcast.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = JOBS[name](spark, SF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["check_nullability", "sanitise_report", "placeholder_scan", "check_empty_strings", "null_profile"])
def test_counts_over_a_wide_bill_are_compiled(no_broadcast, name):
    """With count_if, whose conditions are computed before the aggregate, the methods had up to 13179 bytes."""
    spark, adaptive = no_broadcast, no_broadcast.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = JOBS[name](spark, SF)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000 and "partial_count(if (NOT _common_expr_" not in text


def test_late_passes_hold_every_column_after_what_it_is_made_of():
    from ledgerloom.sources import bill_columns as rules

    done = set(rules.TABLE_OF)
    for step in rules.late_levels(rules.FULL_BILL):
        assert all(set(rules.DEPENDS[c]) <= done for c in step)
        done.update(step)
    assert set(rules.FULL_BILL) <= done
