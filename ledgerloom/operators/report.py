"""The conformance report as tables, with a thin text rendering of the small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import checks, rulebook


def report_tables(bill: DataFrame, cross_findings: list[DataFrame], raw_layer: bool = False) -> dict[str, DataFrame]:
    """Verdict, inventory, findings, refused rules and cross-dataset findings."""
    spark = bill.sparkSession
    compiled = checks.row_checks(bill, raw_layer)
    inventory = checks.summary(bill, compiled)
    refused = spark.createDataFrame(
        [(r.column, r.sentence, r.reason) for r in rulebook.REFUSED], "column_id string, requirement string, reason string")
    tables = {
        "verdict": checks.verdict(inventory),
        "inventory": inventory,
        "findings": inventory.where(F.col("violations") > 0),
        "scope": checks.check_scope(bill, compiled),
        "refused": refused,
    }
    if cross_findings:
        merged = cross_findings[0]
        for more in cross_findings[1:]:
            merged = merged.unionByName(more)
        tables["cross"] = merged
    return tables


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def render(frame: DataFrame, title: str) -> str:
    """Markdown for a table whose length is the number of checks, never of rows."""
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    for row in frame.collect():
        lines.append("| " + " | ".join("" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"
