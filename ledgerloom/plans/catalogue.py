"""Every registered query and its comparison SQL, gathered from the suites."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUITES = ["suite_finance", "suite_reconcile", "suite_normalise", "suite_checks", "suite_findings", "suite_sanitise", "suite_tokens"]


def for_display(frame: DataFrame) -> DataFrame:
    """Decimals become doubles only here, after rounding, at the comparison boundary."""
    decimals = [f.name for f in frame.schema.fields if f.dataType.typeName() == "decimal"]
    return frame.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else frame


def _shown(job):
    def run(spark, sf_dir):
        return for_display(job(spark, sf_dir))
    return run


def _gather(attribute: str) -> dict:
    found: dict = {}
    for suite in SUITES:
        found.update(getattr(import_module(f"ledgerloom.plans.{suite}"), attribute))
    return found


def queries() -> dict:
    return {name: _shown(job) for name, job in _gather("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
