"""Checks of a companion dataset against a rule table: what its sentences ask of type, format, values, order and nulls.

The rules come from the table, not from code: a sentence is read by its form, and one of no known form is told as not
implemented.  Rules are few (some for each column), so they are collected and compiled; the rows are scanned once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import count_where
from ledgerloom.functions.profile import counts_by_column
from ledgerloom.operators.normalise import normalise_requirement

# --- fixed values: forms of requirement sentences, after links and emphasis are taken out -----------
FORMS = {
    "type": r"^{c} MUST be of type (.+)$",
    "format": r"^{c} MUST conform to (.+) requirements$",
    "notnull": r"^{c} MUST NOT be null$",
    "values": r"^{c} MUST be one of the allowed values$",
    "order": r"^{c} MUST be greater than or equal to (\w+)$",
}
# --- fixed values: how a date and time is written -----------------------------
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z$"
DECIMAL = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
PATTERNS = {("type", "Date/Time"): DATE_TIME, ("format", "DateTimeFormat"): DATE_TIME, ("type", "Decimal"): DECIMAL,
            ("format", "NumericFormat"): DECIMAL}
TEXTUAL = {("type", "String"), ("type", "JSON"), ("format", "StringHandling")}


@dataclass(frozen=True)
class CompanionRule:
    check_id: str
    column: str
    sentence: str
    broken: Column | None


def compile_rules(rules: DataFrame, dataset: str, tag: str, columns: list[str]) -> list[CompanionRule]:
    """The sentences of one dataset and version as conditions on its rows; None where the form or a column is unknown."""
    said = rules.where((F.col("dataset") == dataset) & (F.col("tag") == tag)).select(
        "column_id", "allowed_values", F.posexplode("requirements").alias("n", "text"))
    compiled = []
    for r in said.withColumn("sentence", normalise_requirement(F.col("text"))).orderBy("column_id", "n").collect():
        broken = None
        for kind, form in FORMS.items():
            match = re.match(form.format(c=re.escape(r.column_id)), r.sentence)
            if match and r.column_id in columns:
                broken = _condition(kind, r.column_id, match.group(1) if match.groups() else "", r.allowed_values, columns)
                compiled.append(CompanionRule(f"LC-{dataset}-{kind}-{r.column_id}", r.column_id, r.sentence, broken))
                break
        else:
            compiled.append(CompanionRule(f"LC-{dataset}-sentence{r.n + 1}-{r.column_id}", r.column_id, r.sentence, None))
    return compiled


def _condition(kind: str, column: str, what: str, allowed: list[str], columns: list[str]) -> Column | None:
    value = F.col(column)
    if kind == "notnull":
        return value.isNull()
    if kind == "values":
        return ~value.isin(allowed) if allowed else None
    if kind == "order":
        # Times written alike are in order as text.
        return value < F.col(what) if what in columns else None
    if (kind, what) in TEXTUAL:
        return value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    pattern = PATTERNS.get((kind, what))
    return None if pattern is None else ~value.rlike(pattern)


def companion_findings(frame: DataFrame, rules: DataFrame, dataset: str, tag: str) -> DataFrame:
    """check_id, column_id, sentence, rows, violations and outcome (PASS, FAIL or NOT IMPLEMENTED), in one scan."""
    compiled = compile_rules(rules, dataset, tag, frame.columns)
    judged = {c.check_id: count_where(c.broken) for c in compiled if c.broken is not None}
    spark = frame.sparkSession
    known = spark.createDataFrame([(c.check_id, c.column, c.sentence) for c in compiled], "check_id string, column_id string, sentence string")
    if not judged:
        counted = spark.createDataFrame([], "check_id string, violations bigint, total_rows bigint")
    else:
        counted = counts_by_column(frame, judged, "check_id", "violations", {"total_rows": F.count("*")})
    outcome = F.when(F.col("violations").isNull(), "NOT IMPLEMENTED").when(F.col("violations") > 0, "FAIL").otherwise("PASS")
    return known.join(counted, "check_id", "left").withColumn("outcome", outcome)
