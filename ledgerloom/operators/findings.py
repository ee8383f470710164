"""All findings of a table in one pass: violations, hits held back, rows out of scope, group checks and skipped checks.

A row's entries are what its rules find, one entry for its era and one for its commitment.  Entries that only count are
alike in every column but the amounts, so they melt into a row each before the shuffle; what is left to shuffle is
violations and small groups.  Group rules and the notes on eras are read off the groups: the table is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.columns import usage
from ledgerloom.operators import checks, rulebook
from ledgerloom.operators.rulebook import FAIL, INFO, WARN

VIOLATION, SUPPRESSED, NOTE = "violation", "suppressed", "note"
_ERA, _COMMITMENT = "era", "commitment"
_AMOUNTS = ("used", "bought", "stated")
_COUNTS = ("usage_rows", "purchase_rows", "unstated_rows")
_MONEY = "decimal(38,18)"
_TEXTS = ("kind", "check_id", "severity", "subject", "part", "message")


def _entry(kind: str, **values: Column) -> Column:
    types = dict.fromkeys(_TEXTS, "string") | dict.fromkeys(_AMOUNTS, _MONEY) | dict.fromkeys(_COUNTS, "bigint")
    named = {"kind": F.lit(kind)} | values
    return F.struct(*[named.get(name, F.lit(None)).cast(as_type).alias(name) for name, as_type in types.items()])


def _rule_entries(found: list[checks.RowCheck], key: str) -> list[Column]:
    entries = []
    for c in found:
        told = {"check_id": F.lit(c.check_id), "severity": F.lit(c.severity)}
        entries.append(F.when(c.broken, _entry(VIOLATION, **told, subject=F.col(key), message=c.message)))
        if c.suppressed is not None:
            entries.append(F.when(c.suppressed, _entry(SUPPRESSED, **told)))
    return entries


def _commitment_entry() -> Column:
    settled = F.coalesce(F.col("CommitmentDiscountStatus").isin("Used", "Unused"), F.lit(False))
    bought = F.coalesce(F.col("ChargeCategory") == "Purchase", F.lit(False))
    used = F.coalesce(usage(), F.lit(False))
    return F.when(F.col("CommitmentDiscountId") != "", _entry(
        _COMMITMENT, subject=F.col("CommitmentDiscountId"), part=F.col("BillingCurrency"),
        used=F.when(used, F.col("EffectiveCost")), bought=F.when(bought, F.col("BilledCost")),
        stated=F.when(used & settled, F.col("EffectiveCost")), usage_rows=used.cast("long"),
        purchase_rows=bought.cast("long"), unstated_rows=(used & ~settled).cast("long")))


def _out(kind: str, check_id: Column, severity: Column, subject: Column, message: Column, n: Column) -> Column:
    texts = {"check_id": check_id, "severity": severity, "subject": subject, "message": message}
    return F.struct(F.lit(kind).alias("kind"), *[v.cast("string").alias(c) for c, v in texts.items()], n.cast("long").alias("row_count"))


def _of_eras(found: list[checks.RowCheck], columns: list[str]) -> Column:
    """For an era's row count: the checks that do not look at its rows, and the mandatory columns it lacks."""
    absent = checks.absent_mandatory(columns)
    told = F.lit(None)
    for era in schema.ERA_CEILING:
        out_of_scope = [c for c in found if c.era_gated and era not in schema.supported_eras(c.columns)]
        here = [_out(NOTE, F.lit(c.check_id), F.lit(INFO), F.lit(era), F.lit("rows out of the check's eras"), F.col("n")) for c in out_of_scope]
        here += [_out(VIOLATION, F.lit("PRESENCE-mandatory"), F.lit(FAIL), F.lit(era), F.lit(checks.absence_message(c, era)), F.lit(1))
                 for c in absent[era]]
        if here:
            told = F.when(F.col("subject") == era, F.array(*here)).otherwise(told)
    return told


def _of_commitments() -> Column:
    limit = F.lit(rulebook.PRODUCT_TOLERANCE).cast("decimal(7,6)")
    subject = F.concat_ws(" ", F.col("subject"), F.concat(F.lit("["), F.col("part"), F.lit("]")))
    used, bought, stated = (F.coalesce(F.col(a), F.lit(0).cast(_MONEY)) for a in _AMOUNTS)
    unbought = F.col("purchase_rows") == 0
    seen = (F.col("usage_rows") > 0) | (F.col("purchase_rows") > 0)
    closure = F.when(unbought, "no purchase row in this dataset; closure not evaluable").otherwise(
        "usage and purchase differ; the dataset may not span the term")
    split = F.lit("used and unused do not add up to usage")
    return F.array_compact(F.array(
        F.when(seen & (unbought | (F.abs(used - bought) > limit)), _out(VIOLATION, F.lit("COMMIT-closure"), F.lit(WARN), subject, closure, F.lit(1))),
        F.when((F.col("usage_rows") > 0) & (F.abs(used - stated) > limit), _out(VIOLATION, F.lit("COMMIT-split"), F.lit(FAIL), subject, split, F.lit(1)))))


def findings(frame: DataFrame, key: str, raw_layer: bool = False) -> DataFrame:
    """kind, check_id, severity, subject, message, row_count.

    violation: one row per broken rule and row of the table (subject: its key), era or commitment.  suppressed: hits of
    a rule that another check owns, counted.  note: rows out of a check's eras, and checks that could not run.
    """
    found = checks.row_checks(frame, raw_layer)
    with_groups = set(checks.COMMITMENT_COLUMNS) <= set(frame.columns)
    entries = [*_rule_entries(found, key), _entry(_ERA, subject=F.coalesce("x_SchemaEra", F.lit("none")))]
    if with_groups:
        entries.append(_commitment_entry())
    width = checks.FAMILY_WIDTH
    groups = [F.array_compact(F.array(*entries[i:i + width])) for i in range(0, len(entries), width)]
    sums = [F.sum(c).alias(c) for c in (*_AMOUNTS, *_COUNTS)]
    counted = frame.select(F.explode(F.concat(*groups)).alias("e")).select("e.*").groupBy(*_TEXTS).agg(F.count("*").alias("n"), *sums)
    told = [F.col(c) for c in ("check_id", "severity", "subject", "message")]
    # Rows that share key and message are a row each again.
    again = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda _: _out(VIOLATION, *told, F.lit(1)))
    out = (F.when(F.col("kind") == VIOLATION, again).when(F.col("kind") == SUPPRESSED, F.array(_out(SUPPRESSED, *told, F.col("n"))))
           .when(F.col("kind") == _ERA, _of_eras(found, frame.columns)))
    if with_groups:
        out = out.when(F.col("kind") == _COMMITMENT, _of_commitments())
    return counted.select(F.explode(out).alias("f")).select("f.*").unionByName(skipped(frame))


def skipped(frame: DataFrame) -> DataFrame:
    """Checks that need a column the table lacks: said, not passed."""
    rows = [(NOTE, check_id, INFO, None, "not run: a column it reads is absent", None) for check_id in checks.skipped_checks(frame)]
    return frame.sparkSession.createDataFrame(rows, "kind string, check_id string, severity string, subject string, message string, row_count bigint")


def planted_faults(frame: DataFrame, label: str, expectations: DataFrame, raw_layer: bool = False) -> DataFrame:
    """For each planted fault: its rows, those that the check meant for it names, and hits of other checks on them.

    expectations: (label, check_prefix).  Hits are counted by label and check before they meet the expectations.
    """
    marked = frame.where(F.col(label).isNotNull())
    found = checks.row_checks(marked, raw_layer)
    hits = [F.when(c.broken, F.lit(c.check_id)) for c in found] + [F.lit("")]  # the empty name counts the rows themselves
    counted = marked.select(label, F.explode(F.array_compact(F.array(*hits))).alias("check_id")).groupBy(label, "check_id").agg(F.count("*").alias("n"))
    itself = F.coalesce(F.col("check_id") == "", F.lit(False))
    named = F.coalesce(F.col("check_id").startswith(F.col("check_prefix")), F.lit(False))

    def counts(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0).cast("long"))

    return (
        expectations.join(counted, label, "left").groupBy(label, "check_prefix").agg(
            counts(itself).alias("planted"), counts(named).alias("caught"), counts(~named & ~itself).alias("incidental"))
        .withColumn("verdict", F.when(F.col("planted") == 0, "NOT PLANTED").when(F.col("caught") >= F.col("planted"), "CAUGHT").otherwise("MISSED"))
    )
