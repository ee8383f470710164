"""Versioned rule tables: severity, lifecycle and what changes between versions.

A rule table has one row per (tag, column) with its level, nullability, allowed
values, note and requirement sentences.  Tags carry an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.columns import count_where, rows
from ledgerloom.functions.profile import counts_by_column
from ledgerloom.functions.substrings import containing
from ledgerloom.operators.normalise import normalise_requirement

# --- fixed values: keywords by strength; capitals only --------------------------
KEYWORDS = [("FAIL", "MUST|SHALL|REQUIRED"), ("WARN", "SHOULD|RECOMMENDED"), ("INFO", "MAY|OPTIONAL")]


def severity_of(text: Column) -> Column:
    """The strongest keyword wins; a sentence without one has no severity."""
    first, *rest = [(level, text.rlike(rf"\b({words})\b")) for level, words in KEYWORDS]
    result = F.when(first[1], first[0])
    for level, hit in rest:
        result = result.when(hit, level)
    return result


def sentences(rules: DataFrame) -> DataFrame:
    """One row per requirement sentence with its severity."""
    return (
        rules.select("tag", "tag_order", "dataset", "column_id", "allows_nulls",
                     F.posexplode("requirements").alias("sentence_no", "text"))
        .withColumn("severity", severity_of(F.col("text")))
    )


def severity_counts(rules: DataFrame) -> DataFrame:
    return sentences(rules).groupBy("tag", "severity").agg(rows().alias("sentences"))


def feature_levels(rules: DataFrame) -> DataFrame:
    """Columns per level, and in all, for every tag."""
    counted = rules.groupBy("tag", F.coalesce("feature_level", F.lit("(none)")).alias("feature_level")).agg(
        rows().alias("columns"))
    return counted.withColumn("columns_in_tag", F.sum("columns").over(W.partitionBy("tag")))


def column_introduced(rules: DataFrame) -> DataFrame:
    """The version a column states at its first tag, else that tag's own."""
    return rules.groupBy("column_id").agg(
        F.min_by(F.coalesce(F.nullif("introduced", F.lit("")), F.regexp_replace("tag", "^v", "")),
                 "tag_order").alias("introduced"))


def column_removed(rules: DataFrame) -> DataFrame:
    """The first tag a present column is missing from.

    The ordered tags are a short list, so their ``lead`` is one small window;
    presence itself is an anti join on (column, next tag).
    """
    tags = rules.select("tag", "tag_order").distinct()
    following = tags.select(
        "tag", F.lead("tag").over(W.orderBy("tag_order")).alias("next_tag"),
        F.lead("tag_order").over(W.orderBy("tag_order")).alias("next_order"))
    present = rules.select("column_id", "tag").distinct()
    expected = present.join(following, "tag").where("next_tag IS NOT NULL").select(
        "column_id", F.col("next_tag").alias("tag"), "next_order")
    return (
        expected.join(present, ["column_id", "tag"], "left_anti")
        .groupBy("column_id").agg(F.min_by("tag", "next_order").alias("removed"))
    )


def column_successors(rules: DataFrame) -> DataFrame:
    """Columns whose note names a removed column."""
    gone = column_removed(rules).select(F.col("column_id").alias("removed_column"))
    notes = rules.where(F.col("introduced_note") != "").select("column_id", "introduced_note").distinct()
    return (
        containing(notes, "introduced_note", gone, "removed_column")
        .select("removed_column", F.col("column_id").alias("successor")).distinct()
    )


def spec_contradictions(rules: DataFrame) -> DataFrame:
    """Columns whose text forbids null while their table allows it."""
    pattern = F.concat(F.lit(r"\b\Q"), "column_id", F.lit(r"\E\b\s+MUST NOT be null\.?$"))
    return (
        sentences(rules).where(F.lower("allows_nulls") == "true").where(F.regexp_like("text", pattern))
        .select("tag", "column_id").distinct()
    )


def lifecycle_crosscheck(stated: DataFrame, derived: DataFrame) -> DataFrame:
    """Two column -> version maps: how many agree, differ, or are on one side."""
    left = stated.select("column_id", F.col("introduced").alias("stated"))
    right = derived.select("column_id", F.col("introduced").alias("found"))
    outcome = (F.when(F.col("found").isNull(), "missing from tags").when(F.col("stated").isNull(), "not stated")
               .when(F.col("stated") == F.col("found"), "agree").otherwise("mismatch"))
    return left.join(right, "column_id", "full_outer").groupBy(outcome.alias("outcome")).agg(rows().alias("columns"))


def _normalised(requirements: str) -> Column:
    """The normative sentences, normalised, as a set."""
    normative = F.filter(requirements, lambda t: severity_of(t).isNotNull())
    return F.array_distinct(F.transform(normative, normalise_requirement))


def snapshot_diff(rules: DataFrame, before: str, after: str) -> DataFrame:
    """What changed per column between two tags."""
    def side(tag, suffix):
        return rules.where(F.col("tag") == tag).select(
            "column_id", F.lit(True).alias(f"in{suffix}"), F.col("feature_level").alias(f"level{suffix}"),
            F.col("allows_nulls").alias(f"nulls{suffix}"), F.col("allowed_values").alias(f"values{suffix}"),
            _normalised("requirements").alias(f"rules{suffix}"))

    def changed(a, b):
        return F.when(~F.col(a).eqNullSafe(F.col(b)), F.concat_ws(" -> ", F.coalesce(a, F.lit("null")),
                                                                 F.coalesce(b, F.lit("null"))))

    def extra(a, b):
        return F.size(F.array_except(b, a)).cast("long")

    both = side(before, "_a").join(side(after, "_b"), "column_id", "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("common")
    common = F.col("status") == "common"
    return (
        both.withColumn("status", status)
        .select("column_id", "status",
                F.when(common, changed("level_a", "level_b")).alias("feature_level"),
                F.when(common, changed("nulls_a", "nulls_b")).alias("allows_nulls"),
                F.when(common, extra("values_a", "values_b")).alias("values_added"),
                F.when(common, extra("values_b", "values_a")).alias("values_removed"),
                F.when(common, extra("rules_a", "rules_b")).alias("rules_added"),
                F.when(common, extra("rules_b", "rules_a")).alias("rules_removed"))
        .where(~common | F.col("feature_level").isNotNull() | F.col("allows_nulls").isNotNull()
               | (F.expr("values_added + values_removed + rules_added + rules_removed") > 0))
    )


def upgrade_impact(checks: DataFrame, citations: DataFrame, rules: DataFrame, before: str,
                   after: str) -> DataFrame:
    """Which checks do not survive a version move, worst reason first.

    ``checks`` has one row per (check_id, column_id) read; ``citations`` one per
    (check_id, column_id, text, derived) cited.
    """
    old = rules.where(F.col("tag") == before).select("column_id", F.col("allows_nulls").alias("nulls_before"))
    new = rules.where(F.col("tag") == after).select(
        "column_id", F.col("allows_nulls").alias("nulls_after"), F.lit(True).alias("kept"))
    said = rules.where(F.col("tag") == after).select(
        "column_id", F.explode(_normalised("requirements")).alias("sentence"), F.lit(True).alias("said")).distinct()
    gone = (
        checks.join(old, "column_id").join(new, "column_id", "left_anti")
        .select("check_id", F.lit(0).alias("rank"))
    )
    cited = citations.withColumn("sentence", normalise_requirement(F.col("text")))
    judged = cited.join(new, "column_id", "left").join(said, ["column_id", "sentence"], "left").join(
        old, "column_id", "left")
    restated = judged.where(~F.col("derived") & F.col("kept") & F.col("said").isNull()).select(
        "check_id", F.lit(1).alias("rank"))
    relaxed = judged.where((F.col("nulls_before") == "False") & (F.col("nulls_after") == "True")).select(
        "check_id", F.lit(2).alias("rank"))
    names = F.create_map(F.lit(0), F.lit("GONE"), F.lit(1), F.lit("RESTATED"), F.lit(2), F.lit("RELAXED"))
    return (
        gone.unionByName(restated).unionByName(relaxed).groupBy("check_id").agg(F.min("rank").alias("rank"))
        .select("check_id", names[F.col("rank")].alias("impact"))
    )


def duplicate_citations(citations: DataFrame) -> DataFrame:
    """Sentences of one dataset that more than one check implements."""
    sentence = normalise_requirement(F.col("text"))
    return (
        citations.select("dataset", sentence.alias("sentence"), "check_id").distinct()
        .groupBy("dataset", "sentence").agg(rows().alias("checks"), F.min("check_id").alias("first_check"))
        .where("checks > 1")
    )


def uncited_checks(checks: DataFrame, citations: DataFrame) -> DataFrame:
    """Checks that cite no sentence, or a blank one only, which a registry does not admit; and how many columns each reads."""
    cited = citations.where(F.trim("text") != "").select("check_id").distinct()
    return checks.groupBy("check_id").agg(F.count_distinct("column_id").alias("columns_read")).join(cited, "check_id", "left_anti")


#: Fixed value: the wording that makes a sentence a null rule.
NULL_RULE = r"\b(MUST|SHOULD) (NOT )?be null\b"


def stated_null_rules(rules: DataFrame, citations: DataFrame, tag: str) -> DataFrame:
    """Every null rule a snapshot states, once a column, and whether a check cites it in the same normalised words."""
    stated = (
        rules.where(F.col("tag") == tag).select("column_id", F.explode("requirements").alias("text"))
        .select("column_id", normalise_requirement(F.col("text")).alias("sentence"))
        .where(F.col("sentence").rlike(NULL_RULE)).distinct()
    )
    cited = citations.select("column_id", normalise_requirement(F.col("text")).alias("sentence"),
                             F.lit(True).alias("implemented")).distinct()
    return stated.join(cited, ["column_id", "sentence"], "left").withColumn(
        "implemented", F.coalesce("implemented", F.lit(False)))


def service_pairs(bill: DataFrame, pairs: dict[str, list[str]]) -> DataFrame:
    """The (category, subcategory) pairs in use, marked as permitted or not."""
    listed = [f"{c}|{s}" for c, subs in pairs.items() for s in subs]
    return (
        bill.where("ServiceSubcategory <> ''").groupBy("ServiceCategory", "ServiceSubcategory")
        .agg(rows().alias("row_count"))
        .withColumn("permitted", F.coalesce(
            F.concat("ServiceCategory", F.lit("|"), "ServiceSubcategory").isin(*listed), F.lit(False)))
    )


def export_schema_diff(older: DataFrame, newer: DataFrame, fallbacks: dict[str, str]) -> DataFrame:
    """Columns two exports populate: added, dropped, or promoted from an x_ name."""
    def populated(frame, alias):
        return counts_by_column(frame, {c: F.count(F.col(c)) for c in frame.columns}, "column_name", alias)

    promoted_from = F.create_map(*[F.lit(x) for pair in fallbacks.items() for x in pair])
    both = populated(older, "older").join(populated(newer, "newer"), "column_name", "full_outer")
    old_rows, new_rows = F.coalesce("older", F.lit(0)), F.coalesce("newer", F.lit(0))
    source = F.element_at(promoted_from, F.col("column_name"))
    had = both.where(old_rows > 0).select(F.col("column_name").alias("source"))
    return (
        both.withColumn("source", source).join(had.withColumn("had_source", F.lit(True)), "source", "left")
        .select("column_name", old_rows.alias("older_values"), new_rows.alias("newer_values"),
                F.when((old_rows > 0) & (new_rows > 0), "kept")
                .when((new_rows > 0) & F.col("had_source"), "promoted")
                .when(new_rows > 0, "added").when(old_rows > 0, "dropped").otherwise("unused").alias("status"))
    )


def rule_coverage(rules: DataFrame) -> DataFrame:
    """Stated rules by outcome: implemented, refused, partly implemented."""
    return rules.groupBy("column_id").agg(
        rows().alias("stated"), count_where(F.col("implemented")).alias("implemented"),
        count_where(~F.col("implemented")).alias("refused"))
