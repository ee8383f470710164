"""Sanitising and rule-table questions, with comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.operators import sanitise as Z
from ledgerloom.operators import snapshots as S
from ledgerloom.operators.normalise import SPACE
from ledgerloom.plans.oracle_base import over_bill
from ledgerloom.sources import bill_adapter as A
from ledgerloom.sources import bill_columns
from ledgerloom.sources import rule_adapter as R

NAMES = ["BillingAccountName", "x_BillingAccountName", "x_CustomerName"]
IDS = ["BillingAccountId", "SubAccountId", "x_InvoiceSectionId"]
SWEPT = bill_columns.TEXT_COLUMNS
SPARED = ("x_InvoiceSectionId", "x_BillingAccountName")
EXPORT = [c for c in bill_columns.FULL_BILL if c != "x_SchemaEra"]


def _pseudonymise(spark, sf_dir):
    return Z.with_guids_replaced(A.bill(spark, sf_dir, "x_ChargeId", *IDS), IDS)


def _codes(spark, sf_dir):
    codes = ["x_BillingProfileCode", "x_InvoiceSectionId"]
    return Z.with_codes_replaced(A.bill(spark, sf_dir, "x_ChargeId", *codes), codes)


def _leaks(spark, sf_dir):
    original = Z.column_values(A.bill(spark, sf_dir, *SWEPT))
    return Z.leak_scan(original, Z.sanitise(original, spare=SPARED))


def _shapes(spark, sf_dir):
    """Whole texts of documents, pages and conversations, and the ids on the bill."""
    def texts(frame, column, origin):
        return frame.select(F.lit(origin).alias("origin"), F.col(column).alias("text"))

    every = (
        texts(A.table(spark, sf_dir, "documents"), "text", "documents")
        .unionByName(texts(A.table(spark, sf_dir, "pages"), "html", "pages"))
        .unionByName(texts(A.table(spark, sf_dir, "conversations"), "text", "conversations"))
        .unionByName(texts(A.bill(spark, sf_dir, "BillingAccountId"), "BillingAccountId", "bill"))
    )
    return Z.identifier_shapes(every, "text", ["origin"])


def _rules(job, *args):
    return lambda spark, sf: job(R.rule_table(spark, sf), *args)


def _crosscheck(spark, sf_dir):
    rules = R.rule_table(spark, sf_dir)
    stated = A.table(spark, sf_dir, "part").where("p_size % 3 <> 1").select(
        F.concat(F.lit("col_"), F.col("p_partkey").cast("string")).alias("column_id"),
        (F.lit(1995) + F.col("p_size") % 3).cast("string").alias("introduced"))
    return S.lifecycle_crosscheck(stated, S.column_introduced(rules))


def _export_diff(spark, sf_dir):
    bill = A.bill(spark, sf_dir, "x_SchemaEra", *EXPORT)
    return S.export_schema_diff(bill.where("x_SchemaEra = '1.0r2'").select(*EXPORT),
                                bill.where("x_SchemaEra = '1.2'").select(*EXPORT), schema.FALLBACK_COLUMNS)


QUERIES = {
    "mask_names": lambda spark, sf: Z.mask_names(A.bill(spark, sf, "x_ChargeId", *NAMES)),
    "pseudonymise": _pseudonymise,
    "pseudonymise_codes": _codes,
    "sanitise_report": lambda spark, sf: Z.sanitise_report(A.bill(spark, sf, *SWEPT)),
    "leak_scan": _leaks,
    "identifier_shapes": _shapes,
    "requirement_severity": lambda spark, sf: S.sentences(R.rule_table(spark, sf)).select(
        "tag", "column_id", F.col("sentence_no").cast("long").alias("sentence_no"), "text", "severity"),
    "severity_counts": _rules(S.severity_counts),
    "feature_levels": _rules(S.feature_levels),
    "column_introduced": _rules(S.column_introduced),
    "column_removed": _rules(S.column_removed),
    "column_successors": _rules(S.column_successors),
    "spec_contradictions": _rules(S.spec_contradictions),
    "snapshot_diff": _rules(S.snapshot_diff, R.BEFORE, R.AFTER),
    "upgrade_impact": lambda spark, sf: S.upgrade_impact(
        R.checks(spark, sf), R.citations(spark, sf), R.rule_table(spark, sf), R.BEFORE, R.AFTER),
    "duplicate_citations": lambda spark, sf: S.duplicate_citations(R.citations(spark, sf)),
    "uncited_checks": lambda spark, sf: S.uncited_checks(R.checks(spark, sf), R.citations(spark, sf)),
    "stated_rule_coverage": lambda spark, sf: S.rule_coverage(
        S.stated_null_rules(R.rule_table(spark, sf), R.citations(spark, sf), R.AFTER)),
    "lifecycle_crosscheck": _crosscheck,
    "export_schema_diff": _export_diff,
    "service_pairs": lambda spark, sf: S.service_pairs(
        A.bill(spark, sf, "ServiceCategory", "ServiceSubcategory"), schema.SERVICE_PAIRS),
}

# ---- comparison SQL ---------------------------------------------------------

_GUID, _CODE = Z.GUID, Z.BILLING_CODE
_SALT = Z.DEFAULT_SALT


def _sliced(digest: str, sizes) -> str:
    at, parts = 1, []
    for size in sizes:
        parts.append(f"substr({digest}, {at}, {size})")
        at += size
    return " || '-' || ".join(parts)


def _swap(value: str, pattern: str, sizes, upper: bool) -> str:
    digest = f"sha256('{_SALT}' || t)"
    digest = f"upper({digest})" if upper else digest
    return (f"list_reduce(list_concat([{value}], list_distinct(regexp_extract_all({value}, '{pattern}'))), "
            f"lambda acc, t: replace(acc, t, {_sliced(digest, sizes)}))")


def _guids(value: str) -> str:
    return _swap(value, _GUID, (8, 4, 4, 4, 12), False)


def _codes_sql(value: str) -> str:
    return _swap(value, _CODE, (4, 4, 3, 3), True)


_MASK = {"BillingAccountName": "Portfolio Sandbox Account", "x_BillingAccountName": "Portfolio Sandbox Account",
         "x_CustomerName": "Portfolio Sandbox Customer"}


def _cleaned(column: str) -> str:
    if column in SPARED:
        return column
    if column in _MASK:
        return f"CASE WHEN {column} IS NOT NULL THEN '{_MASK[column]}' END"
    return _codes_sql(_guids(column))


_BEFORE_VALUES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM bill WHERE {c} <> ''" for c in SWEPT)
_AFTER_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, value, count(*) AS n FROM (SELECT {_cleaned(c)} AS value FROM bill) WHERE value <> '' GROUP BY value"
    for c in SWEPT)
def _any_script(pattern: str) -> str:
    """The comparison engine's own classes know ASCII alone."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_").replace(r"[^\s", "[^" + SPACE[1:-2])


_SHAPE_SQL = " UNION ALL ".join(
    "SELECT origin, '{name}' AS shape, unnest(regexp_extract_all(text, '{pattern}')) AS token FROM texts".format(
        name=name, pattern=_any_script(pattern).replace("'", "''")) for name, pattern in Z.SHAPES.items())
_PUBLISHED = Z.PUBLISHED


def _over_rules(body: str, ctes: str = "") -> str:
    return "WITH " + R.RULES_SQL + ("," + ctes if ctes else "") + "\n" + body


def _normal(text: str) -> str:
    return (f"regexp_replace(trim(regexp_replace(replace(regexp_replace({text}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '*', ''), "
            f"'{SPACE}', ' ', 'g')), '\\.+$', '')")


_NORMATIVE = "regexp_matches(s, '\\b(MUST|SHALL|REQUIRED|SHOULD|RECOMMENDED|MAY|OPTIONAL)\\b')"
_SET = (f"list_distinct(list_transform(list_filter(requirements, lambda s: {_NORMATIVE}), lambda s: {_normal('s')}))")
_SEVERITY = """CASE WHEN regexp_matches(text, '\\b(MUST|SHALL|REQUIRED)\\b') THEN 'FAIL'
    WHEN regexp_matches(text, '\\b(SHOULD|RECOMMENDED)\\b') THEN 'WARN'
    WHEN regexp_matches(text, '\\b(MAY|OPTIONAL)\\b') THEN 'INFO' END"""
_SENTENCES = f"""
sentence AS (SELECT *, {_SEVERITY} AS severity FROM (
  SELECT tag, dataset, column_id, allows_nulls, unnest(requirements) AS text,
         CAST(generate_subscripts(requirements, 1) - 1 AS BIGINT) AS sentence_no FROM rules))"""
_INTRODUCED = """
first_seen AS (SELECT column_id, arg_min(CASE WHEN introduced <> '' THEN introduced ELSE substr(tag, 2) END, tag_order) AS introduced
               FROM rules GROUP BY column_id)"""
_REMOVED = """
tags AS (SELECT tag, lead(tag) OVER (ORDER BY tag_order) AS next_tag FROM (SELECT DISTINCT tag, tag_order FROM rules)),
gone AS (SELECT column_id, min(next_tag) AS removed FROM rules r JOIN tags USING (tag)
         WHERE next_tag IS NOT NULL AND NOT EXISTS (FROM rules x WHERE x.column_id = r.column_id AND x.tag = next_tag)
         GROUP BY column_id)"""
_CITED = f"""
cited AS (SELECT 'chk_' || p_partkey AS check_id, dataset, column_id, unnest(requirements) AS text, p_size % 7 = 0 AS derived
          FROM rules WHERE tag = '{R.BEFORE}')"""
_EXPORT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) FILTER (WHERE x_SchemaEra = '1.0r2') AS o, "
    f"count({c}) FILTER (WHERE x_SchemaEra = '1.2') AS n, "
    + (f"count({schema.FALLBACK_COLUMNS[c]}) FILTER (WHERE x_SchemaEra = '1.0r2')" if c in schema.FALLBACK_COLUMNS else "0")
    + " AS x FROM bill" for c in EXPORT)

ORACLE = {
    "mask_names": over_bill("SELECT x_ChargeId, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE '{m}' END AS {c}" for c, m in _MASK.items()) + " FROM bill"),
    "pseudonymise": over_bill("SELECT x_ChargeId, " + ", ".join(f"{_guids(c)} AS {c}" for c in IDS) + " FROM bill"),
    "pseudonymise_codes": over_bill("SELECT x_ChargeId, " + ", ".join(
        f"{_codes_sql(c)} AS {c}" for c in ("x_BillingProfileCode", "x_InvoiceSectionId")) + " FROM bill"),
    "sanitise_report": over_bill("SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, " + (f"count({c})" if c in _MASK else
        f"count_if(regexp_matches({c}, '{_GUID}') OR regexp_matches({c}, '{_CODE}'))")
        + f" AS values_changed, '{'name' if c in _MASK else 'identifier'}' AS kind FROM bill" for c in SWEPT)
        + ") WHERE values_changed > 0"),
    "leak_scan": over_bill(f"""
        SELECT column_name, count(*) AS leaking_values, CAST(sum(n) AS BIGINT) AS leaking_rows FROM published a
        WHERE EXISTS (FROM needles WHERE contains(a.value, needle)) GROUP BY ALL""",
        ctes=f"""original AS (SELECT DISTINCT * FROM ({_BEFORE_VALUES})), published AS ({_AFTER_VALUES}),
        needles AS (SELECT DISTINCT unnest(regexp_extract_all(value, '{_GUID}')) AS needle FROM original UNION
                    SELECT DISTINCT unnest(regexp_extract_all(value, '{_CODE}')) FROM original UNION
                    SELECT value FROM original WHERE column_name IN ('BillingAccountName', 'x_BillingAccountName', 'x_CustomerName'))"""),
    "identifier_shapes": over_bill(f"""
        SELECT origin, shape, count(DISTINCT token) AS distinct_tokens, count(*) AS matches FROM ({_SHAPE_SQL})
        WHERE NOT regexp_matches(token, '{_PUBLISHED}') AND NOT contains(token, '{{') GROUP BY ALL""",
        ctes="""texts AS (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'pages', html FROM pages
                UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'bill', BillingAccountId FROM bill)"""),
    "requirement_severity": _over_rules("SELECT tag, column_id, sentence_no, text, severity FROM sentence", _SENTENCES),
    "severity_counts": _over_rules("SELECT tag, severity, count(*) AS sentences FROM sentence GROUP BY ALL", _SENTENCES),
    "feature_levels": _over_rules("""
        SELECT tag, feature_level, count(*) AS columns, any_value(t) AS columns_in_tag
        FROM rules JOIN (SELECT tag, count(*) AS t FROM rules GROUP BY tag) USING (tag) GROUP BY tag, feature_level"""),
    "column_introduced": _over_rules("SELECT * FROM first_seen", _INTRODUCED),
    "column_removed": _over_rules("SELECT * FROM gone", _REMOVED),
    "column_successors": _over_rules("""
        SELECT DISTINCT g.column_id AS removed_column, r.column_id AS successor FROM gone g
        JOIN (SELECT DISTINCT column_id, introduced_note FROM rules WHERE introduced_note <> '') r
          ON contains(r.introduced_note, g.column_id)""", _REMOVED),
    "spec_contradictions": _over_rules("""
        SELECT DISTINCT tag, column_id FROM sentence WHERE allows_nulls = 'True'
          AND regexp_matches(text, '\\b' || column_id || '\\b\\s+MUST NOT be null\\.?$')""", _SENTENCES),
    "snapshot_diff": _over_rules(f"""
        SELECT * FROM (
          SELECT column_id, CASE WHEN a.requirements IS NULL THEN 'added' WHEN b.requirements IS NULL THEN 'removed' ELSE 'common' END AS status,
                 CASE WHEN a.feature_level <> b.feature_level THEN a.feature_level || ' -> ' || b.feature_level END AS feature_level,
                 CASE WHEN a.allows_nulls <> b.allows_nulls THEN a.allows_nulls || ' -> ' || b.allows_nulls END AS allows_nulls,
                 CASE WHEN a.tag = '{R.BEFORE}' AND b.tag = '{R.AFTER}' THEN len(list_filter(b.allowed_values, lambda v: NOT list_contains(a.allowed_values, v))) END AS values_added,
                 CASE WHEN a.tag = '{R.BEFORE}' AND b.tag = '{R.AFTER}' THEN len(list_filter(a.allowed_values, lambda v: NOT list_contains(b.allowed_values, v))) END AS values_removed,
                 CASE WHEN a.tag = '{R.BEFORE}' AND b.tag = '{R.AFTER}' THEN len(list_filter(b.said, lambda v: NOT list_contains(a.said, v))) END AS rules_added,
                 CASE WHEN a.tag = '{R.BEFORE}' AND b.tag = '{R.AFTER}' THEN len(list_filter(a.said, lambda v: NOT list_contains(b.said, v))) END AS rules_removed
          FROM (SELECT *, {_SET} AS said FROM rules WHERE tag = '{R.BEFORE}') a
          FULL JOIN (SELECT *, {_SET} AS said FROM rules WHERE tag = '{R.AFTER}') b USING (column_id))
        WHERE status <> 'common' OR feature_level IS NOT NULL OR allows_nulls IS NOT NULL
           OR values_added + values_removed + rules_added + rules_removed > 0"""),
    "upgrade_impact": _over_rules(f"""
        SELECT check_id, CASE min(rank) WHEN 0 THEN 'GONE' WHEN 1 THEN 'RESTATED' ELSE 'RELAXED' END AS impact FROM (
          SELECT check_id, 0 AS rank FROM reads WHERE column_id IN (SELECT column_id FROM rules WHERE tag = '{R.BEFORE}')
                 AND column_id NOT IN (SELECT column_id FROM rules WHERE tag = '{R.AFTER}')
          UNION ALL
          SELECT check_id, 1 FROM cited c JOIN after_tag n USING (column_id) WHERE NOT c.derived AND NOT list_contains(n.said, {_normal('c.text')})
          UNION ALL
          SELECT check_id, 2 FROM cited c JOIN after_tag n USING (column_id) JOIN rules o ON o.column_id = c.column_id AND o.tag = '{R.BEFORE}'
          WHERE o.allows_nulls = 'False' AND n.allows_nulls = 'True') GROUP BY check_id""", _CITED + f""",
        reads AS (SELECT 'chk_' || p_partkey AS check_id, 'col_' || (p_partkey + o) AS column_id FROM part, (VALUES (0), (1)) v(o)),
        after_tag AS (SELECT *, {_SET} AS said FROM rules WHERE tag = '{R.AFTER}')"""),
    "duplicate_citations": _over_rules(f"""
        SELECT dataset, sentence, count(DISTINCT check_id) AS checks, min(check_id) AS first_check
        FROM (SELECT dataset, check_id, {_normal('text')} AS sentence FROM cited) GROUP BY dataset, sentence
        HAVING count(DISTINCT check_id) > 1""", _CITED),
    "uncited_checks": _over_rules("""
        SELECT check_id, count(DISTINCT n) AS columns_read
        FROM (SELECT 'chk_' || p_partkey AS check_id, unnest([p_partkey, p_partkey + 1]) AS n FROM part)
        WHERE check_id NOT IN (SELECT check_id FROM cited) GROUP BY check_id""", _CITED),
    "stated_rule_coverage": _over_rules(f"""
        SELECT column_id, count(*) AS stated, count(said) AS implemented, count(*) - count(said) AS refused
        FROM (SELECT DISTINCT column_id, {_normal('s')} AS sentence
              FROM (SELECT column_id, unnest(requirements) AS s FROM rules WHERE tag = '{R.AFTER}'))
        LEFT JOIN (SELECT DISTINCT column_id, {_normal('text')} AS sentence, 1 AS said FROM cited) USING (column_id, sentence)
        WHERE regexp_matches(sentence, '\\b(MUST|SHOULD) (NOT )?be null\\b') GROUP BY column_id""", _CITED),
    "lifecycle_crosscheck": _over_rules("""
        SELECT CASE WHEN f.column_id IS NULL THEN 'missing from tags' WHEN s.column_id IS NULL THEN 'not stated'
                    WHEN s.introduced = f.introduced THEN 'agree' ELSE 'mismatch' END AS outcome, count(*) AS columns
        FROM first_seen f FULL JOIN (SELECT 'col_' || p_partkey AS column_id, CAST(1995 + p_size % 3 AS VARCHAR) AS introduced
             FROM part WHERE p_size % 3 <> 1) s ON f.column_id = s.column_id GROUP BY ALL""", _INTRODUCED),
    "export_schema_diff": over_bill(f"""
        SELECT column_name, o AS older_values, n AS newer_values, CASE WHEN o > 0 AND n > 0 THEN 'kept' WHEN n > 0 AND x > 0 THEN 'promoted'
               WHEN n > 0 THEN 'added' WHEN o > 0 THEN 'dropped' ELSE 'unused' END AS status FROM ({_EXPORT_SQL})"""),
    "service_pairs": over_bill(f"""
        SELECT ServiceCategory, ServiceSubcategory, count(*) AS row_count,
               coalesce((ServiceCategory, ServiceSubcategory) IN ({", ".join(
                   f"('{c}', '{s}')" for c, subs in schema.SERVICE_PAIRS.items() for s in subs)}), false) AS permitted
        FROM bill WHERE ServiceSubcategory <> '' GROUP BY ALL"""),
}
