"""A versioned rule table derived from the driver tables.

A column is a part, a tag is a year in which the part shipped, and the
sentences come from the line numbers it shipped under.  The table grows with
lineitem; every array in it is bounded (at most seven sentences, six values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.bill_adapter import table

BEFORE, AFTER = "v1998", "v1999"

# Sentence per line number, as SQL text both engines read.
SENTENCE = """CASE {n}
    WHEN 1 THEN concat(column_id, ' MUST NOT be null.')
    WHEN 2 THEN concat('[', column_id, '](#', column_id, ') MUST be of type *String*.')
    WHEN 3 THEN concat(column_id, '  SHOULD NOT be null when [Other](#other) is null')
    WHEN 4 THEN concat(column_id, ' MAY be null when the *charge* is free.')
    WHEN 5 THEN 'A charge of this kind is described by its column.'
    WHEN 6 THEN concat('Columns of ', dataset, ' MUST follow the naming convention..')
    ELSE 'The value is RECOMMENDED to be short' END"""

ATTRIBUTES = {
    "feature_level": "CASE level_code % 3 WHEN 0 THEN 'Mandatory' WHEN 1 THEN 'Conditional' ELSE 'Optional' END",
    "allows_nulls": "CASE WHEN top_flag = 'R' THEN 'False' ELSE 'True' END",
    "introduced": "CASE WHEN p_size % 4 = 0 THEN CAST(1995 + p_size % 3 AS STRING) ELSE '' END",
    "introduced_note": """CASE WHEN p_size % 10 = 3 THEN concat('Takes over from col_',
        CAST(p_partkey - 1 AS STRING), ' of the earlier list') ELSE '' END""",
}


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_linenumber").alias("level_code"), F.max("l_returnflag").alias("top_flag"),
             F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("allowed_values"),
             F.sort_array(F.collect_set("l_linenumber")).alias("numbers"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return (
        shipped.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .selectExpr("concat('v', CAST(year AS STRING)) AS tag", "CAST(year AS INT) AS tag_order",
                    "p_type AS dataset", "concat('col_', CAST(p_partkey AS STRING)) AS column_id",
                    "p_partkey", "p_size", "allowed_values", "numbers",
                    *[f"{rule} AS {name}" for name, rule in ATTRIBUTES.items()])
        .withColumn("requirements", F.expr(f"transform(numbers, n -> {SENTENCE.format(n='n')})"))
        .drop("numbers")
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check reads a column and its neighbour."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.select(
        F.concat(F.lit("chk_"), F.col("p_partkey").cast("string")).alias("check_id"),
        F.explode(F.array("p_partkey", F.col("p_partkey") + 1)).alias("n")).select(
        "check_id", F.concat(F.lit("col_"), F.col("n").cast("string")).alias("column_id"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check cites every sentence its column had before the move."""
    return rule_table(spark, sf_dir).where(F.col("tag") == BEFORE).select(
        F.concat(F.lit("chk_"), F.col("p_partkey").cast("string")).alias("check_id"), "dataset", "column_id",
        F.explode("requirements").alias("text"), (F.col("p_size") % 7 == 0).alias("derived"))


RULES_SQL = f"""
shipped AS (
  SELECT l_partkey, year(l_shipdate) AS year, sum(l_linenumber) AS level_code, max(l_returnflag) AS top_flag,
         list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS allowed_values,
         list_sort(list(DISTINCT l_linenumber)) AS numbers
  FROM lineitem GROUP BY ALL),
named AS (
  SELECT *, 'v' || year AS tag, year AS tag_order, p_type AS dataset, 'col_' || p_partkey AS column_id
  FROM shipped JOIN part ON l_partkey = p_partkey),
rules AS (
  SELECT tag, tag_order, dataset, column_id, p_partkey, p_size, allowed_values,
         {", ".join(f"{rule} AS {name}" for name, rule in ATTRIBUTES.items())},
         list_transform(numbers, lambda n: {SENTENCE.format(n="n")}) AS requirements
  FROM named)"""
